"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are learned from as such; everything else is
unlabelled text, toxic or not.  A text is seen as the set of its words (runs of
letters, lower-cased) and of their first 4, 5 and 6 letters.  Of these, up to
``FEATURES`` that stand in so many more of the toxic than of the unlabelled
sample that chance among all of them would hardly do it (a Poisson likelihood
ratio of twice the logarithm of their number; the ``FEW`` best in any case)
become inputs of linear classifiers written in numpy.

With g the margin, l the logistic loss and pi the share of toxic texts, the
risk of calling all unlabelled text clean counts its toxic part wrongly.  It is
corrected by the positives: pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]).
Where the second part of a batch turns negative, which only overfitting can do,
the step climbs it instead (Kiryo et al., 2017).  pi is not given: a classifier
fitted on one half of the samples ranks the other half, and pi is the least
share of unlabelled to positive texts above a score, at the score where that
bound with its sampling error is smallest (Garg et al., 2021).  The score is pi
times the density of positive over that of unlabelled texts at the margin, a
rising step curve fitted on margins that a member trained on the other half
gives, and joined by straight lines.

The samples are bounded: ``POSITIVES`` toxic ids and ``UNLABELLED`` ids of all
documents, by a hash of the id, of folds that are not held out (of rows that
share an id, the least text); an id labelled both ways counts as toxic.  All
other labels stay unread.  Scoring takes whole texts of all rows.  Text is the
only input.

Nulls: a null text is empty; a text without known features has the score of the
constant.  Without a toxic example every score is 0.  A null id is not held out
and never learned from.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.llm.sampling import held_out, sample_ids
from terratile.llm.text import give_back
from terratile.storage import stage_table

POSITIVES, UNLABELLED = 2000, 8000
FEATURES, FEW, LEAST_TEXTS = 1024, 16, 2
FOLDS, OUT = 3, 1
PREFIXES = (4, 5, 6)
WORDS = 1_000_000  # words whose features a worker remembers
STEPS, RATE, DECAY = 300, 0.05, 1e-3
_WORD = re.compile(r"[^\W\d_]+")
_LONG = 1 << 20


def words(text: str | None) -> set[str]:
    """The distinct words of a text."""
    low = (text or "").lower()
    return set(_WORD.findall(low)) if len(low) <= _LONG else {m[0] for m in _WORD.finditer(low)}


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


def text_features(text: str | None) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


class Toxicity:
    """Weights of the features, a constant, and the curve (margins, scores) from margin to score."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float, curve: tuple[np.ndarray, np.ndarray], prior: float):
        self.at = {f: i for i, f in enumerate(features)}
        self.weights, self.bias, self.curve, self.prior = weights.tolist(), bias, curve, prior
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def columns(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known = self._known
        for w in words(text):
            cols = known.get(w)
            if cols is None:
                if len(known) >= WORDS:
                    known.clear()
                cols = known[w] = tuple(self.at[f] for f in word_features(w) if f in self.at)
            if cols:
                found.update(cols)
        return found

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = np.array([self.bias + sum(self.weights[c] for c in sorted(self.columns(t))) for t in texts], float)
        return np.interp(margin, *self.curve)


def fit_member(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """A linear classifier (weights, constant last) by the non-negative risk, over rows of 0/1 features of toxic (p) and unlabelled (u) texts."""
    p, u = p.astype(np.float32), u.astype(np.float32)
    d = p.shape[1]
    theta, mean, square = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    for k in range(1, steps + 1):
        gp, gu = p @ theta[:d] + theta[d], u @ theta[:d] + theta[d]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # slopes of the losses along the margins
        rise_p, rise_u = -prior * sp / len(sp), su / len(su)
        if clean >= 0:
            rise_p = rise_p + prior * (sp - 1) / len(sp)
        else:
            rise_p, rise_u = -rise_p, -rise_u
        down = np.append(p.T @ rise_p.astype(np.float32) + u.T @ rise_u.astype(np.float32), rise_p.sum() + rise_u.sum())
        down[:d] += DECAY * theta[:d]
        mean, square = 0.9 * mean + 0.1 * down, 0.99 * square + 0.01 * down**2
        theta = theta - RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return theta


def class_prior(p: np.ndarray, u: np.ndarray, risk: float = 0.1) -> float:
    """The share of toxic texts among the unlabelled, from margins of texts that the classifier did not see."""
    cuts = np.unique(p)[::-1]
    over_p = 1 - np.searchsorted(np.sort(p), cuts, "left") / len(p)
    over_u = 1 - np.searchsorted(np.sort(u), cuts, "left") / len(u)
    error = np.sqrt(np.log(4 / risk) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((over_u + error) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 1 / (len(u) + 2), 0.9))


def density_curve(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(margins, scores): ``prior`` times the rising density ratio of the two samples, at most 1."""
    at = np.unique(np.concatenate([p, u]))
    n_p = np.bincount(np.searchsorted(at, p), minlength=len(at)) * (prior / len(p))
    n_u = np.bincount(np.searchsorted(at, u), minlength=len(at)) / len(u)
    blocks: list[list[float]] = []  # mass of toxic, of all, first and last margin; neighbours that fall are pooled
    for x, a, b in zip(at.tolist(), n_p.tolist(), n_u.tolist(), strict=True):
        blocks.append([a, b, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a1, b1, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a1, blocks[-1][1] + b1, blocks[-1][2], last]
    ends = np.array([b[2:] for b in blocks]).ravel()
    share = np.repeat([min(1.0, b[0] / b[1]) if b[1] else 1.0 for b in blocks], 2)
    floor = 1 / (1 + np.exp(-np.clip(ends, -30, 30)))  # keeps the order of margins within a step
    return ends, np.clip(0.999 * share + 0.001 * floor, 0, 1)


def fit(features: list[str], p: np.ndarray, u: np.ndarray) -> Toxicity:
    """The classifiers of two samples of texts given as rows of 0/1 features."""
    if len(p) < 2 or len(u) < 2 or not features:
        constant = 0.0 if not len(p) else 1 / (len(u) + 2)
        return Toxicity([], np.zeros(0), 0.0, (np.zeros(1), np.full(1, constant)), constant)
    margin = lambda x, theta: x @ theta[:-1] + theta[-1]
    halves = ((slice(0, None, 2), slice(1, None, 2)), (slice(1, None, 2), slice(0, None, 2)))
    first = fit_member(p[::2], u[::2], 0.1)
    prior = class_prior(margin(p[1::2], first), margin(u[1::2], first))
    members = [fit_member(p[a], u[a], prior) for a, _ in halves]
    unseen_p = np.concatenate([margin(p[b], m) for (_, b), m in zip(halves, members, strict=True)])
    unseen_u = np.concatenate([margin(u[b], m) for (_, b), m in zip(halves, members, strict=True)])
    theta = np.mean(members, axis=0)
    return Toxicity(features, theta[:-1], float(theta[-1]), density_curve(unseen_p, unseen_u, prior), prior)


def fit_on(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Toxicity:
    """The classifiers fitted on bounded samples of ``docs`` and of toxic ids in ``labels`` (doc_id, toxic)."""
    toxic = sample_ids(labels.where("toxic = 1").select("doc_id", F.lit(1).alias("label")), positives, FOLDS, OUT)
    others = sample_ids(docs.select("doc_id", F.lit(0).alias("label")), unlabelled, FOLDS, OUT)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(toxic.union(others)), "doc_id")
    rows = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "label").agg(F.min("text").alias("text"))
    sample = stage_table(rows, "toxicity_sample")  # positives + unlabelled rows at most
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = (Counter(), Counter())
            for label, text in zip(part["label"], part["text"], strict=True):
                found[label].update(text_features(text))
            names = list(found[0] | found[1])
            yield pd.DataFrame({"feature": names, "p": [found[1][f] for f in names], "u": [found[0][f] for f in names]})

    counts = sample.mapInPandas(counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    staged = stage_table(counts.where(F.col("p") >= LEAST_TEXTS), "toxicity_features")
    chance = (F.col("u") + 1) * (n_p / (n_u + 1))
    ratio = 2 * (F.col("p") * F.log(F.col("p") / chance) - (F.col("p") - chance))
    best = staged.where(F.col("p") > chance).withColumn("ratio", ratio).orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect()
    least = 2 * math.log(max(staged.count(), 2))
    features = [r.feature for i, r in enumerate(best) if i < FEW or r.ratio >= least]
    at = Toxicity(features, np.zeros(0), 0.0, (np.zeros(1), np.zeros(1)), 0.0)

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            cols = [np.array(sorted(at.columns(t)), np.int32).tobytes() for t in part["text"]]
            yield part[["doc_id", "label"]].assign(cols=cols)

    seen = sorted(sample.mapInPandas(columns, "doc_id string, label int, cols binary").collect(), key=lambda r: (r.label, r.doc_id))
    x = np.zeros((len(seen), len(features)), np.uint8)
    for i, r in enumerate(seen):
        x[i, np.frombuffer(r.cols, np.int32)] = 1
    return fit(features, x[n_u:], x[:n_u])


def scored(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """``docs`` with one column more, the score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = pd.Series(shared.value.score(texts.tolist()))
        give_back()
        return found

    return docs.withColumn(name, score("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    rows = scored(docs.select("doc_id", "text"), fit_on(docs, labels))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, OUT).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return scored(whole, fit_on(docs, labels), "_score").where(F.col("_score") < threshold).select("_row.*")
