"""Document quality by a linear-chain conditional random field over lines.

Every line that holds a word is a place of a chain with two states, bad (0) and
good (1).  Its features describe the line (length, shares of symbols, capitals,
shouts, bars and digits, word length, whether an earlier line equals it, how it
ends) and the lines before and after it.  The field is fitted by gradient
ascent on a bounded sample of labelled documents whose lines carry their
document's label.  Forward-backward gives each line's marginal probability of
being good; their mean, weighted by line length, and the share of the worst
lines go through a logistic curve fitted on the same sample, so that the score
reads as the probability of label 1.

The sample takes ``DOCS`` documents of each label, by a hash of the id, of the
folds that are not held out, with all their lines (of rows that share an id,
the least text).  Scoring takes every line of every text.  Text is the only
input.  Ids may be of any type that casts to text and back.

Nulls: a null or wordless text has no line; its score is what the curve gives
to a chain of one empty line.  Without labels of both kinds every score is the
share of label 1 (0.5 if there is none).  A null id is not held out and never
learned from.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.llm.sampling import held_out, sample_ids
from terratile.llm.text import give_back
from terratile.llm.token_files import slices

DOCS, ROUNDS = 1500, 150
OWN = 10
SIDES = [1, 2, 3, 4, 7]  # features of the line before and after that a line also sees
WIDTH = 1 + OWN + 2 * len(SIDES)

_KINDS = np.zeros((5, 256), bool)  # letters and beyond ASCII, capitals, symbols, digits, blanks
_KINDS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS[1, 65:91] = True
_KINDS[2, list(b"#*$%&<>@^~=_\\{}[]")] = True
_KINDS[3, 48:58] = True
_KINDS[4, list(b" \t\r\x0b\x0c")] = True


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of all lines, lengths of lines, lines of each text)."""
    lines, counts, repeats = [], [], []
    for t in texts:
        mine = [x for x in (t or "").encode().split(b"\n") if x.strip()] or [b""]
        seen: set[bytes] = set()
        for x in mine:
            repeats.append(x in seen)
            seen.add(x)
        lines += mine
        counts.append(len(mine))
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(size + 1) - size - 1

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int32), starts)

    alpha, upper, odd, digit, blank = (total(k[data]) for k in _KINDS)
    gap = _KINDS[4][data]
    words = total(~gap & (data != 10) & np.concatenate([[True], gap[:-1] | (data[:-1] == 10)]))
    shout, bar = total(data == 33), total(data == 124)
    w, n = np.maximum(words, 1), np.maximum(size, 1)
    mean = (size - blank) / w
    last = np.array([x[-1:] in b".!?:;\"" and bool(x) for x in lines])
    own = np.stack(
        [
            np.log1p(words) / 4, np.minimum(odd / w, 3), upper / np.maximum(alpha, 1), np.minimum(shout / w, 2), np.minimum(bar / w, 2),
            np.minimum(digit / n * 5, 2), np.clip(mean - 6, -4, 8) / 4, np.array(repeats, float), last.astype(float), (words < 4).astype(float),
        ],
        axis=1,
    )
    return own, n, np.array(counts, np.int64)


def chain_features(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A constant, the line's own features, and some of the lines before and after it."""
    before, after = np.zeros((len(own), len(SIDES))), np.zeros((len(own), len(SIDES)))
    before[1:], after[:-1] = own[:-1, SIDES], own[1:, SIDES]
    ends = np.cumsum(counts)
    before[ends - counts], after[ends - 1] = 0, 0
    return np.hstack([np.ones((len(own), 1)), own, before, after])


def marginals(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(state) of each line, expected moves [2, 2] of each chain, log of each chain's total weight).

    ``scores``: [line, state], ``moves``: [from, to].  All chains are stepped at
    once, longest first, so a step touches only chains that are still running.
    """
    order = np.argsort(-counts, kind="stable")
    length, first = counts[order], (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), "right")
    node, move = np.exp(scores - scores.max(1, keepdims=True)), np.exp(moves)
    ahead, scale = np.empty_like(node), np.empty(len(node))
    for t, n in enumerate(active):
        at = first[:n] + t
        a = node[at] if t == 0 else node[at] * (ahead[at - 1] @ move)
        scale[at] = a.sum(1)
        ahead[at] = a / scale[at][:, None]
    back = np.ones_like(node)
    pairs = np.zeros((len(counts), 2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        right = node[at] * back[at] / scale[at][:, None]
        back[at - 1] = right @ move.T
        pairs[order[: active[t]]] += ahead[at - 1][:, :, None] * move[None] * right[:, None, :]
    starts = np.cumsum(counts) - counts
    weight = np.add.reduceat(np.log(scale) + scores.max(1), starts) if len(counts) else np.zeros(0)
    return ahead * back, pairs, weight


class Field:
    """The fitted weights: lines to states, moves between states, and the curve to a score."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, curve: np.ndarray, constant: float | None = None):
        self.weights, self.moves, self.curve, self.constant = weights, moves, curve, constant

    def document(self, own: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the curve sees of each text: log-odds of the weighted mean marginal, and of its worst lines."""
        good = marginals(chain_features(own, counts) @ self.weights, self.moves, counts)[0][:, 1]
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)
        bad = np.add.reduceat((good < 0.5) * size, starts) / np.add.reduceat(size, starts)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(counts)), np.log(mean / (1 - mean)), bad], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.document(*line_features(texts)) @ self.curve, -30, 30)))


def fit(own: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """The field of a sample of texts with labels 0 and 1."""
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(3), float(labels.mean()) if len(labels) else 0.5)
    x, y = chain_features(own, counts), np.repeat(labels, counts)
    each = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / counts  # classes and texts weigh alike
    line = np.repeat(each, counts)
    theta, mean, square = np.zeros(2 * WIDTH + 4), np.zeros(2 * WIDTH + 4), np.zeros(2 * WIDTH + 4)
    target = np.eye(2)[y]
    inside = np.ones(len(y), bool)
    inside[np.cumsum(counts) - counts] = False
    to = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), line[to])
    for k in range(1, rounds + 1):
        w, m = theta[: 2 * WIDTH].reshape(WIDTH, 2), theta[2 * WIDTH :].reshape(2, 2)
        prob, pairs, _ = marginals(x @ w, m, counts)
        up = np.concatenate([(x.T @ (line[:, None] * (target - prob))).ravel(), (seen - (each[:, None, None] * pairs).sum(0)).ravel()]) - 1e-3 * theta
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up**2
        theta = theta + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    field = Field(theta[: 2 * WIDTH].reshape(WIDTH, 2), theta[2 * WIDTH :].reshape(2, 2), np.zeros(3))
    z, curve = field.document(own, size, counts), np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression, classes weighed alike
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        each = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
        slope = z.T @ (each * (labels - p)) - curve
        bend = (z * (each * p * (1 - p))[:, None]).T @ z + np.eye(3)
        curve = curve + np.linalg.solve(bend, slope)
    field.curve = curve
    return field


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = DOCS) -> Field:
    """The field fitted on a bounded sample of ``docs`` with ``labels`` (doc_id, quality)."""
    chosen = sample_ids(labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)"), per_label)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own, size, counts = line_features(rows["text"].tolist())
            ends = np.cumsum(counts)
            own, size = (np.split(x, ends[:-1]) for x in (own, size.astype(np.int64)))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "own": [x.tobytes() for x in own], "size": [x.tobytes() for x in size]})

    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * per_label rows at most
    picked = picked.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    rows = picked.mapInPandas(features, "doc_id string, label int, own binary, size binary").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    if not rows:
        return fit(np.zeros((0, OWN)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    own = np.frombuffer(b"".join(r.own for r in rows)).reshape(-1, OWN)
    size = np.frombuffer(b"".join(r.size for r in rows), np.int64)
    return fit(own, size, np.array([len(r.size) // 8 for r in rows]), np.array([r.label for r in rows]))


def scored(docs: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """``docs`` with one column more, the score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        sizes = texts.str.len().fillna(0).to_numpy(np.int64)
        parts = [shared.value.score(texts.iloc[a:b].tolist()) for a, b in slices(sizes, 1 << 21)]
        give_back()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    rows = scored(docs.select("doc_id", "text"), fit_on(docs, labels))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_predicted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` predicted good, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return scored(whole, fit_on(docs, labels), "_score").where(F.col("_score") >= threshold).select("_row.*")
