"""Quality rules combined by weak supervision.

Each rule looks at counts of one text and votes good (1), bad (-1) or abstains
(0).  The votes of all documents are counted by pattern; there are at most
3 ** rules patterns, so the counts are small whatever the corpus.
Expectation-maximisation over the counts estimates, for each rule, how often it
votes either way on good and on bad texts (votes taken as independent given the
class, abstentions as missing), and gives each pattern a posterior probability
of being good.  A text is kept if it passes the two base limits and its
posterior is at least ``keep_at``.

Nulls: a null text has no words, so it fails the base limits, as do texts of
under ten words.  Repeated rows and rows without an id are judged one by one.
An empty table gives an empty result.  Other columns are passed through; the
columns this operator adds replace any of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratile.llm.text import give_back

WINDOW = 5
LONG = 1 << 20  # bytes of a text from which its words are hashed, not held
SPACE = b" \t\n\x0b\x0c\r"
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_shouts", "n_bars"]
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + MORE])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    twice = np.flatnonzero(np.bincount(number)[number] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _space_cut(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end before white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        to = gap.start() if gap else len(data)
        yield data[at:to]
        at = to


def long_repeat_words(data: bytes) -> tuple[int, int]:
    """(words, ``repeat_words``) of a long text, by 64-bit hashes of its words and windows held as arrays."""
    words = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, part.split()), np.uint64) for part in _space_cut(data, LONG)])
    n = len(words) - WINDOW + 1
    if n < 2:
        return len(words), 0
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = (window ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n][twice] += 1
    edge[WINDOW:][twice] -= 1
    return len(words), int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS and MORE for one text."""
    text = text or ""
    data = text.encode()
    if len(data) > LONG:
        n_words, repeats = long_repeat_words(data)
    else:
        words = data.split()
        n_words, repeats = len(words), repeat_words(words)
    bare = data.translate(None, SPACE)
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    lower = bare.lower()
    letters = len(lower) - len(lower.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        n_words,
        len(text) - (len(data) - len(bare)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        letters,
        data.count(b"!"),
        data.count(b"|"),
    )


@F.pandas_udf(_SCHEMA)
def _counts(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([counts(t) for t in texts], columns=COUNTS + MORE, dtype="int64")
    give_back()
    return found


def _vote(value: Column, good: float, bad: float) -> Column:
    """Good up to ``good``, bad over ``bad``, abstaining between."""
    return F.when(value <= good, 1).when(value > bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule; per_word is by word, per_line by line, others as named."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length = F.col("word_chars") / words
    return {
        "repeats": _vote(F.col("n_repeat_words") / words, 0.05, 0.2),
        "symbols": _vote(F.col("n_symbols") / words, 0.05, 0.3),
        "lines": _vote(F.col("n_dup_lines") / lines, 0.1, 0.3),
        "capitals": _vote(F.col("n_upper") / F.greatest("n_letters", F.lit(1)), 0.15, 0.4),
        "shouts": _vote(F.col("n_shouts") / words, 0.02, 0.2),
        "bars": _vote(F.col("n_bars") / words, 0.01, 0.15),
        "length": F.when(F.col("n_words") >= 20, 1).when(F.col("n_words") < 10, -1).otherwise(0),
        "word_length": F.when(length.between(3, 10), 1).when(~length.between(2, 14), -1).otherwise(0),
    }


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good by pattern, accuracy by rule).

    ``patterns``: distinct rows of votes, ``weights``: documents of each.  Good
    and bad texts each have, for every rule, a probability of each of the three
    votes.  A first guess, that a text with a bad vote is likely bad, starts the
    rounds; each rate carries a prior of a few made-up documents, so a rule that
    hardly ever votes neither decides nor divides by zero.
    """
    kinds = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    post = np.where((patterns < 0).any(1), 0.1, 0.95)
    prior = np.array([[[0.2, 2.0, 3.0]], [[2.0, 2.0, 0.5]]])  # of good texts, of bad texts
    for _ in range(rounds):
        on = np.stack([weights * post, weights * (1 - post)])
        rates = np.einsum("cp,prv->crv", on, kinds) + prior
        logs = np.log(rates / rates.sum(2, keepdims=True))
        share = (on.sum(1) + [9, 1]) / (weights.sum() + 10)
        each = np.log(share)[:, None] + np.einsum("crv,prv->cp", logs, kinds)
        new = 1 / (1 + np.exp(np.clip(each[1] - each[0], -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    agree = weights * post @ kinds[:, :, 2] + weights * (1 - post) @ kinds[:, :, 0]
    return post, agree / np.maximum(weights @ (patterns != 0), 1)


def judged(docs: DataFrame, columns: list[str], keep_at: float = 0.5) -> DataFrame:
    """``columns`` of ``docs`` with COUNTS, base_failed, kept and p_good.

    The counts are made twice, for the patterns and for the verdicts, since
    writing the rows in between would cost as much disk as they have.
    """
    names = list(rules())
    own = [c for c in columns if c.lower() not in {*COUNTS, "base_failed", "p_good", "kept"}]
    counted = docs.select(F.struct(*own).alias("_own"), _counts("text").alias("_counts"))
    code = sum(((v + 1) * F.lit(3**i) for i, v in enumerate(rules().values())), F.lit(0)).cast("int")
    found = counted.select("_counts.*").select(code.alias("code")).groupBy("code").count()
    found = found.orderBy("code").collect()  # 3 ** rules rows at most
    codes = np.array([r["code"] for r in found], np.int64)
    patterns = codes.reshape(-1, 1) // 3 ** np.arange(len(names)) % 3 - 1
    post, _ = fit(patterns, np.array([float(r["count"]) for r in found]))
    posts = [(int(c), float(p)) for c, p in zip(codes, post, strict=True)]
    by_code = docs.sparkSession.createDataFrame(posts, "_code int, p_good double")
    flat = counted.select("_own", "_counts.*").withColumn("_code", code).join(F.broadcast(by_code), "_code")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    flat = flat.withColumn("base_failed", failed)
    flat = flat.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
    return flat.select("_own.*", *COUNTS, "base_failed", "kept", "p_good")


def quality_report(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id with the counts, base_failed, kept and p_good of each row."""
    return judged(docs, ["doc_id"], keep_at)


def keep_good(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return judged(whole, ["_row"], keep_at).where("kept").select("_row.*")
