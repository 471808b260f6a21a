"""Source divergence audit: how far apart the sources of a language are in the use of its terms.

Terms are the matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in whole texts,
A-Z lower-cased.  A language keeps the V terms that stand in ``LEAST_DOCS`` of
its rows.  Each group (lang, source), and each language as a whole, gives a kept
term of ``count`` occurrences p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)),
with N its occurrences of all kept terms; so p depends on the count alone.

The distance of two groups, the sum of |p - q| over all kept terms, comes from
count-level bitmaps: the kept terms of a language are dealt to buckets by a hash
and numbered within them, and for each (group, count) a bitset of the bucket's term
numbers is stored.  For a pair of groups, AND and popcount of two levels give
the cell of their joint counts, which is multiplied by |p - q| of the two
levels; a level's terms in no cell have count zero in the other group, and terms
in no level of either have zero in both.  A task holds one bucket of about
``BUCKET`` terms for two blocks of ``BLOCK`` sources, whatever the size of the
corpus.  All arithmetic is on whole numbers.

Nulls: null text, lang and source are ''.  Every group that occurs has its pairs,
also without terms; a language without kept terms has distances of 0.  Every
row counts as a document, also repeated ones.  An empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.llm.text import give_back
from terratile.storage import broadcast_if_small, stage_table

LEAST_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
BUCKET, BLOCK = 2048, 32
HELD = 200_000  # terms whose counts a task holds before it hands them on
SLICE = 1 << 20  # bytes of one text parted at a time

#: What is no letter becomes a blank, capitals their small letters; all bytes of characters beyond ASCII stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about ``SLICE`` bytes."""
    low = text.translate(_TABLE)
    at = 0
    while at < len(low):
        to = low.find(b" ", at + SLICE)
        to = len(low) if to < 0 else to
        yield low[at:to].split()
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            while held:  # a group is gone before the next is handed on, and the last before memory is given back
                (lang, source), (n, rows) = held.popitem()
                names = list(n)
                for a in range(0, len(names), 20_000):
                    part = names[a : a + 20_000]
                    yield pa.record_batch(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([rows[t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
                n = rows = names = part = None
            give_back()

        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                n, rows = held.setdefault((lang[i], source[i]), (Counter(), Counter()))
                before, seen = len(n), set()
                for part in terms(text.as_py()):
                    n.update(part)
                    seen.update(part)
                rows.update(seen)
                size += len(n) - before
                if size >= HELD:
                    n = rows = seen = part = text = None
                    yield from hand_on()
                    size = 0
        batch = lang = source = n = rows = seen = part = text = None
        yield from hand_on()

    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exact for any 64-bit counts."""
    up = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = (total + PRIOR * kept).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def numbered(whole: DataFrame) -> DataFrame:
    """Adds to the kept terms (lang, term, all, v) their bucket, their number in it, and the bucket's size."""
    bucket = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BUCKET)).cast("int")
    within = Window.partitionBy("lang", "bucket")
    return whole.withColumn("bucket", bucket).withColumns(
        {"number": F.row_number().over(within.orderBy("term")) - 1, "size": F.count("*").over(within).cast("int")}
    )


def bitmaps(told: DataFrame) -> DataFrame:
    """(lang, bucket, source, count, p, size, bits): the terms of each (group, count) in a bucket, as a bitset of their numbers."""

    def levels(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["size"].iloc[0])
        bits: dict[tuple[str, int, int], np.ndarray] = {}
        for source, n, p, k in zip(part["source"], part["n"], part["p"], part["number"].tolist(), strict=True):
            row = bits.get((source, n, p))
            if row is None:
                row = bits[source, n, p] = np.zeros(-(-size // 64) * 8, np.uint8)
            row[k >> 3] |= 1 << (k & 7)
        first = part.iloc[0]
        out = pd.DataFrame([*bits], columns=["source", "count", "p"])
        return out.assign(lang=first["lang"], bucket=first["bucket"], size=size, bits=[x.tobytes() for x in bits.values()])

    schema = "source string, count long, p long, lang string, bucket int, size int, bits binary"
    columns = ["lang", "bucket", "block", "source", "n", "p", "number", "size"]
    return told.select(columns).groupBy("lang", "bucket", "block").applyInPandas(levels, schema)


def _level_set(part: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(p of each level, its bits as 64-bit words) of one group in a bucket."""
    bits = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), width) if len(part) else np.zeros((0, width), np.uint64)
    return part["p"].to_numpy(np.int64), bits


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], zero_a: int, zero_b: int, size: int) -> int:
    """Sum of |p - q| over a bucket's ``size`` terms, from the levels of two groups and what they give to count zero."""
    (p, left), (q, right) = a, b
    ones_a, ones_b = np.bitwise_count(left).sum(1, dtype=np.int64), np.bitwise_count(right).sum(1, dtype=np.int64)
    joint = np.zeros((len(p), len(q)), np.int64)
    for k in range(len(p)):
        joint[k] = np.bitwise_count(left[k] & right).sum(1, dtype=np.int64)
    value = int((joint * np.abs(p[:, None] - q[None, :])).sum())
    value += int(((ones_a - joint.sum(1)) * np.abs(p - zero_b)).sum() + ((ones_b - joint.sum(0)) * np.abs(q - zero_a)).sum())
    return value + int(size - ones_a.sum() - ones_b.sum() + joint.sum()) * abs(zero_a - zero_b)


def pair_values(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two groups of a language, both ways; ``groups``: lang, source, v, zero, block, blocks."""
    schema = "lang string, source string, item string, value long"
    # a bucket's sources, also those without a term there, for each pair of blocks
    spots = levels.groupBy("lang", "bucket").agg(F.max("size").alias("size"))
    every = spots.join(groups, "lang").join(levels.drop("size"), ["lang", "bucket", "source"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = every.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def values(part: pd.DataFrame) -> pd.DataFrame:
        size, lang = int(part["size"].iloc[0]), part["lang"].iloc[0]
        width = -(-size // 64)
        sets = {}
        for source, rows in part.groupby("source", sort=True):
            sets[source] = (int(rows["block"].iloc[0]), int(rows["zero"].iloc[0]), _level_set(rows[rows["bits"].notna()], width))
        lo, hi = int(part["lo"].iloc[0]), int(part["hi"].iloc[0])
        out = []
        names = list(sets)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                block_a, zero_a, of_a = sets[a]
                block_b, zero_b, of_b = sets[b]
                if {block_a, block_b} == {lo, hi}:
                    value = pair_value(of_a, of_b, zero_a, zero_b, size)
                    out += [(lang, a, b, value), (lang, b, a, value)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    columns = ["lang", "bucket", "source", "p", "size", "bits", "block", "zero", "lo", "hi"]
    return dealt.select(columns).groupBy("lang", "bucket", "lo", "hi").applyInPandas(values, schema)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group (lang, source).

    Part ``pair``: the distance to each other source of the language.  Part
    ``term``: the kept terms that the group holds and gives more than the
    language does, the ``top`` largest differences.  Ranks go by falling value,
    then by the item's bytes.
    """
    counts = stage_table(term_counts(docs), "term_counts")
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    whole = stage_table(whole.select("lang", "term", "all"), "kept_terms")
    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))  # a row a language
    placed = stage_table(numbered(whole.join(F.broadcast(langs.select("lang", "v")), "lang")), "numbered_terms").drop("v")
    kept = stage_table(counts.drop("docs").join(broadcast_if_small(placed, 100), ["lang", "term"]), "kept_counts")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "total"])
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    zero = F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)
    groups = stage_table(groups.withColumn("zero", zero), "groups")

    small = broadcast_if_small(groups, 100)
    told = kept.join(small.select("lang", "source", "v", "n_lang", "total", "block"), ["lang", "source"]).withColumns(
        {"p": probability(F.col("n"), F.col("total"), F.col("v")), "q": probability(F.col("all"), F.col("n_lang"), F.col("v"))}
    )
    levels = stage_table(bitmaps(told), "count_levels")
    found = pair_values(levels, small).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("v = 0").select("lang", "source")
    both = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.union(both.select("lang", "source", "item", "value")).withColumn("rank", F.row_number().over(order))
    more = told.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(best.withColumn("part", F.lit("term")).select(columns))
