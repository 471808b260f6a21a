"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are those of the license scan; an item's shingles are its runs of
``width`` words (the whole sequence if it has fewer), taken as a set.  An item
is contained in a document if at least ``threshold`` of the item's shingles are
among the document's runs of as many words.  So an item of fewer words than
``width`` is contained where it stands word for word.

Search: items are partitioned by size (powers of two of their number of
shingles); an item's signature is its k smallest shingle hashes, with k one
more than the number of shingles that an item of its partition may miss at
most.  A document that contains the item cannot miss all of them, so one signature hash found in a document
makes the pair a candidate, however long the document is, and no pair is lost.
(Banded whole-document signatures would lose short items in long documents: the
Jaccard similarity of 40 shingles within 20,000 is 0.002.)  Candidates are
verified by exact containment of shingles as strings: the item's array of
shingles is met with the document's in one row, so no shingle is a shuffle key.

All steps are DataFrame expressions and joins.  Documents' shingles are hashed
in place, and only those that hit a signature become rows.  The signatures are
joined with a broadcast if Spark finds their measured size under its threshold,
else by a shuffle of hashes.

Rows of candidates lead back to their texts by a broadcast if their counted
number makes them small, else by a shuffle.

A document is known by its doc_id and two 64-bit hashes of its text, so rows are judged
singly: rows that share an id (or have none) do not answer for each other, and
rows that share id and text give one result.  Items are told apart in the same
way.  Nulls: a null text is empty: no shingles, contained nowhere, containing
nothing.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratile.llm.text import word_array
from terratile.storage import broadcast_if_small, stage_table

WIDTH, THRESHOLD = 5, 0.8


def _starts(width: int | Column) -> Column:
    """0 .. n - width; none for a text of fewer words."""
    last = F.size("words") - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hash(at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get("words", at + i) for i in range(width)])


def _hashing(width: int):
    return lambda at: _hash(at, width)


def _named(width: int):
    return lambda h: F.struct(F.lit(width).alias("width"), h.alias("hash"))


def _shingles(width: Column, most: int) -> Column:
    """The distinct runs of ``width`` words (``most`` at most), as strings."""

    def run(at: Column) -> Column:  # a slice would copy the whole array at each place
        return F.concat_ws(" ", *[F.when(F.lit(i) < width, F.get("words", at + i)) for i in range(most)])

    return F.array_distinct(F.transform(_starts(width), run))


def _digest() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_no, item_id, width, shingles, hashes, n) of each distinct item with words; n counts its shingles."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(width))).withColumn("shingles", _shingles(F.col("width"), width))
    by_width = F.lit(None).cast("array<bigint>")
    for w in range(1, width + 1):
        by_width = F.when(F.col("width") == w, F.array_distinct(F.transform(_starts(w), _hashing(w)))).otherwise(by_width)
    rows = rows.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "width", "shingles", by_width.alias("hashes"))
    return rows.withColumn("n", F.size("shingles").cast("long"))


def signatures(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_no, width, hash): the smallest hashes of each item, as many as its size class needs."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # the largest size of the partition
    k = (F.floor(top * F.lit(1 - threshold) + 1e-9) + 1).cast("int")
    return shingles.select("item_no", "width", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("hash"))


def _contained(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_id, digest, item_id, n_shared, n_item) of each distinct document that contains an item."""
    shingles = stage_table(item_shingles(items, width), "items")  # as written, an item keeps its number
    signed = stage_table(signatures(shingles, threshold), "signatures")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # 1 .. width
    words = docs.select("doc_id", _digest().alias("digest"), word_array(F.col("text")).alias("words"))
    if widths[1:]:  # items shorter than the width look for runs of their own length
        runs = [F.transform(F.transform(_starts(w), _hashing(w)), _named(w)) for w in widths]
        hashed = words.select("doc_id", "digest", F.explode(F.concat(*runs)).alias("run")).select("doc_id", "digest", "run.*")
    else:
        w = min(widths, default=width)
        hashed = words.select("doc_id", "digest", "words", F.explode(_starts(w)).alias("at"))
        hashed = hashed.select("doc_id", "digest", F.lit(w).alias("width"), _hash(F.col("at"), w).alias("hash"))
    found = hashed.join(signed, ["hash", "width"]).select("doc_id", "digest", "item_no").distinct()
    found = broadcast_if_small(stage_table(found, "candidates"), 64).toDF("_doc", "_digest", "item_no")
    met = words.join(found, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).join(shingles.drop("hashes"), "item_no")
    shared = F.size(F.array_intersect(_shingles(F.col("width"), width), F.col("shingles"))).cast("long")
    met = met.select("doc_id", "digest", "item_no", "item_id", shared.alias("n_shared"), F.col("n").alias("n_item"))
    return met.where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9).dropDuplicates(["doc_id", "digest", "item_no"])


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each contained item."""
    found = _contained(docs, items, width, threshold)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the columns of ``docs``."""
    hit = stage_table(_contained(docs, items, width, threshold).select("doc_id", "digest").distinct(), "hits")
    hit = broadcast_if_small(hit, 64).toDF("_hit", "_digest")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), _digest().alias("_sha1"))
    return whole.join(hit, (F.col("_sha1") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_hit")), "left_anti").select("_row.*")
