"""Bounded, repeatable samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int = 5, out: int = 0) -> Column:
    """True where the fold is ``out``; false for a null id, which is never learned from either."""
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def sample_ids(labelled: DataFrame, per_label: int, folds: int = 5, out: int = 0) -> DataFrame:
    """(doc_id, label): of each label the ``per_label`` ids that come first in a hashed order.

    Rows without id or label and rows of fold ``out`` take no part; an id with
    several labels has the smallest.  Counts by label and the hash's first ten
    bits, summed before they are shuffled, tell up to which of them a label has
    enough; within the last, the next ten bits do.  The cuts (a row a label, and
    the callers hold a model of every label) are broadcast to where the ids lie,
    so an id is dropped before anything is dealt by label, and only about
    ``per_label`` ids of a label are ranked.
    """
    known = labelled.select("doc_id", "label").dropna().where(fold(F.col("doc_id"), folds) != out)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    left = known.withColumn("hash", F.xxhash64("doc_id"))
    for shift in (54, 44):
        bits = F.shiftrightunsigned("hash", shift)
        sizes = left.groupBy("label", bits.alias("bits")).agg(F.count("*").alias("n"))
        run = F.sum("n").over(Window.partitionBy("label").orderBy("bits"))
        cut = sizes.withColumn("run", run).groupBy("label").agg(F.min(F.when(F.col("run") >= per_label, F.col("bits"))).alias("cut"))
        left = left.join(F.broadcast(cut), "label").where(F.col("cut").isNull() | (bits <= F.col("cut"))).drop("cut")
    order = Window.partitionBy("label").orderBy(F.shiftrightunsigned("hash", 44), "hash", "doc_id")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label).select("doc_id", "label")
