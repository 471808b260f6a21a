"""Comparison of metrics, thresholds, operating points, and boxes against boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.operators.search import ranked_hits
from terratile.storage import stage_table

#: Names of metrics by the last part of their path (fixed values).
HIGHER = ["tp", "map", "iou", "accuracy"]
HIGHER_PART = ["recall", "precision", "ndcg", "f1", "ap50", "per_s", "throughput", "agreement", "f0.5"]
LOWER = ["fpr", "fp", "fn", "false_positive_rate", "false_positives", "false_negatives"]
LOWER_END = ["_ms", "_seconds", "_mb", "_mib", "_gb", "_bytes", "_per_tile", "_wall_s", "_vram", "_rss"]
LOWER_START = ["latency", "peak_", "bytes_per", "seconds_per", "ms_per", "cost"]


def lower_is_better(path: Column) -> Column:
    """True, false, or null where the name tells no direction; higher names are asked first."""
    last = F.lower(F.element_at(F.split(path, r"\."), -1))
    some = lambda tests: F.greatest(*tests)
    higher = last.isin(*HIGHER) | some([F.contains(last, F.lit(s)) for s in HIGHER_PART])
    lower = last.isin(*LOWER) | some([F.endswith(last, F.lit(s)) for s in LOWER_END]) | some([F.startswith(last, F.lit(s)) for s in LOWER_START])
    return F.when(higher, False).when(lower, True)


def snapshot_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two tables (path, value, band) side by side: difference, relative difference, larger noise band and verdict.

    A difference as large as the band is noise; a path of one side only says so.
    """
    both = baseline.select("path", F.col("value").alias("base"), F.col("band").alias("b1")).join(
        candidate.select("path", F.col("value").alias("cand"), F.col("band").alias("b2")), "path", "full"
    )
    delta, band, lower = F.col("cand") - F.col("base"), F.greatest("b1", "b2"), lower_is_better(F.col("path"))
    verdict = (
        F.when(F.col("cand").isNull(), "only_in_baseline").when(F.col("base").isNull(), "only_in_candidate").when(band.isNull(), "no_band")
        .when(F.abs(delta) <= band, "within_noise").when(lower.isNull(), "changed").when(lower == (delta < 0), "improved").otherwise("regressed")
    )
    relative = F.when(F.col("base") != 0, delta / F.abs("base"))
    return both.select("path", "base", "cand", delta.alias("delta"), relative.alias("relative"), band.alias("band"), verdict.alias("verdict"))


def with_paired(diff: DataFrame, intervals: DataFrame) -> DataFrame:
    """A ``snapshot_diff`` with ``low`` and ``high`` of the paired difference (path, low, high) where there is one.

    Where the bands tell nothing (within_noise, no_band) an interval that leaves
    out 0 does: improved_paired, regressed_paired, or changed_paired without a direction.
    """
    rows = diff.join(intervals.select("path", "low", "high"), "path", "left")
    lower, open_ = lower_is_better(F.col("path")), F.col("verdict").isin("within_noise", "no_band")
    apart = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False))
    paired = F.when(lower.isNull(), "changed_paired").when(F.when(lower, F.col("high") < 0).otherwise(F.col("low") > 0), "improved_paired").otherwise("regressed_paired")
    return rows.withColumn("verdict", F.when(open_ & apart, paired).otherwise(F.col("verdict")))


def verdict_counts(diff: DataFrame) -> DataFrame:
    """(verdict, n), and the row ``total``."""
    return diff.groupBy("verdict").agg(F.count("*").alias("n")).union(diff.agg(F.count("*").alias("n")).select(F.lit("total").alias("verdict"), "n"))


def judged_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Per query over its whole candidate set (query_id, rank, grade): precision, recall, recall capped at k, gain, strict precision, prevalence, lift."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    rows = ranked.withColumn("best", F.row_number().over(ideal))
    top, hit = F.col("rank") <= k, F.col("grade") > 0
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("n_candidates"), F.count_if(hit).alias("n_relevant"), F.count_if(top & hit).alias("hits"), F.count_if(top & (F.col("grade") == 2)).alias("strict"),
        F.sum(F.when(top, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.when(F.col("best") <= k, F.col("grade") / F.log2(F.col("best") + 1))).alias("idcg"),
    )
    any_, p = F.col("n_relevant") > 0, F.col("hits") / k
    return out.select(
        "query_id", "n_candidates", "n_relevant", p.alias("precision"), F.when(any_, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.when(any_, F.col("hits") / F.least(F.col("n_relevant"), F.lit(k))).otherwise(0.0).alias("recall_capped"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        (F.col("strict") / k).alias("precision_strict"), F.when(any_, p * F.col("n_candidates") / F.col("n_relevant")).alias("lift"),
    )


def threshold_curve(ranked: DataFrame, relevant: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold the macro precision, recall and F1 of rankings cut where the score first falls below it.

    ``ranked``: query_id, rank, score, hit; ``relevant``: every query with ``n_relevant``.
    """
    marks = ranked.select("query_id", "rank", "score", "hit", F.explode(F.array(*map(F.lit, thresholds))).alias("tau"))
    so_far = Window.partitionBy("query_id", "tau").orderBy("rank")
    kept = marks.withColumn("weak", F.max((F.col("score") < F.col("tau")).cast("int")).over(so_far)).where("weak = 0")
    kept = kept.groupBy("tau", "query_id").agg(F.avg(F.col("hit").cast("double")).alias("p"), F.sum(F.col("hit").cast("int")).alias("hits"))
    grid = relevant.select("query_id", "n_relevant", F.explode(F.array(*map(F.lit, thresholds))).alias("tau"))
    rows = grid.join(kept, ["tau", "query_id"], "left")
    recall = F.when(F.col("n_relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).otherwise(0.0)
    out = rows.groupBy("tau").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"), F.avg(recall).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def operating_points(detections: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per class and threshold the true and false positives at that score or above, misses, precision, recall, F1."""
    marks = detections.select("class_id", F.col("hit").cast("int").alias("hit"), "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    above = F.col("score") >= F.col("threshold")
    out = marks.groupBy("class_id", "threshold").agg(F.sum("hit").alias("n_true"), F.count_if(above & (F.col("hit") == 1)).alias("tp"), F.count_if(above & (F.col("hit") == 0)).alias("fp"))
    over = lambda a, b: F.when(b > 0, a / b)
    out = out.withColumn("fn", F.col("n_true") - F.col("tp")).withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("n_true")))
    return out.withColumn("f1", over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_f1(detections: DataFrame) -> DataFrame:
    """Per class the score at which F1 over its ranked detections is greatest (the higher score on a tie)."""
    rows = ranked_hits(detections)
    f1 = F.round(2 * F.col("tp") / (F.col("n") + F.col("n_true")), 6)
    return rows.groupBy("class_id").agg(F.max(F.struct(f1.alias("f1"), F.col("score"))).alias("b")).select("class_id", "b.f1", "b.score")


# ---- boxes


def _spread(boxes: DataFrame, cell: float) -> DataFrame:
    for axis, low, high in (("gx", "x0", "x1"), ("gy", "y0", "y1")):
        boxes = boxes.withColumn(axis, F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))
    return boxes


def overlaps(left: DataFrame, right: DataFrame, cell: float = 256.0, asked: Column | None = None) -> DataFrame:
    """Pairs of boxes (l, r structs) of one image and class that overlap, with ``iou``; only those for which ``asked`` holds, if it is given.

    Boxes are spread over grid cells; a pair is formed in the cell of its
    intersection's first corner only.  Cells are wide against common boxes, so
    that few boxes are sent to more than one.  A table that meets itself is
    shuffled once, if ``asked`` has no condition on one side alone.
    """
    a = _spread(left, cell).select("image_id", "class_id", "gx", "gy", F.struct(*left.columns).alias("l"))
    b = _spread(right, cell).select("image_id", "class_id", "gx", "gy", F.struct(*right.columns).alias("r"))
    met = a.join(b, ["image_id", "class_id", "gx", "gy"])
    if asked is not None:
        met = met.where(asked)
    x0, y0, x1, y1 = F.greatest("l.x0", "r.x0"), F.greatest("l.y0", "r.y0"), F.least("l.x1", "r.x1"), F.least("l.y1", "r.y1")
    met = met.where((x1 > x0) & (y1 > y0) & (F.floor(x0 / cell) == F.col("gx")) & (F.floor(y0 / cell) == F.col("gy")))
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    inter = (x1 - x0) * (y1 - y0)
    # Spark may work this out before it drops pairs that do not overlap, where the union is no area and can be 0
    return met.select("image_id", "class_id", "l", "r", F.try_divide(inter, area("l") + area("r") - inter).alias("iou"))


def best_matches(boxes: DataFrame, truths: DataFrame) -> DataFrame:
    """Per box the truth of its image and class with the largest overlap (smallest id on a tie), null and 0 where none overlaps."""
    best = overlaps(boxes, truths).groupBy(F.col("l.box_id").alias("box_id")).agg(F.max(F.struct("iou", -F.col("r.truth_id"))).alias("b"))
    best = best.select("box_id", F.col("b.iou").alias("iou"), (-F.col("b.col2")).alias("truth_id"))
    return boxes.select("box_id").join(best, "box_id", "left").select("box_id", "truth_id", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def merge_across_chips(boxes: DataFrame, least: float = 0.5, pairs: Callable[..., DataFrame] = overlaps) -> DataFrame:
    """Boxes that survive when, best score first, a kept box removes overlapping ones of the same image and class from other chips.

    Ties in score go to the smaller id; a box of an unknown chip (negative number) removes none.  Instead of a walk through each list, a
    box is settled once all better boxes that could remove it are: kept when
    all of those are gone, gone when one of them is kept.  Rounds follow the
    longest chain of overlaps, not the length of a list; all lists at once.
    """
    others = F.when(F.col("l.chip_id") != F.col("r.chip_id"), F.col("l.chip_id") >= 0)
    before = (F.col("l.score") > F.col("r.score")) | ((F.col("l.score") == F.col("r.score")) & (F.col("l.box_id") < F.col("r.box_id")))
    met = pairs(boxes, boxes, asked=others & before).where(F.col("iou") > least)
    open_ = stage_table(met.select(F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b")).distinct(), "removes")
    gone = None
    while not open_.isEmpty():
        # no open edge leads to it: kept, so all that it removes go, and so do the edges from and to them
        kept = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = stage_table(open_.join(kept, "a", "left_semi").select("b").distinct(), "gone")
        gone = out if gone is None else gone.union(out)
        rest = open_.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
        open_ = stage_table(rest, "removes")
    return boxes if gone is None else boxes.join(gone.select(F.col("b").alias("box_id")), "box_id", "left_anti")


# ---- repeats of training rows


def repeat_factors(chips: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Per chip the largest of its classes' factors max(1, sqrt(threshold / share of chips with the class)).

    ``chips`` has a row an object (chip_id, class_id); null classes are empty chips, with factor 1.
    """
    total = chips.agg(F.count_distinct("chip_id").alias("n"))
    present = chips.dropDuplicates(["chip_id", "class_id"])
    shares = present.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("m")).crossJoin(F.broadcast(total))  # one row
    factors = shares.select("class_id", F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) * F.col("n") / F.col("m"))).alias("r"))
    return present.join(factors, "class_id", "left").groupBy("chip_id").agg(F.coalesce(F.max("r"), F.lit(1.0)).alias("factor"))


def rounded_repeats(factors: DataFrame, seed: int = 8241) -> DataFrame:
    """Adds ``repeats``: the factor rounded up with its fraction as chance, drawn by a hash of the chip's id and the seed."""
    draw = F.pmod(F.xxhash64("chip_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    down = F.floor("factor")
    return factors.withColumn("repeats", F.greatest(F.lit(1), down + (draw < F.col("factor") - down).cast("int")))
