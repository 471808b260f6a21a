"""Evaluation of detectors with oriented boxes: best truths, one hit a truth, precision over recall.

A box is a row with a ring of four points (``ring``), an image and a class.
Spark works on candidate pairs of boxes whose extents meet (spread over grid
cells), cuts many pairs of rings at once in Arrow batches, and keeps the best
truth of each detection.  Everything after that counts rows in order of score
with totals of earlier parts (``scan``), so a class may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions import polygons
from terratile.operators import evaluation, scan
from terratile.storage import stage_table

#: Overlaps at which average precision is taken, and ranges of the long side in pixels (fixed values).
OVERLAPS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
SIZES = {"all": (None, None), "0-16": (0.0, 16.0), "16-32": (16.0, 32.0), "32-96": (32.0, 96.0), "96-inf": (96.0, float("inf"))}


def with_extent(boxes: DataFrame) -> DataFrame:
    """Adds the extent x0, y0, x1, y1 of ``ring``; the ring is made once."""
    names = [c for c in boxes.columns if c != "ring"]
    return boxes.select(*names, F.explode(F.array("ring")).alias("ring")).withColumns(polygons.extent(F.col("ring")))


def ring_overlaps(left: DataFrame, right: DataFrame, cell: float = 256.0, asked: Column | None = None) -> DataFrame:
    """Pairs (l, r structs) of one image and class whose rings have an area in common, with ``iou``, as ``evaluation.overlaps`` has them; rings are convex."""
    met = evaluation.overlaps(with_extent(left), with_extent(right), cell, asked)
    return met.select("image_id", "class_id", "l", "r", polygons.iou(F.col("l.ring"), F.col("r.ring")).alias("iou")).where("iou > 0")


def matched(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """Per detection (det_id, image_id, class_id, score, ring) its best truth (truth_id, difficult, ring): the largest overlap, the smallest id on a tie.

    Columns: det_id, class_id, score, det_size, truth_id (null where nothing
    overlaps), iou (9 digits; then 0), difficult, truth_size.  Sizes are long sides.
    """
    pairs = ring_overlaps(detections.select("det_id", "image_id", "class_id", "ring"), truths.select("truth_id", "image_id", "class_id", "difficult", "ring"))
    found = F.struct(F.round("iou", 9).alias("iou"), (-F.col("r.truth_id")).alias("back"), F.col("r.difficult").alias("difficult"), polygons.long_side(F.col("r.ring")).alias("truth_size"))
    best = pairs.groupBy(F.col("l.det_id").alias("det_id")).agg(F.max(found).alias("b"))
    best = best.select("det_id", (-F.col("b.back")).alias("truth_id"), "b.iou", "b.difficult", "b.truth_size")
    own = detections.select("det_id", "class_id", "score", polygons.long_side(F.col("ring")).alias("det_size"))
    return own.join(best, "det_id", "left").withColumns({"iou": F.coalesce("iou", F.lit(0.0)), "difficult": F.coalesce("difficult", F.lit(False))})


def _cases(overlaps: list[float], sizes: list[str]) -> Column:
    """Overlaps over all sizes, and the first overlap for each range of sizes."""
    cases = [(at, "all") for at in overlaps] + [(overlaps[0], s) for s in sizes if s != "all"]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("overlap"), F.lit(s).alias("size")) for a, s in cases]))


def _inside(value: str) -> Column:
    out = F.lit(True)
    for name, (low, high) in SIZES.items():
        if low is not None:
            out = F.when(F.col("size") == name, F.coalesce((F.col(value) >= low) & (F.col(value) < high), F.lit(False))).otherwise(out)
    return out


def _listed(overlaps: list[float], sizes: list[str]) -> list[tuple[float, str]]:
    return [(at, "all") for at in overlaps] + [(overlaps[0], s) for s in sizes if s != "all"]


def _within(value: str, size: str) -> Column:
    low, high = SIZES[size]
    return F.lit(True) if low is None else F.coalesce((F.col(value) >= low) & (F.col(value) < high), F.lit(False))


def _bit(mask: str, k: int) -> Column:
    return F.shiftright(F.col(mask), k).bitwiseAND(1)


def judged(matches: DataFrame, cases: list[tuple[float, str]]) -> DataFrame:
    """A row a detection, whatever the number of ``cases`` (overlap, range of sizes; 62 at most), written: class_id, det_id, score, truth_id, and two
    sets of bits, a bit a case: ``counted``, and ``hits`` of those that count.

    A detection of a difficult truth, of a truth of another size, or of no truth
    and another size itself, does not count.
    """
    counted = hits = F.lit(0).cast("long")
    for k, (at, size) in enumerate(cases):
        hit = (F.col("iou") >= at) & F.col("truth_id").isNotNull()
        some = F.when(hit, ~F.col("difficult") & _within("truth_size", size)).otherwise(_within("det_size", size))
        counted = counted + F.when(some, F.lit(1 << k)).otherwise(0).cast("long")
        hits = hits + F.when(some & hit, F.lit(1 << k)).otherwise(0).cast("long")
    return stage_table(matches.select("class_id", "det_id", "score", "truth_id", counted.alias("counted"), hits.alias("hits")), "judged")


def first_hits(rows: DataFrame, n: int) -> DataFrame:
    """(class_id, det_id, score, tp): of ``judged`` rows the detections that are the best-scored hit of their truth in a case, as bits of the cases."""
    best = [F.min(F.when(_bit("hits", k) == 1, F.struct((-F.col("score")).alias("s"), "det_id"))).alias(f"_{k}") for k in range(n)]
    found = rows.where("hits <> 0").groupBy("class_id", "truth_id").agg(*best)
    each = F.explode(F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.col(f"_{k}.det_id").alias("det_id"), (-F.col(f"_{k}.s")).alias("score")) for k in range(n)]))
    each = found.select("class_id", each.alias("e")).select("class_id", "e.*").where("det_id IS NOT NULL")
    return each.groupBy("class_id", "det_id").agg(F.max("score").alias("score"), F.bit_or("bit").alias("tp"))


def _spread_cases(cases: list[tuple[float, str]], mask: str, *fields) -> Column:
    """The cases whose bit is set, each with ``fields`` (k -> column)."""
    each = [F.when(_bit(mask, k) == 1, F.struct(F.lit(float(at)).alias("overlap"), F.lit(size).alias("size"), *[f(k) for f in fields])) for k, (at, size) in enumerate(cases)]
    return F.explode(F.array_compact(F.array(*each))).alias("case")


def hit_points(rows: DataFrame, cases: list[tuple[float, str]]) -> DataFrame:
    """(class_id, overlap, size, det_id, score, tp_so_far, n): the points of each case's curve at its hits, from ``judged`` rows.

    Precision falls from a hit to the next one and recall stays, so the largest
    of both lie at hits.  All cases are counted along one order of the
    detections; a hit comes into it as a row of its own, behind its detection.
    """
    n = len(cases)
    base = rows.where("counted <> 0").select("class_id", "det_id", "score", "counted", F.lit(0).cast("long").alias("tp"))
    both = base.unionByName(first_hits(rows, n).withColumn("counted", F.lit(0).cast("long")))
    sums = {f"_n{k}": _bit("counted", k) for k in range(n)} | {f"_t{k}": _bit("tp", k) for k in range(n)}
    so_far = scan.running(both, ["class_id"], [F.desc("score"), F.col("det_id"), F.col("tp")], sums).where("tp <> 0")
    return so_far.select("class_id", "det_id", "score", _spread_cases(cases, "tp", lambda k: F.col(f"_t{k}").alias("tp_so_far"), lambda k: F.col(f"_n{k}").alias("n"))).select("class_id", "case.*", "det_id", "score")


def truth_counts(truths: DataFrame, overlaps: list[float], sizes: list[str]) -> DataFrame:
    """(class_id, overlap, size, n_true): truths that are not difficult, by range of sizes."""
    sized = truths.where(~F.col("difficult")).select("class_id", polygons.long_side(F.col("ring")).alias("truth_size"))
    rows = sized.select("*", _cases(overlaps, sizes).alias("case")).select("*", "case.*")
    kinds = truths.select("class_id").distinct().select("class_id", _cases(overlaps, sizes).alias("case")).select("class_id", "case.*")
    counts = rows.where(_inside("truth_size")).groupBy("class_id", "overlap", "size").agg(F.count("*").alias("n_true"))
    return kinds.join(counts, ["class_id", "overlap", "size"], "left").na.fill(0, ["n_true"])


def curve(matches: DataFrame, truths: DataFrame, overlaps: list[float] | None = None, sizes: list[str] | None = None) -> DataFrame:
    """Per class, overlap and range of sizes its detections by falling score: hits ``tp_so_far`` of ``n``, ``precision``, ``recall`` (null without truths)."""
    overlaps, sizes = overlaps or [0.5], sizes or ["all"]
    group, cases = ["class_id", "overlap", "size"], _listed(overlaps, sizes)
    rows = judged(matches, cases)
    rows = rows.where("counted <> 0").join(first_hits(rows, len(cases)).drop("score"), ["class_id", "det_id"], "left").na.fill(0, ["tp"])
    rows = rows.select("class_id", "det_id", "score", _spread_cases(cases, "counted", lambda k: _bit("tp", k).cast("int").alias("tp"))).select("class_id", "case.*", "det_id", "score")
    rows = scan.running(rows, group, [F.desc("score"), F.col("det_id")], {"tp_so_far": F.col("tp"), "n": F.lit(1)})
    rows = rows.join(truth_counts(truths, overlaps, sizes), group, "left").na.fill(0, ["n_true"])
    return rows.withColumns({"precision": F.col("tp_so_far") / F.col("n"), "recall": F.when(F.col("n_true") > 0, F.col("tp_so_far") / F.col("n_true"))})


def average_precisions(matches: DataFrame, truths: DataFrame, overlaps: list[float] | None = None, sizes: list[str] | None = None) -> DataFrame:
    """(class_id, overlap, size, n_true, ap, ap11): area under the falling envelope of precision over recall, and its mean at eleven recalls.

    Null for classes without truths, 0 for those without detections.
    """
    overlaps, sizes = overlaps or OVERLAPS, sizes or list(SIZES)
    group, cases = ["class_id", "overlap", "size"], _listed(overlaps, sizes)
    rows = hit_points(judged(matches, cases), cases).join(truth_counts(truths, overlaps, sizes), group, "left").na.fill(0, ["n_true"])
    rows = rows.withColumns({"precision": F.col("tp_so_far") / F.col("n"), "recall": F.when(F.col("n_true") > 0, F.col("tp_so_far") / F.col("n_true"))})
    rows = scan.running(stage_table(rows, "hit_points"), group, [F.col("score"), F.desc("det_id")], maxima={"envelope": F.col("precision")})
    marks = [F.coalesce(F.max(F.when(F.col("recall") >= 0.1 * k, F.col("precision"))), F.lit(0.0)) for k in range(11)]
    found = rows.groupBy(*group).agg(F.sum("envelope").alias("sum"), (sum(marks[1:], marks[0]) / 11).alias("ap11"))
    out = truth_counts(truths, overlaps, sizes).join(found, group, "left")
    some = F.col("n_true") > 0
    return out.select(*group, "n_true", F.when(some, F.coalesce(F.col("sum") / F.col("n_true"), F.lit(0.0))).alias("ap"), F.when(some, F.coalesce("ap11", F.lit(0.0))).alias("ap11"))


def class_summary(precisions: DataFrame) -> DataFrame:
    """Per class: n_true, ap50, ap50_11 and ap50_95, the mean over overlaps, of all sizes."""
    half = F.abs(F.col("overlap") - 0.5) < 1e-9
    return precisions.where("size = 'all'").groupBy("class_id").agg(
        F.max("n_true").alias("n_true"), F.max(F.when(half, F.col("ap"))).alias("ap50"), F.max(F.when(half, F.col("ap11"))).alias("ap50_11"), F.avg("ap").alias("ap50_95")
    )


def best_scores(points: DataFrame) -> DataFrame:
    """Per class, overlap and range of sizes of a ``curve`` the score of greatest F1 (the first reached on a tie); classes without truths are left out."""
    f1 = 2 * F.col("tp_so_far") / (F.col("n") + F.col("n_true"))
    best = points.where("n_true > 0").groupBy("class_id", "overlap", "size").agg(F.max(F.struct(F.round(f1, 9).alias("f1"), F.col("score"))).alias("b"))
    return best.select("class_id", "overlap", "size", "b.f1", "b.score")


def best_scores_at(matches: DataFrame, truths: DataFrame, overlaps: list[float] | None = None, sizes: list[str] | None = None) -> DataFrame:
    """``best_scores`` of the ``curve`` of the same arguments without making it: F1 is greatest at a hit, or 0 everywhere and the best score its first."""
    overlaps, sizes = overlaps or [0.5], sizes or ["all"]
    group, cases = ["class_id", "overlap", "size"], _listed(overlaps, sizes)
    rows = judged(matches, cases)
    top = rows.groupBy("class_id").agg(*[F.max(F.when(_bit("counted", k) == 1, F.col("score"))).alias(f"_{k}") for k in range(len(cases))])
    each = [F.struct(F.lit(float(at)).alias("overlap"), F.lit(size).alias("size"), F.col(f"_{k}").alias("score")) for k, (at, size) in enumerate(cases)]
    top = top.select("class_id", F.explode(F.array(*each)).alias("case")).select("class_id", "case.*").where("score IS NOT NULL")
    first = top.select(*group, "score", F.lit(0).cast("long").alias("tp_so_far"), F.lit(1).cast("long").alias("n"))
    points = hit_points(rows, cases).select(*group, "score", "tp_so_far", "n").union(first)
    return best_scores(points.join(truth_counts(truths, overlaps, sizes), group))


def merged_rings(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """``evaluation.merge_across_chips`` for boxes (box_id, image_id, class_id, chip_id, score, ring) by the overlap of their rings."""
    return evaluation.merge_across_chips(boxes, least, ring_overlaps)
