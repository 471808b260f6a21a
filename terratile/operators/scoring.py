"""Relevance rules, averages over queries, resampled intervals, curves, ablations, explanations and training sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import clip
from terratile.operators import change, scan, search
from terratile.storage import stage_table

# ---- relevance rules

#: Fixed values.  A kind of ground gets the first grade of which all ranges hold: (grade, {field: (least, most)}); None is open.
GROUND = {
    "water_body": [(2, {"water_frac": (0.10, None)}), (1, {"water_frac": (0.03, None)}), (1, {"dist_water_m": (0.0, 0.0), "water_frac": (0.015, None)})],
    "river_sandbars": [(2, {"dist_river_m": (None, 200), "water_frac": (0.05, None), "bare_frac": (0.04, None)}), (1, {"dist_river_m": (None, 400), "water_frac": (0.02, None)})],
    "bridge": [
        (2, {"dist_river_m": (None, 100), "water_frac": (0.03, None), "built_frac": (0.20, None), "edge_density": (0.18, None)}),
        (1, {"dist_river_m": (None, 250), "built_frac": (0.20, None)}), (1, {"dist_river_m": (None, 250), "edge_density": (0.22, None)}),
    ],
    "riverside_built": [
        (2, {"dist_river_m": (None, 600), "built_frac": (0.28, None), "ndvi_p50": (None, 0.50)}),
        (1, {"dist_river_m": (None, 1500), "built_frac": (0.25, None), "ndvi_p50": (None, 0.55)}), (1, {"dist_river_m": (None, 600), "built_frac": (0.20, None)}),
    ],
    "dense_urban": [(2, {"built_frac": (0.45, None), "ndvi_p50": (None, 0.32), "edge_density": (0.18, None)}), (1, {"built_frac": (0.32, None), "ndvi_p50": (None, 0.42)})],
    "residential": [(2, {"built_frac": (0.35, None), "ndvi_p50": (0.20, 0.48), "edge_density": (0.15, None)}), (1, {"built_frac": (0.27, None), "ndvi_p50": (None, 0.52)})],
    "agriculture": [
        (2, {"ndvi_p50": (0.35, 0.75), "edge_density": (0.15, None), "water_frac": (None, 0.03), "built_frac": (None, 0.25)}),
        (1, {"ndvi_p50": (0.30, None), "edge_density": (0.10, None), "built_frac": (None, 0.30)}),
    ],
    "cropland_boundaries": [
        (2, {"ndvi_p50": (0.35, 0.78), "edge_density": (0.20, None), "built_frac": (None, 0.22)}),
        (1, {"ndvi_p50": (0.30, None), "edge_density": (0.14, None), "built_frac": (None, 0.28)}),
    ],
    "irrigated": [
        (2, {"ndvi_p50": (0.40, None), "ndwi_p90": (-0.28, None), "built_frac": (None, 0.22), "edge_density": (0.12, None)}),
        (1, {"ndvi_p50": (0.35, None), "ndwi_p90": (-0.34, None)}),
    ],
    "bare": [
        (2, {"bare_frac": (0.40, None), "ndvi_p50": (None, 0.25), "water_frac": (None, 0.02), "edge_density": (None, 0.16)}),
        (1, {"bare_frac": (0.22, None), "ndvi_p50": (None, 0.35), "water_frac": (None, 0.03)}),
    ],
    "riverbank_vegetation": [
        (2, {"dist_river_m": (None, 400), "dense_veg_frac": (0.55, None), "ndvi_p50": (0.55, None)}),
        (1, {"dist_river_m": (None, 1200), "dense_veg_frac": (0.50, None)}), (1, {"dist_river_m": (None, 400), "ndvi_p50": (0.45, None)}),
    ],
    "paved_road": [
        (2, {"edge_density": (0.28, None), "ndvi_p10": (None, 0.15), "built_frac": (0.18, 0.55)}), (1, {"edge_density": (0.22, None), "ndvi_p10": (None, 0.22), "built_frac": (0.15, None)}),
    ],
    "dirt_road": [
        (2, {"edge_density": (0.26, None), "ndvi_p10": (None, 0.18), "bare_frac": (0.10, None)}), (1, {"edge_density": (0.20, None), "ndvi_p10": (None, 0.25), "bare_frac": (0.05, None)}),
    ],
}

#: The judged queries and the kind of ground each asks for.
QUERIES = {
    "newly built structures near a river": "riverside_built", "settlement along a riverbank": "riverside_built", "a river with sandbars": "river_sandbars",
    "dense urban buildings": "dense_urban", "agricultural fields": "agriculture", "open bare ground": "bare", "a water body": "water_body",
    "cropland with visible field boundaries": "cropland_boundaries", "a paved road": "paved_road", "riverside construction": "riverside_built",
    "a bridge crossing a river": "bridge", "dense vegetation along a riverbank": "riverbank_vegetation", "an urban residential neighborhood": "residential",
    "irrigated farmland": "irrigated", "a braided river channel with sandbars": "river_sandbars", "a dirt track or unpaved road": "dirt_road",
}


def grade(kind: str) -> Column:
    """The grade of a described tile for a kind of ground."""
    out = F.lit(0)
    for value, ranges in reversed(GROUND[kind]):
        tests = [t for f, (low, high) in ranges.items() for t in ((F.col(f) >= low) if low is not None else None, (F.col(f) <= high) if high is not None else None) if t is not None]
        out = F.when(reduce(and_, tests), value).otherwise(out)
    return out


def relevance_grades(tiles: DataFrame, queries: dict[str, str] = QUERIES) -> DataFrame:
    """(tile_id, query, grade) of every tile for every query; an unusable tile is 0, a usable one without its distances an error."""
    lost = F.coalesce("usable", F.lit(False)) & (F.col("dist_river_m").isNull() | F.col("dist_water_m").isNull())
    checked = tiles.withColumn("usable", F.when(lost, F.raise_error(F.lit("a usable tile has no distance to river or water"))).otherwise(F.coalesce("usable", F.lit(False))))
    items = F.array(*[F.struct(F.lit(q).alias("query"), F.when(F.col("usable"), grade(kind)).otherwise(0).alias("grade")) for q, kind in queries.items()])
    return checked.select("tile_id", F.explode(items).alias("g")).select("tile_id", "g.*")


# ---- averages over queries


def macro_means(metrics: DataFrame, subsets: DataFrame, names: list[str]) -> DataFrame:
    """Mean of ``names`` over the queries of each subset (subset, query_id)."""
    return metrics.join(subsets, "query_id").groupBy("subset").agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in names])


def top_composition(ranked: DataFrame, k: int, home: Column) -> DataFrame:
    """Where the first k come from, as shares averaged over queries: judged relevant, judged 0, unjudged at ``home``, unjudged elsewhere."""
    bucket = F.when(F.col("grade") > 0, "judged_relevant").when(F.col("grade") == 0, "judged_zero").when(home, "unjudged_home").otherwise("unjudged_other")
    kept = ranked.where(F.col("rank") <= k).withColumn("bucket", bucket)
    queries = ranked.agg(F.count_distinct("query_id").alias("n"))
    return kept.groupBy("bucket").agg(F.count("*").alias("m")).crossJoin(F.broadcast(queries)).select("bucket", (F.col("m") / (k * F.col("n"))).alias("share"))  # one row


def judged_precision(ranked: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Per filter condition: mean size of what it keeps a query, judged hits among judged, share judged."""
    items = F.array(*[F.struct(F.lit(name).alias("condition"), test.alias("keep")) for name, test in conditions.items()])
    rows = ranked.select("query_id", "grade", F.explode(items).alias("c")).select("query_id", "grade", "c.*").where("keep")
    per = rows.groupBy("condition", "query_id").agg(F.count("*").alias("size"), F.count("grade").alias("judged"), F.count_if(F.col("grade") > 0).alias("hits"))
    return per.groupBy("condition").agg(F.avg("size").alias("mean_size"), F.avg(F.when(F.col("judged") > 0, F.col("hits") / F.col("judged"))).alias("precision"), (F.sum("judged") / F.sum("size")).alias("share_judged"))


def judge_coverage(tiles: DataFrame, judged: DataFrame) -> DataFrame:
    """Per region: tiles, judged tiles and their share, and the on-target rate (graded above 0) among them."""
    best = judged.groupBy("tile_id").agg(F.max("grade").alias("grade"))
    rows = tiles.join(best, "tile_id", "left")
    out = rows.groupBy("region").agg(F.count("*").alias("n_tiles"), F.count("grade").alias("n_judged"), F.count_if(F.col("grade") > 0).alias("n_on_target"))
    return out.withColumns({"coverage": F.col("n_judged") / F.col("n_tiles"), "on_target": F.try_divide("n_on_target", "n_judged")})


# ---- resampling


#: A Poisson(1) number is the count of these that a draw from 0 to 1 reaches.
LEVELS = tuple(round(t, 8) for t in accumulate((0.36787944, 0.36787944, 0.18393972, 0.06131324, 0.01532831, 0.00306566, 0.00051094)))
#: Detections of a class that lie together in a row, and replicates that are counted at once.
BLOCK, AT_ONCE = 1 << 13, 128


def resample_weight(unit: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a unit is drawn in a replicate: a Poisson(1) number from an MD5, so that any task can work it out by itself."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", unit, replicate, F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / F.lit(4294967296)

    def number(u: Column) -> Column:
        found = F.lit(len(LEVELS))
        for k, level in reversed(list(enumerate(LEVELS))):
            found = F.when(u < level, k).otherwise(found)
        return found

    return F.get(F.transform(F.array(u), number), F.lit(0))  # the MD5 is made once, not for each level


def replicates(rows: DataFrame, unit: str, n: int, seed: int = 0) -> DataFrame:
    """``rows`` once for each of ``n`` replicates that draws their unit, with ``replicate`` and ``weight``; sums over replicates combine in each partition."""
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.withColumn("weight", resample_weight(F.col(unit).cast("string"), F.col("replicate").cast("string"), seed)).where("weight > 0")


def paired_interval(units: DataFrame, group: str, n: int = 2000, level: float = 0.95) -> DataFrame:
    """Per group (unit, base, cand): mean difference, its percentile interval over replicates, half of its width, and whether 0 lies outside."""
    delta = units.withColumn("delta", F.col("cand") - F.col("base"))
    means = replicates(delta, "unit", n).groupBy(group, "replicate").agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("m"))
    low, high = (1 - level) / 2, (1 + level) / 2
    ends = means.groupBy(group).agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))  # n values a group
    rows = delta.groupBy(group).agg(F.avg("delta").alias("delta")).join(ends, group)
    return rows.withColumns({"half_width": (F.col("high") - F.col("low")) / 2, "significant": (F.col("low") > 0) | (F.col("high") < 0)})


@lru_cache(maxsize=1 << 15)
def _draws(unit: str, start: int, stop: int) -> bytes:
    """``resample_weight`` of a unit (its text and a colon) in each of some replicates, a byte each."""
    u = np.frombuffer(b"".join(hashlib.md5(f"{unit}{k}:0".encode()).digest()[:4] for k in range(start, stop)), ">u4") / 4294967296
    return np.searchsorted(LEVELS, u, side="right").astype(np.uint8).tobytes()


def resampled_ap(detections: DataFrame, n: int = 100, level: float = 0.95) -> DataFrame:
    """Per class the percentile interval of average precision over replicates that draw whole images."""
    kept = stage_table(detections.select("class_id", "det_id", "score", "image_id", F.col("hit").cast("int").alias("hit")), "detections")
    ap = reduce(DataFrame.union, [_replicate_aps(kept, range(a, min(a + AT_ONCE, n))) for a in range(0, n, AT_ONCE)])
    return ap.groupBy("class_id").agg(F.count("*").alias("n_replicates"), F.percentile("ap", (1 - level) / 2).alias("low"), F.percentile("ap", (1 + level) / 2).alias("high"))


def _detection_blocks(detections: DataFrame, numbers: range) -> DataFrame:
    """Detections of a class along the falling score, ``BLOCK`` a row: (class_id, part, seq) in order, what each image weighs in the replicates, images and hits one by one, and the sums of the weights (n) and of those of hits (t); written."""
    start, stop = numbers.start, numbers.stop

    def block(rows: pa.Table, part: int, seq: int) -> pa.RecordBatch:
        images = rows["unit"].combine_chunks().dictionary_encode()
        drawn = b"".join(_draws(u, start, stop) for u in images.dictionary.to_pylist())
        weights = np.frombuffer(drawn, np.uint8).reshape(-1, stop - start)
        at, hit = images.indices.to_numpy(), rows["hit"].to_numpy() == 1
        n, t = (np.bincount(x, minlength=len(weights)) @ weights for x in (at, at[hit]))
        binary = [pa.array([x], pa.binary()) for x in (drawn, at.astype("<u2").tobytes(), hit.tobytes())]
        return pa.record_batch([rows["class_id"].combine_chunks()[:1], pa.array([part], pa.int32()), pa.array([seq]), *binary, pa.array([n]), pa.array([t])], names=["class_id", "part", "seq", "weights", "images", "hits", "n", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            begin = 0
            for end in pc.run_end_encode(batch["class_id"]).run_ends.to_pylist():
                rows, begin = pa.table(batch.slice(begin, end - begin).columns, names=batch.schema.names), end
                if held is not None and held["class_id"][0].as_py() == rows["class_id"][0].as_py():
                    rows, held = pa.concat_tables([held, rows]), None
                if held is not None:
                    yield block(held, part, seq)
                    seq += 1
                while rows.num_rows >= BLOCK:
                    yield block(rows.slice(0, BLOCK), part, seq)
                    seq, rows = seq + 1, rows.slice(BLOCK)
                held = rows if rows.num_rows else None
        if held is not None:
            yield block(held, part, seq)

    order = [F.col("class_id"), F.desc("score"), F.col("det_id")]
    unit = F.coalesce(F.concat(F.col("image_id").cast("string"), F.lit(":")), F.lit(""))
    placed = detections.select("class_id", "score", "det_id", unit.alias("unit"), F.coalesce("hit", F.lit(0)).cast("int").alias("hit"))
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("class_id", "unit", "hit")
    kind = detections.schema["class_id"].dataType.simpleString()
    return stage_table(dealt.mapInArrow(cut, f"class_id {kind}, part int, seq long, weights binary, images binary, hits binary, n array<long>, t array<long>"), "blocks")


def _along_blocks(blocks: DataFrame, found: Callable[[np.ndarray, np.ndarray, dict], np.ndarray], name: str, width: int) -> DataFrame:
    """(part, seq, ``name``): what ``found`` makes of a block's hits: weights and precisions, a row a hit in order and a column a replicate, and the row."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                weights = np.frombuffer(row["weights"], np.uint8).reshape(-1, width)[np.frombuffer(row["images"], "<u2")]
                hit = np.frombuffer(row["hits"], bool)
                mine = weights[hit]
                n = np.asarray(row["n0"]) + np.cumsum(weights, axis=0, dtype=np.int64)[hit]
                t = np.asarray(row["t0"]) + np.cumsum(mine, axis=0, dtype=np.int64)
                out = found(mine, np.where(mine > 0, t / np.maximum(n, 1), 0.0), row)
                yield pa.record_batch([pa.array([row["part"]], pa.int32()), pa.array([row["seq"]]), pa.array([out])], names=["part", "seq", name])

    return blocks.drop("class_id", "n", "t").mapInArrow(act, f"part int, seq long, {name} array<double>")


def _replicate_aps(detections: DataFrame, numbers: range) -> DataFrame:
    """(replicate, class_id, ap) of some replicates, all counted along one order of the detections, block by block.

    Before a block is looked at, the sums of the blocks before it are known, and
    for the envelope the best precision of those after it: a row a block each.
    """
    width = len(numbers)
    blocks = _detection_blocks(detections, numbers)
    each = blocks.select("class_id", "part", "seq", F.posexplode(F.arrays_zip("n", "t")).alias("k", "s")).select("class_id", "part", "seq", "k", "s.*")
    order = Window.partitionBy("class_id", "k").orderBy("part", "seq").rowsBetween(*scan.BEFORE)
    ahead = Window.partitionBy("class_id", "k").orderBy(F.desc("part"), F.desc("seq")).rowsBetween(*scan.BEFORE)

    def packed(rows: DataFrame, *names: str) -> DataFrame:
        values = rows.groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("all"))  # a value a replicate
        return values.select("part", "seq", *[F.col(f"all.{c}").alias(c) for c in names])

    sums = each.select("part", "seq", "k", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}0") for c in "nt"])
    placed = stage_table(blocks.join(packed(sums, "n0", "t0"), ["part", "seq"]), "placed_blocks")
    best = _along_blocks(placed, lambda w, p, row: p.max(axis=0, initial=0.0), "best", width)
    best = placed.select("class_id", "part", "seq").join(stage_table(best, "best_of_blocks"), ["part", "seq"]).select("class_id", "part", "seq", F.posexplode("best").alias("k", "best"))
    later = best.select("part", "seq", "k", F.coalesce(F.max("best").over(ahead), F.lit(0.0)).alias("later"))

    def area(w: np.ndarray, p: np.ndarray, row: dict) -> np.ndarray:
        rising = np.maximum.accumulate(p[::-1], axis=0)[::-1]
        return (np.maximum(rising, np.asarray(row["later"])) * w).sum(axis=0)

    parts = stage_table(_along_blocks(placed.join(packed(later, "later"), ["part", "seq"]), area, "area", width), "areas")
    rows = placed.select("class_id", "part", "seq", "t").join(parts, ["part", "seq"]).select("class_id", F.posexplode(F.arrays_zip("area", "t")).alias("k", "s"))
    sums = rows.groupBy("class_id", "k").agg(F.try_divide(F.sum("s.area"), F.sum("s.t")).alias("ap"))
    return sums.where("ap IS NOT NULL").select((F.col("k") + numbers.start).alias("replicate"), "class_id", "ap")


# ---- curves, groups and thresholds


def reproduction(reported: DataFrame, measured: DataFrame) -> DataFrame:
    """Reported numbers (path, value, tol_abs, tol_rel) against measured ones (path, value; null where it could not be made): status and difference."""
    both = reported.join(measured.select("path", F.col("value").alias("measured"), F.lit(True).alias("_run")), "path", "left")
    gap, allowed = F.abs(F.col("measured") - F.col("value")), F.col("tol_abs") + F.col("tol_rel") * F.abs("value")
    status = F.when(F.col("_run").isNull(), "NOT_RUN").when(F.col("measured").isNull() | (gap > allowed), "NOT_REPRODUCED").otherwise("REPRODUCED")
    return both.select("path", F.col("value").alias("reported"), "measured", gap.alias("abs_diff"), status.alias("status"))


def pixel_curve(pixels: DataFrame, thresholds: list[float], group: str | None = None) -> DataFrame:
    """Per threshold (and group): confusion of ``score`` against ``truth`` and precision, recall, F1, F0.5, IoU and false positive rate.

    Pixels are counted once by the number of thresholds they reach; the curve
    adds those few counts up.
    """
    cuts = sorted(thresholds)
    keys = [group] if group else []
    reach = reduce(lambda a, t: a + (F.col("score") >= t).cast("int"), cuts, F.lit(0))
    bins = pixels.groupBy(*keys, reach.alias("reach")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    items = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("least")) for i, t in enumerate(cuts, 1)])
    rows = bins.withColumn("t", F.explode(items)).withColumn("over", F.col("reach") >= F.col("t.least"))
    s = lambda c, over: F.sum(F.when(F.col("over") == over, F.col(c)).otherwise(0))
    out = rows.groupBy(*keys, F.col("t.threshold").alias("threshold")).agg(s("pos", True).alias("tp"), s("neg", True).alias("fp"), s("pos", False).alias("fn"), s("neg", False).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b, none=0.0: F.when(b > 0, a / b).otherwise(none)
    out = out.withColumns({"precision": over(tp, tp + fp, 1.0), "recall": over(tp, tp + fn), "iou": over(tp, tp + fp + fn), "fpr": over(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": over(2 * p * r, p + r), "f05": over(1.25 * p * r, 0.25 * p + r)})


def best_threshold(curve: DataFrame, by: str, *keys: str) -> DataFrame:
    """The threshold of the greatest ``by``, the lower one on a tie."""
    return curve.groupBy(*keys).agg(F.max(F.struct(F.round(by, 9).alias("v"), -F.col("threshold"))).alias("b")).select(*keys, F.col("b.v").alias(by), (-F.col("b.col2")).alias("threshold"))


def group_summary(per_class: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group (group, class_id) of classes with truths: macro and truth-weighted mean of ``ap``; null values drop out of both."""
    rows = per_class.where("n_true > 0").join(groups, "class_id")
    weight = F.when(F.col("ap").isNotNull(), F.col("n_true"))
    return rows.groupBy("group").agg(F.count("*").alias("n_classes"), F.sum("n_true").alias("n_true"), F.avg("ap").alias("macro_ap"), (F.sum(F.col("ap") * F.col("n_true")) / F.sum(weight)).alias("weighted_ap"))


def operating_grid(points: DataFrame) -> DataFrame:
    """Macro F1 over classes at each threshold of ``evaluation.operating_points``, and the pooled counts there."""
    return points.groupBy("threshold").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def halves(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``tune``: true for the first half of the ids in a hashed order (the larger half of an odd number is for test)."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    total = ids.agg(F.floor(F.count("*") / 2).alias("_half"))
    return scan.positions(ids, order, "_at").crossJoin(F.broadcast(total)).withColumn("tune", F.col("_at") <= F.col("_half")).drop("_at", "_half")  # one row


def tuned_report(detections: DataFrame, images: DataFrame, thresholds: list[float], seed: int) -> DataFrame:
    """Per class: the threshold with the best F1 on the tuning images (the lower on a tie), and precision, recall and F1 at it on the others only."""
    from terratile.operators.evaluation import operating_points

    rows = detections.join(halves(images, "image_id", seed), "image_id")
    best = best_threshold(operating_points(rows.where("tune"), thresholds).fillna({"f1": 0.0}), "f1", "class_id").select("class_id", "threshold")
    test = operating_points(rows.where(~F.col("tune")), thresholds)
    return test.join(best, ["class_id", "threshold"]).select("class_id", "threshold", "tp", "fp", "fn", "precision", "recall", "f1")


# ---- explanations


def decomposition(cfg: change.Config = change.Config()) -> Column:
    """Array of (name, value, weight, factor, effect): the six terms and three multipliers of the confidence, and what each alone moved it by, in points.

    A factor is the term to its share of the weights; without it the confidence
    would be ``raw / factor``, within 0 and 1.
    """
    terms = change.confidence_terms(cfg)
    total = sum(w for _, _, w in terms)
    parts = [(name, value, w, F.pow(F.greatest(value, F.lit(1e-3)), F.lit(w / total))) for name, value, w in terms]
    parts += [(name, value, 0.0, value) for name, value in change.confidence_multipliers().items()]
    raw = reduce(lambda a, b: a * b, [p[3] for p in parts])
    final = clip(raw, 0.0, 1.0)
    effect = lambda f: F.when(f > 0, 100.0 * (final - clip(raw / f, 0.0, 1.0)))
    return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(float(w)).alias("weight"), f.cast("double").alias("factor"), effect(f).alias("effect")) for n, v, w, f in parts])


def explained(rows: DataFrame) -> DataFrame:
    """(candidate_id, name, value, weight, factor, effect, reproduces): the decomposition, and whether its product gives the stored ``confidence`` within 0.005."""
    parts = rows.select("candidate_id", "confidence", decomposition().alias("parts"))
    again = clip(F.aggregate("parts", F.lit(1.0), lambda a, p: a * p["factor"]), 0.0, 1.0)
    return parts.withColumn("reproduces", F.abs(again - F.col("confidence")) <= 0.005).select("candidate_id", "reproduces", F.inline("parts"))


def spectral_tests(rows: DataFrame, cfg: change.Config = change.Config()) -> DataFrame:
    """(candidate_id, type, test, value, threshold, met, decisive): every test of the typing rules; ``decisive`` are those of the type assigned."""
    nv, nb, nw, raw, long = (F.col(c) for c in ("ndvi_anomaly", "ndbi_anomaly", "ndwi_anomaly", "d_ndwi", "elongation"))
    tests = [
        ("water_gain", "ndwi anomaly at least", nw, cfg.ndwi_change, nw >= cfg.ndwi_change), ("water_gain", "ndwi change at least", raw, cfg.ndwi_least, raw >= cfg.ndwi_least),
        ("water_loss", "ndwi anomaly at most", nw, -cfg.ndwi_change, nw <= -cfg.ndwi_change), ("water_loss", "ndvi anomaly at most", nv, cfg.ndvi_flat, nv <= cfg.ndvi_flat),
        ("road", "ndbi anomaly at least", nb, cfg.road_ndbi_up, nb >= cfg.road_ndbi_up), ("road", "elongation at least", long, cfg.road_elongation, long >= cfg.road_elongation),
        ("construction", "ndbi anomaly at least", nb, cfg.ndbi_up, nb >= cfg.ndbi_up), ("construction", "ndvi anomaly at most", nv, cfg.ndvi_flat, nv <= cfg.ndvi_flat),
        ("clearance", "ndvi anomaly at most", nv, cfg.ndvi_down, nv <= cfg.ndvi_down), ("clearance", "ndbi anomaly below", F.abs(nb), cfg.ndbi_up, F.abs(nb) < cfg.ndbi_up),
    ]
    items = [F.struct(F.lit(k).alias("type"), F.lit(t).alias("test"), v.alias("value"), F.lit(float(c)).alias("threshold"), m.alias("met"), (F.col("change_type") == k).alias("decisive")) for k, t, v, c, m in tests]
    return rows.select("candidate_id", F.inline(F.array(*items)))


def stage_trace(rows: DataFrame) -> DataFrame:
    """(candidate_id, step, stage, verdict, factor): the eight stages a candidate passes, in order; gates without a weight have factor null."""
    gate = F.transform(
        F.array_sort("trace", lambda a, b: F.when(a["rule"] == b["rule"], 0).when(a["rule"] == "morphology", -1).when(b["rule"] == "morphology", 1).otherwise(0)),
        lambda t: F.struct(t["rule"].alias("stage"), F.when(t["verdict"] == "pass", "passed").when(t["verdict"] == "downweight", "downweighted").otherwise("rejected").alias("verdict"), F.when(t["verdict"] == "downweight", t["weight"]).cast("double").alias("factor")),
    )
    kind, seen = F.col("change_type"), F.col("persistence")
    support = F.when(seen.isin("transient", "inconsistent"), "demoted").when(seen == "none", "no_support").when(seen == "single_pair", "not_assessable").otherwise("supported")
    last = F.array(
        F.struct(F.lit("typing").alias("stage"), F.when(kind == "other", "unclassified").otherwise("typed").alias("verdict"), F.lit(None).cast("double").alias("factor")),
        F.struct(F.lit("persistence").alias("stage"), support.alias("verdict"), change.by_key(seen, change.PERSISTENCE_PENALTY, 1.0).alias("factor")),
        F.struct(F.lit("sar").alias("stage"), F.when(F.col("sar_available"), "applied").otherwise("unavailable").alias("verdict"), F.when(F.col("sar_available"), clip(F.col("sar"), 0.5, 1.15)).otherwise(1.0).cast("double").alias("factor")),
    )
    return rows.select("candidate_id", F.posexplode(F.concat(gate, last)).alias("step", "s")).select("candidate_id", "step", "s.*")


def ablation(rows: DataFrame, stages: dict[str, Column], group: str) -> DataFrame:
    """(group, stage, tp, fp, fn, tn, precision, recall, f1) as tests are added one by one; ``pooled`` over all groups comes with them.

    ``rows`` has ``truth`` and ``found`` (what the model says before any test).
    """
    keep, items = F.col("found"), []
    for step, (name, test) in enumerate({"raw": F.lit(True), **stages}.items()):
        keep = keep & test
        items.append(F.struct(F.lit(step).alias("step"), F.lit(name).alias("stage"), keep.alias("keep")))
    spread = rows.select(F.col(group).cast("string").alias(group), "truth", F.explode(F.array(*items)).alias("s")).select(group, "truth", "s.*")
    t, k = F.col("truth"), F.col("keep")
    per = spread.groupBy(group, "step", "stage").agg(F.count_if(t & k).alias("tp"), F.count_if(~t & k).alias("fp"), F.count_if(t & ~k).alias("fn"), F.count_if(~t & ~k).alias("tn"))
    pooled = per.groupBy("step", "stage").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).withColumn(group, F.lit("pooled"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per.unionByName(pooled).withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


# ---- vectors


def concept_labels(vectors: DataFrame, concepts: DataFrame, n: int = 3) -> DataFrame:
    """(label, rank, concept, cosine): the concepts (concept, embedding) whose vectors are most like each centroid; joined element by element."""
    cells = search.centroids(vectors).select("label", "pos", F.col("value").alias("x"))
    other = concepts.select("concept", F.posexplode("embedding").alias("pos", "y")).withColumn("y", F.col("y").cast("double"))
    met = cells.join(other, "pos").groupBy("label", "concept").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    scored = met.withColumn("cosine", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6))
    order = Window.partitionBy("label").orderBy(F.desc("cosine"), "concept")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("label", "rank", "concept", "cosine")


def uniform_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows that come first in a hashed order of their key, with ``total``, the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    picked = rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
    return picked.crossJoin(F.broadcast(total))  # one row


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, components): the first ``k`` principal components of each centred vector, fitted on all of them."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    return model.transform(centred).select("vec_id", vector_to_array("p").alias("components"))


# ---- training sets


def label_geometry(labels: DataFrame, size: float) -> DataFrame:
    """Adds ``norm`` (corners over ``size``, within 0 and 1), ``angle`` of the longest edge in [0, 180), ``deviation`` from the axes and ``upright``.

    ``labels`` has ``points``, four structs x, y in order round the box.
    """
    p = lambda i, c: F.col("points")[i % 4][c]
    edges = [F.struct(F.hypot(p(i + 1, "x") - p(i, "x"), p(i + 1, "y") - p(i, "y")).alias("n"), F.lit(-i).alias("i"), (p(i + 1, "x") - p(i, "x")).alias("dx"), (p(i + 1, "y") - p(i, "y")).alias("dy")) for i in range(4)]
    longest = F.greatest(*edges)  # the first of the longest
    angle = F.pmod(F.degrees(F.atan2(longest["dy"], longest["dx"])), F.lit(180.0))
    quarter = F.pmod(angle, F.lit(90.0))
    norm = F.flatten(F.transform("points", lambda q: F.array(clip(q["x"] / size, 0.0, 1.0), clip(q["y"] / size, 0.0, 1.0))))
    two = lambda c: F.size(F.array_distinct(F.transform("points", lambda q: F.round(q[c] * 1000).cast("long")))) == 2
    return labels.withColumns({"norm": norm, "angle": angle, "deviation": F.least(quarter, 90.0 - quarter), "upright": two("x") & two("y")})


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Four corners of a box by centre, sides and the angle of its width."""
    ux, uy, vx, vy = F.cos(angle) * w / 2, F.sin(angle) * w / 2, -F.sin(angle) * h / 2, F.cos(angle) * h / 2
    return F.array(*[F.struct((cx + a * ux + b * vx).alias("x"), (cy + a * uy + b * vy).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def image_boxes(boxes: DataFrame) -> DataFrame:
    """Chip boxes (cx, cy, w, h, angle, x_off, y_off) as the upright boxes that hold them, in coordinates of the whole image."""
    corners = rotated_corners(F.col("cx") + F.col("x_off"), F.col("cy") + F.col("y_off"), F.col("w"), F.col("h"), F.col("angle"))
    side = lambda f, c: f(F.transform("corners", lambda q: q[c]))
    rows = boxes.withColumn("corners", corners)
    return rows.withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}).drop("corners")


def holdout(objects: DataFrame, fraction: float, seed: int, cap: float = 2.0) -> DataFrame:
    """(image_id, class_id, held): images held out by class, the rarest first, whole images only.

    An image belongs to its rarest class; in hashed order those of a class are
    held while the objects of the class in them stay within ``fraction`` of all
    of the class.  A class of which more than ``cap`` times that would be held
    in all (in images of other classes too) loses its own held images.
    """
    counts = objects.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy("class_id").agg(F.sum("n").alias("total"))
    sized = counts.join(F.broadcast(totals), "class_id")  # a row a class
    own = sized.groupBy("image_id").agg(F.min(F.struct("total", "class_id", "n")).alias("m")).select("image_id", "m.*")
    order = [F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.lit(str(seed)))), F.col("image_id")]
    run = scan.running(own, ["class_id"], order, {"so_far": F.col("n")})
    first = run.withColumn("held", F.col("so_far") <= F.ceil(F.col("total") * fraction))
    held = sized.join(first.where("held").select("image_id"), "image_id", "left_semi").groupBy("class_id").agg(F.sum("n").alias("in_all"))
    over = held.join(totals, "class_id").where(F.col("in_all") > F.ceil(F.col("total") * fraction * cap)).select("class_id", F.lit(True).alias("_over"))
    return first.join(F.broadcast(over), "class_id", "left").select("image_id", "class_id", (F.col("held") & F.col("_over").isNull()).alias("held"))


def training_windows(windows: DataFrame, share: float, hard_share: float, most: int, seed: int) -> DataFrame:
    """(window_id, kind) of the windows trained on: positives of at most ``most`` labels, and background up to ``share`` of them.

    ``hard_share`` of the background are windows with distractors, the others
    any; where either runs short the other fills up.  Both go by a hashed order.
    """
    kind = F.when((F.col("n_labels") > 0) & (F.col("n_labels") <= most), "positive").when(F.col("n_labels") == 0, F.when(F.col("n_distractors") > 0, "negative_hard").otherwise("negative_random"))
    rows = windows.withColumn("kind", kind).where("kind IS NOT NULL")
    sizes = rows.agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in (("positive", "n_pos"), ("negative_hard", "n_hard"), ("negative_random", "n_easy"))])
    budget = F.round(F.col("n_pos") * share)
    hard = F.least(F.col("n_hard"), F.round(budget * hard_share))
    easy = F.least(F.col("n_easy"), budget - hard)
    sizes = sizes.select(F.least(F.col("n_hard"), budget - easy).alias("take_hard"), easy.alias("take_easy"))
    order = [F.md5(F.concat_ws(":", F.col("window_id").cast("string"), F.lit(str(seed)))), F.col("window_id")]
    placed = scan.running(rows.where("kind <> 'positive'"), ["kind"], order, {"at": F.lit(1)}).crossJoin(F.broadcast(sizes))  # one row
    drawn = placed.where(F.col("at") <= F.when(F.col("kind") == "negative_hard", F.col("take_hard")).otherwise(F.col("take_easy")))
    return rows.where("kind = 'positive'").select("window_id", "kind").union(drawn.select("window_id", "kind"))


def conversion_faults(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, n): images without a label file and the other way round, lines that have not nine fields, values outside 0 and 1, unknown classes, images in two splits.

    ``images``: image_id, split; ``labels``: image_id, line (class and eight coordinates).
    """
    files = labels.select("image_id").distinct().withColumn("_l", F.lit(1))
    pairs = images.select("image_id").distinct().withColumn("_i", F.lit(1)).join(files, "image_id", "full")
    parts = labels.where("line IS NOT NULL").withColumn("f", F.split(F.trim("line"), r"\s+"))
    values = F.transform(F.slice("f", 2, 8), lambda v: v.try_cast("double"))
    tests = {
        "image_without_labels": pairs.where("_l IS NULL"), "labels_without_image": pairs.where("_i IS NULL"), "not_nine_fields": parts.where(F.size("f") != 9),
        "value_out_of_range": parts.where((F.size("f") == 9) & F.exists(values, lambda v: F.coalesce(~v.between(0.0, 1.0), F.lit(True)))),
        "unknown_class": parts.where(F.coalesce(~F.col("f")[0].try_cast("int").between(0, 7), F.lit(True))),
        "image_in_two_splits": images.groupBy("image_id").agg(F.count_distinct("split").alias("n")).where("n > 1"),
    }
    return reduce(DataFrame.union, [df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")) for rule, df in tests.items()])


def repeat_list(chips: DataFrame, seed: int) -> DataFrame:
    """(place, chip_id, copy): each chip ``repeats`` times, all of them shuffled by a hash of chip, copy and seed."""
    copies = chips.select("chip_id", F.explode(F.sequence(F.lit(1), F.greatest("repeats", F.lit(1)))).alias("copy"))
    order = [F.md5(F.concat_ws(":", "chip_id", "copy", F.lit(str(seed)))), F.col("chip_id"), F.col("copy")]
    return scan.positions(copies, order, "place").select("place", "chip_id", "copy")


def split_report(chips: DataFrame) -> DataFrame:
    """Per split (image_id, n_labels, n_original, gsd): images, chips, positives, negatives, labels, share retained, density and least and largest ground sample distance."""
    rows = chips.groupBy("split").agg(
        F.count_distinct("image_id").alias("n_images"), F.count("*").alias("n_chips"), F.count_if(F.col("n_labels") > 0).alias("n_positive"), F.count_if(F.col("n_labels") == 0).alias("n_negative"),
        F.sum("n_labels").alias("n_labels"), F.sum("n_original").alias("n_original"), F.min("gsd").alias("least_gsd"), F.max("gsd").alias("most_gsd"),
    )
    return rows.withColumns({"retained_pct": F.round(100 * F.col("n_labels") / F.col("n_original"), 2), "density": F.round(F.col("n_labels") / F.col("n_positive"), 4)})


def split_quantiles(chips: DataFrame) -> DataFrame:
    """Per split the 10th, 50th and 90th percentile of the ground sample distance of its chips."""
    return scan.quantiles(chips, ["split"], "gsd", {"gsd_p10": 0.1, "gsd_p50": 0.5, "gsd_p90": 0.9})


def collapse_recovery(precisions: DataFrame) -> DataFrame:
    """Per condition (condition, query_id, raw, full, filtered): mean precisions, ``collapse`` = filtered - raw, ``recovered`` = full - raw, and the share of the collapse recovered (null if there is none)."""
    out = precisions.groupBy("condition").agg(*[F.avg(c).alias(c) for c in ("raw", "full", "filtered")])
    fall, back = F.col("filtered") - F.col("raw"), F.col("full") - F.col("raw")
    return out.select("*", fall.alias("collapse"), back.alias("recovered"), F.when(fall != 0, back / fall).alias("share_recovered"))
