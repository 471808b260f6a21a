"""Pixel-table operators: indices, tile statistics, stencils and components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions import polygons
from terratile.functions.columns import clip, normalised_difference
from terratile.operators import scan
from terratile.operators.graph import connected_components
from terratile.storage import broadcast_if_small, stage_table

#: Scene classes that count as clear ground (fixed values).
CLEAR = [4, 5, 6, 7]


def with_indices(pixels: DataFrame) -> DataFrame:
    b03, b04, b08, b11 = (F.col(b) for b in ("b03", "b04", "b08", "b11"))
    pairs = {"ndvi": (b08, b04), "ndwi": (b03, b08), "ndbi": (b11, b08)}
    return pixels.withColumns({k: normalised_difference(a, b) for k, (a, b) in pairs.items()})


def tile_statistics(pixels: DataFrame, side: int = 256) -> DataFrame:
    """Per tile of the grid: pixels, bad share, and over clear pixels mean, deviation, percentiles and class shares."""
    rows = with_indices(pixels).withColumn("row_no", F.floor(F.col("y") / side)).withColumn("col_no", F.floor(F.col("x") / side))
    ok = F.col("scl").isin(*CLEAR)
    rows = rows.withColumns({k: F.when(ok, F.col(k)) for k in ("ndvi", "ndwi", "ndbi")})
    stats = [F.round(f(c), 6).alias(f"{c}_{n}") for c in ("ndvi", "ndwi", "ndbi") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    shares = {
        "water_frac": F.col("ndwi") > 0.0, "veg_frac": F.col("ndvi") > 0.35, "dense_veg_frac": F.col("ndvi") > 0.55,
        "built_frac": (F.col("ndbi") > -0.05) & (F.col("ndvi") < 0.30) & (F.col("ndwi") < 0.0),
    }
    return rows.groupBy("observation_id", "row_no", "col_no").agg(
        F.count("*").alias("n_pixels"), F.count_if(ok).alias("n_valid"), F.round(F.avg((~ok).cast("int")), 6).alias("bad_frac"), *stats,
        F.round(F.percentile("ndvi", 0.5), 6).alias("ndvi_p50"), *[F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in shares.items()],
    )


def window_mean(pixels: DataFrame, value: str) -> DataFrame:
    """Mean of positive values in the 3 x 3 window round each pixel: sums of three along rows, then of three of these along columns."""
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    sums = pixels.where(F.col(value) > 0).select("observation_id", "y", "x", F.col(value).alias("total"), F.lit(1).cast("long").alias("n"))
    for axis in ("x", "y"):
        sums = sums.select("*", step.alias("_step")).withColumn(axis, F.col(axis) + F.col("_step"))
        sums = sums.groupBy("observation_id", "y", "x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return pixels.select("observation_id", "y", "x").join(sums, ["observation_id", "y", "x"]).select("observation_id", "y", "x", "n", (F.col("total") / F.col("n")).alias("mean"))


def local_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of the distinct pixels, sorted by (y, x), the place of the first pixel of its 8-connected component."""
    width = int(x.max()) + 2 if len(x) else 1
    key = y * width + x
    ends = []
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(key, key + step)
        met = np.flatnonzero(np.append(key, -1)[at] == key + step)
        ends.append((met, at[met]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # roots hook to the least root next to them
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(mask: DataFrame, side: int = 256) -> DataFrame:
    """8-connected components of (observation_id, y, x): label_y, label_x is the component's first pixel by (y, x).

    Two levels: the pixels of a square of ``side`` are labelled in one task, and
    only pixels on the squares' borders make edges between labels, which are
    contracted; so what is written grows with the borders.
    """
    cells = mask.select("observation_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    square = {"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)}

    def label(pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.sort_values(["y", "x"], ignore_index=True)
        y, x = pixels["y"].to_numpy(), pixels["x"].to_numpy()
        first = local_components(y - y.min(), x - x.min())
        return pixels[["observation_id", "y", "x"]].assign(ry=y[first], rx=x[first])

    kind = cells.schema["observation_id"].dataType.simpleString()
    local = cells.withColumns(square).groupBy("observation_id", "ty", "tx").applyInPandas(label, f"observation_id {kind}, y long, x long, ry long, rx long")
    local = stage_table(local, "local_labels")
    at_y, at_x = F.pmod("y", F.lit(side)), F.pmod("x", F.lit(side))
    border = local.where((at_y == 0) | (at_y == side - 1) | (at_x == 0) | (at_x == side - 1))
    root = F.struct("observation_id", "ry", "rx")
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = border.select(root.alias("a"), "observation_id", "y", "x", ahead.alias("s"))
    near = near.select("a", "observation_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    edges = near.join(border.select("observation_id", "y", "x", root.alias("b")), ["observation_id", "y", "x"]).select("a", "b").where("a <> b")
    roots = stage_table(connected_components(edges).toDF("a", "root"), "border_roots")
    best = roots.groupBy("root").agg(F.min("a").alias("label"))  # the least first pixel of any square is that of the whole
    moved = roots.join(best, "root").select(F.col("a.observation_id").alias("observation_id"), F.col("a.ry").alias("ry"), F.col("a.rx").alias("rx"), "label")
    out = local.join(broadcast_if_small(stage_table(moved, "labels"), 64), ["observation_id", "ry", "rx"], "left")
    return out.select("observation_id", "y", "x", F.coalesce("label.ry", "ry").alias("label_y"), F.coalesce("label.rx", "rx").alias("label_x"))


def component_shapes(labelled: DataFrame, min_px: int = 1) -> DataFrame:
    """Per component: area, box and fill ratio."""
    rows = labelled.groupBy("observation_id", "label_y", "label_x").agg(
        F.count("*").alias("area_px"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    box = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return rows.where(F.col("area_px") >= min_px).withColumn("fill", F.round(F.col("area_px") / box, 6))


def range_summary(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Per group: least, 2nd percentile, mean, median, 98th percentile and greatest of the values there are."""
    cut = {"p2": 0.02, "median": 0.5, "p98": 0.98}
    ends = rows.groupBy(*group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return ends.join(scan.quantiles(rows, list(group), value, cut), list(group))


def band_reliability(rows: DataFrame, pairs: list[tuple[str, str]], *group: str) -> DataFrame:
    """Per group the worst correlation of the band pairs, and the reliability that follows: clip((c - 0.55) / 0.35, 0.5, 1)."""
    worst = [F.corr(a, b) for a, b in pairs]
    out = rows.groupBy(*group).agg((F.least(*worst) if len(worst) > 1 else worst[0]).alias("min_corr"))
    return out.withColumn("reliability", clip((F.col("min_corr") - 0.55) / 0.35, 0.5, 1.0))


def stretched_difference(rows: DataFrame, a: str, b: str, *group: str, least: float = 0.1) -> DataFrame:
    """Per group, of two bands each stretched between its 2nd and 98th percentile: mean absolute difference, share above ``least``, correlation."""
    one, two = (scan.quantiles(rows, list(group), c, {f"_{c}_low": 0.02, f"_{c}_high": 0.98}) for c in (a, b))
    met = rows.join(stage_table(one.join(two, list(group)), "stretch"), list(group))
    low, high = (lambda c, n=n: F.col(f"_{c}_{n}") for n in ("low", "high"))
    stretch = lambda c: F.when(high(c) > low(c), clip((F.col(c) - low(c)) / (high(c) - low(c)), 0.0, 1.0)).otherwise(0.0)
    met = met.select(*group, stretch(a).alias("a"), stretch(b).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return met.groupBy(*group).agg(F.avg(gap).alias("mean_abs"), F.avg((gap > least).cast("double")).alias("share_above"), F.corr("a", "b").alias("corr"))


def component_features(labelled: DataFrame, prob: DataFrame, min_px: int = 50) -> DataFrame:
    """Per component of at least ``min_px``: area, box, centre, mean and largest probability, elongation and fill.

    Elongation is the square root of the ratio of the eigenvalues (1e-6 at least) of the
    sample covariance of the pixels' places; 1 below three pixels.  Probabilities
    are summed as whole millionths, so their mean hangs on no order.
    """
    vy, vx, cov = F.var_samp("y"), F.var_samp("x"), F.covar_samp("y", "x")
    half, root = (vy + vx) / 2, F.sqrt(F.pow((vy - vx) / 2, 2) + cov * cov)
    high, low = F.greatest(half + root, F.lit(1e-6)), F.greatest(half - root, F.lit(1e-6))
    rows = labelled.join(prob, ["observation_id", "y", "x"]).groupBy("observation_id", "label_y", "label_x").agg(
        F.count("*").alias("area_px"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        (F.sum(F.round(F.col("prob") * 1e6).cast("long")) / (F.count("*") * 1e6)).alias("mean_prob"), F.max("prob").alias("max_prob"), F.when(F.count("*") < 3, 1.0).otherwise(F.sqrt(high / low)).alias("elongation"),
    )
    box = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return rows.where(F.col("area_px") >= min_px).withColumn("fill", F.col("area_px") / box)


def largest_first(features: DataFrame, least_px: int, most: int = 20_000) -> DataFrame:
    """The ``most`` largest components of at least ``least_px`` with their ``rank``: by area, then observation and first pixel."""
    order = [F.desc("area_px"), F.col("observation_id"), F.col("label_y"), F.col("label_x")]
    top = features.where(F.col("area_px") >= least_px).orderBy(*order).limit(most)  # the feature: a cut list
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def window_plan(images: DataFrame, size: int = 1024, stride: int = 824) -> DataFrame:
    """(image_id, x0, y0): window origins that cover each image; the last of a row or column ends at the edge."""
    origins = lambda d: F.when(d <= size, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_union(F.sequence(F.lit(0).cast("long"), F.greatest(d - size, F.lit(0)).cast("long"), F.lit(stride).cast("long")), F.array((d - size).cast("long")))
    )
    rows = images.select("image_id", F.explode(origins(F.col("height"))).alias("y0"), origins(F.col("width")).alias("xs"))
    return rows.select("image_id", F.explode("xs").alias("x0"), "y0")


def window_boxes(images: DataFrame, boxes: DataFrame, size: int = 1024, stride: int = 824) -> DataFrame:
    """(image_id, x0, y0, box_id, class_id, kept, visible, cover): the windows of an image that a box (image_id, box_id, class_id, kept, ring) reaches into.

    ``visible``: share of the ring's area inside the window; ``cover``: the same of
    its extent.  Which windows they are follows from the numbers of the origins,
    so a box meets only its own.  Rings without area reach into none.
    """
    placed = boxes.withColumns({**polygons.extent(F.col("ring")), "_whole": polygons.area(F.col("ring"))}).withColumnsRenamed({"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"})
    rows = placed.join(images.select("image_id", "width", "height"), "image_id")

    def origins(low: str, high: str, length: str) -> Column:
        last = F.greatest(F.col(length) - size, F.lit(0)).cast("long")
        first = F.greatest(F.floor((F.col(low) - size) / stride) + 1, F.lit(0))
        stop = F.least(F.ceil(F.col(high) / stride) - 1, F.floor(last / stride))
        inner = F.when(first <= stop, F.transform(F.sequence(first, F.greatest(first, stop)), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
        return F.filter(F.array_union(inner, F.array(last)), lambda o: (o < F.col(high)) & (o + size > F.col(low)))

    rows = rows.select("*", F.explode(origins("bx0", "bx1", "width")).alias("x0")).select("*", F.explode(origins("by0", "by1", "height")).alias("y0"))
    window = polygons.upright(F.col("x0"), F.col("y0"), F.col("x0") + size, F.col("y0") + size)
    inside = (F.col("bx0") >= F.col("x0")) & (F.col("bx1") <= F.col("x0") + size) & (F.col("by0") >= F.col("y0")) & (F.col("by1") <= F.col("y0") + size)
    # rings that lie inside go without their points
    rows = rows.withColumn("_inside", inside).withColumn("_common", polygons.common_area(F.when(~F.col("_inside"), F.col("ring")), window))
    visible = F.when(F.col("_whole") > 1e-6, F.when(F.col("_inside"), 1.0).otherwise(F.col("_common") / F.col("_whole")))
    along = lambda low, high, o: F.least(F.col(high), F.col(o) + size) - F.greatest(F.col(low), F.col(o))
    cover = along("bx0", "bx1", "x0") * along("by0", "by1", "y0") / F.greatest((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")), F.lit(1e-6))
    return rows.select("image_id", "x0", "y0", "box_id", "class_id", "kept", visible.alias("visible"), cover.alias("cover")).where("visible > 0")


def window_labels(images: DataFrame, boxes: DataFrame, size: int = 1024, stride: int = 824, least: float = 0.6, distractor: float = 0.5) -> DataFrame:
    """Every window (image_id, x0, y0) with ``n_boxes``, the kept boxes visible by ``least`` or more, and ``n_distractors``, the others whose extent is covered by ``distractor``."""
    met = window_boxes(images, boxes, size, stride)
    counts = met.groupBy("image_id", "x0", "y0").agg(
        F.count_if(F.col("kept") & (F.col("visible") >= least - 1e-9)).alias("n_boxes"), F.count_if(~F.col("kept") & (F.col("cover") >= distractor - 1e-9)).alias("n_distractors")
    )
    return window_plan(images, size, stride).join(counts, ["image_id", "x0", "y0"], "left").na.fill(0, ["n_boxes", "n_distractors"])
