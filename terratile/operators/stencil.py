"""Neighbourhood operators over pixel tables: gradients, slope, speckle filter, backscatter change.

A pixel table has one row a pixel (observation_id, y, x, values) of a full
grid.  Beyond the grid's edge the nearest pixel counts, as often as it is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import clip
from terratile.operators import scan

AT = ["observation_id", "y", "x"]
#: Derivative kernels, row by row from the top left (fixed values).
ACROSS = [-1.0, 0.0, 1.0, -2.0, 0.0, 2.0, -1.0, 0.0, 1.0]
DOWN = [-1.0, -2.0, -1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 1.0]
FLAT_DEG = 0.05
LOOKS = 4.4


def _bounds(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("observation_id").agg(*[f(c).alias(f"{c}{n}") for c in "yx" for n, f in ((0, F.min), (1, F.max))])


def _targets(axis: str) -> Column:
    """Where on an axis a pixel is met, and at which offset (-1, 0, 1) from there."""
    at, low, high = F.col(axis), F.col(f"{axis}0"), F.col(f"{axis}1")
    place = lambda t, d: F.struct(t.alias("t"), F.lit(d).alias("d"))
    inside = F.filter(F.array(*[place(at - d, d) for d in (-1, 0, 1)]), lambda p: p["t"].between(low, high))
    edges = F.filter(F.array(place(low, -1), place(high, 1)), lambda p: ((p["d"] == -1) & (at == low)) | ((p["d"] == 1) & (at == high)))
    return F.concat(inside, edges)


def gradients(pixels: DataFrame, value: str) -> DataFrame:
    """(observation_id, y, x, across, down): sums of the 3 x 3 derivative kernels round each pixel.

    Each pixel sends its value to the places that see it; partial sums are made before the shuffle.
    """
    sent = pixels.select(*AT, value).join(_bounds(pixels), "observation_id")
    sent = sent.select("observation_id", value, _targets("x").alias("tx"), F.explode(_targets("y")).alias("ty"))
    sent = sent.select("observation_id", value, "ty", F.explode("tx").alias("tx"))
    spot = (F.col("ty.d") + 1) * 3 + F.col("tx.d") + 2
    weight = lambda kernel: F.element_at(F.array(*map(F.lit, kernel)), spot)
    return sent.groupBy("observation_id", F.col("ty.t").alias("y"), F.col("tx.t").alias("x")).agg(
        F.sum(F.col(value) * weight(ACROSS)).alias("across"), F.sum(F.col(value) * weight(DOWN)).alias("down")
    )


def edge_density(pixels: DataFrame, value: str, side: int = 256, least: float = 0.10) -> DataFrame:
    """Per tile the share of pixels whose gradient (by pixel) exceeds ``least``."""
    size = F.hypot("across", "down") / 8.0
    tiles = gradients(pixels, value).groupBy("observation_id", F.floor(F.col("y") / side).alias("row_no"), F.floor(F.col("x") / side).alias("col_no"))
    return tiles.agg(F.count("*").alias("n_pixels"), F.avg((size > least).cast("double")).alias("edge_density"))


def slope_aspect(pixels: DataFrame, value: str, pixel_m: float = 10.0) -> DataFrame:
    """Slope in degrees and compass bearing of the way down; the bearing is -1 where the slope is below 0.05 degrees."""
    slopes = gradients(pixels, value).withColumns({c: F.col(c) / (8.0 * pixel_m) for c in ("across", "down")})
    slope = F.degrees(F.atan(F.hypot("across", "down")))
    bearing = F.pmod(270.0 - F.degrees(F.atan2(-F.col("down"), F.col("across"))), F.lit(360.0))
    return slopes.select(*AT, slope.alias("slope"), F.when(slope < FLAT_DEG, -1.0).otherwise(bearing).alias("aspect"))


def box_sums(pixels: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """Adds sums of ``values`` over the (2 radius + 1)-square round each pixel: a window along rows, then one along columns.

    A window holds one line of one grid, so its length is the grid's side.
    """
    rows = pixels.withColumns(values)
    for axis, other in (("x", "y"), ("y", "x")):
        line = Window.partitionBy("observation_id", other)
        near, whole = line.orderBy(axis).rangeBetween(-radius, radius), line.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({"_low": F.min(axis).over(line), "_high": F.max(axis).over(line)})
        before = F.greatest(F.lit(radius) - (F.col(axis) - F.col("_low")), F.lit(0))
        after = F.greatest(F.lit(radius) - (F.col("_high") - F.col(axis)), F.lit(0))
        rows = rows.withColumns({k: F.sum(k).over(near) + before * F.first(k).over(whole) + after * F.last(k).over(whole) for k in values}).drop("_low", "_high")
    return rows


def speckle_filtered(pixels: DataFrame, intensity: str, valid: Column, out: str, radius: int = 3, looks: float = LOOKS) -> DataFrame:
    """Adds ``out``: the local mean plus the deviation, weighted by how far local variation exceeds that of speckle; null where not valid."""
    x = F.when(valid, F.col(intensity).cast("double")).otherwise(0.0)
    rows = box_sums(pixels, {"_n": valid.cast("double"), "_s": x, "_q": x * x}, radius)
    mean, square = F.col("_s") / F.col("_n"), F.col("_q") / F.col("_n")
    seen = F.greatest(square - mean * mean, F.lit(0.0)) / F.greatest(mean * mean, F.lit(1e-12))
    weight = clip(1.0 - (1.0 / looks) / F.greatest(seen, F.lit(1e-12)), 0.0, 1.0)
    return rows.withColumn(out, F.when(valid, mean + weight * (F.col(intensity) - mean))).drop("_n", "_s", "_q")


def backscatter_change(pixels: DataFrame, earlier: str, later: str, speckle: bool = True, limit_db: float = 25.0) -> DataFrame:
    """(observation_id, y, x, db): 10 log10 of the intensity ratio of two amplitudes (0: no data), clipped; null where either lacks data."""
    valid = (F.col(earlier) > 0) & (F.col(later) > 0)
    rows = pixels.select(*AT, earlier, later).withColumns({"_i1": F.col(earlier) * F.col(earlier), "_i2": F.col(later) * F.col(later)})
    if speckle:
        for c in ("_i1", "_i2"):
            rows = speckle_filtered(rows, c, valid, c + "f")
    else:
        rows = rows.withColumns({"_i1f": F.col("_i1"), "_i2f": F.col("_i2")})
    db = 10.0 * F.log10(F.col("_i2f") / F.col("_i1f"))
    return rows.select(*AT, F.when(valid, clip(db, -limit_db, limit_db)).alias("db"))


def change_summary(rows: DataFrame, *group: str, least: int = 10) -> DataFrame:
    """Per group: pixels with data, median, mean, 16th and 84th percentile of ``db``, and whether there are enough of them."""
    counts = rows.groupBy(*group).agg(F.count("db").alias("n_px"), F.avg("db").alias("mean_db"), (F.count("db") >= least).alias("available"))
    cut = scan.quantiles(rows, list(group), "db", {"median_db": 0.5, "p16_db": 0.16, "p84_db": 0.84})
    return counts.join(cut, list(group), "left") if group else counts.crossJoin(F.broadcast(cut))  # one row
