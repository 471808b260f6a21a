"""Radiometric normalisation of a later date to an earlier one, unchanged tiles and its acceptance; distances, tiling and samples of pixel tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import clip, normalised_difference
from terratile.operators import raster, scan
from terratile.storage import stage_table

#: Scene classes that are no ground: no data, saturated, shadow, cloud and snow; and water (fixed values).
BAD_CLASSES, WATER_CLASS = [0, 1, 3, 8, 9, 10, 11], 6
#: Limits of the gain of a clamped fit, distance where there is no water, and the tiers of an unchanged tile.
GAIN_LIMITS, NO_WATER_M = (0.85, 1.15), 1e6
TIERS = [(0.04, 0.04, 0.06), (0.06, 0.06, 0.09), (0.09, 0.09, 0.13)]
MAD = 1.4826


def invariant_pixels(pairs: DataFrame, bands: list[str], max_ndvi: float = 0.25, min_nir: float = 400.0, stable: float = 1.0, group: str = "pair_id") -> DataFrame:
    """Pixels very likely unchanged: all bands above 0, ground and no water, hardly green and bright in b08, at both dates.

    ``pairs`` has ``ref_`` and ``sub_`` columns of each band and of scl.  With
    ``stable`` below 1 only that share stays, by the least sum of relative
    differences after each band is matched by the ratio of its medians.
    """
    both = lambda test: test("ref_") & test("sub_")
    ndvi = lambda d: normalised_difference(F.col(f"{d}b08"), F.col(f"{d}b04"))
    tests = [both(lambda d, b=b: F.col(f"{d}{b}") > 0) for b in bands]
    tests += [both(lambda d: ~F.col(f"{d}scl").isin(*BAD_CLASSES, WATER_CLASS)), both(lambda d: F.abs(ndvi(d)) < max_ndvi), both(lambda d: F.col(f"{d}b08") > min_nir)]
    rows = pairs
    for t in tests:
        rows = rows.where(t)
    if stable >= 1:
        return rows
    columns = [f"{d}{b}" for b in bands for d in ("ref_", "sub_")]
    single = rows.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(group, "x.*")
    middle = scan.quantiles(single, [group, "column"], "v", {"middle": 0.5})  # of all bands and dates at once
    rows = rows.join(middle.groupBy(group).agg(*[F.max(F.when(F.col("column") == c, F.col("middle"))).alias(f"_{c}") for c in columns]), group)
    gap = sum((F.abs(F.col(f"ref_{b}") - F.col(f"_ref_{b}") / F.greatest(f"_sub_{b}", F.lit(1e-6)) * F.col(f"sub_{b}")) / (F.col(f"ref_{b}") + 1.0) for b in bands), F.lit(0.0))
    rows = rows.withColumn("_gap", gap)
    cut = scan.quantiles(rows, [group], "_gap", {"_cut": stable})
    return rows.join(cut, group).where("_gap <= _cut").select(*pairs.columns)


def _line(rows: DataFrame, keys: list[str], method: str) -> DataFrame:
    """(keys, gain, offset) of y = gain * x + offset."""
    cov = F.covar_pop("x", "y")
    stats = rows.groupBy(*keys).agg(cov.alias("c"), F.var_pop("x").alias("vx"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.when(F.col("vx") > 0, F.col("c") / F.col("vx")).otherwise(1.0)
    gain = {"additive": F.lit(1.0), "ols": slope, "rma": F.when(F.col("sx") > 0, F.when(F.col("c") >= 0, 1.0).otherwise(-1.0) * F.col("sy") / F.col("sx")).otherwise(1.0), "clamped": clip(slope, *GAIN_LIMITS)}[method]
    stats = stats.withColumn("gain", gain)
    if method in ("ols", "rma"):
        return stats.select(*keys, "gain", (F.col("my") - F.col("gain") * F.col("mx")).alias("offset"))
    rest = rows.join(stats.select(*keys, "gain"), keys).withColumn("_d", F.col("y") - F.col("gain") * F.col("x"))
    return stats.select(*keys, "gain").join(scan.quantiles(rest, keys, "_d", {"offset": 0.5}), keys)


def fit_bands(rows: DataFrame, keys: list[str], method: str = "additive", n_sigma: float = 2.5, rounds: int = 3) -> DataFrame:
    """(keys, gain, offset, r2, corr, n, rmse): the line of y (reference) over x (subject) of each group.

    Each round drops rows whose residual is further from the median residual than
    ``n_sigma`` deviations, unless that would leave under 100 rows or half of them.
    """
    kept = rows
    fit = _line(kept, keys, method)
    for _ in range(rounds):
        away = kept.join(fit, keys).withColumn("_r", F.col("y") - F.col("gain") * F.col("x") - F.col("offset"))
        limits = scan.quantiles(away, keys, "_r", {"_mid": 0.5}).join(away.groupBy(*keys).agg(F.stddev_pop("_r").alias("_s"), F.count("*").alias("_n")), keys)
        near = away.join(limits, keys).withColumn("_near", F.abs(F.col("_r") - F.col("_mid")) <= n_sigma * F.col("_s"))
        enough = near.groupBy(*keys).agg((F.count_if("_near") >= F.greatest(F.lit(100), F.max("_n") * 0.5)).alias("_go"))
        kept = near.join(enough, keys).where("_near OR NOT _go OR _s <= 1e-9").select(*rows.columns)
        fit = _line(kept, keys, method)
    away = kept.join(fit, keys).withColumn("_r", F.col("y") - F.col("gain") * F.col("x") - F.col("offset"))
    out = away.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("_e"), (F.var_pop("y") * F.count("*")).alias("_t"), F.corr("x", "y").alias("corr"))
    out = out.withColumns({"r2": F.when(F.col("_t") > 0, 1 - F.col("_e") / F.col("_t")), "rmse": F.sqrt(F.col("_e") / F.col("n"))}).drop("_e", "_t")
    return fit.join(out, keys)


def offset_grid(pixels: DataFrame, block: int, least: int, shrink: float = 0.0, deadband: float = 0.0, sigma: float = 0.8) -> DataFrame:
    """(observation_id, by, bx, own, offset): the median of y - x of each block, smoothed over the grid and held between 0 and the block's own.

    ``own`` is shrunk by |d| / (|d| + shrink * MAD), and 0 within ``deadband``
    MADs or with under ``least`` pixels.  Smoothing is a Gaussian of ``sigma``
    blocks cut off at 4; beyond the grid its edge counts.  A block has
    ``block`` * ``block`` pixels at most, so its median is taken in one task.
    """
    at = ["observation_id", "by", "bx"]
    rows = pixels.select("observation_id", F.floor(F.col("y_px") / block).alias("by"), F.floor(F.col("x_px") / block).alias("bx"), (F.col("y") - F.col("x")).alias("d"))
    mid = rows.groupBy(*at).agg(F.percentile("d", 0.5).alias("m"), F.count("*").alias("n"))
    mad = rows.join(mid, at).groupBy(*at).agg((F.percentile(F.abs(F.col("d") - F.col("m")), 0.5) * MAD).alias("mad"))
    size = F.abs("m")
    own = F.when((F.col("n") < least) | (size < deadband * F.col("mad")), 0.0).otherwise(F.when(size > 0, F.col("m") * size / (size + shrink * F.col("mad"))).otherwise(0.0))
    grid = mid.join(mad, at).select(*at, own.alias("own"))
    ends = grid.groupBy("observation_id").agg(*[f(c).alias(f"{c}{k}") for c in ("by", "bx") for k, f in ((0, F.min), (1, F.max))])
    reach = int(4 * sigma + 0.5)
    steps = [(d, float(np.exp(-d * d / (2 * sigma * sigma)))) for d in range(-reach, reach + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(u * v).alias("w")) for a, u in steps for b, v in steps]))
    spot = lambda c, d: F.least(F.greatest(F.col(c) + F.col(d), F.col(f"{c}0")), F.col(f"{c}1"))
    asked = grid.join(ends, "observation_id").withColumn("s", step).select(*at, spot("by", "s.dy").alias("fy"), spot("bx", "s.dx").alias("fx"), "s.w")
    seen = asked.join(grid.select("observation_id", F.col("by").alias("fy"), F.col("bx").alias("fx"), F.col("own").alias("v")), ["observation_id", "fy", "fx"])
    smooth = seen.groupBy(*at).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("smooth"))
    low, high = F.least(F.lit(0.0), F.col("own")), F.greatest(F.lit(0.0), F.col("own"))
    return grid.join(smooth, at).select(*at, "own", F.least(F.greatest("smooth", low), high).alias("offset"))


def corner_offsets(grid: DataFrame) -> DataFrame:
    """(observation_id, by, bx, q00, q01, q10, q11): the offsets at the corners of each square between block middles, the edge repeated outside."""
    ends = grid.groupBy("observation_id").agg(*[f(c).alias(f"{c}{k}") for c in ("by", "bx") for k, f in ((0, F.min), (1, F.max))])
    squares = ends.select("*", F.explode(F.sequence(F.col("by0") - 1, F.col("by1"))).alias("by")).select("*", F.explode(F.sequence(F.col("bx0") - 1, F.col("bx1"))).alias("bx"))
    for i in (0, 1):
        for j in (0, 1):
            y, x = (F.least(F.greatest(F.col(c) + d, F.col(f"{c}0")), F.col(f"{c}1")) for c, d in (("by", i), ("bx", j)))
            asked = squares.withColumns({"_y": y, "_x": x})
            here = grid.select("observation_id", F.col("by").alias("_y"), F.col("bx").alias("_x"), F.col("offset").alias(f"q{i}{j}"))
            squares = asked.join(here, ["observation_id", "_y", "_x"], "left").withColumn(f"q{i}{j}", F.coalesce(f"q{i}{j}", F.lit(0.0))).drop("_y", "_x")
    return squares.select("observation_id", "by", "bx", "q00", "q01", "q10", "q11")


def normalised(pixels: DataFrame, fits: DataFrame, grid: DataFrame, block: int) -> DataFrame:
    """``pixels`` (observation_id, y_px, x_px, dn) with ``dn_norm``: gain * dn + the bilinear offset, at least 0, rounded; no data (0) stays 0."""
    gy, gx = ((F.col(c) + 0.5) / block - 0.5 for c in ("y_px", "x_px"))
    rows = pixels.withColumns({"by": F.floor(gy), "bx": F.floor(gx), "_fy": gy - F.floor(gy), "_fx": gx - F.floor(gx)})
    rows = rows.join(corner_offsets(grid), ["observation_id", "by", "bx"], "left").join(fits.select("observation_id", "gain"), "observation_id")
    q = lambda n: F.coalesce(n, F.lit(0.0))
    top = q("q00") * (1 - F.col("_fx")) + q("q01") * F.col("_fx")
    low = q("q10") * (1 - F.col("_fx")) + q("q11") * F.col("_fx")
    out = F.col("gain") * F.col("dn") + top * (1 - F.col("_fy")) + low * F.col("_fy")
    return rows.withColumn("dn_norm", F.when(F.col("dn") == 0, 0.0).otherwise(F.round(F.greatest(out, F.lit(0.0))))).select(*pixels.columns, "dn_norm")


def unchanged_tiles(pairs: DataFrame, side: int) -> DataFrame:
    """Tiles that pass the filters at both dates with their changes, likeness and ``tier`` (0 strictest; null: changed).

    Filters: 99 % valid, at most 0.5 % water and 1 % bad classes at either date, b08 varying by at most 45 %.
    """
    bands = ("b04", "b08", "b11")
    ok = F.lit(True)
    for d in ("ref_", "sub_"):
        for b in bands:
            ok = ok & (F.col(f"{d}{b}") > 0)
    v = lambda c: F.when(ok, F.col(c))
    index = lambda d, a, b: F.avg(F.when(ok, normalised_difference(F.col(d + a), F.col(d + b))))
    share = lambda test: F.avg(test.cast("double"))
    tiles = pairs.groupBy("pair_id", F.floor(F.col("y") / side).alias("row_no"), F.floor(F.col("x") / side).alias("col_no")).agg(
        share(ok).alias("valid"), F.greatest(*[share(F.col(f"{d}scl") == WATER_CLASS) for d in ("ref_", "sub_")]).alias("water"), F.greatest(*[share(F.col(f"{d}scl").isin(*BAD_CLASSES)) for d in ("ref_", "sub_")]).alias("bad"),
        (F.stddev_pop(v("sub_b08")) / F.greatest(F.avg(v("sub_b08")), F.lit(1.0))).alias("cv"),
        F.abs(index("ref_", "b08", "b04") - index("sub_", "b08", "b04")).alias("d_ndvi"), F.abs(index("ref_", "b11", "b08") - index("sub_", "b11", "b08")).alias("d_ndbi"),
        *[(F.abs(F.avg(v(f"ref_{b}")) - F.avg(v(f"sub_{b}"))) / F.greatest(0.5 * (F.avg(v(f"ref_{b}")) + F.avg(v(f"sub_{b}"))), F.lit(1.0))).alias(f"d_{b}") for b in ("b08", "b11")],
        sum((F.coalesce(F.corr(v(f"ref_{b}"), v(f"sub_{b}")), F.lit(0.0)) for b in ("b08", "b11")), F.lit(0.0)).alias("likeness"),
    )
    tier = F.lit(None).cast("int")
    for k, (a, b, c) in reversed(list(enumerate(TIERS))):
        tier = F.when((F.col("d_ndvi") <= a) & (F.col("d_ndbi") <= b) & (F.col("d_b08") <= c) & (F.col("d_b11") <= c), k).otherwise(tier)
    return tiles.where("valid >= 0.99 AND water <= 0.005 AND bad <= 0.01 AND cv <= 0.45").withColumn("tier", tier)


def spaced_pick(tiles: DataFrame, n: int = 5) -> list:
    """Up to ``n`` tiles (rows) of one pair, most alike first: at least 6 tiles apart, then 3, then any; of the strictest tier that gives min(n, 3).

    A pick is one partially aggregated pass; only the picks reach the driver.
    """
    best = F.max(F.struct("likeness", -F.col("row_no"), -F.col("col_no")))
    picks: list = []
    tiles = stage_table(tiles.select("row_no", "col_no", "likeness", "tier"), "tiles_to_pick")  # worked out once, not for each pick
    for tier in range(len(TIERS)):
        pool, picks = tiles.where(F.col("tier") <= tier), []
        for apart in (6, 3, 1):
            while len(picks) < n:
                left = pool
                for p in picks:
                    left = left.where(F.greatest(F.abs(F.col("row_no") - p["row_no"]), F.abs(F.col("col_no") - p["col_no"])) >= apart)
                top = left.agg(best.alias("b")).first()["b"]
                if top is None:
                    break
                picks.append({"row_no": -top[1], "col_no": -top[2], "likeness": top[0]})
        if len(picks) >= min(n, 3):
            break
    return picks


def acceptance(rows: DataFrame, flip_dn: float = 20.0, near_zero: float = 0.005) -> DataFrame:
    """Per band over unchanged tiles (tile_id, band, ref, before, after in DN): worst difference before and after, mean shrink, sign flips, near-zero reflectances, and whether it got worse."""
    tiles = rows.groupBy("band", "tile_id").agg((F.avg("before") - F.avg("ref")).alias("d0"), (F.avg("after") - F.avg("ref")).alias("d1"), F.avg((F.col("after") / 10000 < near_zero).cast("double")).alias("dark"))
    flip = (F.signum("d0") != F.signum("d1")) & (F.least(F.abs("d0"), F.abs("d1")) > flip_dn)
    out = tiles.groupBy("band").agg(
        F.count("*").alias("n_tiles"), F.max(F.abs("d0")).alias("worst_before"), F.max(F.abs("d1")).alias("worst_after"), F.avg(F.abs("d0") - F.abs("d1")).alias("mean_shrink"), F.count_if(flip).alias("n_flips"), F.count_if(F.col("dark") > 0.01).alias("n_dark"),
    )
    return out.withColumn("degraded", F.col("worst_after") > F.col("worst_before"))


def true_colour(dn: Column, offset: Column, low: Column | float = 0.0, high: Column | float = 0.3) -> Column:
    """0 to 255 of a digital number: reflectance between ``low`` and ``high`` stretched and rounded; no data (0) is 0."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    value = ((dn - offset) / 10000.0 - low) / (high - low)
    return F.when(dn == 0, 0).otherwise(F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255)).cast("int")


def sampled_delta(pixels: DataFrame, before: str, after: str, side: int, n: int, seed: int) -> DataFrame:
    """Per observation the median change of a value over the pixels of ``n`` windows of ``side``, which come first in a hashed order."""
    keys = ["observation_id", "wy", "wx"]
    rows = pixels.select("observation_id", F.floor(F.col("y") / side).alias("wy"), F.floor(F.col("x") / side).alias("wx"), (F.col(after) - F.col(before)).alias("d"))
    order = Window.partitionBy("observation_id").orderBy(F.md5(F.concat_ws(":", "observation_id", "wy", "wx", F.lit(str(seed)))), "wy", "wx")
    chosen = rows.select(*keys).distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return rows.join(chosen.drop("k"), keys, "left_semi").groupBy("observation_id").agg(F.percentile("d", 0.5).alias("median_delta"), F.count("*").alias("n_pixels"))  # n * side * side values


def shift_summary(shifts: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per pair (dy, dx of its windows): medians, MAD, length of the median shift and whether it exceeds ``limit`` pixels.  A pair has some hundreds of windows."""
    mid = shifts.groupBy("pair_id").agg(F.count("*").alias("n_windows"), F.percentile("dy", 0.5).alias("dy_mid"), F.percentile("dx", 0.5).alias("dx_mid"))
    away = shifts.join(mid, "pair_id").groupBy("pair_id").agg(F.percentile(F.hypot(F.col("dy") - F.col("dy_mid"), F.col("dx") - F.col("dx_mid")), 0.5).alias("mad"))
    rows = mid.join(away, "pair_id").withColumn("shift", F.hypot("dy_mid", "dx_mid"))
    return rows.withColumn("exceeds", F.col("shift") > limit)


def window_shifts(pixels: DataFrame, side: int) -> DataFrame:
    """(pair_id, wy, wx, dy, dx): whole-pixel shift of ``sub`` against ``ref`` in each window of ``side``, by phase correlation; windows that are not full or are flat drop out."""

    def shift(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[:1][["pair_id", "wy", "wx"]]
        if len(rows) != side * side or not (rows["ref"].std() > 0 and rows["sub"].std() > 0):
            return first.assign(dy=0.0, dx=0.0).iloc[:0]
        rows = rows.sort_values(["y", "x"])
        a, b = (np.fft.fft2(rows[c].to_numpy(float).reshape(side, side) - rows[c].mean()) for c in ("ref", "sub"))
        cross = b * np.conj(a)
        peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        dy, dx = np.unravel_index(int(peak.argmax()), peak.shape)
        return first.assign(dy=float((dy + side // 2) % side - side // 2), dx=float((dx + side // 2) % side - side // 2))

    rows = pixels.select("pair_id", F.floor(F.col("y") / side).alias("wy"), F.floor(F.col("x") / side).alias("wx"), "y", "x", "ref", "sub")
    return rows.groupBy("pair_id", "wy", "wx").applyInPandas(shift, "pair_id long, wy long, wx long, dy double, dx double")


# ---- masks and distances


def mask_union(masks: DataFrame) -> DataFrame:
    """(gy, gx, water) on the global grid: water where any date has it."""
    return masks.groupBy("gy", "gx").agg(F.max("water").alias("water"))


def opened(mask: DataFrame) -> DataFrame:
    """The cells (observation_id, y, x) left by a 3 x 3 opening: cells of full 3 x 3 squares within the mask."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    sent = mask.select("observation_id", "y", "x", steps.alias("s")).select("observation_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    core = sent.groupBy("observation_id", "y", "x").count().where("count = 9")
    grown = core.select("observation_id", "y", "x", steps.alias("s"))
    return grown.select("observation_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()


def nearest_distance(cells: DataFrame, targets: DataFrame, pixel_m: float, name: str) -> DataFrame:
    """``cells`` (observation_id, y, x) with ``name``: the distance to the nearest target cell of the observation; NO_WATER_M where it has none.

    First along columns by windows, then along rows over the columns' squares.
    A task holds one row of an image at a time.
    """
    hit = targets.select("observation_id", "y", "x").distinct().withColumn("_hit", F.col("y"))
    rows = cells.join(hit, ["observation_id", "y", "x"], "left")
    down = Window.partitionBy("observation_id", "x").orderBy("y")
    up = F.col("y") - F.last("_hit", True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("_hit", True).over(down.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    rows = rows.withColumn("_g", F.least(up, below).cast("double")).select(*cells.columns, "_g")

    def along(part: pd.DataFrame) -> pd.DataFrame:
        x, g = part["x"].to_numpy(float), part["_g"].to_numpy(float)
        known = ~np.isnan(g)
        if not known.any():
            return part.drop(columns="_g").assign(**{name: NO_WATER_M})
        best = np.concatenate([(((s[:, None] - x[known]) ** 2) + g[known] ** 2).min(1) for s in np.array_split(x, max(1, len(x) // 512))])
        return part.drop(columns="_g").assign(**{name: np.sqrt(best) * pixel_m})

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cells.schema)}, {name} double"
    return rows.groupBy("observation_id", "y").applyInPandas(along, schema)


def water_distances(mask: DataFrame, cells: DataFrame, pixel_m: float = 40.0) -> DataFrame:
    """``cells`` with dist_water_m and dist_river_m: to opened water, and to its largest component (of equal ones the first by place)."""
    water = opened(mask)
    labelled = raster.components(water)
    sizes = labelled.groupBy("observation_id", "label_y", "label_x").agg(F.count("*").alias("n"))
    river = sizes.groupBy("observation_id").agg(F.max(F.struct("n", -F.col("label_y"), -F.col("label_x"))).alias("m"))
    river = river.select("observation_id", (-F.col("m.col2")).alias("label_y"), (-F.col("m.col3")).alias("label_x"))
    river = labelled.join(river, ["observation_id", "label_y", "label_x"], "left_semi")
    return nearest_distance(nearest_distance(cells, water, pixel_m, "dist_water_m"), river, pixel_m, "dist_river_m")


def tile_least(distances: DataFrame, side: int, *names: str) -> DataFrame:
    """The least distance in each tile."""
    return distances.groupBy("observation_id", F.floor(F.col("y") / side).alias("row_no"), F.floor(F.col("x") / side).alias("col_no")).agg(*[F.round(F.min(c), 1).alias(c) for c in names])


def terrain_sample(points: DataFrame, pixels: DataFrame, *names: str) -> DataFrame:
    """``points`` (point_id, observation_id, y, x) with the median of each value in the 3 x 3 pixels round them; pixels outside the image are left out."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = points.select("point_id", "observation_id", "y", "x", steps.alias("s")).select("point_id", "observation_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return asked.join(pixels, ["observation_id", "y", "x"]).groupBy("point_id").agg(*[F.percentile(c, 0.5).alias(c) for c in names])  # nine values


# ---- tiles


def tiling(pixels: DataFrame, band: str, side: int, prefix: str) -> DataFrame:
    """(observation_id, tile_name, row_no, col_no, width, height, n_pixels): tiles of ``side`` that hold any data in ``band``; those at the edge are smaller."""
    at = ["observation_id", F.floor(F.col("y") / side).alias("row_no"), F.floor(F.col("x") / side).alias("col_no")]
    tiles = pixels.groupBy(*at).agg(F.max((F.col(band) != 0).cast("int")).alias("_any"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("n_pixels"))
    name = F.format_string("%s%d_r%03d_c%03d", F.lit(prefix), F.col("observation_id"), F.col("row_no"), F.col("col_no"))
    return tiles.where("_any = 1").select("observation_id", name.alias("tile_name"), "row_no", "col_no", "width", "height", "n_pixels")


def described_tiles(catalogue: DataFrame, pixels: DataFrame, side: int) -> DataFrame:
    """Descriptors of the catalogue's tiles only (observation_id, row_no, col_no); a tile without pixels is an error."""
    found = raster.tile_statistics(pixels, side)
    rows = catalogue.join(found, ["observation_id", "row_no", "col_no"], "left")
    bad = F.raise_error(F.concat(F.lit("tile outside the raster: "), F.concat_ws(" ", "observation_id", "row_no", "col_no")))
    return rows.withColumn("n_pixels", F.when(F.col("n_pixels").isNotNull(), F.col("n_pixels")).otherwise(bad.cast("bigint")))


def thinned_mask(pixels: DataFrame, every: int = 4) -> DataFrame:
    """(observation_id, gy, gx, water): the water mask at every ``every``-th pixel of both axes of the global grid (y0, x0 is the image's corner there)."""
    gy, gx = F.col("y0") + F.col("y"), F.col("x0") + F.col("x")
    rows = pixels.where((gy % every == 0) & (gx % every == 0))
    return rows.select("observation_id", (gy / every).cast("long").alias("gy"), (gx / every).cast("long").alias("gx"), (F.col("scl") == WATER_CLASS).alias("water"))


def window_crop(pixels: DataFrame, row_no: int, col_no: int, side: int) -> DataFrame:
    """The pixels of one tile in its own coordinates; the edge is partial, and a tile without pixels an error."""
    rows = pixels.where((F.floor(F.col("y") / side) == row_no) & (F.floor(F.col("x") / side) == col_no))
    if rows.isEmpty():
        raise ValueError(f"tile ({row_no}, {col_no}) lies outside")
    return rows.withColumns({"y": F.col("y") - row_no * side, "x": F.col("x") - col_no * side})
