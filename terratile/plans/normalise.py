"""Queries of normalisation, distances, tiling and samples of pixel tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terratile.operators import normalise, raster, reports
from terratile.plans.registry import QUERIES, query

_PAIRS = {
    "ref_b04": "b1", "sub_b04": "b2", "ref_b08": "b1 + z * 20", "sub_b08": "b2 + z * 21", "ref_b11": "b1 + amp1", "sub_b11": "b2 + amp1 + z", "ref_scl": "scl", "sub_scl": "(scl + z) % 12",
}
_P = f"SELECT observation_id AS pair_id, y, x, {', '.join(f'{v} AS {k}' for k, v in _PAIRS.items())} FROM {{grid}}"


def pairs(b):
    return b("grid").selectExpr("observation_id AS pair_id", "y", "x", *[f"{v} AS {k}" for k, v in _PAIRS.items()])


_NDVI = "abs(({d}b08 - {d}b04) / nullif({d}b08 + {d}b04, 0))"
_INVARIANT = f"""SELECT * FROM ({_P}) WHERE ref_b04 > 0 AND sub_b04 > 0 AND ref_b08 > 0 AND sub_b08 > 0 AND ref_scl NOT IN (0, 1, 3, 8, 9, 10, 11, 6) AND sub_scl NOT IN (0, 1, 3, 8, 9, 10, 11, 6)
 AND {_NDVI.format(d='ref_')} < 0.25 AND {_NDVI.format(d='sub_')} < 0.25 AND ref_b08 > 400 AND sub_b08 > 400"""


@query("i12_invariant_pixels", f"SELECT pair_id, y, x FROM ({_INVARIANT})")
def _(b):
    return normalise.invariant_pixels(pairs(b), ["b04", "b08"]).select("pair_id", "y", "x")


@query(
    "i12_stable_pixels",
    f"""WITH p AS ({_INVARIANT}), m AS (SELECT pair_id, median(ref_b04) AS r4, median(sub_b04) AS s4, median(ref_b08) AS r8, median(sub_b08) AS s8 FROM p GROUP BY 1),
    g AS (SELECT pair_id, y, x, abs(ref_b04 - r4 / greatest(s4, 1e-6) * sub_b04) / (ref_b04 + 1.0) + abs(ref_b08 - r8 / greatest(s8, 1e-6) * sub_b08) / (ref_b08 + 1.0) AS gap FROM p JOIN m USING (pair_id))
    SELECT pair_id, y, x FROM g JOIN (SELECT pair_id, quantile_cont(gap, 0.8) AS cut FROM g GROUP BY 1) USING (pair_id) WHERE gap <= cut""",
)
def _(b):
    return normalise.invariant_pixels(pairs(b), ["b04", "b08"], stable=0.8).select("pair_id", "y", "x")


_XY = f"SELECT pair_id, ref_b08 AS y, sub_b08 AS x FROM ({_INVARIANT})"


def xy(b):
    return normalise.invariant_pixels(pairs(b), ["b04", "b08"]).select("pair_id", F.col("ref_b08").alias("y"), F.col("sub_b08").alias("x"))


def _fit_sql(line: str) -> str:
    """One round of clipping, in DuckDB; ``line`` makes (pair_id, gain, "offset") from a table {t}."""
    return f"""WITH k0 AS ({_XY}), f0 AS ({line.format(t='k0')}), r0 AS (SELECT k0.*, y - gain * x - "offset" AS r FROM k0 JOIN f0 USING (pair_id)), l0 AS (SELECT pair_id, median(r) AS m, stddev_pop(r) AS s, count(*) AS n FROM r0 GROUP BY 1),
    n0 AS (SELECT r0.*, abs(r - m) <= 2.5 * s AS near, n FROM r0 JOIN l0 USING (pair_id)), g0 AS (SELECT pair_id, count(*) FILTER (near) >= greatest(100, any_value(n) * 0.5) AS go FROM n0 GROUP BY 1),
    k1 AS (SELECT pair_id, y, x FROM n0 JOIN g0 USING (pair_id) WHERE near OR NOT go), f1 AS ({line.format(t='k1')})
    SELECT f1.pair_id, round(gain, 5) AS gain, round("offset", 3) AS "offset", n, round(1 - e / t, 5) AS r2, round(c, 5) AS corr, round(sqrt(e / n), 3) AS rmse FROM f1 JOIN (SELECT k1.pair_id, count(*) AS n, sum(pow(y - gain * x - "offset", 2)) AS e, var_pop(y) * count(*) AS t, corr(x, y) AS c FROM k1 JOIN f1 USING (pair_id) GROUP BY 1) USING (pair_id)"""


_LINES = {
    "ols": "SELECT pair_id, regr_slope(y, x) AS gain, regr_intercept(y, x) AS \"offset\" FROM {t} GROUP BY 1",
    "rma": "SELECT pair_id, sign(covar_pop(x, y)) * stddev_pop(y) / stddev_pop(x) AS gain, avg(y) - sign(covar_pop(x, y)) * stddev_pop(y) / stddev_pop(x) * avg(x) AS \"offset\" FROM {t} GROUP BY 1",
    "additive": "SELECT pair_id, 1.0::DOUBLE AS gain, median(y - x) AS \"offset\" FROM {t} GROUP BY 1",
    "clamped": "SELECT pair_id, any_value(g) AS gain, median(y - g * x) AS \"offset\" FROM (SELECT *, least(greatest(regr_slope(y, x) OVER (PARTITION BY pair_id), 0.85), 1.15) AS g FROM {t}) GROUP BY 1",
}


def _fit_query(method: str):
    @query(f"i13_fit_{method}", _fit_sql(_LINES[method]))
    def _(b):
        return normalise.fit_bands(xy(b), ["pair_id"], method, rounds=1).withColumns({c: F.round(c, d) for c, d in (("gain", 5), ("offset", 3), ("r2", 5), ("corr", 5), ("rmse", 3))})


for _method in _LINES:
    _fit_query(_method)

_OWN = """WITH d AS (SELECT observation_id, CAST(floor(y / 10) AS BIGINT) AS by_, CAST(floor(x / 10) AS BIGINT) AS bx, b1 - b2 AS d FROM {grid}), m AS (SELECT observation_id, by_, bx, median(d) AS m, count(*) AS n FROM d GROUP BY ALL),
 a AS (SELECT observation_id, by_, bx, median(abs(d - m)) * 1.4826 AS mad FROM d JOIN m USING (observation_id, by_, bx) GROUP BY ALL),
 o AS (SELECT observation_id, by_, bx, CASE WHEN n < 20 OR abs(m) < 0.1 * mad THEN 0 WHEN m = 0 THEN 0 ELSE m * abs(m) / (abs(m) + 0.5 * mad) END AS own FROM m JOIN a USING (observation_id, by_, bx)),
 e AS (SELECT observation_id, min(by_) AS y0, max(by_) AS y1, min(bx) AS x0, max(bx) AS x1 FROM o GROUP BY 1),
 s AS (SELECT o.observation_id, o.by_, o.bx, o.own, sum(q.own * exp(-(dy * dy + dx * dx) / 1.28)) / sum(exp(-(dy * dy + dx * dx) / 1.28)) AS smooth FROM o JOIN e USING (observation_id), range(-3, 4) a(dy), range(-3, 4) c(dx), o q
  WHERE q.observation_id = o.observation_id AND q.by_ = least(greatest(o.by_ + dy, y0), y1) AND q.bx = least(greatest(o.bx + dx, x0), x1) GROUP BY ALL),
 g AS (SELECT observation_id, by_, bx, own, least(greatest(smooth, least(0, own)), greatest(0, own)) AS "offset" FROM s)"""


def offsets(b):
    pixels = b("grid").select("observation_id", F.col("y").alias("y_px"), F.col("x").alias("x_px"), F.col("b1").alias("y"), F.col("b2").alias("x"))
    return normalise.offset_grid(pixels, 10, 20, shrink=0.5, deadband=0.1)


@query("i14_offset_grid", _OWN + ' SELECT observation_id, by_ AS "by", bx, round(own, 4) AS own, round("offset", 4) AS "offset" FROM g')
def _(b):
    return offsets(b).withColumns({c: F.round(c, 4) for c in ("own", "offset")})


@query(
    "i15_normalised",
    _OWN + """, p AS (SELECT observation_id, y, x, b2 AS dn, (y + 0.5) / 10 - 0.5 AS gy, (x + 0.5) / 10 - 0.5 AS gx FROM {grid}), c AS (SELECT p.*, floor(gy) AS iy, floor(gx) AS ix, e.* EXCLUDE (observation_id) FROM p JOIN e USING (observation_id)),
    v AS (SELECT c.observation_id, c.y, c.x, dn, sum(g."offset" * (CASE WHEN i = 0 THEN 1 - (gy - iy) ELSE gy - iy END) * (CASE WHEN j = 0 THEN 1 - (gx - ix) ELSE gx - ix END)) AS o FROM c, range(2) a(i), range(2) b(j), g
     WHERE g.observation_id = c.observation_id AND g.by_ = least(greatest(iy + i, y0), y1) AND g.bx = least(greatest(ix + j, x0), x1) GROUP BY ALL)
    SELECT observation_id, count(*) AS n, sum(abs(CASE WHEN dn = 0 THEN 0 ELSE greatest(0.97 * dn + o, 0) END - dn)) / count(*) < 5000 AS sane, round(avg(CASE WHEN dn = 0 THEN 0 ELSE greatest(0.97 * dn + o, 0) END), 0) AS mean_norm FROM v GROUP BY 1""",
)
def _(b):
    pixels = b("grid").select("observation_id", F.col("y").alias("y_px"), F.col("x").alias("x_px"), F.col("b2").alias("dn"))
    fits = b("grid").select("observation_id").distinct().withColumn("gain", F.lit(0.97))
    rows = normalise.normalised(pixels, fits, offsets(b), 10)
    return rows.groupBy("observation_id").agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("dn_norm") - F.col("dn"))) < 5000).alias("sane"), F.round(F.avg("dn_norm"), 0).alias("mean_norm"))


@query(
    "i16_unchanged_tiles",
    f"""WITH p AS (SELECT pair_id, CAST(floor(y / 10) AS BIGINT) AS row_no, CAST(floor(x / 10) AS BIGINT) AS col_no, ref_b04 AS r4, ref_b08 AS r8, ref_b11 AS r11, ref_b04 + z AS s4, ref_b08 + z AS s8, ref_b11 + z AS s11 FROM (SELECT observation_id AS pair_id, y, x, z, b1 + 1000 AS ref_b04, b1 + 2000 AS ref_b08, b1 + 1500 AS ref_b11 FROM {{grid}})),
    t AS (SELECT pair_id, row_no, col_no, abs(avg((r8 - r4) / (r8 + r4)) - avg((s8 - s4) / (s8 + s4))) AS dv, abs(avg((r11 - r8) / (r11 + r8)) - avg((s11 - s8) / (s11 + s8))) AS db, abs(avg(r8) - avg(s8)) / (0.5 * (avg(r8) + avg(s8))) AS dn, abs(avg(r11) - avg(s11)) / (0.5 * (avg(r11) + avg(s11))) AS ds,
     stddev_pop(s8) / avg(s8) AS cv, corr(r8, s8) + corr(r11, s11) AS likeness FROM p GROUP BY ALL)
    SELECT pair_id, row_no, col_no, round(likeness, 5) AS likeness, CASE WHEN dv <= 0.04 AND db <= 0.04 AND dn <= 0.06 AND ds <= 0.06 THEN 0 WHEN dv <= 0.06 AND db <= 0.06 AND dn <= 0.09 AND ds <= 0.09 THEN 1 WHEN dv <= 0.09 AND db <= 0.09 AND dn <= 0.13 AND ds <= 0.13 THEN 2 END AS tier FROM t WHERE cv <= 0.45""",
)
def _(b):
    bands = {"b04": 1000, "b08": 2000, "b11": 1500}
    grid = b("grid").select(F.col("observation_id").alias("pair_id"), "y", "x", *[(F.col("b1") + v).alias(f"ref_{k}") for k, v in bands.items()], *[(F.col("b1") + v + F.col("z")).alias(f"sub_{k}") for k, v in bands.items()], F.lit(4).alias("ref_scl"), F.lit(5).alias("sub_scl"))
    return normalise.unchanged_tiles(grid, 10).select("pair_id", "row_no", "col_no", F.round("likeness", 5).alias("likeness"), "tier")


@query(
    "i24_acceptance",
    """WITH t AS (SELECT band, CAST(floor(y / 10) AS BIGINT) * 10 + CAST(floor(x / 10) AS BIGINT) AS tile_id, avg(b) - avg(r) AS d0, avg(a) - avg(r) AS d1, avg((a / 10000 < 0.005)::INT) AS dark FROM (SELECT observation_id % 3 AS band, y, x, b1 AS r, b2 AS b, b2 - 90 + observation_id AS a FROM {grid}) GROUP BY ALL)
    SELECT band, count(*) AS n_tiles, round(max(abs(d0)), 6) AS worst_before, round(max(abs(d1)), 6) AS worst_after, round(avg(abs(d0) - abs(d1)), 6) AS mean_shrink, count(*) FILTER (sign(d0) <> sign(d1) AND least(abs(d0), abs(d1)) > 20) AS n_flips, count(*) FILTER (dark > 0.01) AS n_dark, max(abs(d1)) > max(abs(d0)) AS degraded FROM t GROUP BY band""",
)
def _(b):
    tile = F.floor(F.col("y") / 10) * 10 + F.floor(F.col("x") / 10)
    rows = b("grid").select((F.col("observation_id") % 3).alias("band"), tile.alias("tile_id"), F.col("b1").alias("ref"), F.col("b2").alias("before"), (F.col("b2") - 90 + F.col("observation_id")).alias("after"))
    return normalise.acceptance(rows).withColumns({c: F.round(c, 6) for c in ("worst_before", "worst_after", "mean_shrink")})


@query("i11_true_colour", "SELECT observation_id, y, x, CASE WHEN b1 % 7 = 0 THEN 0 ELSE CAST(round(least(greatest((b1 - 100) / 10000.0 / 0.3, 0), 1) * 255) AS INT) END AS red FROM {grid}")
def _(b):
    dn = F.when(F.col("b1") % 7 == 0, 0).otherwise(F.col("b1"))
    return b("grid").select("observation_id", "y", "x", normalise.true_colour(dn, F.lit(100)).alias("red"))


@query(
    "i23_sampled_delta",
    """WITH r AS (SELECT observation_id, CAST(floor(y / 5) AS BIGINT) AS wy, CAST(floor(x / 5) AS BIGINT) AS wx, b2 - b1 AS d FROM {grid}), c AS (SELECT observation_id, wy, wx FROM (SELECT DISTINCT observation_id, wy, wx FROM r) QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY md5(CAST(observation_id AS STRING) || ':' || CAST(wy AS STRING) || ':' || CAST(wx AS STRING) || ':1'), wy, wx) <= 12)
    SELECT observation_id, median(d) AS median_delta, count(*) AS n_pixels FROM r JOIN c USING (observation_id, wy, wx) GROUP BY 1""",
)
def _(b):
    return normalise.sampled_delta(b("grid"), "b1", "b2", 5, 12, 1)


@query(
    "i20_shift_summary",
    """WITH s AS (SELECT place AS pair_id, shift_px - 0.2 AS dy, gsd_m - 0.5 + shift_px AS dx FROM {scenes_at}), m AS (SELECT pair_id, count(*) AS n, median(dy) AS my, median(dx) AS mx FROM s GROUP BY 1)
    SELECT pair_id, any_value(n) AS n_windows, round(any_value(my), 6) AS dy_mid, round(any_value(mx), 6) AS dx_mid, round(median(sqrt(pow(dy - my, 2) + pow(dx - mx, 2))), 6) AS mad, round(sqrt(any_value(my) ** 2 + any_value(mx) ** 2), 6) AS shift, sqrt(any_value(my) ** 2 + any_value(mx) ** 2) > 0.5 AS exceeds FROM s JOIN m USING (pair_id) GROUP BY pair_id""",
)
def _(b):
    shifts = b("scenes_at").select(F.col("place").alias("pair_id"), (F.col("shift_px") - 0.2).alias("dy"), (F.col("gsd_m") - 0.5 + F.col("shift_px")).alias("dx"))
    return normalise.shift_summary(shifts).withColumns({c: F.round(c, 6) for c in ("dy_mid", "dx_mid", "mad", "shift")})


def i20_window_shifts(spark, sf_dir: str):
    """Phase correlation has no SQL; tests compare with known shifts."""
    from terratile.plans.bindings import bind

    grid = bind(spark, sf_dir, "grid").select(F.col("observation_id").alias("pair_id"), "y", "x", F.col("b1").alias("ref"), F.col("b2").alias("sub"))
    return normalise.window_shifts(grid, 10)


QUERIES["i20_window_shifts"] = i20_window_shifts


@query(
    "i22_time_profile",
    """WITH RECURSIVE o AS (SELECT place, observation_id AS file_id, acquired_at, west, south, east, north, row_number() OVER (PARTITION BY place ORDER BY acquired_at, observation_id) AS k FROM {scenes_at}),
    f AS (SELECT place, 0::BIGINT AS k, 0::BIGINT AS file_id, false AS kept, -1e9 AS w, -1e9 AS s, 1e9 AS e, 1e9 AS n FROM (SELECT DISTINCT place FROM o) UNION ALL
     SELECT o.place, o.k, o.file_id, ok, CASE WHEN ok THEN greatest(w, west) ELSE w END, CASE WHEN ok THEN greatest(s, south) ELSE s END, CASE WHEN ok THEN least(e, east) ELSE e END, CASE WHEN ok THEN least(n, north) ELSE n END
     FROM (SELECT o.*, f.w, f.s, f.e, f.n, greatest(w, west) < least(e, east) AND greatest(s, south) < least(n, north) AS ok FROM f JOIN o ON o.place = f.place AND o.k = f.k + 1) o)
    SELECT place, acquired_at, min(cloud) AS least, max(cloud) AS most, round(avg(cloud), 6) AS mean FROM f JOIN {observations} b ON b.observation_id = f.file_id JOIN {tiles} t ON t.observation_id = f.file_id WHERE k > 0 AND kept GROUP BY f.place, acquired_at""".replace("SELECT place, acquired_at, min", "SELECT f.place, acquired_at, min"),
)
def _(b):
    files = b("scenes_at").withColumnRenamed("observation_id", "file_id")
    kept = reports.common_footprint(files).where("kept").select("place", F.col("file_id").alias("observation_id"))
    rows = b("tiles").join(kept, "observation_id").join(b("observations").select("observation_id", "acquired_at"), "observation_id")
    return rows.groupBy("place", "acquired_at").agg(F.min("cloud").alias("least"), F.max("cloud").alias("most"), F.round(F.avg("cloud"), 6).alias("mean"))


# ---- masks and distances

_MASK = "SELECT observation_id % 4 AS observation_id, y, x FROM {grid} WHERE (z + y // 4 + x // 5) % 3 <> 0 OR (y BETWEEN 8 AND 15 AND x BETWEEN 10 AND 30) GROUP BY ALL"
_OPENED = f"""m AS ({_MASK}), c AS (SELECT m.observation_id, m.y, m.x FROM m JOIN m n ON n.observation_id = m.observation_id AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1 GROUP BY ALL HAVING count(*) = 9),
 w AS (SELECT DISTINCT observation_id, y + dy AS y, x + dx AS x FROM c, range(-1, 2) a(dy), range(-1, 2) b(dx))"""


def _mask(b):
    z, y, x = F.col("z"), F.col("y"), F.col("x")
    wet = ((z + F.floor(y / 4) + F.floor(x / 5)) % 3 != 0) | (y.between(8, 15) & x.between(10, 30))
    return b("grid").where(wet).select((F.col("observation_id") % 4).alias("observation_id"), "y", "x").distinct()


@query("s4_mask_union", "SELECT y AS gy, x AS gx, max(scl = 6) AS water FROM {grid} GROUP BY ALL")
def _(b):
    return normalise.mask_union(b("grid").select(F.col("y").alias("gy"), F.col("x").alias("gx"), (F.col("scl") == 6).alias("water")))


@query(
    "i7_water_distances",
    f"""WITH RECURSIVE {_OPENED}, n AS (SELECT a.observation_id AS o, a.y, a.x, b.y AS y2, b.x AS x2 FROM w a JOIN w b ON a.observation_id = b.observation_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r AS (SELECT observation_id AS o, y, x, y AS ly, x AS lx FROM w UNION SELECT r.o, n.y2, n.x2, r.ly, r.lx FROM r JOIN n ON r.o = n.o AND r.y = n.y AND r.x = n.x), l AS (SELECT o, y, x, min(row(ly, lx)) AS label FROM r GROUP BY ALL),
    z AS (SELECT o, label FROM (SELECT o, label, count(*) AS k FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o ORDER BY k DESC, label) = 1), v AS (SELECT l.o, y, x FROM l JOIN z ON l.o = z.o AND l.label = z.label),
    a AS (SELECT DISTINCT observation_id % 4 AS o, y, x FROM {{grid}}), d AS (SELECT a.o, a.y, a.x, coalesce((SELECT sqrt(min(pow(w.y - a.y, 2) + pow(w.x - a.x, 2))) * 40 FROM w WHERE w.observation_id = a.o), 1e6) AS dw, coalesce((SELECT sqrt(min(pow(v.y - a.y, 2) + pow(v.x - a.x, 2))) * 40 FROM v WHERE v.o = a.o), 1e6) AS dr FROM a)
    SELECT o AS observation_id, CAST(floor(y / 10) AS BIGINT) AS row_no, CAST(floor(x / 10) AS BIGINT) AS col_no, round(min(dw), 1) AS dist_water_m, round(min(dr), 1) AS dist_river_m FROM d GROUP BY ALL""",
)
def _(b):
    cells = b("grid").select((F.col("observation_id") % 4).alias("observation_id"), "y", "x").distinct()
    return normalise.tile_least(normalise.water_distances(_mask(b), cells), 10, "dist_water_m", "dist_river_m")


@query(
    "i8_distance_rasters",
    "WITH a AS (SELECT DISTINCT observation_id % 4 AS o, y, x FROM {grid}), t AS (SELECT DISTINCT observation_id % 4 AS o, y, x FROM {grid} WHERE scl = 6 AND prob > 0.8) SELECT o AS observation_id, y, x, round(coalesce((SELECT sqrt(min(pow(t.y - a.y, 2) + pow(t.x - a.x, 2))) * 10 FROM t WHERE t.o = a.o), 1e6), 4) AS dist_m FROM a",
)
def _(b):
    grid = b("grid").withColumn("observation_id", F.col("observation_id") % 4)
    cells = grid.select("observation_id", "y", "x").distinct()
    return normalise.nearest_distance(cells, grid.where("scl = 6 AND prob > 0.8"), 10.0, "dist_m").withColumn("dist_m", F.round("dist_m", 4))


@query(
    "i10_terrain_sample",
    """WITH p AS (SELECT o_orderkey AS point_id, CAST(floor(o_orderkey / 1500) AS BIGINT) AS o, o_custkey % 30 AS y, o_custkey % 50 AS x FROM orders WHERE o_orderkey % 20 = 0)
    SELECT point_id, median(z)::DOUBLE AS z, median(amp1)::DOUBLE AS amp1 FROM p JOIN {grid} g ON g.observation_id = p.o AND abs(g.y - p.y) <= 1 AND abs(g.x - p.x) <= 1 GROUP BY point_id""",
)
def _(b):
    t, o = F.col("tile_id"), F.col("observation_id")
    points = b("tiles").where(t % 20 == 0).select(t.alias("point_id"), F.floor(t / 1500).alias("observation_id"), (o % 30).alias("y"), (o % 50).alias("x"))
    return normalise.terrain_sample(points, b("grid"), "z", "amp1")


# ---- tiles


@query(
    "i1_tiling",
    """SELECT observation_id, printf('s%d_r%03d_c%03d', observation_id, CAST(floor(y / 16) AS BIGINT), CAST(floor(x / 16) AS BIGINT)) AS tile_name, CAST(floor(y / 16) AS BIGINT) AS row_no, CAST(floor(x / 16) AS BIGINT) AS col_no, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS n_pixels
    FROM {grid} GROUP BY ALL HAVING max(CASE WHEN scl > 10 THEN 0 ELSE 1 END) = 1""",
)
def _(b):
    return normalise.tiling(b("grid").withColumn("data", F.when(F.col("scl") > 10, 0).otherwise(1)), "data", 16, "s")


@query(
    "i6_described_tiles",
    """SELECT * FROM (SELECT observation_id, CAST(floor(y / 40) AS BIGINT) AS row_no, CAST(floor(x / 40) AS BIGINT) AS col_no, count(*) AS n_pixels, count(*) FILTER (scl IN (4, 5, 6, 7)) AS n_valid FROM {pixels} GROUP BY ALL) WHERE (row_no + col_no) % 2 = 0""",
)
def _(b):
    tiles = b("pixels").select("observation_id", F.floor(F.col("y") / 40).alias("row_no"), F.floor(F.col("x") / 40).alias("col_no")).distinct().where("(row_no + col_no) % 2 = 0")
    return normalise.described_tiles(tiles, b("pixels"), 40).select("observation_id", "row_no", "col_no", "n_pixels", "n_valid")


@query("i6_thinned_mask", "SELECT observation_id, CAST((y + observation_id * 30) / 4 AS BIGINT) AS gy, CAST((x + 2) / 4 AS BIGINT) AS gx, scl = 6 AS water FROM {grid} WHERE (y + observation_id * 30) % 4 = 0 AND (x + 2) % 4 = 0")
def _(b):
    return normalise.thinned_mask(b("grid").withColumns({"y0": F.col("observation_id") * 30, "x0": F.lit(2)}))


@query("a26_window_crop", "SELECT y - 16 AS y, x - 32 AS x, b1, b2 FROM {grid} WHERE observation_id = 0 AND floor(y / 16) = 1 AND floor(x / 16) = 2")
def _(b):
    return normalise.window_crop(b("grid").where("observation_id = 0"), 1, 2, 16).select("y", "x", "b1", "b2")
