"""Queries of the pixel operators, over the bindings, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terratile.operators import raster, stencil
from terratile.plans.registry import query


def _round(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _round_product(df, digits: int, *names: str):
    """Rounds doubles as the SQL's engine does, the product with a power of ten, so that halves such as 0.271875 go the same way."""
    return df.withColumns({n: F.round(F.col(n) * float(10**digits), 0) / float(10**digits) for n in names})


# Every pixel with its neighbours; beyond the edge the nearest pixel.
_SEEN = """SELECT p.observation_id, p.y, p.x, dy, dx, q.{v} AS v FROM {{grid}} p CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dy) CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dx)
 JOIN (SELECT observation_id, max(y) AS my, max(x) AS mx FROM {{grid}} GROUP BY 1) m ON m.observation_id = p.observation_id
 JOIN {{grid}} q ON q.observation_id = p.observation_id AND q.y = least(greatest(p.y + dy, 0), my) AND q.x = least(greatest(p.x + dx, 0), mx)"""
_GRADIENT = f"SELECT observation_id, y, x, sum(v * dx * (2 - abs(dy)))::DOUBLE AS across, sum(v * dy * (2 - abs(dx)))::DOUBLE AS down FROM ({_SEEN.format(v='z', r=1)}) GROUP BY ALL"


@query(
    "i9_slope_aspect",
    f"""SELECT observation_id, y, x, round(slope, 4) AS slope, CASE WHEN slope < 0.05 THEN -1.0 ELSE round((270.0 - degrees(atan2(-d, a)) + 360.0) % 360.0, 4) END AS aspect FROM (
    SELECT *, degrees(atan(sqrt(a * a + d * d))) AS slope FROM (SELECT observation_id, y, x, across / 80.0 AS a, down / 80.0 AS d FROM ({_GRADIENT})))""",
)
def _(b):
    return _round(stencil.slope_aspect(b("grid"), "z"), 4, "slope", "aspect")


@query(
    "i5_edge_density",
    f"SELECT observation_id, CAST(floor(y / 10) AS BIGINT) AS row_no, CAST(floor(x / 10) AS BIGINT) AS col_no, count(*) AS n_pixels, round(avg((sqrt(across * across + down * down) / 8.0 > 12.0)::INT), 6) AS edge_density FROM ({_GRADIENT}) GROUP BY ALL",
)
def _(b):
    return _round(stencil.edge_density(b("grid"), "z", 10, 12.0), 6, "edge_density")


def _filtered(amp: str) -> str:
    seen = _SEEN.format(v=f"{amp} * q.{amp} AS v, CASE WHEN q.amp1 > 0 AND q.amp2 > 0 THEN 1 ELSE 0 END", r=3).replace("END AS v FROM", "END AS ok FROM").replace("{{", "{").replace("}}", "}")
    return f"""SELECT observation_id, y, x, mean + least(greatest(1.0 - (1.0 / 4.4) / greatest(seen, 1e-12), 0.0), 1.0) * (c - mean) AS f FROM (
     SELECT *, greatest(square - mean * mean, 0.0) / greatest(mean * mean, 1e-12) AS seen FROM (
     SELECT observation_id, y, x, sum(ok * v)::DOUBLE / sum(ok) AS mean, sum(ok * v * v)::DOUBLE / sum(ok) AS square, max(v) FILTER (dy = 0 AND dx = 0) AS c, max(ok) FILTER (dy = 0 AND dx = 0) AS here FROM ({seen}) GROUP BY ALL) WHERE here = 1)"""


_DB = f"SELECT g.observation_id, g.y, g.x, CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL THEN least(greatest(10.0 * log10(b.f / a.f), -25.0), 25.0) END AS db FROM {{grid}} g LEFT JOIN ({_filtered('amp1')}) a USING (observation_id, y, x) LEFT JOIN ({_filtered('amp2')}) b USING (observation_id, y, x)"


@query("i17_speckle_filter", f"SELECT g.observation_id, g.y, g.x, round(f, 4) AS filtered FROM {{grid}} g LEFT JOIN ({_filtered('amp1')}) USING (observation_id, y, x)")
def _(b):
    rows = b("grid").withColumn("intensity", F.col("amp1") * F.col("amp1"))
    return _round(stencil.speckle_filtered(rows, "intensity", (F.col("amp1") > 0) & (F.col("amp2") > 0), "filtered"), 4, "filtered").select("observation_id", "y", "x", "filtered")


@query("i18_backscatter_change", f"SELECT observation_id, y, x, round(db, 5) AS db FROM ({_DB})")
def _(b):
    return _round(stencil.backscatter_change(b("grid"), "amp1", "amp2"), 5, "db")


@query(
    "i19_backscatter_summary",
    f"""SELECT observation_id, count(db) AS n_px, round(avg(db), 5) AS mean_db, round(quantile_cont(db, 0.5), 5) AS median_db, round(quantile_cont(db, 0.16), 5) AS p16_db, round(quantile_cont(db, 0.84), 5) AS p84_db, count(db) >= 10 AS available FROM ({_DB}) GROUP BY observation_id""",
)
def _(b):
    rows = stencil.change_summary(stencil.backscatter_change(b("grid"), "amp1", "amp2"), "observation_id")
    return _round(rows, 5, "mean_db", "median_db", "p16_db", "p84_db")


@query(
    "d23_range_summary",
    "SELECT observation_id, min(z) AS least, max(z) AS most, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.02), 6) AS p2, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.98), 6) AS p98 FROM {grid} GROUP BY observation_id",
)
def _(b):
    return _round(raster.range_summary(b("grid"), "z", "observation_id"), 6, "mean", "p2", "median", "p98")


@query(
    "j2_band_reliability",
    "SELECT observation_id, round(c, 6) AS min_corr, round(least(greatest((c - 0.55) / 0.35, 0.5), 1.0), 6) AS reliability FROM (SELECT observation_id, least(corr(b1, b2), corr(amp1, amp2)) AS c FROM {grid} GROUP BY observation_id)",
)
def _(b):
    return _round(raster.band_reliability(b("grid"), [("b1", "b2"), ("amp1", "amp2")], "observation_id"), 6, "min_corr", "reliability")


@query(
    "i21_visual_difference",
    """SELECT observation_id, round(avg(abs(a - b)), 6) AS mean_abs, round(avg((abs(a - b) > 0.1)::INT), 6) AS share_above, round(corr(a, b), 6) AS corr FROM (
    SELECT observation_id, least(greatest((b1 - l1) / (h1 - l1), 0.0), 1.0) AS a, least(greatest((b2 - l2) / (h2 - l2), 0.0), 1.0) AS b FROM {grid} JOIN (
    SELECT observation_id, quantile_cont(b1, 0.02) AS l1, quantile_cont(b1, 0.98) AS h1, quantile_cont(b2, 0.02) AS l2, quantile_cont(b2, 0.98) AS h2 FROM {grid} GROUP BY 1) USING (observation_id)) GROUP BY observation_id""",
)
def _(b):
    return _round(raster.stretched_difference(b("grid"), "b1", "b2", "observation_id"), 6, "mean_abs", "share_above", "corr")


@query(
    "i2_cloud_fraction",
    "SELECT observation_id, CAST(floor(y / 10) AS BIGINT) AS row_no, CAST(floor(x / 10) AS BIGINT) AS col_no, round(avg((scl IN (0, 1, 3, 8, 9, 10, 11))::INT), 6) AS cloud FROM {grid} GROUP BY ALL",
)
def _(b):
    cells = b("grid").groupBy("observation_id", F.floor(F.col("y") / 10).alias("row_no"), F.floor(F.col("x") / 10).alias("col_no"))
    return cells.agg(F.round(F.avg(F.col("scl").isin(0, 1, 3, 8, 9, 10, 11).cast("double")), 6).alias("cloud"))


_COMPONENTS = """WITH RECURSIVE m AS (SELECT observation_id AS o, y, x, prob FROM {grid} WHERE prob >= 0.7),
    n AS (SELECT a.o, a.y, a.x, b.y AS y2, b.x AS x2 FROM m a JOIN m b ON a.o = b.o AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r AS (SELECT o, y, x, y AS ly, x AS lx FROM m UNION SELECT r.o, n.y2, n.x2, r.ly, r.lx FROM r JOIN n ON r.o = n.o AND r.y = n.y AND r.x = n.x),
    l AS (SELECT o, y, x, min(row(ly, lx)) AS label FROM r GROUP BY ALL),
    c AS (SELECT o, label, count(*) AS area_px, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, avg(y) AS cy, avg(x) AS cx, sum(round(prob * 1e6)::BIGINT) / (count(*) * 1e6) AS mean_prob, max(prob) AS max_prob, var_samp(y) AS vy, var_samp(x) AS vx, covar_samp(y, x) AS cv
     FROM l JOIN m USING (o, y, x) GROUP BY ALL)
    """


def _changed(b):
    changed = b("grid").where("prob >= 0.7")
    return raster.component_features(raster.components(changed), changed.select("observation_id", "y", "x", "prob"), 4)


@query(
    "j4_component_features",
    _COMPONENTS + """SELECT o AS observation_id, label[1] AS label_y, label[2] AS label_x, area_px, y0, y1, x0, x1, round(cy, 5) AS cy, round(cx, 5) AS cx, round(mean_prob, 6) AS mean_prob, max_prob, round(area_px / ((y1 - y0 + 1) * (x1 - x0 + 1)), 5) AS fill,
    CASE WHEN area_px < 3 THEN 1.0 ELSE round(sqrt(greatest((vy + vx) / 2 + sqrt(pow((vy - vx) / 2, 2) + cv * cv), 1e-6) / greatest((vy + vx) / 2 - sqrt(pow((vy - vx) / 2, 2) + cv * cv), 1e-6)), 2) END AS elongation FROM c WHERE area_px >= 4""",
)
def _(b):
    return _round(_round(_round(_changed(b), 5, "cy", "cx", "fill"), 6, "mean_prob"), 2, "elongation")


@query(
    "f7_largest_components",
    _COMPONENTS + """SELECT o AS observation_id, label[1] AS label_y, label[2] AS label_x, area_px, row_number() OVER (ORDER BY area_px DESC, o, label[1], label[2]) AS rank FROM c WHERE area_px >= 6 ORDER BY area_px DESC, o, label[1], label[2] LIMIT 50""",
)
def _(b):
    return raster.largest_first(_changed(b), 6, 50).select("observation_id", "label_y", "label_x", "area_px", "rank")


_ORIGINS = "CASE WHEN {d} <= 1024 THEN [0] ELSE list_distinct(list_append(range(0, {d} - 1024 + 1, 824), {d} - 1024)) END"


@query("m1_window_plan", f"SELECT image_id, x0, unnest({_ORIGINS.format(d='height')}) AS y0 FROM (SELECT *, unnest({_ORIGINS.format(d='width')}) AS x0 FROM {{images}})")
def _(b):
    return raster.window_plan(b("images"))
