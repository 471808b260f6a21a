"""Queries of oriented boxes over the bindings, with the SQL that checks them.

The SQL finds a common area another way: the corners of each ring inside the
other and the crossings of their edges, in order round their middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.functions import polygons
from terratile.operators import detection, raster, rings
from terratile.plans.imagery import _round, _round_product
from terratile.plans.registry import query


def _turned(of: str, angle: str) -> str:
    """SQL of the ring of a box x0, y0, x1, y1 turned by ``angle`` degrees."""
    corners = []
    for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = f"{i} * ({of}x1 - {of}x0) / 2", f"{j} * ({of}y1 - {of}y0) / 2"
        corners.append(f"{{{{'x': ({of}x0 + {of}x1) / 2 + {dx} * cos(radians({angle})) - {dy} * sin(radians({angle})), 'y': ({of}y0 + {of}y1) / 2 + {dx} * sin(radians({angle})) + {dy} * cos(radians({angle}))}}}}")
    return f"[{', '.join(corners)}]".replace("{{", "{").replace("}}", "}")


_ANGLE, _TRUE_ANGLE = "box_id % 7 * 13e0", "truth_id % 5 * 9e0"
_RINGS = f"""bx AS MATERIALIZED (SELECT *, {_turned("", _ANGLE)} AS ring FROM (SELECT DISTINCT * FROM {{boxes}})), tx AS MATERIALIZED (SELECT *, truth_id % 11 = 0 AS difficult, {_turned("", _TRUE_ANGLE)} AS ring FROM {{truths}}),
 be AS MATERIALIZED (SELECT *, list_min(list_transform(ring, lambda p: p.x)) AS ex0, list_max(list_transform(ring, lambda p: p.x)) AS ex1, list_min(list_transform(ring, lambda p: p.y)) AS ey0, list_max(list_transform(ring, lambda p: p.y)) AS ey1 FROM bx),
 te AS MATERIALIZED (SELECT *, list_min(list_transform(ring, lambda p: p.x)) AS ex0, list_max(list_transform(ring, lambda p: p.x)) AS ex1, list_min(list_transform(ring, lambda p: p.y)) AS ey0, list_max(list_transform(ring, lambda p: p.y)) AS ey1 FROM tx)"""


def _inside(p: str, r: str) -> str:
    return f"list_bool_and(list_transform([1, 2, 3, 4], lambda i: ({r}[i % 4 + 1].x - {r}[i].x) * ({p}.y - {r}[i].y) - ({r}[i % 4 + 1].y - {r}[i].y) * ({p}.x - {r}[i].x) >= -1e-9))"


def _common(pairs: str) -> str:
    """CTEs up to ``io`` (a, b, iou): pairs (a, b, ra, rb) of rings with a common area."""
    cross = "(a2.x - a1.x) * (b2.y - b1.y) - (a2.y - a1.y) * (b2.x - b1.x)"
    return f"""pr AS MATERIALIZED ({pairs}),
    pt AS (SELECT a, b, p.x AS x, p.y AS y FROM (SELECT a, b, rb, unnest(ra) AS p FROM pr) WHERE {_inside("p", "rb")} UNION ALL SELECT a, b, p.x, p.y FROM (SELECT a, b, ra, unnest(rb) AS p FROM pr) WHERE {_inside("p", "ra")}
     UNION ALL SELECT a, b, a1.x + t * (a2.x - a1.x), a1.y + t * (a2.y - a1.y) FROM (SELECT *, ((b1.x - a1.x) * (b2.y - b1.y) - (b1.y - a1.y) * (b2.x - b1.x)) / d AS t, ((b1.x - a1.x) * (a2.y - a1.y) - (b1.y - a1.y) * (a2.x - a1.x)) / d AS u FROM
      (SELECT *, {cross} AS d FROM (SELECT a, b, ra[i] AS a1, ra[i % 4 + 1] AS a2, rb[j] AS b1, rb[j % 4 + 1] AS b2 FROM pr, range(1, 5) AS n(i), range(1, 5) AS m(j))) WHERE abs(d) > 1e-9) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
    ce AS (SELECT a, b, avg(x) AS mx, avg(y) AS my FROM pt GROUP BY a, b),
    hu AS (SELECT a, b, list({{'x': x - mx, 'y': y - my}} ORDER BY atan2(y - my, x - mx)) AS h FROM pt JOIN ce USING (a, b) GROUP BY a, b),
    ar AS (SELECT a, b, list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i].x * h[i % len(h) + 1].y - h[i % len(h) + 1].x * h[i].y)) / 2 AS common FROM hu WHERE len(h) > 2),
    io AS MATERIALIZED (SELECT ar.a, ar.b, common / (aa + ab - common) AS iou FROM ar JOIN pr ON ar.a = pr.a AND ar.b = pr.b WHERE common > 1e-9)"""


def _sized(x: str) -> str:
    return f"({x}.x1 - {x}.x0) * ({x}.y1 - {x}.y0)"


_MEET = "a.ex0 < b.ex1 AND b.ex0 < a.ex1 AND a.ey0 < b.ey1 AND b.ey0 < a.ey1"
_WITH_TRUTHS = _common(f"SELECT a.box_id AS a, b.truth_id AS b, a.ring AS ra, b.ring AS rb, {_sized('a')} AS aa, {_sized('b')} AS ab FROM be a JOIN te b ON a.image_id = b.image_id AND a.class_id = b.class_id AND {_MEET}")
_MATCHED = f"""WITH {_RINGS}, {_WITH_TRUTHS},
    mt AS MATERIALIZED (SELECT x.box_id AS det_id, x.class_id, x.score, greatest(x.x1 - x.x0, x.y1 - x.y0) AS det_size, m.b AS truth_id, coalesce(m.iou, 0.0) AS iou, coalesce(t.difficult, false) AS difficult, greatest(t.x1 - t.x0, t.y1 - t.y0) AS truth_size
     FROM bx x LEFT JOIN (SELECT a, b, round(iou, 9) AS iou FROM io QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(iou, 9) DESC, b) = 1) m ON m.a = x.box_id LEFT JOIN tx t ON t.truth_id = m.b)"""


def turned(b) -> tuple[DataFrame, DataFrame]:
    def ring(angle: str):
        return polygons.rotated((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.expr(angle))

    boxes = b("boxes").distinct().select("box_id", "image_id", "class_id", "chip_id", "score", ring(_ANGLE).alias("ring"))
    truths = b("truths").select("truth_id", "image_id", "class_id", (F.col("truth_id") % 11 == 0).alias("difficult"), ring(_TRUE_ANGLE).alias("ring"))
    return boxes, truths


def matches(b) -> tuple[DataFrame, DataFrame]:
    boxes, truths = turned(b)
    return detection.matched(boxes.withColumnRenamed("box_id", "det_id"), truths), truths


@query("c19_oriented_matches", f"{_MATCHED} SELECT det_id, class_id, truth_id, round(iou, 6) AS iou, difficult, round(det_size, 4) AS det_size, round(truth_size, 4) AS truth_size FROM mt")
def _(b):
    found = matches(b)[0]
    return _round(_round(found, 6, "iou"), 4, "det_size", "truth_size").select("det_id", "class_id", "truth_id", "iou", "difficult", "det_size", "truth_size")


@query(
    "l19_oriented_merge",
    f"""WITH RECURSIVE {_RINGS}, {_common(f"SELECT a.box_id AS a, b.box_id AS b, a.ring AS ra, b.ring AS rb, {_sized('a')} AS aa, {_sized('b')} AS ab FROM be a JOIN be b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.chip_id <> b.chip_id AND {_MEET}")},
    rm AS MATERIALIZED (SELECT a, list(b) AS foes FROM io WHERE iou > 0.2 GROUP BY a),
    o AS MATERIALIZED (SELECT box_id, image_id, class_id, coalesce(foes, []) AS foes, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, box_id) AS rk FROM bx LEFT JOIN rm ON rm.a = bx.box_id),
    g AS (SELECT DISTINCT image_id, class_id, 0::BIGINT AS rk, 0::BIGINT AS box_id, false AS kept, []::BIGINT[] AS held FROM o
    UNION ALL SELECT a.image_id, a.class_id, a.rk, a.box_id, NOT list_has_any(held, foes), CASE WHEN list_has_any(held, foes) THEN held ELSE list_append(held, a.box_id) END FROM g JOIN o a ON a.image_id = g.image_id AND a.class_id = g.class_id AND a.rk = g.rk + 1)
    SELECT box_id, image_id, class_id FROM g WHERE kept""",
)
def _(b):
    return detection.merged_rings(turned(b)[0], 0.2).select("box_id", "image_id", "class_id")


_CASES = "(SELECT * FROM (VALUES (0.5, 'all'), (0.55, 'all'), (0.6, 'all'), (0.65, 'all'), (0.7, 'all'), (0.75, 'all'), (0.8, 'all'), (0.85, 'all'), (0.9, 'all'), (0.95, 'all'), (0.5, '0-16'), (0.5, '16-32'), (0.5, '32-96'), (0.5, '96-inf')) AS v(overlap, size))"
_RANGES = "(SELECT * FROM (VALUES ('all', -1e0, 1e18), ('0-16', 0, 16), ('16-32', 16, 32), ('32-96', 32, 96), ('96-inf', 96, 1e18)) AS v(size, low, high))"
_CURVE = f"""{_MATCHED}, cs AS (SELECT overlap::DOUBLE AS overlap, size, low, high FROM {_CASES} JOIN {_RANGES} USING (size)),
    tc AS MATERIALIZED (SELECT k.class_id, overlap, size, count(t.truth_id) AS n_true FROM (SELECT DISTINCT class_id FROM tx) k CROSS JOIN cs LEFT JOIN (SELECT *, greatest(x1 - x0, y1 - y0) AS s FROM tx WHERE NOT difficult) t ON t.class_id = k.class_id AND round(s, 6) >= low AND round(s, 6) < high GROUP BY ALL),
    jh AS (SELECT * FROM (SELECT m.*, overlap, size, low, high, iou >= overlap AND truth_id IS NOT NULL AS hit FROM mt m CROSS JOIN cs)
     WHERE CASE WHEN hit THEN NOT difficult AND round(truth_size, 6) >= low AND round(truth_size, 6) < high ELSE round(det_size, 6) >= low AND round(det_size, 6) < high END),
    jt AS (SELECT *, CASE WHEN hit AND row_number() OVER (PARTITION BY class_id, overlap, size, hit, truth_id ORDER BY score DESC, det_id) = 1 THEN 1 ELSE 0 END AS tp FROM jh),
    cv AS MATERIALIZED (SELECT jt.*, coalesce(n_true, 0) AS n_true, sum(tp) OVER w AS tp_so_far, row_number() OVER w AS n FROM jt LEFT JOIN tc USING (class_id, overlap, size) WINDOW w AS (PARTITION BY class_id, overlap, size ORDER BY score DESC, det_id))"""
_AP = f"""{_CURVE}, en AS (SELECT *, max(tp_so_far / n) OVER (PARTITION BY class_id, overlap, size ORDER BY score, det_id DESC ROWS UNBOUNDED PRECEDING) AS env FROM cv),
    ap AS (SELECT class_id, overlap, size, sum(env) FILTER (tp = 1) AS s, ({" + ".join(f"coalesce(max(tp_so_far / n) FILTER (tp_so_far / n_true >= {0.1 * k!r}e0), 0.0)" for k in range(11))}) / 11 AS e FROM en GROUP BY ALL),
    fin AS (SELECT class_id, overlap, size, n_true, CASE WHEN n_true > 0 THEN coalesce(s / n_true, 0.0) END AS ap, CASE WHEN n_true > 0 THEN coalesce(e, 0.0) END AS ap11 FROM tc LEFT JOIN ap USING (class_id, overlap, size))"""


@query("l15_oriented_precision", f"{_AP} SELECT class_id, overlap, size, n_true, round(ap, 6) AS ap, round(ap11, 6) AS ap11 FROM fin")
def _(b):
    return _round(detection.average_precisions(*matches(b)), 6, "ap", "ap11")


@query("l15_class_summary", f"{_AP} SELECT class_id, max(n_true) AS n_true, round(max(ap) FILTER (overlap = 0.5), 6) AS ap50, round(max(ap11) FILTER (overlap = 0.5), 6) AS ap50_11, round(avg(ap), 6) AS ap50_95 FROM fin WHERE size = 'all' GROUP BY class_id")
def _(b):
    return _round(detection.class_summary(detection.average_precisions(*matches(b), sizes=["all"])), 6, "ap50", "ap50_11", "ap50_95")


@query("l16_precision_recall", f"{_CURVE} SELECT class_id, det_id, tp, CAST(tp_so_far AS BIGINT) AS tp_so_far, n, round(tp_so_far / n, 6) AS precision, CASE WHEN n_true > 0 THEN round(tp_so_far / n_true, 6) END AS recall FROM cv WHERE overlap = 0.5 AND size = 'all'")
def _(b):
    found = _round(detection.curve(*matches(b)), 6, "precision", "recall")
    return found.select("class_id", "det_id", "tp", "tp_so_far", "n", "precision", "recall")


@query("l16_best_scores_by_size", f"{_CURVE} SELECT class_id, overlap, size, round(f1, 6) AS f1, round(score, 6) AS score FROM (SELECT *, round(2 * tp_so_far / (n + n_true), 9) AS f1 FROM cv) WHERE overlap = 0.5 AND n_true > 0 QUALIFY row_number() OVER (PARTITION BY class_id, overlap, size ORDER BY f1 DESC, score DESC) = 1")
def _(b):
    found = detection.best_scores_at(*matches(b), sizes=list(detection.SIZES))
    return _round(found, 6, "f1", "score")


# ---- windows of training images

_IMAGES = "SELECT image_id, width, height FROM {images}"
_SPREAD = f"SELECT *, class_id < 3 AS kept, {_turned('', _ANGLE)} AS ring FROM (SELECT DISTINCT box_id, image_id, class_id, x0 * 25 AS x0, y0 * 20 AS y0, x0 * 25 + (x1 - x0) * 8 AS x1, y0 * 20 + (y1 - y0) * 8 AS y1 FROM {{boxes}})"
_STARTS = "CASE WHEN {d} <= 1024 THEN [0] ELSE list_distinct(list_append(range(0, {d} - 1024 + 1, 824), {d} - 1024)) END"
_WINDOWS = f"""WITH im AS ({_IMAGES}), sx AS ({_SPREAD}), w AS MATERIALIZED (SELECT image_id, x0::BIGINT AS x0, unnest({_STARTS.format(d="height")})::BIGINT AS y0 FROM (SELECT *, unnest({_STARTS.format(d="width")}) AS x0 FROM im)),
    se AS MATERIALIZED (SELECT *, list_min(list_transform(ring, lambda p: p.x)) AS ex0, list_max(list_transform(ring, lambda p: p.x)) AS ex1, list_min(list_transform(ring, lambda p: p.y)) AS ey0, list_max(list_transform(ring, lambda p: p.y)) AS ey1, (x1 - x0) * (y1 - y0) AS size FROM sx),
    {_common("SELECT {'box': s.box_id, 'x': w.x0, 'y': w.y0} AS a, w.image_id AS b, s.ring AS ra, [{'x': w.x0::DOUBLE, 'y': w.y0::DOUBLE}, {'x': w.x0 + 1024e0, 'y': w.y0::DOUBLE}, {'x': w.x0 + 1024e0, 'y': w.y0 + 1024e0}, {'x': w.x0::DOUBLE, 'y': w.y0 + 1024e0}] AS rb, s.size AS aa, 0e0 AS ab FROM w JOIN se s ON s.image_id = w.image_id AND ex0 < w.x0 + 1024 AND ex1 > w.x0 AND ey0 < w.y0 + 1024 AND ey1 > w.y0")},
    vs AS MATERIALIZED (SELECT ar.b AS image_id, ar.a.x AS x0, ar.a.y AS y0, ar.a.box AS box_id, se.class_id, kept, common / se.size AS visible,
     (least(ex1, ar.a.x + 1024) - greatest(ex0, ar.a.x)) * (least(ey1, ar.a.y + 1024) - greatest(ey0, ar.a.y)) / ((ex1 - ex0) * (ey1 - ey0)) AS cover FROM ar JOIN se ON se.box_id = ar.a.box WHERE common > 1e-6)"""


def _training(b):
    d = b("boxes").select("box_id", "image_id", "class_id", F.expr("x0 * 25").alias("x0"), F.expr("y0 * 20").alias("y0"), F.expr("x0 * 25 + (x1 - x0) * 8").alias("x1"), F.expr("y0 * 20 + (y1 - y0) * 8").alias("y1")).distinct()
    ring = polygons.rotated((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.expr(_ANGLE))
    return b("images"), d.select("box_id", "image_id", "class_id", (F.col("class_id") < 3).alias("kept"), ring.alias("ring"))


@query("m1_window_boxes", f"{_WINDOWS} SELECT image_id, x0, y0, box_id, round(visible, 5) AS visible FROM vs WHERE visible > 1e-5")
def _(b):
    found = raster.window_boxes(*_training(b)).where("visible > 1e-5")
    return _round_product(found, 5, "visible").select("image_id", "x0", "y0", "box_id", "visible")


@query("m1_window_labels", f"{_WINDOWS} SELECT w.image_id, w.x0, w.y0, count(*) FILTER (kept AND visible >= 0.6 - 1e-9) AS n_boxes, count(*) FILTER (NOT kept AND cover >= 0.5 - 1e-9) AS n_distractors FROM w LEFT JOIN vs USING (image_id, x0, y0) GROUP BY ALL")
def _(b):
    return raster.window_labels(*_training(b))


# ---- rings

_CUT = 12
_SHAPES = "SELECT watch_id AS ring_id, west AS w, south AS s, east AS e, north AS n FROM {watches}"
_ZONES = "SELECT zone AS box_id, west AS bw, south AS bs, east AS be, north AS bn FROM {zones}"


def shapes(b) -> DataFrame:
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return b("watches").select(F.col("watch_id").alias("ring_id"), F.array(polygons.point(w, s), polygons.point(e, s), polygons.point(e, s + 2), polygons.point(w + 2, n), polygons.point(w, n)).alias("ring"))


@query("h19_rings_meet_boxes", f"SELECT ring_id, box_id FROM ({_SHAPES}) JOIN ({_ZONES}) ON w <= be AND bw <= e AND s <= bn AND bs <= n AND greatest(w, bw) - w + greatest(s, bs) - s <= {_CUT}")
def _(b):
    return rings.rings_meeting_boxes(shapes(b), b("zones").withColumnRenamed("zone", "box_id"))


@query(
    "h19_overlap_shares",
    f"""SELECT ring_id AS left_id, box_id AS right_id, round(common / least(98.0, big - greatest(0, 0)), 5) AS share FROM (SELECT *, (be - bw) * (bn - bs) AS big, (pow(greatest(c, 0), 2) - pow(greatest(c - p, 0), 2) - pow(greatest(c - q, 0), 2) + pow(greatest(c - p - q, 0), 2)) / 2 AS common
    FROM (SELECT *, {_CUT} - (greatest(w, bw) - w) - (greatest(s, bs) - s) AS c, least(e, be) - greatest(w, bw) AS p, least(n, bn) - greatest(s, bs) AS q FROM ({_SHAPES}) JOIN ({_ZONES}) ON w < be AND bw < e AND s < bn AND bs < n)) WHERE common > 1e-9""".replace("98.0", "68.0"),
)
def _(b):
    z = b("zones")
    boxes = z.select(F.col("zone").alias("ring_id"), polygons.upright(F.col("west"), F.col("south"), F.col("east"), F.col("north")).alias("ring"))
    return _round(rings.overlap_shares(shapes(b), boxes).where("share > 1e-10"), 5, "share")


_SEGMENTS = "[[w, s, e, s], [e, s, e, s + 2], [e, s + 2, w + 2, n], [w + 2, n, w, n], [w, n, w, s]]"
_RAD = "(pi() / 180 * 6371000.0)"


@query(
    "h19_ring_distances",
    f"""WITH f AS (SELECT customer_at AS point_id, lon, lat FROM (SELECT o_orderkey AS customer_at, (o_orderkey * 37 % 3600) / 10e0 - 180e0 AS lon, (o_orderkey * 53 % 1400) / 10e0 - 70e0 AS lat FROM orders)), r AS ({_SHAPES}),
    g AS (SELECT point_id, ring_id, lon > w AND lon < e AND lat > s AND lat < n AND (lon - w) + (lat - s) < {_CUT} AS inside,
     list_transform({_SEGMENTS}, lambda t: [(t[1] - lon) * cos(radians(lat)) * {_RAD}, (t[2] - lat) * {_RAD}, (t[3] - lon) * cos(radians(lat)) * {_RAD}, (t[4] - lat) * {_RAD}]) AS seg FROM f JOIN r ON lon BETWEEN w - 10 AND e + 10 AND lat BETWEEN s - 2 AND n + 2),
    d AS (SELECT point_id, ring_id, CASE WHEN inside THEN 0e0 ELSE list_min(list_transform(seg, lambda t: sqrt(pow(t[1] + greatest(0, least(1, -(t[1] * (t[3] - t[1]) + t[2] * (t[4] - t[2])) / (pow(t[3] - t[1], 2) + pow(t[4] - t[2], 2)))) * (t[3] - t[1]), 2)
     + pow(t[2] + greatest(0, least(1, -(t[1] * (t[3] - t[1]) + t[2] * (t[4] - t[2])) / (pow(t[3] - t[1], 2) + pow(t[4] - t[2], 2)))) * (t[4] - t[2]), 2)))) END AS m FROM g)
    SELECT point_id, ring_id, round(m, 1) AS distance_m FROM d WHERE m <= 100000""",
)
def _(b):
    at = b("tiles").select(F.col("tile_id").alias("point_id"), F.expr("(tile_id * 37 % 3600) / 10e0 - 180e0").alias("lon"), F.expr("(tile_id * 53 % 1400) / 10e0 - 70e0").alias("lat"))
    return _round(rings.nearest_rings(at, shapes(b), 100_000), 1, "distance_m")
