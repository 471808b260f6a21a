"""Queries of places, review and catalogue checks, over the bindings, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions import columns as C
from terratile.operators import catalog, change, places, review, scan, search
from terratile.plans.queries import ANOMALIES, SIGNIFICANCE, TYPE, scored
from terratile.plans.registry import query

KEY = """coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(aoi_name, '_scaled_82km$', ''), '-82km$', ''), '_diverse$', ''), '_scaled$', ''), '_[0-9]{2}[A-Za-z]{3}$', ''), ''), 'unknown')"""
TOKENS = """coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(aoi_name, '[_-]'), lambda t: lower(t) NOT IN ('diverse', 'scaled', '82km', '') AND NOT regexp_full_match(lower(t), '[0-9]{2}[a-z]{3}')), '_'), ''), nullif(aoi_name, ''), 'unknown')"""


@query("h1_region_slug", f"SELECT observation_id, {KEY} AS region, {TOKENS} AS tokens FROM {{sites}}")
def _(b):
    name = F.col("aoi_name")
    return b("sites").select("observation_id", places.region_key(name).alias("region"), places.region_tokens(name).alias("tokens"))


@query(
    "d5_region_list",
    f"SELECT region, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, count(*) AS n FROM (SELECT t.*, {KEY} AS region FROM {{tiles}} t JOIN {{sites}} USING (observation_id)) GROUP BY region",
)
def _(b):
    named = b("sites").select("observation_id", places.region_key(F.col("aoi_name")).alias("region"))
    return places.extents(b("tiles").join(named, "observation_id"), "region")


ZONED = "SELECT c.candidate_id, coalesce(min(zone), 'outside') AS zone FROM {candidates} c LEFT JOIN {zones} z ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY c.candidate_id"


@query("c6_point_zone", ZONED)
def _(b):
    return places.first_zone(b("candidates"), b("zones"), "candidate_id")


@query("d7_zone_findings", f"SELECT zone, change_type, count(*) AS n FROM (SELECT candidate_id, {TYPE} AS change_type FROM ({ANOMALIES})) JOIN ({ZONED}) USING (candidate_id) GROUP BY ALL")
def _(b):
    zone = places.first_zone(b("candidates"), b("zones"), "candidate_id")
    return scored(b).select("candidate_id", "change_type").join(zone, "candidate_id").groupBy("zone", "change_type").agg(F.count("*").alias("n"))


LON, LAT, RADII = 11.0, 48.0, [200000.0, 500000.0, 1000000.0, 2000000.0]
NEAREST = f"""SELECT kind, id, distance_m, CASE WHEN distance_m <= 200000 THEN 0 WHEN distance_m <= 500000 THEN 1 WHEN distance_m <= 1000000 THEN 2 ELSE 3 END AS ring FROM (
 SELECT kind, id, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(y - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(y)) * pow(sin(radians(x - {LON}) / 2), 2))) AS distance_m FROM (
 SELECT 'candidate' AS kind, candidate_id AS id, lon AS x, lat AS y FROM {{candidates}} UNION ALL
 SELECT 'watch', watch_id, greatest(west, least(west + 10, {LON})), greatest(south, least(south + 10, {LAT})) FROM {{watches}})) WHERE distance_m <= 2000000"""


def rings(b) -> DataFrame:
    points = b("candidates").select(F.col("candidate_id").alias("id"), F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"))
    boxes = b("watches").select(F.col("watch_id").alias("id"), "west", "south", (F.col("west") + 10).alias("east"), (F.col("south") + 10).alias("north"))
    return places.within_rings([("candidate", points), ("watch", boxes)], LON, LAT, RADII)


@query(
    "c16_ring_counts",
    f"SELECT r AS ring, kind, (SELECT count(*) FROM ({NEAREST}) h WHERE h.kind = k.kind AND h.ring <= r) AS n FROM (SELECT unnest(range(4)) AS r) CROSS JOIN (VALUES ('candidate'), ('watch')) AS k(kind)",
)
def _(b):
    return places.ring_counts(rings(b), ["candidate", "watch"], len(RADII))


@query("c16_ring_features", f"SELECT kind, id, round(distance_m, 1) AS distance_m, ring FROM ({NEAREST}) ORDER BY round(distance_m, 1), id, kind LIMIT 50")
def _(b):
    return rings(b).withColumn("distance_m", F.round("distance_m", 1)).orderBy("distance_m", "id", "kind").limit(50)


_AXIS = "(SELECT pair_id, {a}, sum(n) OVER (PARTITION BY pair_id ORDER BY {a}) AS acc, sum(n) OVER (PARTITION BY pair_id) AS total FROM (SELECT pair_id, {a}, sum(n) AS n FROM cells GROUP BY ALL))"
_ENDS = "SELECT pair_id, min({a}) FILTER (acc >= 0.025 * total) AS {a}_low, min({a}) FILTER (acc >= (1 - 0.025) * total) AS {a}_high FROM " + _AXIS + " GROUP BY pair_id"


@query(
    "d17_core_box",
    f"""WITH cells AS (SELECT pair_id, CAST(floor(lon / 3.0) AS BIGINT) AS cx, CAST(floor(lat / 3.0) AS BIGINT) AS cy, count(*) AS n FROM {{candidates}} GROUP BY ALL)
    SELECT * FROM ({_ENDS.format(a="cx")}) JOIN ({_ENDS.format(a="cy")}) USING (pair_id)""",
)
def _(b):
    cells = b("candidates").groupBy("pair_id", F.floor(F.col("lon") / 3.0).alias("cx"), F.floor(F.col("lat") / 3.0).alias("cy")).agg(F.count("*").alias("n"))
    return places.core_box(cells, "pair_id")


@query(
    "h7_box_size",
    """SELECT candidate_id, round(greatest(e1, e2), 3) AS length_m, round(least(e1, e2), 3) AS width_m FROM (SELECT candidate_id, sqrt(pow(dx * kx, 2) + pow(0.3 * dx * ky, 2)) AS e1, sqrt(pow(-0.5 * dx * kx, 2) + pow(dx * ky, 2)) AS e2
    FROM (SELECT candidate_id, dx, 111132.92 - 559.82 * cos(2 * phi) + 1.175 * cos(4 * phi) AS ky, 111412.84 * cos(phi) - 93.5 * cos(3 * phi) AS kx
    FROM (SELECT candidate_id, reliability * 0.001 + 0.0001 AS dx, radians(lat + 0.65 * (reliability * 0.001 + 0.0001)) AS phi FROM {candidates})))""",
)
def _(b):
    dx = F.col("reliability") * 0.001 + 0.0001
    corners = [(0.0, 0.0), (1.0, 0.3), (0.5, 1.3), (-0.5, 1.0)]
    ring = F.array(*[F.struct((F.col("lon") + u * dx).alias("x"), (F.col("lat") + v * dx).alias("y")) for u, v in corners])
    length, width = places.box_size_m(ring)
    return b("candidates").select("candidate_id", F.round(length, 3).alias("length_m"), F.round(width, 3).alias("width_m"))


# ---- review

TYPED = f"SELECT *, {TYPE} AS change_type, {SIGNIFICANCE} AS significance_now, pow(least(greatest(confidence, 0.001), 1.0), 0.65) * pow({SIGNIFICANCE}, 0.35) AS raw_score FROM ({ANOMALIES})"
QUEUE = f"SELECT candidate_id, change_type, lon, lat, confidence, area_px, round(raw_score, 6) AS score FROM ({TYPED})"


def queue(b) -> DataFrame:
    """One row a candidate; rows that repeat a candidate wholly count once."""
    rows = scored(b).withColumn("significance", change.significance())
    return rows.select("candidate_id", "change_type", "lon", "lat", "confidence", "area_px", F.round(change.queue_score(), 6).alias("score"))


@query("d10_sector_brief", f"SELECT change_type, count(*) AS n, round(sum(area_px) * 100.0, 1) AS area_m2, round(sum(area_px) * 100.0 / 10000.0, 2) AS area_ha FROM ({TYPED}) GROUP BY ALL")
def _(b):
    return review.sector_brief(scored(b))


@query("d10_most_significant", f"SELECT candidate_id, change_type, score FROM ({QUEUE}) ORDER BY score DESC, candidate_id, change_type LIMIT 10")
def _(b):
    return queue(b).select("candidate_id", "change_type", "score").orderBy(F.desc("score"), "candidate_id", "change_type").limit(10)


DECIDED = "SELECT candidate_id FROM (SELECT candidate_id, decision FROM {decisions} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, decision_id DESC) = 1) WHERE decision <> 'reopen'"


@query(
    "d9_summary",
    f"""SELECT count(*) AS n, count(*) FILTER (confidence >= 0.85) AS n_high, count(*) FILTER (zone <> 'outside') AS n_zone, count(d.candidate_id) AS n_reviewed, round(100.0 * count(d.candidate_id) / count(*), 4) AS review_rate
    FROM {{candidates}} c LEFT JOIN ({ZONED}) z USING (candidate_id) LEFT JOIN ({DECIDED}) d ON d.candidate_id = c.candidate_id""",
)
def _(b):
    zone = places.first_zone(b("candidates"), b("zones"), "candidate_id")
    return review.summary(b("candidates"), zone, catalog.latest_decision(b("decisions")))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(p{i}.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p{i}.lat)) * pow(sin(radians(p{i}.lon - q.lon) / 2), 2)))"
_BEST = "SELECT change_type, candidate_id, score, lon, lat FROM {f} QUALIFY row_number() OVER (PARTITION BY q.change_type ORDER BY q.score DESC, q.candidate_id) = 1"
_ROUNDS = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT q.* FROM {'q' if i == 1 else f'l{i - 1}'} q JOIN p{i} ON p{i}.change_type = q.change_type AND p{i}.candidate_id <> q.candidate_id AND {HAVERSINE.format(i=i)} >= 1500.0), "
    f"p{i + 1} AS MATERIALIZED ({_BEST.format(f=f'l{i} q')})"
    for i in (1, 2)
)


@query(
    "e13_diverse_picks",
    f"""WITH q AS MATERIALIZED (SELECT DISTINCT candidate_id, change_type, lon, lat, score FROM ({QUEUE})), p1 AS MATERIALIZED ({_BEST.format(f="q")}), {_ROUNDS},
    chosen AS (SELECT candidate_id, change_type, score, 0 AS filled FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) ORDER BY score DESC, candidate_id LIMIT 10)
    SELECT * FROM (SELECT * FROM chosen UNION ALL SELECT candidate_id, change_type, score, 1 FROM q WHERE candidate_id NOT IN (SELECT candidate_id FROM chosen)) ORDER BY filled, score DESC, candidate_id LIMIT 10""",
)
def _(b):
    return review.diverse_picks(queue(b).select("candidate_id", "change_type", "lon", "lat", "score").distinct())


@query(
    "e14_featured",
    f"""SELECT candidate_id, change_type, score, CASE WHEN rn = 1 THEN 0 ELSE 1 END AS filled FROM (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY score DESC, candidate_id) AS rn
    FROM (SELECT DISTINCT candidate_id, change_type, score FROM ({QUEUE}) WHERE confidence >= 0.6)) ORDER BY filled, score DESC, candidate_id LIMIT 4""",
)
def _(b):
    return review.featured(queue(b).where("confidence >= 0.6").select("candidate_id", "change_type", "score", "confidence").distinct())


_MONTH = "concat('20', lpad(CAST(CAST(floor(({m}) / 12) AS BIGINT) + 18 AS STRING), 2, '0'), '-', lpad(CAST(({m}) % 12 + 1 AS STRING), 2, '0'), '-15')"
FIRST_SEEN = [
    "area_px", "candidate_id % 4 = 0 AS sar", "CASE candidate_id % 3 WHEN 0 THEN 'persistent' WHEN 1 THEN 'transient' ELSE 'recent' END AS persistence",
    f"CASE WHEN candidate_id % 10 <> 0 THEN {_MONTH.format(m='candidate_id % 83')} END AS first_from",
    f"CASE WHEN candidate_id % 10 <> 0 THEN {_MONTH.format(m='candidate_id % 83 + 1 + (CASE WHEN candidate_id % 7 = 0 THEN 1 ELSE 0 END)')} END AS first_to",
]


@query(
    "d11_interval_archive",
    f"""WITH days AS (SELECT DISTINCT acquired_at FROM {{scenes_at}}), steps AS (SELECT acquired_at AS first_from, lead(acquired_at) OVER (ORDER BY acquired_at) AS first_to FROM days QUALIFY first_to IS NOT NULL),
    found AS (SELECT first_from, first_to, count(*) AS n, round(sum(area_px) * 100.0, 1) AS area_m2, count(*) FILTER (persistence IN ('persistent', 'progressive', 'recent')) AS n_held, count(*) FILTER (sar) AS n_sar
     FROM (SELECT {", ".join(FIRST_SEEN)} FROM {{candidates}}) GROUP BY ALL)
    SELECT coalesce(s.first_from, f.first_from) AS first_from, coalesce(s.first_to, f.first_to) AS first_to, coalesce(n, 0) AS n, coalesce(area_m2, 0.0) AS area_m2, coalesce(n_held, 0) AS n_held, coalesce(n_sar, 0) AS n_sar,
    CASE WHEN s.first_from IS NOT NULL THEN 'interval' WHEN f.first_from IS NULL THEN 'none' ELSE 'multi' END AS bucket,
    date_diff('day', CAST(coalesce(s.first_from, f.first_from) AS DATE), CAST(coalesce(s.first_to, f.first_to) AS DATE)) AS days FROM steps s FULL JOIN found f ON s.first_from = f.first_from AND s.first_to = f.first_to""",
)
def _(b):
    return review.interval_archive(b("candidates").selectExpr(*FIRST_SEEN), b("scenes_at"))


@query(
    "d12_suppression_funnel",
    f"""WITH s AS (SELECT pair_id, count(*) AS raw, count(*) FILTER (k = 'morphology') AS m, count(*) FILTER (k = 'quality') AS q, count(*) FILTER (k = 'phenology') AS p FROM (
     SELECT pair_id, CASE WHEN NOT (greatest(bad_earlier, bad_later) <= 0.05 AND valid_fraction >= 0.8) THEN 'quality'
     WHEN abs(nv) <= 0.10 AND abs(nb) <= 0.06 AND abs(nw) <= 0.08 THEN 'phenology' WHEN area_px < 50 THEN 'morphology' END AS k FROM ({ANOMALIES})) GROUP BY pair_id)
    SELECT pair_id, step, gate, removed, remaining, round(removed / raw, 4) AS share FROM (
     SELECT pair_id, raw, 1 AS step, 'morphology' AS gate, m AS removed, raw - m AS remaining FROM s UNION ALL SELECT pair_id, raw, 2, 'quality', q, raw - m - q FROM s
     UNION ALL SELECT pair_id, raw, 3, 'registration', 0, raw - m - q FROM s UNION ALL SELECT pair_id, raw, 4, 'radiometric', 0, raw - m - q FROM s UNION ALL SELECT pair_id, raw, 5, 'phenology', p, raw - m - q - p FROM s)""",
)
def _(b):
    return review.funnel(change.suppression_summary(scored(b)))


# ---- series of observations

STEPS = """SELECT place, observation_id AS earlier, later, acquired_at AS earlier_at, later_at, later % 3 = 0 AND date_diff('day', CAST(acquired_at AS DATE), CAST(later_at AS DATE)) >= 5 AS changed FROM (
 SELECT *, lead(observation_id) OVER w AS later, lead(acquired_at) OVER w AS later_at FROM {scenes_at} WINDOW w AS (PARTITION BY place ORDER BY acquired_at, observation_id)) WHERE later IS NOT NULL"""
SPANS = """SELECT place, arg_min(observation_id, (acquired_at, observation_id)) AS earlier, arg_max(observation_id, (acquired_at, observation_id)) AS later, min(acquired_at) AS earlier_at, max(acquired_at) AS later_at, count(*) % 2 = 0 AS changed FROM {scenes_at} GROUP BY place"""
EARLIEST = f"""SELECT s.place, CASE WHEN p.place IS NOT NULL THEN 'pair' WHEN s.changed THEN 'span' ELSE 'none' END AS source, CASE WHEN p.place IS NOT NULL THEN p.earlier WHEN s.changed THEN s.earlier END AS earlier,
 CASE WHEN p.place IS NOT NULL THEN p.later WHEN s.changed THEN s.later END AS later, CASE WHEN p.place IS NOT NULL THEN p.earlier_at WHEN s.changed THEN s.earlier_at END AS earlier_at,
 CASE WHEN p.place IS NOT NULL THEN p.later_at WHEN s.changed THEN s.later_at END AS later_at FROM ({SPANS}) s
 LEFT JOIN (SELECT * FROM ({STEPS}) WHERE changed QUALIFY row_number() OVER (PARTITION BY place ORDER BY later_at, later) = 1) p ON p.place = s.place"""


def earliest(b) -> DataFrame:
    rows = b("scenes_at")
    pairs = catalog.consecutive_pairs(rows).withColumn("changed", (F.col("later") % 3 == 0) & (F.col("days") >= 5))
    ends = lambda f: f(F.col("observation_id"), F.struct("acquired_at", "observation_id"))
    spans = rows.groupBy("place").agg(
        ends(F.min_by).alias("earlier"), ends(F.max_by).alias("later"), F.min("acquired_at").alias("earlier_at"), F.max("acquired_at").alias("later_at"), (F.count("*") % 2 == 0).alias("changed")
    )
    return review.earliest_supported(pairs, spans)


@query("e7_earliest_supported", EARLIEST)
def _(b):
    return earliest(b)


@query(
    "e10_timeline",
    f"""SELECT d.place, acquired_at, CASE WHEN acquired_at = start THEN 'baseline' WHEN later_at IS NULL THEN 'no_change_seen' WHEN acquired_at < later_at THEN 'before_detection' WHEN acquired_at = later_at THEN 'first_detected'
    WHEN d.place % 3 <> 1 THEN 'supported' ELSE 'not_supported' END AS role FROM (SELECT DISTINCT place, acquired_at FROM {{scenes_at}}) d JOIN (SELECT place, min(acquired_at) AS start FROM {{scenes_at}} GROUP BY place) USING (place) JOIN ({EARLIEST}) e USING (place)""",
)
def _(b):
    kind = F.when(F.col("place") % 3 == 0, "persistent").when(F.col("place") % 3 == 1, "transient").otherwise("recent")
    return review.timeline(b("scenes_at"), earliest(b).select("place", F.col("later_at").alias("onset"), kind.alias("persistence")))


@query(
    "e11_later_looks",
    f"SELECT e.place, greatest(count(DISTINCT acquired_at) FILTER (acquired_at >= later_at), 1) AS n_later FROM ({EARLIEST}) e JOIN {{scenes_at}} s ON s.place = e.place GROUP BY e.place",
)
def _(b):
    met = b("scenes_at").join(earliest(b).select("place", "later_at"), "place")
    return met.groupBy("place").agg(F.greatest(F.count_distinct(F.when(F.col("acquired_at") >= F.col("later_at"), F.col("acquired_at"))), F.lit(1)).alias("n_later"))


SIDES = "west south east north acquired_at sensor collection_id gsd_m mean_cloud shift_px reference".split()


@query(
    "j16_comparability",
    f"""WITH p AS (SELECT {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in SIDES)}, s.place, earlier, later FROM ({STEPS}) s JOIN {{scenes_at}} a ON a.observation_id = earlier JOIN {{scenes_at}} b ON b.observation_id = later),
    o AS (SELECT *, greatest(least(a_east, b_east) - greatest(a_west, b_west), 0.0) * greatest(least(a_north, b_north) - greatest(a_south, b_south), 0.0) / least((a_east - a_west) * (a_north - a_south), (b_east - b_west) * (b_north - b_south)) AS f FROM p)
    SELECT earlier, later, round(f, 4) AS overlap, f >= 0.3 AS overlap_ok, date_diff('day', CAST(a_acquired_at AS DATE), CAST(b_acquired_at AS DATE)) >= 5 AS days_ok, a_sensor = b_sensor AS sensor_ok, a_collection_id = b_collection_id AS collection_ok,
    a_gsd_m = b_gsd_m AS gsd_ok, a_mean_cloud <= 0.2 AND b_mean_cloud <= 0.2 AS cloud_ok, a_reference = b_reference AND a_shift_px + b_shift_px <= 0.5 AS shift_ok, f >= 0.3 AND a_collection_id = b_collection_id AND a_gsd_m = b_gsd_m AS comparable FROM o""",
)
def _(b):
    rows = b("scenes_at")
    side = lambda s, key: rows.select(F.col("observation_id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in SIDES])
    pairs = catalog.consecutive_pairs(rows).select("earlier", "later").join(side("a", "earlier"), "earlier").join(side("b", "later"), "later")
    oks = [f"{k}_ok" for k in ("overlap", "days", "sensor", "collection", "gsd", "cloud", "shift")]
    return review.comparability(pairs).select("earlier", "later", "overlap", *oks, "comparable")


# ---- whole tables


@query("e19_queue_rank", "SELECT candidate_id, confidence, row_number() OVER (ORDER BY confidence DESC, candidate_id) AS rank FROM (SELECT DISTINCT candidate_id, confidence FROM {candidates})")
def _(b):
    rows = b("candidates").select("candidate_id", "confidence").distinct()
    return scan.positions(rows, [F.desc("confidence"), F.col("candidate_id")], "rank")


def _level(source: str, order: str, text: str) -> str:
    return f"SELECT CAST(floor((n - 1) / 1000) AS BIGINT) AS shard, sha256(string_agg(t, chr(10) ORDER BY n)) AS h FROM (SELECT row_number() OVER (ORDER BY {order}) AS n, {text} AS t FROM {source}) GROUP BY 1"


_THREE = _level(f"({_level('(' + _level('{tiles}', 'tile_id', 'concat_ws(chr(124), tile_id, observation_id, row_no, col_no, coalesce(vec_id, -1), CAST(round(west * 10) AS BIGINT), CAST(round(south * 10) AS BIGINT), CAST(round(cloud * 100) AS BIGINT))') + ')', 'shard', 'h')})", "shard", "h")


@query("d2_fingerprint", f"SELECT (SELECT count(*) FROM {{tiles}}) AS n_rows, h AS sha256 FROM ({_THREE})")
def _(b):
    whole = [F.round(F.col(c) * m).cast("long") for c, m in (("west", 10), ("south", 10), ("cloud", 100))]
    cells = [*map(F.col, ("tile_id", "observation_id", "row_no", "col_no")), F.coalesce("vec_id", F.lit(-1)), *whole]
    return scan.fingerprint(b("tiles"), [F.col("tile_id")], F.concat_ws("|", *[c.cast("string") for c in cells]))


# ---- lists of search results

_TOP = """SELECT s.vec_id AS query_id, v.vec_id, v.embedding, list_sum(list_transform(list_zip(v.embedding, s.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score,
 row_number() OVER (PARTITION BY s.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM {vectors} v JOIN {vectors} s ON s.vec_id % 100 = 0 AND s.vec_id <> v.vec_id QUALIFY rank <= 10"""


def top(b) -> DataFrame:
    v = b("vectors")
    return search.top_k(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query("e17_prefix_cut", f"SELECT query_id, vec_id, rank FROM (SELECT *, min(CASE WHEN rank % 7 = 0 OR score < 0.2 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM ({_TOP})) WHERE cut IS NULL OR rank < cut")
def _(b):
    # every seventh score dips, and ends the list although later scores rise again
    dipped = top(b).withColumn("score", F.when(F.col("rank") % 7 == 0, -1.0).otherwise(F.col("score")))
    return search.prefix_above(dipped, 0.2).select("query_id", "vec_id", "rank")


@query(
    "e18_collapse_near",
    f"""WITH RECURSIVE t AS MATERIALIZED ({_TOP}), g AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, 0::BIGINT AS vec_id, true AS kept, []::FLOAT[][] AS held FROM t
    UNION ALL SELECT g.query_id, t.rank, t.vec_id, ok, CASE WHEN ok THEN list_append(held, t.embedding) ELSE held END FROM g JOIN t ON t.query_id = g.query_id AND t.rank = g.rank + 1,
    LATERAL (SELECT len(list_filter(held, lambda e: list_sum(list_transform(list_zip(e, t.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) >= 0.4)) = 0 AS ok))
    SELECT query_id, rank, vec_id, kept FROM g WHERE rank > 0""",
)
def _(b):
    return search.collapse_near(top(b), b("vectors"), 0.4)
