"""Queries of versioned tables, layouts, index and ranking checks, and medoids, over the bindings, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terratile.functions import grids
from terratile.operators import catalog, clusters, evaluation, layout, places, reports, scoring, search
from terratile.plans.evaluation import _COARSE, _DOT
from terratile.plans.imagery import _round
from terratile.plans.queries import ANOMALIES, CHAIN, SUPPRESSED, scored
from terratile.plans.registry import query
from terratile.sources import snapshots
from terratile.storage import shared_dir

# ---- versions and layout


@query(
    "a1_versioned_tables",
    """SELECT 1 AS version, tile_id, cloud FROM {tiles} WHERE tile_id % 2 = 0 UNION ALL SELECT 2, tile_id, CASE WHEN tile_id % 3 = 0 THEN cloud / 2 ELSE cloud END FROM {tiles} WHERE tile_id % 2 = 0 OR tile_id % 3 = 0""",
)
def _(b):
    tiles = b("tiles")
    held = snapshots.Snapshots(tiles.sparkSession, shared_dir(tiles.sparkSession, "catalogue"), snapshots.catalogue_rules())
    first = tiles.where("tile_id % 2 = 0")
    one = held.commit(0, {"collections": b("collections"), "scenes": b("scenes"), "observations": b("observations"), "tiles": first})
    bad = tiles.where("tile_id % 3 = 0").withColumn("cloud", F.col("cloud") + 1.5)
    try:
        held.commit(one, {"tiles": catalog.upsert(held.read("tiles"), bad, "tile_id")})
    except snapshots.Violation:  # the version stays as it is
        pass
    new = tiles.where("tile_id % 3 = 0").withColumn("cloud", F.col("cloud") / 2)
    held.commit(one, {"tiles": catalog.upsert(held.read("tiles"), new, "tile_id")})
    both = held.read("tiles", 1).select(F.lit(1).alias("version"), "tile_id", "cloud")
    return both.union(held.read("tiles").select(F.lit(2).alias("version"), "tile_id", "cloud"))


@query(
    "b5_layout_box",
    f"""SELECT tile_id, platform, acquired_at, cloud FROM {CHAIN} WHERE west <= -40 AND east >= -70 AND south <= -58 AND north >= -64 AND cloud <= 0.6""",
)
def _(b):
    laid = layout.write_layout(b("tiles"), "tiles")
    chain = catalog.tile_chain(laid, b("observations"), b("scenes"), b("collections"))
    return catalog.query_tiles(chain, (-70, -64, -40, -58), max_cloud=0.6).select("tile_id", "platform", "acquired_at", "cloud")


# ---- vectors


@query(
    "k3_index_against_catalogue",
    """WITH c AS (SELECT vec_id, vec_id * 3 AS tile_id FROM {vectors} WHERE vec_id % 50 <> 7 UNION ALL SELECT vec_id + 100000, vec_id FROM {vectors} WHERE vec_id % 100 = 1), o AS (SELECT vec_id, vec_id * 3 AS tile_id FROM {vectors} WHERE vec_id % 5 = 2)
    SELECT (SELECT count(*) FROM {vectors}) AS n, (SELECT count(*) FROM c) AS n_catalogue, (SELECT count(*) FROM {vectors}) = (SELECT count(*) FROM c) AS agrees, (SELECT count(*) FROM {vectors} WHERE len(embedding) <> 64) AS n_other_length,
    (SELECT min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) FROM {vectors}) AS contiguous, (SELECT count(*) FROM c WHERE vec_id NOT IN (SELECT vec_id FROM {vectors})) AS n_without_vector,
    (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM c)) AS n_lost_pairs""",
)
def _(b):
    v = b("vectors")
    known = v.where("vec_id % 50 <> 7").select("vec_id", (F.col("vec_id") * 3).alias("tile_id")).union(v.where("vec_id % 100 = 1").select(F.col("vec_id") + 100000, "vec_id"))
    return search.index_check(v, known, v.where("vec_id % 5 = 2").select("vec_id", (F.col("vec_id") * 3).alias("tile_id")), 64)


_TOPS = """SELECT s.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY s.vec_id ORDER BY {dot} DESC, v.vec_id) AS rk FROM (SELECT vec_id, {e} AS e FROM {{vectors}}) v JOIN (SELECT vec_id, {e} AS e FROM {{vectors}}) s ON s.vec_id % 40 = 0 AND s.vec_id <> v.vec_id"""


@query(
    "s3_top_agreement",
    f"""WITH a AS ({_TOPS.format(e='embedding', dot=_DOT.format(a='v.e', b='s.e'))} QUALIFY rk <= 10), b AS ({_TOPS.format(e=_COARSE, dot=_DOT.format(a='v.e', b='s.e'))} QUALIFY rk <= 10)
    SELECT a.query_id, count(b.vec_id) AS shared, count(b.vec_id) / 10 AS overlap, coalesce(bool_or(a.rk = 1 AND b.rk = 1), false) AS same_first FROM a LEFT JOIN b USING (query_id, vec_id) GROUP BY a.query_id""",
)
def _(b):
    fine = b("vectors")
    coarse = fine.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 64) / 64))
    one, two = (search.top_k(v, v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10) for v in (fine, coarse))
    return search.neighbour_overlap(one, two, 10)


@query(
    "k5_picked_ids",
    """WITH s AS (SELECT label, count(*) AS size FROM {vectors} GROUP BY label), t AS (SELECT sum(size) AS total, count(*) AS groups FROM s),
    a AS (SELECT label, least(size, 3 + CAST(floor(greatest(60 - 3 * groups, 0) * size / total) AS BIGINT)) AS take FROM s, t)
    SELECT label, vec_id, CAST(rk AS INT) AS rank FROM (SELECT label, vec_id, take, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS rk FROM {vectors} JOIN a USING (label)) WHERE rk <= take""",
)
def _(b):
    return search.stratified_sample(b("vectors"), "label", "vec_id", 60, 3)


@query(
    "d14_observation_clusters",
    """WITH c AS (SELECT observation_id, label AS cluster, count(*) AS n FROM {tiles} t JOIN {vectors} v USING (vec_id) GROUP BY ALL) SELECT observation_id, cluster, n, round(n / sum(n) OVER (PARTITION BY observation_id), 6) AS share FROM c""",
)
def _(b):
    found = clusters.observation_clusters(b("vectors").select("vec_id", F.col("label").alias("cluster")), b("tiles"))
    return _round(found, 6, "share")


# ---- rankings and comparisons


@query(
    "l2_metrics_at",
    """WITH r AS (SELECT observation_id AS q, CASE WHEN cloud < 0.1 THEN 2 WHEN cloud < 0.3 THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY observation_id ORDER BY row_no, tile_id) AS rk FROM {tiles}),
    i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g DESC, rk) AS best FROM r),
    d AS (SELECT q, k, count(*) FILTER (g > 0 AND rk <= k) AS hits, count(*) FILTER (g > 0) AS n, coalesce(sum(g / log2(rk + 1)) FILTER (rk <= k), 0) AS dcg, coalesce(sum(g / log2(best + 1)) FILTER (best <= k), 0) AS idcg FROM i, (SELECT unnest([1, 3, 10])::INT AS k) GROUP BY q, k)
    SELECT q AS query_id, k, round(hits / k, 6) AS precision, CASE WHEN n > 0 THEN round(hits / n, 6) ELSE 0.0 END AS recall, CASE WHEN idcg > 0 THEN round(dcg / idcg, 6) ELSE 0.0 END AS ndcg FROM d""",
)
def _(b):
    order = Window.partitionBy("observation_id").orderBy("row_no", "tile_id")
    grade = F.when(F.col("cloud") < 0.1, 2).when(F.col("cloud") < 0.3, 1).otherwise(0)
    ranked = b("tiles").select(F.col("observation_id").alias("query_id"), grade.alias("grade"), F.row_number().over(order).alias("rank"))
    return _round(search.ranking_metrics_at(ranked, [1, 3, 10]), 6, "precision", "recall", "ndcg")


_SIDE = "SELECT {m} AS path, avg(score) AS value, CASE WHEN count(*) % 3 > 0 THEN 0.02e0 END AS band FROM {{detections}} WHERE det_id % 2 = {k} GROUP BY 1"
_JUDGED = f"""WITH x AS ({_SIDE.format(m="concat(CASE class_id WHEN 0 THEN 'a.recall' WHEN 1 THEN 'a.latency_ms' WHEN 2 THEN 'a.count' WHEN 3 THEN 'b.precision' ELSE 'b.false_positives' END, '')", k=0)}), y AS ({_SIDE.format(m="concat(CASE class_id WHEN 0 THEN 'a.recall' WHEN 1 THEN 'a.latency_ms' WHEN 2 THEN 'a.count' WHEN 3 THEN 'b.precision' ELSE 'b.false_positives' END, '')", k=1)}),
    j AS (SELECT path, y.value - x.value AS delta, greatest(x.band, y.band) AS band, CASE WHEN path IN ('a.recall', 'b.precision') THEN false WHEN path IN ('a.latency_ms', 'b.false_positives') THEN true END AS lower FROM x JOIN y USING (path)),
    v AS (SELECT *, CASE WHEN band IS NULL THEN 'no_band' WHEN abs(delta) <= band THEN 'within_noise' WHEN lower IS NULL THEN 'changed' WHEN lower = (delta < 0) THEN 'improved' ELSE 'regressed' END AS v0 FROM j),
    p AS (SELECT *, CASE WHEN v0 IN ('no_band', 'within_noise') AND delta <> 0 AND path <> 'b.precision' THEN CASE WHEN lower IS NULL THEN 'changed_paired' WHEN lower = (delta < 0) THEN 'improved_paired' ELSE 'regressed_paired' END ELSE v0 END AS verdict FROM v)"""


def _paired(b):
    kind = F.expr("CASE class_id WHEN 0 THEN 'a.recall' WHEN 1 THEN 'a.latency_ms' WHEN 2 THEN 'a.count' WHEN 3 THEN 'b.precision' ELSE 'b.false_positives' END")
    sides = [b("detections").where(F.col("det_id") % 2 == k).groupBy(kind.alias("path")).agg(F.avg("score").alias("value"), F.when(F.count("*") % 3 > 0, 0.02).alias("band")) for k in (0, 1)]
    diff = evaluation.snapshot_diff(*sides)
    spans = diff.where("path <> 'b.precision'").select("path", (F.col("delta") - F.abs("delta") / 2).alias("low"), (F.col("delta") + F.abs("delta") / 2).alias("high"))
    return evaluation.with_paired(diff, spans)


@query("l12_paired_verdicts", f"{_JUDGED} SELECT path, round(delta, 8) AS delta, verdict FROM p")
def _(b):
    return _round(_paired(b), 8, "delta").select("path", "delta", "verdict")


@query("l12_verdict_counts", f"{_JUDGED} SELECT verdict, count(*) AS n FROM p GROUP BY verdict UNION ALL SELECT 'total', count(*) FROM p")
def _(b):
    return evaluation.verdict_counts(_paired(b))


@query(
    "j17_component_precision",
    f"""WITH s AS (SELECT candidate_id, mean_prob, candidate_id % 3 = 0 AS hit, area_px FROM (SELECT *, {SUPPRESSED} AS s FROM ({ANOMALIES})) WHERE s IS NULL),
    r AS (SELECT o, hit, row_number() OVER w AS pos, sum(hit::INT) OVER w AS tp FROM (SELECT 'model' AS o, candidate_id, hit, mean_prob AS v FROM s UNION ALL SELECT 'area', candidate_id, hit, area_px FROM s) WINDOW w AS (PARTITION BY o ORDER BY v DESC, candidate_id ROWS UNBOUNDED PRECEDING))
    SELECT o AS ordered_by, count(*) AS n, CAST(sum(hit::INT) AS BIGINT) AS n_true, round(avg(tp / pos) FILTER (hit), 6) AS ap, CASE WHEN max(pos) >= 10 THEN max(tp) FILTER (pos = 10) / 10 END AS at_10, CASE WHEN max(pos) >= 100 THEN max(tp) FILTER (pos = 100) / 100 END AS at_100 FROM r GROUP BY o""",
)
def _(b):
    left = scored(b).where("suppressed_by IS NULL").select("candidate_id", "mean_prob", "area_px", (F.col("candidate_id") % 3 == 0).alias("hit"))
    return _round(search.ranked_precision(left, {"model": F.col("mean_prob"), "area": F.col("area_px").cast("double")}, "candidate_id", [10, 100]), 6, "ap")


@query(
    "l10_collapse_recovery",
    """WITH q AS (SELECT concat('c', CAST(observation_id % 3 AS STRING)) AS condition, observation_id AS query_id, avg((cloud < 0.3 AND tile_id % 4 <> 0)::INT) AS raw, avg((cloud < 0.3)::INT) AS full_, avg((cloud < 0.3)::INT) FILTER (row_no < 32) AS filtered FROM {tiles} GROUP BY ALL HAVING count(*) FILTER (row_no < 32) > 0),
    m AS (SELECT condition, avg(raw) AS raw, avg(full_) AS f, avg(filtered) AS filtered FROM q GROUP BY condition)
    SELECT condition, round(raw, 6) AS raw, round(f, 6) AS "full", round(filtered, 6) AS filtered, round(filtered - raw, 6) AS collapse, round(f - raw, 6) AS recovered, CASE WHEN filtered <> raw THEN round((f - raw) / (filtered - raw), 5) END AS share_recovered FROM m""",
)
def _(b):
    good, inside = F.col("cloud") < 0.3, F.col("row_no") < 32
    rows = b("tiles").groupBy(F.concat(F.lit("c"), (F.col("observation_id") % 3).cast("string")).alias("condition"), F.col("observation_id").alias("query_id")).agg(
        F.avg((good & (F.col("tile_id") % 4 != 0)).cast("int")).alias("raw"), F.avg(good.cast("int")).alias("full"), F.avg(F.when(inside, good.cast("int"))).alias("filtered")
    )
    found = scoring.collapse_recovery(rows.where("filtered IS NOT NULL"))
    return _round(_round(found, 6, "raw", "full", "filtered", "collapse", "recovered"), 5, "share_recovered")


@query(
    "d24_split_quantiles",
    """SELECT CAST(o_orderkey % 3 AS STRING) AS split, round(quantile_cont(g, 0.1), 6) AS gsd_p10, round(quantile_cont(g, 0.5), 6) AS gsd_p50, round(quantile_cont(g, 0.9), 6) AS gsd_p90 FROM (SELECT o_orderkey, (o_custkey % 97) * 0.5e0 AS g FROM orders) GROUP BY 1""",
)
def _(b):
    chips = b("tiles").select((F.col("tile_id") % 3).cast("string").alias("split"), (F.col("observation_id") % 97 * 0.5).alias("gsd"))
    return _round(scoring.split_quantiles(chips), 6, "gsd_p10", "gsd_p50", "gsd_p90")


# ---- places


@query(
    "s6_footprint_reasons",
    """WITH RECURSIVE x AS (SELECT place, observation_id AS file_id, acquired_at, CASE WHEN observation_id % 13 <> 0 THEN west END AS west, south, CASE WHEN observation_id % 17 = 0 THEN west - 1 ELSE east END AS east, north FROM {scenes_at}),
    o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY acquired_at, file_id) AS k FROM x WHERE west IS NOT NULL AND west < east),
    f AS (SELECT place, 0::BIGINT AS k, 0::BIGINT AS file_id, false AS kept, -1e9 AS w, -1e9 AS s, 1e9 AS e, 1e9 AS n FROM (SELECT DISTINCT place FROM o) UNION ALL
     SELECT o.place, o.k, o.file_id, ok, CASE WHEN ok THEN greatest(w, west) ELSE w END, CASE WHEN ok THEN greatest(s, south) ELSE s END, CASE WHEN ok THEN least(e, east) ELSE e END, CASE WHEN ok THEN least(n, north) ELSE n END
     FROM (SELECT o.*, f.w, f.s, f.e, f.n, greatest(w, west) < least(e, east) AND greatest(s, south) < least(n, north) AS ok FROM f JOIN o ON o.place = f.place AND o.k = f.k + 1) o)
    SELECT x.place, x.file_id, coalesce(f.kept, false) AS kept, CASE WHEN x.west IS NULL THEN 'no_box' WHEN x.west >= x.east THEN 'empty_box' WHEN NOT f.kept THEN 'apart_from_common' END AS reason FROM x LEFT JOIN f ON f.place = x.place AND f.file_id = x.file_id AND f.k > 0""",
)
def _(b):
    files = b("scenes_at").withColumnRenamed("observation_id", "file_id").withColumns(
        {"east": F.when(F.col("file_id") % 17 == 0, F.col("west") - 1).otherwise(F.col("east")), "west": F.when(F.col("file_id") % 13 != 0, F.col("west"))}
    )
    return reports.footprint_reasons(files)


_SETS = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(grids.COLUMNS))


@query(
    "h9_grid_squares",
    f"""SELECT candidate_id, CAST(zone AS VARCHAR) || band || substr(CASE (zone - 1) % 3 {_SETS} END, CAST(floor(easting / 100000) AS INT), 1) || substr('{grids.ROWS}', CAST((floor(northing / 100000) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1 AS INT), 1) AS square
    FROM (SELECT candidate_id, zone, band, {grids.EASTING} AS easting, {grids.NORTHING} AS northing FROM (SELECT *, {grids.TERMS} FROM (SELECT *, {grids.T} AS t FROM (SELECT candidate_id, lon, lat, radians(lat) AS phi, CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS zone,
    substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INT) + 1, 1) AS band, radians(lon - ((CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1) * 6 - 183)) AS dl FROM {{findings}}))))""",
)
def _(b):
    return grids.with_grid(b("findings")).select("candidate_id", "square")


_AT = "SELECT aoi_name AS region, observation_id AS point_id, (observation_id * 37 % 600) / 10e0 - 20e0 + CASE WHEN observation_id % 29 = 0 THEN 100e0 ELSE 0e0 END AS lon, (observation_id * 53 % 400) / 10e0 + 10e0 AS lat FROM {observations}"
_KM = "12742000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
_MEDOID = f"WITH p AS ({_AT}), m AS (SELECT region, point_id, lon, lat, total_m FROM (SELECT a.region, a.point_id, a.lon, a.lat, round(sum({_KM}), 3) AS total_m FROM p a JOIN p b ON a.region = b.region GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY region ORDER BY total_m, point_id) = 1)"


def _at(b):
    o = F.col("observation_id")
    lon = (o * 37 % 600) / 10.0 - 20.0 + F.when(o % 29 == 0, 100.0).otherwise(0.0)
    return b("observations").select(F.col("aoi_name").alias("region"), o.alias("point_id"), lon.alias("lon"), ((o * 53 % 400) / 10.0 + 10.0).alias("lat"))


@query("h10_medoids", f"{_MEDOID} SELECT region, point_id, lon, lat, round(total_m, 1) AS total_m FROM m")
def _(b):
    return _round(places.medoids(_at(b), "region"), 1, "total_m")


@query(
    "h10_framed_points",
    f"""{_MEDOID}, d AS (SELECT b.*, {_KM} <= 2500000 AS near FROM m a JOIN p b ON a.region = b.region), f AS (SELECT region, min(lon) FILTER (near) AS w, max(lon) FILTER (near) AS e, min(lat) FILTER (near) AS s, max(lat) FILTER (near) AS n, count(*) FILTER (near) AS n_kept, count(*) FILTER (NOT near) AS n_outside FROM d GROUP BY region)
    SELECT region, round(w - greatest(0.02, (e - w) * 0.12), 6) AS west, round(s - greatest(0.02, (n - s) * 0.12), 6) AS south, round(e + greatest(0.02, (e - w) * 0.12), 6) AS east, round(n + greatest(0.02, (n - s) * 0.12), 6) AS north, n_kept, n_outside FROM f""",
)
def _(b):
    return _round(places.framed(_at(b), "region"), 6, "west", "south", "east", "north")
