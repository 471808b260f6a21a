"""Queries of summaries, trajectories, sets and text helpers, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terratile.operators import reports, search
from terratile.plans.listing import SEEDED
from terratile.plans.queries import CHAIN, chain
from terratile.plans.registry import query


@query(
    "d8_console_metrics",
    f"""SELECT 'n_tiles' AS metric, count(*) AS value FROM {{tiles}} UNION ALL SELECT 'n_vectors', count(*) FROM {{vectors}} UNION ALL SELECT 'scenes_of_' || CAST(collection_id AS STRING), count(DISTINCT scene_id) FROM {CHAIN} GROUP BY collection_id
    UNION ALL SELECT 'n_sensors', count(DISTINCT sensor) FROM {CHAIN} UNION ALL SELECT 'findings_' || change_type, count(*) FROM {{findings}} GROUP BY change_type""",
)
def _(b):
    return reports.console_metrics({"tiles": b("tiles"), "vectors": b("vectors")}, b("findings"), chain(b))


_CLUSTERS = "SELECT label AS cluster, CAST(label % 4 AS STRING) AS concept, count(*) AS size FROM {vectors} GROUP BY label"


@query("d16_concept_groups", f"SELECT concept, count(*) AS n_clusters, sum(size) AS n_tiles, string_agg(CAST(cluster AS STRING), ',' ORDER BY size DESC, cluster) AS clusters FROM ({_CLUSTERS}) GROUP BY concept")
def _(b):
    clusters = b("vectors").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size")).withColumn("concept", (F.col("cluster") % 4).cast("string"))
    return reports.concept_groups(clusters)


@query(
    "d18_observation_archive",
    "SELECT observation_id, place, acquired_at, count(*) AS n_tiles, round(avg(cloud), 6) AS mean_cloud, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM {tiles} JOIN {observations} USING (observation_id) GROUP BY ALL",
)
def _(b):
    return reports.observation_archive(b("tiles"), b("observations")).withColumn("mean_cloud", F.round("mean_cloud", 6))


@query(
    "d19_view_coverage",
    """WITH h AS (SELECT * FROM {scenes_at} WHERE west < 1.5 AND east > 0.5 AND south < 1.5 AND north > 0.5),
    g AS (SELECT 0.5 + (x + 0.5) * 0.125 AS cx, 0.5 + (y + 0.5) * 0.125 AS cy FROM range(8) a(x), range(8) b(y))
    SELECT (SELECT count(*) FROM h) AS n_scenes, (SELECT min(acquired_at) FROM h) AS first_date, (SELECT max(acquired_at) FROM h) AS last_date,
    (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM h WHERE cx BETWEEN west - 1e-9 AND east + 1e-9 AND cy BETWEEN south - 1e-9 AND north + 1e-9)) / 64 AS fraction""",
)
def _(b):
    return reports.view_coverage(b("scenes_at"), (0.5, 0.5, 1.5, 1.5), 0.125)


@query(
    "d20_detection_totals",
    """WITH d AS (SELECT image_id % 7 AS observation_id, image_id AS tile_id, class_id, score, det_id FROM {detections}), p AS (SELECT observation_id, tile_id, count(*) AS n FROM d GROUP BY ALL),
    t AS (SELECT observation_id, count(*) AS n_tiles, sum(n) AS n_hits, avg(n) AS mean_per_tile, max(n) AS max_per_tile FROM p GROUP BY 1),
    c AS (SELECT * FROM (SELECT observation_id, class_id, count(*) AS n FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY n DESC, class_id) = 1),
    r AS (SELECT observation_id, score, row_number() OVER (PARTITION BY observation_id ORDER BY score, det_id) AS at_ FROM d)
    SELECT observation_id, n_tiles, n_hits, round(mean_per_tile, 6) AS mean_per_tile, max_per_tile, class_id AS top_class, n AS n_top_class, max(score) FILTER (at_ = ceil(n_hits * 0.1)) AS q10, max(score) FILTER (at_ = ceil(n_hits * 0.5)) AS q50, max(score) FILTER (at_ = ceil(n_hits * 0.9)) AS q90
    FROM t JOIN c USING (observation_id) JOIN r USING (observation_id) GROUP BY ALL""",
)
def _(b):
    rows = b("detections").select((F.col("image_id") % 7).alias("observation_id"), F.col("image_id").alias("tile_id"), "class_id", "score", "det_id")
    return reports.detection_totals(rows).withColumn("mean_per_tile", F.round("mean_per_tile", 6))


@query(
    "d22_radar_agreement",
    """SELECT count(*) AS n_gains, count(*) FILTER (sar_available) AS n_covered, count(*) FILTER (sar_available AND vv_db - 0.25 <= -1) AS n_agree, round(median(vv_db - 0.25) FILTER (sar_available), 6) AS median_anomaly,
    round(count(*) FILTER (sar_available AND vv_db - 0.25 <= -1) / count(*) FILTER (sar_available), 6) AS agreement FROM {findings} WHERE change_type = 'water_gain'""",
)
def _(b):
    return reports.radar_agreement(b("findings"), 0.25).withColumns({c: F.round(c, 6) for c in ("median_anomaly", "agreement")})


_ND = "CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END"
_INDEX = f"""SELECT observation_id, CAST(floor(y / 40) AS BIGINT) AS row_no, CAST(floor(x / 64) AS BIGINT) AS col_no, avg((scl IN (4, 5, 6, 7))::INT) AS valid,
 avg({_ND.format(a='b08', b='b04')}) FILTER (scl IN (4, 5, 6, 7)) AS ndvi, avg({_ND.format(a='b03', b='b08')}) FILTER (scl IN (4, 5, 6, 7)) AS ndwi, avg({_ND.format(a='b11', b='b08')}) FILTER (scl IN (4, 5, 6, 7)) AS ndbi,
 avg(({_ND.format(a='b03', b='b08')} > 0)::INT) FILTER (scl IN (4, 5, 6, 7)) AS water FROM {{pixels}} GROUP BY ALL HAVING max((scl IN (4, 5, 6, 7))::INT) = 1"""
_SQUARE = _INDEX.replace("x / 64", "x / 40")


@query("d25_index_table", f"SELECT observation_id, row_no, col_no, round(valid, 6) AS valid, round(ndvi, 4) AS ndvi, round(ndwi, 4) AS ndwi, round(ndbi, 4) AS ndbi, round(water, 6) AS water FROM ({_SQUARE})")
def _(b):
    return reports.index_table(b("pixels"), 40, [4, 5, 6, 7]).withColumns({c: F.round(c, 6) for c in ("valid", "water")})


@query(
    "d25_extreme_tiles",
    f"""WITH t AS (SELECT observation_id, row_no, col_no, round(ndvi, 4) AS ndvi, round(ndwi, 4) AS ndwi, round(ndbi, 4) AS ndbi FROM ({_SQUARE})),
    v AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ndvi DESC, row_no DESC, col_no DESC) = 1), w AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ndwi DESC, row_no DESC, col_no DESC) = 1),
    u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ndbi DESC, row_no DESC, col_no DESC) = 1)
    SELECT v.observation_id, v.row_no AS vegetation_row_no, v.col_no AS vegetation_col_no, w.row_no AS water_row_no, w.col_no AS water_col_no, u.row_no AS built_row_no, u.col_no AS built_col_no,
    v.ndvi >= w.ndvi AND w.ndwi >= v.ndwi AND u.ndbi >= v.ndbi AS sane FROM v JOIN w USING (observation_id) JOIN u USING (observation_id)""",
)
def _(b):
    return reports.extreme_tiles(reports.index_table(b("pixels"), 40, [4, 5, 6, 7]))


_STAGES = """SELECT class_id AS benchmark, s AS step, tp / (tp + fp) AS precision, tp / n AS recall, 2 * tp / (tp + fp + n) AS f1 FROM (SELECT class_id, s, count(*) FILTER (hit AND score >= s * 0.2) AS tp, count(*) FILTER (NOT hit AND score >= s * 0.2) AS fp, count(*) FILTER (hit) AS n
 FROM {detections}, range(5) t(s) GROUP BY ALL)"""


@query(
    "d26_stage_deltas",
    f"""SELECT benchmark, step, round(precision, 6) AS precision, round(f1, 6) AS f1, round(precision - lag(precision) OVER w, 4) AS delta_precision, round(recall - lag(recall) OVER w, 4) AS delta_recall, round(f1 - lag(f1) OVER w, 4) AS delta_f1 FROM ({_STAGES}) WINDOW w AS (PARTITION BY benchmark ORDER BY step)""",
)
def _(b):
    at = b("detections").select("class_id", "score", "hit", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"))
    over = F.col("score") >= F.col("step") * 0.2
    rows = at.groupBy(F.col("class_id").alias("benchmark"), "step").agg(F.count_if(F.col("hit") & over).alias("tp"), F.count_if(~F.col("hit") & over).alias("fp"), F.count_if("hit").alias("n"))
    tp, fp, n = (F.col(c) for c in ("tp", "fp", "n"))
    stages = rows.select("benchmark", "step", (tp / (tp + fp)).alias("precision"), (tp / n).alias("recall"), (2 * tp / (tp + fp + n)).alias("f1"))
    return reports.stage_deltas(stages).select("benchmark", "step", F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"), "delta_precision", "delta_recall", "delta_f1")


@query(
    "d27_cluster_runs",
    """WITH m AS (SELECT r AS run, CASE WHEN label % (r + 3) = 0 THEN -1 ELSE label % (r + 8) END AS cluster FROM {vectors}, range(3) t(r)), s AS (SELECT run, cluster, count(*) AS n FROM m GROUP BY ALL),
    l AS (SELECT run, cluster % 5 AS label FROM s WHERE cluster >= 0), d AS (SELECT run, count(*) AS k FROM (SELECT run, label FROM l GROUP BY ALL HAVING count(*) > 1) GROUP BY run)
    SELECT run, count(*) FILTER (cluster >= 0) AS n_clusters, round(100 * coalesce(sum(n) FILTER (cluster < 0), 0) / sum(n), 1) AS noise_pct, round(100 * max(n) / sum(n), 1) AS largest_pct, coalesce(any_value(k), 0) AS n_shared_labels FROM s LEFT JOIN d USING (run) GROUP BY run""",
)
def _(b):
    runs = b("vectors").select("label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    members = runs.select("run", F.when(F.col("label") % (F.col("run") + 3) == 0, -1).otherwise(F.col("label") % (F.col("run") + 8)).alias("cluster"))
    names = members.where("cluster >= 0").distinct().select("run", (F.col("cluster") % 5).alias("label"))
    return reports.cluster_runs(members, names)


# ---- trajectories and timelines

_LOOKUPS = """SELECT f.subject AS candidate_id, f.subject % 40 AS place, concat('20', lpad(CAST(k + 18 AS STRING), 2, '0'), '-01-01') AS earlier_at, concat('20', lpad(CAST(k + 19 AS STRING), 2, '0'), '-01-01') AS later_at,
 (f.subject + k) % 5 <> 0 AS covered, (f.subject * 7 + k * 3) % 4 = 0 OR (k > 2 AND f.subject % 3 = 0) AS changed FROM (SELECT DISTINCT subject FROM {findings}) f, range(6) t(k)"""


def lookups(b):
    rows = b("findings").select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    s, k = F.col("subject"), F.col("k")
    day = lambda n: F.concat(F.lit("20"), F.lpad((k + n).cast("string"), 2, "0"), F.lit("-01-01"))
    return rows.select(
        s.alias("candidate_id"), (s % 40).alias("place"), day(18).alias("earlier_at"), day(19).alias("later_at"), ((s + k) % 5 != 0).alias("covered"), (((s * 7 + k * 3) % 4 == 0) | ((k > 2) & (s % 3 == 0))).alias("changed")
    )


@query(
    "e8_trajectory",
    f"""WITH l AS ({_LOOKUPS}), f AS (SELECT candidate_id, count(*) FILTER (covered) AS nc, count(*) FILTER (covered AND changed) AS nch, min(later_at) FILTER (covered AND changed) AS fl, min(earlier_at) FILTER (covered AND changed) AS fe FROM l GROUP BY 1),
    a AS (SELECT candidate_id, count(*) AS na, count(*) FILTER (changed) AS ns FROM l JOIN f USING (candidate_id) WHERE later_at > fl AND covered GROUP BY 1)
    SELECT candidate_id, nc AS n_covered, nch AS n_changed, fe AS first_earlier, fl AS first_later, CASE WHEN nc = 0 THEN 'unknown' WHEN nch = 0 THEN 'none' WHEN coalesce(na, 0) = 0 THEN 'single' WHEN na = ns THEN 'persistent' ELSE 'transient' END AS trajectory FROM f LEFT JOIN a USING (candidate_id)""",
)
def _(b):
    return reports.trajectory(lookups(b))


@query(
    "e9_trajectory_view",
    """WITH d AS (SELECT DISTINCT place, acquired_at FROM {observations}), s AS (SELECT place, acquired_at AS earlier_at, lead(acquired_at) OVER (PARTITION BY place ORDER BY acquired_at) AS later_at FROM d),
    p AS (SELECT a.place, a.acquired_at AS earlier_at, b.acquired_at AS later_at FROM d a JOIN d b ON a.place = b.place AND a.acquired_at < b.acquired_at)
    SELECT p.*, CASE WHEN s.place IS NULL THEN 'span' ELSE 'consecutive' END AS interval FROM p LEFT JOIN s USING (place, earlier_at, later_at)""",
)
def _(b):
    dates = b("observations").select("place", "acquired_at").distinct()
    pairs = dates.withColumnRenamed("acquired_at", "earlier_at").join(dates.withColumnRenamed("acquired_at", "later_at"), "place").where("earlier_at < later_at")
    return reports.trajectory_view(pairs, dates)


@query(
    "e12_playhead",
    """WITH e AS (SELECT place, min(acquired_at) AS a, max(acquired_at) AS z FROM {observations} GROUP BY place), p AS (SELECT place, acquired_at, CASE WHEN a < z THEN date_diff('day', a::DATE, acquired_at::DATE) / date_diff('day', a::DATE, z::DATE) ELSE 0 END AS position FROM {observations} JOIN e USING (place))
    SELECT place, coalesce(max(acquired_at) FILTER (position <= 0.4), min(acquired_at)) AS acquired_at FROM p GROUP BY place""",
)
def _(b):
    return reports.playhead(reports.calendar_positions(b("observations").select("place", "acquired_at")), 0.4)


@query(
    "e15_examples",
    """WITH t AS (SELECT tile_id, cloud, tile_id % 9 AS cluster, CASE WHEN tile_id % 31 = 0 THEN 'rare' ELSE aoi_name END AS region FROM {tiles} JOIN {observations} USING (observation_id)), c AS (SELECT cluster, region, count(*) AS n FROM t GROUP BY ALL),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, region) AS place FROM c), k AS (SELECT * FROM r WHERE share >= 0.05 OR (place = 1 AND NOT EXISTS (SELECT 1 FROM r q WHERE q.cluster = r.cluster AND q.share >= 0.05))),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster, region ORDER BY cloud, md5(CAST(tile_id AS STRING)), tile_id) AS depth FROM t)
    SELECT cluster, tile_id, row_number() OVER (PARTITION BY cluster ORDER BY depth, place) AS turn FROM p JOIN k USING (cluster, region) QUALIFY turn <= 4""",
)
def _(b):
    rows = b("tiles").join(b("observations").select("observation_id", "aoi_name"), "observation_id")
    return reports.examples(rows.select("tile_id", "cloud", (F.col("tile_id") % 9).alias("cluster"), F.when(F.col("tile_id") % 31 == 0, "rare").otherwise(F.col("aoi_name")).alias("region")))


@query("f6_draw_order", "SELECT tile_id, row_number() OVER (ORDER BY cloud DESC, acquired_at, tile_id) AS z FROM {tiles} JOIN {observations} USING (observation_id)")
def _(b):
    return reports.draw_order(b("tiles").join(b("observations").select("observation_id", "acquired_at"), "observation_id")).select("tile_id", "z")


# ---- sets


@query(
    "s1_pooled_lists",
    f"""WITH r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({SEEDED})), a AS (SELECT vec_id, rank AS rank_a FROM r WHERE query_id = 0 AND rank <= 15), b AS (SELECT vec_id, rank AS rank_b FROM r WHERE query_id = 100 AND rank <= 15),
    l AS (SELECT vec_id, rank_a, rank_b FROM a FULL JOIN b USING (vec_id)) SELECT vec_id, rank_a, rank_b, false AS drawn FROM l UNION ALL
    (SELECT vec_id, NULL, NULL, true FROM {{vectors}} WHERE vec_id NOT IN (SELECT vec_id FROM l) ORDER BY md5(CAST(vec_id AS STRING) || ':5'), vec_id LIMIT 12)""",
)
def _(b):
    ranked = search.similar_to(b("vectors"), b("vectors").where("vec_id % 100 = 0").select("vec_id"), 15)
    return reports.pooled(ranked.where("query_id = 0"), ranked.where("query_id = 100"), b("vectors"), 15, 12, 5)


@query("s5_split_leaks", "SELECT source_id, count(DISTINCT split) AS n_splits FROM (SELECT l_partkey AS source_id, l_linenumber % 3 AS split FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT l_partkey, 0 FROM lineitem WHERE l_partkey % 2 = 1) GROUP BY 1 HAVING n_splits > 1")
def _(b):
    source = F.col("part_no")
    return reports.leaked(b("lines").select(source.alias("source_id"), F.when(source % 2 == 0, F.col("line_no") % 3).otherwise(0).alias("split")))


@query(
    "s6_common_footprint",
    """WITH RECURSIVE o AS (SELECT place, observation_id AS file_id, west, south, east, north, row_number() OVER (PARTITION BY place ORDER BY acquired_at, observation_id) AS k FROM {scenes_at}),
    f AS (SELECT place, 0::BIGINT AS k, 0::BIGINT AS file_id, false AS kept, -1e9 AS w, -1e9 AS s, 1e9 AS e, 1e9 AS n FROM (SELECT DISTINCT place FROM o) UNION ALL
     SELECT o.place, o.k, o.file_id, ok, CASE WHEN ok THEN greatest(w, west) ELSE w END, CASE WHEN ok THEN greatest(s, south) ELSE s END, CASE WHEN ok THEN least(e, east) ELSE e END, CASE WHEN ok THEN least(n, north) ELSE n END
     FROM (SELECT o.*, f.w, f.s, f.e, f.n, greatest(w, west) < least(e, east) AND greatest(s, south) < least(n, north) AS ok FROM f JOIN o ON o.place = f.place AND o.k = f.k + 1) o)
    SELECT place, file_id, kept FROM f WHERE k > 0""",
)
def _(b):
    return reports.common_footprint(b("scenes_at").withColumnRenamed("observation_id", "file_id"))


# ---- names, dates and text


@query(
    "h2_scene_parts",
    """SELECT observation_id, 'S2' || CASE WHEN observation_id % 2 = 0 THEN 'A' ELSE 'B' END AS platform, acquired_at AS scene_date, 'S2' || CASE WHEN observation_id % 2 = 0 THEN 'A' ELSE 'B' END || '_MSIL2A_' || replace(acquired_at, '-', '') || 'T050701' AS bare_name FROM {observations}""",
)
def _(b):
    name = F.concat(F.lit("S2"), F.when(F.col("observation_id") % 2 == 0, "A").otherwise("B"), F.lit("_MSIL2A_"), F.regexp_replace("acquired_at", "-", ""), F.lit("T050701__"), F.lower("aoi_name"))
    return b("observations").select("observation_id", *[v.alias(k) for k, v in reports.scene_parts(name).items()])


@query("h3_tile_parts", "SELECT tile_id, row_no, col_no, 'im' || CAST(tile_id AS STRING) AS stem, row_no * 824 AS x, col_no * 824 AS y FROM {tiles}")
def _(b):
    n = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    tile = F.concat(F.lit("S2A__r_"), F.lit("x_r"), n("row_no"), F.lit("_c"), n("col_no"))
    chip = F.concat(F.lit("im"), F.col("tile_id").cast("string"), F.lit("__"), (F.col("row_no") * 824).cast("string"), F.lit("_"), (F.col("col_no") * 824).cast("string"))
    named = b("tiles").select("tile_id", tile.alias("tile"), chip.alias("chip"))
    return named.select("tile_id", *[v.alias(k) for k, v in (reports.tile_parts(F.col("tile")) | reports.chip_parts(F.col("chip"))).items()])


@query("h4_radii_and_box", "SELECT observation_id, 500.0 AS first, CASE WHEN observation_id % 5 + 1000.0 = 1000 THEN 2 ELSE 3 END AS n, west, north FROM {scenes_at}")
def _(b):
    text = lambda c: F.col(c).cast("string")
    rows = b("scenes_at").withColumn("box", F.concat_ws(", ", *map(text, ("west", "south", "east", "north")))).withColumn("list", F.concat(F.lit("1000, 500,"), (F.col("observation_id") % 5 + 1000).cast("string")))
    out = rows.select("observation_id", reports.radii(F.col("list")).alias("r"), reports.bbox_of(F.col("box")).alias("b"))
    return out.select("observation_id", F.col("r")[0].alias("first"), F.size("r").alias("n"), "b.west", "b.north")


@query(
    "h5_day_difference",
    """SELECT earlier, later, date_diff('day', a::DATE, z::DATE) AS days, CASE WHEN month(a::DATE) = month(z::DATE) THEN 'same season' ELSE 'different season' END AS season FROM (
    SELECT observation_id AS earlier, acquired_at AS a, lead(observation_id) OVER w AS later, lead(acquired_at) OVER w AS z FROM {observations} WINDOW w AS (PARTITION BY place ORDER BY acquired_at, observation_id)) WHERE later IS NOT NULL""",
)
def _(b):
    from terratile.operators import catalog

    pairs = catalog.consecutive_pairs(b("observations"))
    return pairs.select("earlier", "later", *[v.alias(k) for k, v in reports.day_text(F.col("earlier_at"), F.col("later_at")).items()])


@query("h10_padded_extent", "SELECT place, round(w - (e - w) * 0.1, 6) AS west, round(s - (n - s) * 0.1, 6) AS south, round(e + (e - w) * 0.1, 6) AS east, round(n + (n - s) * 0.1, 6) AS north FROM (SELECT place, min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS n FROM {scenes_at} GROUP BY place)")
def _(b):
    from terratile.operators import places

    boxes = places.extents(b("scenes_at"), "place")
    return boxes.select("place", *[F.round(v, 6).alias(k) for k, v in reports.padded({c: F.col(c) for c in ("west", "south", "east", "north")}, 0.1).items()])


@query(
    "h20_footprint_box",
    """SELECT candidate_id, round(lon - greatest(pair_id * 20 / 2, 30.0) / 1000 / (111.32 * cos(radians(lat))), 6) AS west, round(lat - greatest(pair_id * 20 / 2, 30.0) / 1000 / 110.57, 6) AS south,
    round(lon + greatest(pair_id * 20 / 2, 30.0) / 1000 / (111.32 * cos(radians(lat))), 6) AS east, round(lat + greatest(pair_id * 20 / 2, 30.0) / 1000 / 110.57, 6) AS north FROM {findings}""",
)
def _(b):
    box = reports.footprint_box(F.col("lon"), F.col("lat"), F.col("pair_id") * 20)
    return b("findings").select("candidate_id", *[F.round(v, 6).alias(k) for k, v in box.items()])


@query(
    "h13_lexicon_terms",
    """WITH t AS (SELECT * FROM (VALUES ('build', 'ndbi'), ('footprint', 'ndbi'), ('river', 'ndwi'), ('bank', 'ndwi'), ('crop', 'ndvi')) v(stem, idx))
    SELECT candidate_id AS query_id, idx AS index, string_agg(DISTINCT stem, ',' ORDER BY stem) AS terms FROM {findings} JOIN t ON contains(lower(detail), stem) GROUP BY ALL""",
)
def _(b):
    stems = [("build", "ndbi"), ("footprint", "ndbi"), ("river", "ndwi"), ("bank", "ndwi"), ("crop", "ndvi")]
    return reports.lexicon_terms(b("findings").select(F.col("candidate_id").alias("query_id"), F.col("detail").alias("text")), stems)


@query(
    "h15_headlines",
    """SELECT candidate_id, CASE change_type WHEN 'construction' THEN 'Construction' WHEN 'vegetation_loss' THEN 'Vegetation Loss' WHEN 'water_gain' THEN 'Water Gain' WHEN 'water_loss' THEN 'Water Loss' ELSE 'Other' END || ' ('
    || CASE WHEN confidence >= 0.85 THEN 'high confidence' WHEN confidence >= 0.6 THEN 'medium confidence' WHEN confidence IS NULL THEN 'unrated' ELSE 'low confidence' END || '), '
    || CASE WHEN first_at IS NULL THEN 'date not determined' ELSE 'between ' || first_at || ' and ' || last_at END || '. ' || CASE persistence WHEN 'persistent' THEN 'It has stayed since.' WHEN 'transient' THEN 'It did not last.' ELSE 'It was seen once.' END || ' '
    || CASE WHEN sar_available THEN printf('Radar change %.1f dB.', vv_db) ELSE 'No radar cover.' END AS headline FROM {findings}""",
)
def _(b):
    return reports.headline(b("findings")).select("candidate_id", "headline")


@query(
    "h16_distinct_labels",
    """WITH c AS (SELECT DISTINCT l_linenumber AS run, l_suppkey AS cluster, 'concept ' || CAST(l_suppkey % 7 AS STRING) AS concept, CASE WHEN l_suppkey % 5 <> 0 THEN 'r' || CAST(l_suppkey % 4 AS STRING) END AS region FROM lineitem),
    f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY run, concept) <= 1 THEN concept ELSE concept || coalesce(' (' || region || ')', ' (c' || CAST(cluster AS STRING) || ')') END AS label FROM c)
    SELECT run, cluster, CASE WHEN count(*) OVER (PARTITION BY run, label) > 1 AND NOT ends_with(label, '(c' || CAST(cluster AS STRING) || ')') THEN concept || ' (c' || CAST(cluster AS STRING) || ')' ELSE label END AS label FROM f""",
)
def _(b):
    keys = b("lines").select(F.col("line_no").alias("run"), F.col("supplier_no").alias("cluster")).distinct()
    text = lambda c: c.cast("string")
    rows = keys.select("run", "cluster", F.concat(F.lit("concept "), text(F.col("cluster") % 7)).alias("concept"), F.when(F.col("cluster") % 5 != 0, F.concat(F.lit("r"), text(F.col("cluster") % 4))).alias("region"))
    return reports.distinct_labels(rows).select("run", "cluster", "label")


@query(
    "h17_flat_numbers",
    """SELECT decision_id, 'a.n' AS path, decision_id * 1e0 AS value FROM {decisions} UNION ALL SELECT decision_id, 'a.b.c', 1.5e0 FROM {decisions} WHERE decision_id % 2 = 0 UNION ALL SELECT decision_id, 'top', 3e0 FROM {decisions} UNION ALL SELECT decision_id, 'p.q.r.s.t.u', decision_id + 0.25e0 FROM {decisions}""",
)
def _(b):
    n = F.col("decision_id").cast("string")
    inner = F.when(F.col("decision_id") % 2 == 0, '{"c": 1.5}').otherwise('"text"')
    doc = F.concat(F.lit('{"meta": {"x": 1}, "top": 3, "list": [1, 2], "ok": true, "p": {"q": {"r": {"s": {"t": {"u": '), n, F.lit('.25}}}}}, "a": {"n": '), n, F.lit(', "b": '), inner, F.lit("}}"))
    return reports.flat_numbers(b("decisions").select("decision_id", doc.alias("doc")), "decision_id", "doc")
