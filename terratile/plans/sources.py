"""Queries of reports, ledgers, manifests, sharded embeddings, map grids and evidence, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terratile.functions import grids
from terratile.operators import listing, reports
from terratile.plans.registry import query
from terratile.sources import ledgers
from terratile.storage import shared_dir


@query("a15_ranked_details", "SELECT candidate_id, change_type, confidence FROM {findings}")
def _(b):
    rows = b("findings").select("candidate_id", "change_type", "confidence")
    path = shared_dir(rows.sparkSession, "details")
    rows.write.json(path)
    return ledgers.read_ranked(rows.sparkSession, "", path)


@query("a15_inline_report", "SELECT candidate_id, change_type, confidence FROM {findings} ORDER BY candidate_id, confidence, change_type LIMIT 50")
def _(b):
    top = b("findings").select("candidate_id", "change_type", "confidence").orderBy("candidate_id", "confidence", "change_type").limit(50)
    path = shared_dir(top.sparkSession, "report")
    top.agg(F.collect_list(F.struct("candidate_id", "change_type", "confidence")).alias("top")).coalesce(1).write.json(path)  # fifty rows
    return ledgers.read_ranked(top.sparkSession, path, None)


@query(
    "a19_brief_text",
    "SELECT change_type || ': n ' || CAST(count(*) AS STRING) || ', persistent ' || CAST(count(*) FILTER (persistence = 'persistent') AS STRING) || ', first at ' || coalesce(min(first_at), 'none') || '.' AS value FROM {findings} GROUP BY change_type",
)
def _(b):
    brief = b("findings").groupBy("change_type").agg(F.count("*").alias("n"), F.count_if(F.col("persistence") == "persistent").alias("persistent"), F.min("first_at").alias("first_at"))
    path = shared_dir(brief.sparkSession, "brief")
    ledgers.brief_lines(brief, "change_type", ["n", "persistent", "first_at"]).write.text(path)
    return brief.sparkSession.read.text(path)


@query("a20_artifacts", "SELECT 'f' || CAST(tile_id AS STRING) AS name, CASE WHEN tile_id % 3 = 0 THEN tile_id * 2 ELSE tile_id END AS bytes FROM {tiles}")
def _(b):
    old = b("tiles").select(F.concat(F.lit("f"), F.col("tile_id").cast("string")).alias("name"), F.col("tile_id").alias("bytes"))
    return ledgers.record_artifacts(old, old.where("bytes % 3 = 0").withColumn("bytes", F.col("bytes") * 2))


@query("a20_sections", "SELECT CASE WHEN tile_id % 2 = 0 THEN 'runs' ELSE 'analysis' END AS section, CAST(tile_id AS STRING) AS key, CASE WHEN tile_id % 6 = 1 THEN 'new' ELSE 'old' END AS value FROM {tiles}")
def _(b):
    key = F.col("tile_id").cast("string").alias("key")
    old = b("tiles").select(F.when(F.col("tile_id") % 2 == 0, "runs").otherwise("analysis").alias("section"), key, F.lit("old").alias("value"))
    return ledgers.record_section(old, "analysis", b("tiles").where("tile_id % 6 = 1").select(key, F.lit("new").alias("value")))


_BITS = "concat(vec_id, ':', label, ':', array_to_string(list_transform(embedding, lambda e: CAST(round(e::DOUBLE * 1e6) AS BIGINT)), ','))"


def _vector_text():
    cells = F.transform("embedding", lambda e: F.round(e.cast("double") * 1e6).cast("long").cast("string"))
    return F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(cells, ","))


_MANIFEST = f"SELECT CAST(floor((n - 1) / 100) AS BIGINT) AS shard, count(*) AS n_rows, sha256(string_agg(t, chr(10) ORDER BY n)) AS sha256 FROM (SELECT row_number() OVER (ORDER BY vec_id) AS n, {_BITS} AS t FROM {{vectors}}) GROUP BY 1"


@query("a21_vector_shards", _MANIFEST)
def _(b):
    return ledgers.shard_manifest(b("vectors"), "vec_id", _vector_text(), 100)


@query("a21_shards_to_redo", f"SELECT shard FROM ({_MANIFEST}) WHERE shard % 3 = 1 OR shard % 4 = 2")
def _(b):
    whole = ledgers.shard_manifest(b("vectors"), "vec_id", _vector_text(), 100)
    # what is there: every third shard is missing, and one value of every fourth was changed
    damaged = b("vectors").withColumn("embedding", F.when(F.floor(F.col("vec_id") / 100) % 4 == 2, F.transform("embedding", lambda e: e + 1)).otherwise(F.col("embedding")))
    found = ledgers.shard_manifest(damaged, "vec_id", _vector_text(), 100).select("shard", F.col("sha256").alias("found"))
    return ledgers.shards_to_redo(whole.select("shard", "n_rows"), whole.where("shard % 3 <> 1").join(found, "shard"))


@query("a22_embedding_map", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS new_id, tile_id, vec_id AS source_id, observation_id FROM {tiles} WHERE vec_id IS NOT NULL")
def _(b):
    from terratile.operators import scan

    rows = scan.positions(b("tiles").where("vec_id IS NOT NULL"), [F.col("vec_id")], "at").select((F.col("at") - 1).alias("new_id"), "tile_id", F.col("vec_id").alias("source_id"), "observation_id")
    path = shared_dir(rows.sparkSession, "map")
    ledgers.write_map(rows, path, {"dim": "64"})
    return ledgers.read_map(rows.sparkSession, path)


@query("a24_type_boxes", "SELECT class_id + 10 AS class_id, count(*) AS n, sum(x0) AS x0, sum(y1) AS y1 FROM {boxes} WHERE class_id <> 3 GROUP BY 1")
def _(b):
    boxes = b("boxes")
    path = shared_dir(boxes.sparkSession, "typed")
    boxes.select(F.struct("image_id", F.col("class_id").cast("int").alias("type_id"), F.array("x0", "y0", "x1", "y1").alias("bounds")).alias("properties")).write.json(path)
    rows = ledgers.read_type_boxes(boxes.sparkSession, path, {k: k + 10 for k in (0, 1, 2, 4)})
    return rows.groupBy("class_id").agg(F.count("*").alias("n"), F.sum(F.col("corners")[0]["x"]).alias("x0"), F.sum(F.col("corners")[2]["y"]).alias("y1"))


@query("a25_judged_set", "SELECT observation_id AS query_id, observation_id % 4 = 0 AS low_confidence, tile_id, CAST(tile_id % 3 AS INT) AS grade FROM {tiles}")
def _(b):
    tiles = b("tiles")
    path = shared_dir(tiles.sparkSession, "judged")
    # a query's judged tiles are one line of the file
    grades = F.map_from_entries(F.collect_list(F.struct(F.col("tile_id").cast("string").alias("k"), (F.col("tile_id") % 3).cast("int").alias("v"))))
    tiles.groupBy(F.col("observation_id").alias("query_id")).agg((F.first("observation_id") % 4 == 0).alias("low_confidence"), grades.alias("grades")).write.json(path)
    return ledgers.read_judged(tiles.sparkSession, path)


@query("a27_ledger_tiers", "SELECT observation_id % 3 AS tier, count(*) AS n_scenes, sum(place) AS n_tiles, round(sum(gsd_m), 6) AS seconds, max(observation_id) AS peak_mb, round(sum(place) / sum(gsd_m), 6) AS tiles_per_s FROM {observations} GROUP BY 1")
def _(b):
    rows = b("observations").select((F.col("observation_id") % 3).alias("tier"), F.col("place").alias("n_tiles"), F.col("gsd_m").alias("seconds"), F.col("observation_id").alias("peak_mb"))
    path = shared_dir(rows.sparkSession, "ledger")
    rows.write.json(path)
    out = ledgers.ledger_tiers(ledgers.read_ledger(rows.sparkSession, path, "tier bigint, n_tiles bigint, seconds double, peak_mb bigint"))
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "tiles_per_s")})


# ---- map grids and evidence


@query(
    "h9_map_grid",
    f"""SELECT candidate_id, zone, band, round({grids.EASTING}, 3) AS easting, round({grids.NORTHING}, 3) AS northing FROM (SELECT *, {grids.TERMS} FROM (SELECT *, {grids.T} AS t FROM (SELECT candidate_id, lon, lat, radians(lat) AS phi, CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS zone,
    substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INT) + 1, 1) AS band, radians(lon - ((CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1) * 6 - 183)) AS dl FROM {{findings}})))""",
)
def _(b):
    rows = grids.with_grid(b("findings"))
    return rows.select("candidate_id", "zone", "band", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query(
    "b20_spectral_evidence",
    """SELECT t.observation_id, row_no, col_no, n_valid > 0 AS usable, CASE WHEN n_valid > 0 THEN ndvi END AS ndvi_mean, CASE WHEN n_valid > 0 THEN water END AS water_frac, round(cos(radians(10 + row_no)) * 111320 / 7, 4) AS patch_m FROM (
    SELECT observation_id, CAST(floor(y / 40) AS BIGINT) AS row_no, CAST(floor(x / 40) AS BIGINT) AS col_no, count(*) FILTER (scl IN (4, 5, 6, 7)) AS n_valid,
    round(avg(CASE WHEN b08 + b04 > 0 THEN (b08 - b04) / (b08 + b04) ELSE 0 END) FILTER (scl IN (4, 5, 6, 7)), 6) AS ndvi, round(avg((CASE WHEN b03 + b08 > 0 THEN (b03 - b08) / (b03 + b08) ELSE 0 END > 0)::INT) FILTER (scl IN (4, 5, 6, 7)), 6) AS water FROM {pixels} GROUP BY ALL) t""",
)
def _(b):
    from terratile.operators import raster

    stats = raster.tile_statistics(b("pixels"), 40).withColumn("mid_lat", F.col("row_no") + 10)
    rows = reports.spectral_evidence(stats, ["ndvi_mean", "water_frac"])
    return rows.select("observation_id", "row_no", "col_no", "usable", "ndvi_mean", "water_frac", F.round("patch_m", 4).alias("patch_m"))


@query(
    "c14_sensor_dossier",
    """SELECT place, substr(acquired_at, 1, 4) AS year, observation_id, platform, observation_id * 1e0 AS sun_elevation FROM {observations} JOIN {scenes} USING (scene_id) QUALIFY row_number() OVER (PARTITION BY place, substr(acquired_at, 1, 4) ORDER BY acquired_at, observation_id) = 1""",
)
def _(b):
    meta = F.concat(F.lit('{"view": {"view:sun_elevation": '), F.col("observation_id").cast("string"), F.lit("}}"))
    rows = b("observations").join(b("scenes"), "scene_id").withColumn("metadata", meta)
    return listing.sensor_dossier(rows, "sun_elevation").select("place", "year", "observation_id", "platform", F.col("found").alias("sun_elevation"))


@query("d21_latency_summary", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM {measures} GROUP BY event_type""")
def _(b):
    cuts = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    return reports.latency_summary(b("measures"), "event_type", "value", cuts).withColumns({c: F.round(c, 6) for c in cuts})
