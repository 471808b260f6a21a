"""Queries of sinks, sources, keyed writes and streams, over the bindings, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratile.operators import catalog
from terratile.plans.bindings import BINDINGS, bind, sql
from terratile.plans.registry import QUERIES, SQL, query
from terratile.sources import features
from terratile.storage import shared_dir
from terratile.streaming import logs


def ring(side: float = 0.001):
    lon, lat = F.col("lon"), F.col("lat")
    corners = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side), (0.0, 0.0)]
    return F.array(*[F.array(lon + x, lat + y) for x, y in corners])


@query("a17_feature_export", "SELECT candidate_id, pair_id, confidence, lon AS west, lat AS south, lon + 0.001e0 AS east, lat + 0.001e0 AS north, 5 AS n_positions FROM {candidates}")
def _(b):
    rows = b("candidates")
    path = shared_dir(rows.sparkSession, "features")
    features.feature_lines(rows, ring(), ["candidate_id", "pair_id", "confidence"]).write.text(path)
    back = features.read_features(rows.sparkSession, path, "candidate_id: bigint, pair_id: bigint, confidence: double")
    corner = lambda i, k, n: F.col("ring")[i][k].alias(n)
    return back.select("candidate_id", "pair_id", "confidence", corner(0, 0, "west"), corner(0, 1, "south"), corner(2, 0, "east"), corner(2, 1, "north"), F.size("ring").alias("n_positions"))


@query("a16_ranked_csv", "SELECT candidate_id, pair_id, area_px, lon, lat, confidence, seen_at::DATE AS seen_on FROM {candidates}")
def _(b):
    rows = b("candidates").select("candidate_id", "pair_id", "area_px", "lon", "lat", "confidence", F.to_date("seen_at").alias("seen_on"))
    path = shared_dir(rows.sparkSession, "ranked")
    rows.write.option("header", True).csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "a18_export_errors",
    """SELECT candidate_id, array_to_string(list_filter([CASE WHEN candidate_id % 5 = 0 THEN 'ring' END, CASE WHEN lon + (candidate_id % 7) * 30 > 180 THEN 'range' END, CASE WHEN candidate_id % 11 = 0 THEN 'missing:confidence' END,
    CASE WHEN candidate_id % 13 = 0 THEN 'dates' END, CASE WHEN candidate_id % 17 = 0 THEN 'digest' END], lambda x: x IS NOT NULL), ',') AS errors FROM {candidates}""",
)
def _(b):
    key = F.col("candidate_id")
    closed = F.when(key % 5 == 0, F.slice(ring(0.0), 1, 3)).otherwise(F.transform(ring(0.0), lambda p: F.array(p[0] + (key % 7) * 30, p[1])))
    moved = F.transform(closed, lambda p: F.when(key % 5 == 0, F.array(p[0] + (key % 7) * 30, p[1])).otherwise(p))
    dates = [F.lit("2020-02-29"), F.when(key % 13 == 0, "2021-02-30").otherwise("2021-03-01")]
    digest = F.when(key % 17 == 0, "abc").otherwise(F.sha2(key.cast("string"), 256))
    errors = features.export_errors(moved, {"confidence": F.when(key % 11 != 0, F.col("confidence"))}, dates, digest)
    return b("candidates").select("candidate_id", F.concat_ws(",", errors).alias("errors"))


@query("a23_label_text", "SELECT chip_id, x0, y0, x1, y1, class_id, false AS difficult FROM {boxes}")
def _(b):
    boxes = b("boxes")
    path = shared_dir(boxes.sparkSession, "labels")
    heads = boxes.select("chip_id").distinct().select("chip_id", F.lit("gsd:0.5").alias("value"))
    # one folder a chip set, which is few; one folder an image would be as many as there are images
    features.label_lines(boxes, "chip_id").unionByName(heads).write.partitionBy("chip_id").text(path)
    at = lambda i, n: F.col("corners")[i].alias(n)
    back = features.read_labels(boxes.sparkSession, path)
    return back.select(F.col("chip_id").cast("long").alias("chip_id"), at(0, "x0"), at(1, "y0"), at(4, "x1"), at(5, "y1"), F.col("class_id").cast("long").alias("class_id"), "difficult")


# ---- keyed writes


@query("a5_append_tiles", "SELECT tile_id, observation_id FROM {tiles}")
def _(b):
    tiles = b("tiles").select("tile_id", "observation_id")
    return catalog.append_tiles(tiles.where("tile_id % 10 <> 0"), tiles.where("tile_id % 10 = 0"), b("observations"))


@query(
    "a10_set_context",
    "SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN CASE WHEN tile_id % 6 <> 0 THEN row_no * 2.5 END ELSE 1e6 END AS dist_water FROM {tiles} WHERE tile_id % 2 = 0 OR tile_id % 5 = 0",
)
def _(b):
    old = b("tiles").where("tile_id % 2 = 0 OR tile_id % 5 = 0").select("tile_id", F.lit(1e6).alias("dist_water"))
    new = b("tiles").where("tile_id % 3 = 0").select("tile_id", F.when(F.col("tile_id") % 6 != 0, F.col("row_no") * 2.5).alias("dist_water"))
    return catalog.set_context(old, new, "tile_id", ["dist_water"])


@query(
    "a11_append_decisions",
    "SELECT decision_id, candidate_id, decision, created_at FROM {decisions} WHERE decision_id % 4 <> 0 UNION ALL SELECT decision_id, candidate_id, decision, CASE WHEN decision_id % 8 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE created_at END FROM {decisions} WHERE decision_id % 4 = 0",
)
def _(b):
    log = b("decisions").select("decision_id", "candidate_id", "decision", "created_at")
    new = log.where("decision_id % 4 = 0").withColumn("created_at", F.when(F.col("decision_id") % 8 != 0, F.col("created_at")))
    return catalog.append_decisions(log.where("decision_id % 4 <> 0"), new, F.lit("2025-01-01 00:00:00").cast(new.schema["created_at"].dataType))


@query(
    "a12_watch_updates",
    "SELECT watch_id, west, CASE WHEN watch_id % 3 = 0 THEN NULL WHEN watch_id % 2 = 0 THEN 0.9e0 ELSE min_confidence END AS min_confidence, active FROM {watches} WHERE watch_id % 7 <> 0",
)
def _(b):
    watches = b("watches").select("watch_id", "west", "min_confidence", "active")
    cleared = F.when(F.col("watch_id") % 3 == 0, F.array(F.lit("min_confidence"), F.lit("west")))
    changes = watches.where("watch_id % 2 = 0 OR watch_id % 3 = 0").select("watch_id", F.when(F.col("watch_id") % 2 == 0, 0.9).alias("min_confidence"), F.lit(None).cast("double").alias("west"), cleared.alias("cleared"))
    kept, _ = catalog.delete_watches(watches, b("decisions").withColumnRenamed("candidate_id", "watch_id"), watches.where("watch_id % 7 = 0"))
    return catalog.update_watches(kept, changes, ["min_confidence"])


# ---- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, keep = BINDINGS[name]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return logs.read_log(spark, sf_dir, table, schema).where(keep).selectExpr(*columns)


def n1_incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.upsert_table(logs.tile_rollup(_stream(spark, sf_dir, "tiles")), "observation_id")


QUERIES["n1_incremental_rollup"] = n1_incremental_rollup
SQL["n1_incremental_rollup"] = sql(
    "SELECT observation_id, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, count(*) AS n_tiles, max(cloud) AS cloud_max, count(*) FILTER (cloud <= 0.05) AS n_clear FROM {tiles} GROUP BY observation_id"
)


def n5_once_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["candidate_id", "lon", "lat", "confidence"]
    return logs.watch_once(_stream(spark, sf_dir, "candidates").select(*columns), bind(spark, sf_dir, "watches"))


QUERIES["n5_once_only"] = n5_once_only
SQL["n5_once_only"] = sql(
    "SELECT DISTINCT watch_id, candidate_id FROM {watches} w JOIN {candidates} c ON active AND lon BETWEEN west AND east AND lat BETWEEN south AND north AND confidence >= min_confidence"
)
