"""Reading and writing of reports, judged sets, ledgers, manifests and sharded embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratile.operators import catalog, scan

_DETAIL = "candidate_id bigint, change_type string, confidence double"


def read_ranked(spark: SparkSession, report: str, details: str | None) -> DataFrame:
    """Ranked candidates: those of the detail files (one to a line), or, without any, the list inside the report (one JSON document)."""
    if details is not None:
        return spark.read.schema(_DETAIL).json(details)
    inner = _DETAIL.replace(" bigint", ": bigint").replace(" string", ": string").replace(" double", ": double")
    return spark.read.schema(f"top array<struct<{inner}>>").option("multiLine", True).json(report).select(F.inline("top"))


def brief_lines(brief: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column ``value``: a sentence for each row of a sector brief, in order of its key."""
    parts = [F.format_string(f"{n.replace('_', ' ')} %s", F.coalesce(F.col(n).cast("string"), F.lit("none"))) for n in names]
    return brief.orderBy(key).select(F.concat(F.col(key).cast("string"), F.lit(": "), F.concat_ws(", ", *parts), F.lit(".")).alias("value"))


def record_artifacts(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest's artifacts with those of ``new`` put in by name."""
    return catalog.upsert(manifest, new, "name")


def record_section(sections: DataFrame, name: str, facts: DataFrame) -> DataFrame:
    """(section, key, value): a section's keys put in or replaced; other sections and keys stay."""
    rows = facts.select(F.lit(name).alias("section"), "key", "value")
    kept = sections.join(rows.select("section", "key"), ["section", "key"], "left_anti")
    return kept.unionByName(rows)


def write_map(rows: DataFrame, path: str, meta: dict[str, str]) -> None:
    """An embedding map (new_id, tile_id, source_id, observation_id) and its facts; a path that is there already is an error."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    facts = [(k, v) for k, v in meta.items()]
    rows.sparkSession.createDataFrame(facts, "key string, value string").write.mode("errorifexists").parquet(f"{path}/meta")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The map in order of new_id."""
    return spark.read.parquet(f"{path}/rows").orderBy("new_id")


def read_type_boxes(spark: SparkSession, path: str, classes: dict[int, int]) -> DataFrame:
    """(image_id, class_id, corners) of upright label features (one to a line: image, type, bounds); types without a class drop out."""
    rows = spark.read.schema("properties struct<image_id: bigint, type_id: int, bounds: array<double>>").json(path).select("properties.*")
    named = F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*map(F.lit, classes.values())))
    b = F.col("bounds")
    corners = F.array(*[F.struct(b[i].alias("x"), b[j].alias("y")) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))])
    return rows.withColumn("class_id", F.try_element_at(named, F.col("type_id"))).where("class_id IS NOT NULL").select("image_id", "class_id", corners.alias("corners"))


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, low_confidence, tile_id, grade) of judged sets (one query to a line with its grades by tile); a null grade is an error."""
    rows = spark.read.schema("query_id bigint, low_confidence boolean, grades map<string, int>").json(path)
    long = rows.select("query_id", "low_confidence", F.explode("grades").alias("tile_id", "grade"))
    bad = F.raise_error(F.concat(F.lit("no grade of tile "), F.col("tile_id")))
    return long.select("query_id", "low_confidence", F.col("tile_id").cast("long").alias("tile_id"), F.when(F.col("grade").isNotNull(), F.col("grade")).otherwise(bad.cast("int")).alias("grade"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; lines that are none drop out."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def ledger_tiers(ledger: DataFrame) -> DataFrame:
    """Per tier: scenes, tiles, seconds, tiles a second and the largest memory."""
    rows = ledger.groupBy("tier").agg(F.count("*").alias("n_scenes"), F.sum("n_tiles").alias("n_tiles"), F.sum("seconds").alias("seconds"), F.max("peak_mb").alias("peak_mb"))
    return rows.withColumn("tiles_per_s", F.col("n_tiles") / F.col("seconds"))


# ---- sharded embeddings


def shard_manifest(vectors: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """(shard, n_rows, sha256) of shards of ``size`` rows in order of ``key``; ``text`` should hold all of a row, its vector too."""
    return scan.shard_digests(vectors, [F.col(key)], text, size)


def shards_to_redo(wanted: DataFrame, done: DataFrame, same_header: bool = True) -> DataFrame:
    """(shard) of the plan (shard, n_rows) that the manifest lacks or holds with another row count or checksum; all of them if its header differs.

    ``done`` has shard, n_rows, sha256 as written and ``found``, the checksum of what is there now.
    """
    if not same_header:
        return wanted.select("shard")
    good = done.where(F.col("sha256").eqNullSafe(F.col("found"))).select("shard", "n_rows")
    return wanted.join(good, ["shard", "n_rows"], "left_anti").select("shard")


def finalised(wanted: DataFrame, done: DataFrame, n_rows: int) -> DataFrame:
    """The manifest in order of shards, if no shard is to be redone and the rows add up; otherwise an error."""
    missing = shards_to_redo(wanted, done).count()
    total = done.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    if missing or total != n_rows:
        raise ValueError(f"{missing} shards are missing or damaged; {total} of {n_rows} rows")
    return done.orderBy("shard")
