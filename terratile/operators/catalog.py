"""Catalogue operators: keyed writes, lookups, joins, rollups and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.operators import scan


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them; of rows of ``new`` that share a key the greatest stays."""
    columns = new.columns
    new = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("_row")).select("_row.*")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def keep_context(old: DataFrame, new: DataFrame, key: str, context: list[str]) -> DataFrame:
    """Upsert that never touches the ``context`` columns of rows that are there."""
    fresh = new.drop(*context).withColumn("_is_new", F.lit(True))
    other = [c for c in fresh.columns if c not in (key, "_is_new")]
    joined = old.alias("o").join(fresh.alias("n"), key, "full_outer")
    return joined.select(
        key, *[F.when(F.col("n._is_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in other], *[f"o.{c}" for c in context]
    )


def register(old: DataFrame, new: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """``upsert``; a row of ``new`` without its parent is an error."""
    if not orphans(new, parents, parent_key).isEmpty():
        raise ValueError(f"{parent_key} is unknown")
    return upsert(old, new, key)


def register_observations(old: DataFrame, new: DataFrame, scenes: DataFrame) -> DataFrame:
    """``register`` by observation_id; a missing dataset_dir is the id."""
    named = new.withColumn("dataset_dir", F.coalesce("dataset_dir", F.col("observation_id").cast("string")))
    return register(old, named, "observation_id", scenes, "scene_id")


def append_vectors(old: DataFrame, new: DataFrame, key: str, dim: int) -> DataFrame:
    """``old`` (id, key, embedding) with ``new`` behind it: ids go on from the count in order of ``key``; another length of vector is an error."""
    if not new.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).isEmpty():
        raise ValueError(f"a vector has not {dim} elements")
    placed = scan.positions(new, [F.col(key)], "at").withColumn("id", F.col("at") - 1 + F.lit(old.count()))
    return old.unionByName(placed.select(old.columns))


def append_tiles(tiles: DataFrame, new: DataFrame, observations: DataFrame) -> DataFrame:
    """``tiles`` with ``new``; raises when a tile is there already or twice in ``new``, or its observation is not there."""
    twice = new.groupBy("tile_id").count().where("count > 1")
    known = new.join(tiles.select("tile_id"), "tile_id", "left_semi")
    orphan = new.join(observations.select("observation_id"), "observation_id", "left_anti")
    for wrong, what in ((twice, "tile_id comes twice"), (known, "tile_id is there already"), (orphan, "observation_id is unknown")):
        if not wrong.isEmpty():
            raise ValueError(what)
    return tiles.unionByName(new)


def tile_chain(tiles: DataFrame, observations: DataFrame, scenes: DataFrame, collections: DataFrame) -> DataFrame:
    """Tile, observation, scene and collection joined by their keys."""
    return tiles.join(observations, "observation_id").join(scenes, "scene_id").join(collections, "collection_id")


def query_tiles(chain: DataFrame, bbox: tuple | None = None, dates: tuple | None = None, sensor: str | None = None, platform: str | None = None, max_cloud: float | None = None) -> DataFrame:
    """Tiles that meet a box, inclusive dates (as text), collection sensor, scene platform and a largest cloud share."""
    keep: Column = F.lit(True)
    if bbox:
        west, south, east, north = bbox
        keep = keep & (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    if dates:
        keep = keep & F.col("acquired_at").between(*dates)
    for name, value in (("sensor", sensor), ("platform", platform)):
        if value is not None:
            keep = keep & (F.col(name) == value)
    return chain.where(keep if max_cloud is None else keep & (F.col("cloud") <= max_cloud))


def observation_rollup(tiles: DataFrame) -> DataFrame:
    """Per observation: envelope, count, cloud mean, median and maximum, clear tiles."""
    return tiles.groupBy("observation_id").agg(
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        F.count("*").alias("n_tiles"), F.round(F.avg("cloud"), 6).alias("cloud_mean"), F.percentile("cloud", 0.5).alias("cloud_median"),
        F.max("cloud").alias("cloud_max"), F.count_if(F.col("cloud") <= 0.05).alias("n_clear"),
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def region_sensor_catalogue(chain: DataFrame) -> DataFrame:
    """Per region and sensor: observations, dates, first and last date, tiles."""
    return chain.groupBy("aoi_name", "sensor").agg(
        F.countDistinct("observation_id").alias("n_observations"), F.countDistinct("acquired_at").alias("n_dates"),
        F.min("acquired_at").alias("first_date"), F.max("acquired_at").alias("last_date"), F.count("*").alias("n_tiles"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive: row count and the sum of row hashes modulo 2**32."""
    row = F.crc32(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).cast("binary"))
    return df.agg(F.count("*").alias("n_rows"), (F.sum(row) % F.lit(2**32)).alias("fingerprint"))


def best_acquisition(observations: DataFrame) -> DataFrame:
    """Per place the least cloudy observation, the newest on a tie, then the smallest id."""
    best = F.min_by(F.struct("observation_id", "acquired_at", "mean_cloud"), F.struct("mean_cloud", -F.unix_date(F.to_date("acquired_at")), "observation_id"))
    return observations.groupBy("place").agg(best.alias("b")).select("place", "b.*")


def latest_decision(log: DataFrame) -> DataFrame:
    """Last row of each candidate by (created_at, decision_id); ``reopen`` reads as undecided."""
    last = log.groupBy("candidate_id").agg(F.max(F.struct("created_at", "decision_id", "decision")).alias("d"))
    status = F.when(F.col("d.decision") == "reopen", "undecided").otherwise(F.col("d.decision"))
    return last.select("candidate_id", "d.decision_id", "d.decision", status.alias("status"))


def consecutive_pairs(observations: DataFrame) -> DataFrame:
    """Neighbours in acquisition order at each place, with the days between."""
    order = Window.partitionBy("place").orderBy("acquired_at", "observation_id")
    nexts = observations.select(
        "place", F.col("observation_id").alias("earlier"), F.col("acquired_at").alias("earlier_at"), F.lead("observation_id").over(order).alias("later"), F.lead("acquired_at").over(order).alias("later_at")
    ).where(F.col("later").isNotNull())
    return nexts.withColumn("days", F.datediff("later_at", "earlier_at"))


def cumulative_by_date(rows: DataFrame) -> DataFrame:
    """Running count and area of each type over dates (a daily aggregate first)."""
    daily = rows.groupBy("change_type", "day").agg(F.count("*").alias("n"), F.sum("area_px").alias("area"))
    run = Window.partitionBy("change_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("change_type", "day", F.sum("n").over(run).alias("n_so_far"), F.sum("area").over(run).alias("area_so_far"))


def set_context(rows: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` replaced where ``new`` has the key; keys that are not there add nothing."""
    fresh = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(fresh, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_{c}" for c in columns])


def append_decisions(log: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """The log with new decisions; a blank id or time is filled in, and a decision that is none of the three raises an error."""
    known = F.col("decision").isin("confirm", "reject", "reopen")
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("decision")).otherwise(F.raise_error(F.lit("unknown decision")))
    filled = new.withColumns({"decision": checked, "decision_id": F.coalesce("decision_id", F.xxhash64(*new.columns)), "created_at": F.coalesce("created_at", now if now is not None else F.current_timestamp())})
    return log.unionByName(filled.select(log.columns))


def update_watches(watches: DataFrame, changes: DataFrame, clearable: list[str]) -> DataFrame:
    """Partial update: a change's null leaves a column alone, but clears those named in its array ``cleared`` if they are ``clearable``."""
    columns = [c for c in watches.columns if c != "watch_id"]
    new = changes.select("watch_id", F.col("cleared").alias("_cleared"), *[F.col(c).alias(f"_{c}") for c in columns if c in changes.columns])
    joined = watches.join(new, "watch_id", "left")
    out = {}
    for c in columns:
        value = F.coalesce(f"_{c}", c) if c in changes.columns else F.col(c)
        if c in clearable:
            value = F.when(F.coalesce(F.array_contains("_cleared", c), F.lit(False)), F.lit(None)).otherwise(value)
        out[c] = value
    return joined.select("watch_id", *[v.alias(c) for c, v in out.items()])


def delete_watches(watches: DataFrame, notices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Watches without those of ``gone``, and the notices of the watches that stay."""
    keys = gone.select("watch_id").distinct()
    return watches.join(keys, "watch_id", "left_anti"), notices.join(keys, "watch_id", "left_anti")
