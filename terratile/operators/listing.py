"""Lookups and lists of the catalogue, the search results and the candidate queue.

Filters are optional arguments: one that is None keeps all rows.  All of them
are column predicates, so those on stored columns reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import within_ring
from terratile.operators.watch import kinds, of_members, spread_for_join
from terratile.storage import stage_table

#: Other names of the two sensors (fixed values).
RADAR = ["sentinel-1", "s1", "sar", "c-sar"]
OPTICAL = ["sentinel-2", "s2", "msi", "sentinel-2a", "sentinel-2b"]


def _where(rows: DataFrame, tests: list[Column | None]) -> DataFrame:
    return rows.where(reduce(and_, [t for t in tests if t is not None], F.lit(True)))


def _equals(**values) -> list[Column | None]:
    return [None if v is None else F.col(k) == v for k, v in values.items()]


def _overlaps(bbox: tuple | None) -> Column | None:
    if bbox is None:
        return None
    west, south, east, north = bbox
    return (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row or rows of one key."""
    return rows.where(F.col(key) == value)


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``, each once per row."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def looked_up(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A row for each asked id with the columns of ``rows``, and ``missing`` where there is none."""
    found = rows.withColumn("_there", F.lit(True))
    return ids.select(key).distinct().join(found, key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def list_tiles(tiles: DataFrame, observation_id=None) -> DataFrame:
    """Tiles, of one observation if given, by vector id (tiles without one first)."""
    return _where(tiles, _equals(observation_id=observation_id)).orderBy(F.col("vec_id").asc_nulls_first(), "tile_id")


def list_scenes(scenes: DataFrame, observations: DataFrame) -> DataFrame:
    """Scenes with the date of their first observation, in order of it."""
    first = observations.groupBy("scene_id").agg(F.min("acquired_at").alias("acquired_at"))
    return scenes.join(first, "scene_id", "left").orderBy(F.col("acquired_at").asc_nulls_last(), "scene_id")


def list_observations(observations: DataFrame, scenes: DataFrame, collection_id=None, dates: tuple | None = None, point: tuple | None = None, bbox: tuple | None = None) -> DataFrame:
    """Observations of a collection, within inclusive dates, whose footprint holds a point or meets a box.

    The footprint is ``ring`` (array of x, y) where there is one, whose edge does
    not belong to it, else the box west, south, east, north.
    """
    rows = observations.join(_where(scenes, _equals(collection_id=collection_id)).select("scene_id"), "scene_id", "left_semi") if collection_id is not None else observations
    tests: list[Column | None] = [_overlaps(bbox), None if dates is None else F.col("acquired_at").between(*dates)]
    if point is not None:
        x, y = F.lit(float(point[0])), F.lit(float(point[1]))
        tests.append((F.col("west") < x) & (x < F.col("east")) & (F.col("south") < y) & (y < F.col("north")))
        if "ring" in observations.columns:
            tests.append(F.col("ring").isNull() | within_ring(x, y, F.col("ring")))
    return _where(rows, tests).orderBy("acquired_at", "observation_id")


def list_derived(derived: DataFrame, observation_id=None, tile_id=None, kind: str | None = None) -> DataFrame:
    return _where(derived, _equals(observation_id=observation_id, tile_id=tile_id, kind=kind)).orderBy("derived_id")


def spectral_tile_ids(rows: DataFrame, version: str | None = None) -> DataFrame:
    """Ids of the tiles that are described, by one version if given."""
    return _where(rows, _equals(version=version)).select("tile_id").distinct()


def list_decisions(log: DataFrame, candidate_id=None, limit: int | None = None) -> DataFrame:
    """Decisions in the order they were made; the first ``limit``."""
    rows = _where(log, _equals(candidate_id=candidate_id)).orderBy("created_at", "decision_id")
    return rows if limit is None else rows.limit(limit)


def list_watches(watches: DataFrame, active_only: bool = False) -> DataFrame:
    return watches.where("active") if active_only else watches


def list_notices(notices: DataFrame, watch_id=None, unseen_only: bool = False) -> DataFrame:
    """Notices of a watch, the newest first."""
    rows = _where(notices, [*_equals(watch_id=watch_id), ~F.col("seen") if unseen_only else None])
    return rows.orderBy(F.desc("created_at"), "notification_id")


def select_tiles(tiles: DataFrame, collection_ids: DataFrame | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Embedded tiles by vector id, from beyond ``after``; the first ``limit``."""
    rows = tiles if collection_ids is None else tiles.join(collection_ids.select("collection_id").distinct(), "collection_id", "left_semi")
    rows = _where(rows, [F.col("vec_id").isNotNull(), None if after is None else F.col("vec_id") > after]).orderBy("vec_id")
    return rows if limit is None else rows.limit(limit)


def footprints(tiles: DataFrame) -> DataFrame:
    """Adds width, height (km) and area of each tile by the scale at its middle latitude."""
    width = (F.col("east") - F.col("west")) * 111.32 * F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    height = (F.col("north") - F.col("south")) * 110.57
    return tiles.withColumns({"width_km": width, "height_km": height, "area_km2": width * height})


def tiles_with_hits(detections: DataFrame) -> DataFrame:
    """Tiles with detections, most first."""
    return detections.groupBy("tile_id").agg(F.count("*").alias("n"), F.max("score").alias("best")).orderBy(F.desc("n"), "tile_id")


# ---- search results


def search_filters(hits: DataFrame, bbox: tuple | None = None, dates: tuple | None = None, sensor: str | None = None, max_cloud: float | None = None) -> DataFrame:
    """Hits whose tile's middle lies in an inclusive box, by inclusive dates, sensor and largest cloud share."""
    tests = [*_equals(sensor=sensor), None if dates is None else F.col("acquired_at").between(*dates), None if max_cloud is None else F.col("cloud") <= max_cloud]
    if bbox is not None:
        west, south, east, north = bbox
        tests += [((F.col("west") + F.col("east")) / 2).between(west, east), ((F.col("south") + F.col("north")) / 2).between(south, north)]
    return _where(hits, tests)


def hits_with_tiles(hits: DataFrame, chain: DataFrame) -> DataFrame:
    """Scored vectors with what the catalogue knows of their tile; vectors without one drop out."""
    return hits.join(chain, "vec_id")


# ---- candidate queue


def with_status(candidates: DataFrame, latest: DataFrame, key: str = "candidate_id") -> DataFrame:
    """``candidates`` with ``decision``, the latest status of each or ``undecided``."""
    status = latest.select(key, F.col("status").alias("decision"))
    return candidates.join(status, key, "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))


def list_candidates(
    rows: DataFrame, ids: DataFrame | None = None, change_type: str | None = None, min_confidence: float | None = None, persistence: str | None = None,
    first_detected: list[str] | None = None, sensor: str | None = None, year: int | None = None, dates: tuple | None = None, bbox: tuple | None = None,
    decision: str | None = None, all_dates: tuple = ("", ""),
) -> DataFrame:
    """Candidates (with ``decision``) that meet all filters given.

    The window of a candidate is first_at .. last_at, or ``all_dates`` where it
    has none; it must overlap ``dates`` (an end may be None; ``year`` stands for
    an end that is not given).  ``first_detected`` holds windows as ``first_last``
    or ``none``.  A radar name asks for radar evidence, an optical one for nothing,
    any other finds nothing.
    """
    start, end = dates or (None, None)
    start, end = (start or (f"{year}-01-01" if year else None)), (end or (f"{year}-12-31" if year else None))
    window = F.when(F.col("first_at").isNull(), "none").otherwise(F.concat_ws("_", "first_at", "last_at"))
    name = (sensor or "").lower()
    radar = None if not sensor or name in OPTICAL else F.coalesce("sar_available", F.lit(False)) if name in RADAR else F.lit(False)
    tests = [
        *_equals(change_type=change_type, persistence=persistence, decision=decision),
        None if min_confidence is None else F.coalesce("confidence", F.lit(0.0)) >= min_confidence,
        None if first_detected is None else window.isin(first_detected), radar,
        None if start is None else F.coalesce("last_at", F.lit(all_dates[1])) >= start, None if end is None else F.coalesce("first_at", F.lit(all_dates[0])) <= end,
        _overlaps(bbox),
    ]
    found = _where(rows, tests)
    return found if ids is None else with_ids(found, ids, "candidate_id")


def candidate_page(rows: DataFrame, sort: str = "queue_score", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in sorted order with ``place``; a leading minus or ``rank`` sorts upwards, nulls count as -1, ties go by id."""
    key = sort.lstrip("-")
    value = F.coalesce(F.col(key).cast("double"), F.lit(-1.0)) if dict(rows.dtypes)[key] != "string" else F.col(key)
    order = [value.asc() if sort.startswith("-") or key == "rank" else value.desc(), F.col("candidate_id")]
    page = rows.orderBy(*order).limit(offset + limit)
    return page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("place") > offset)


def candidate_summary(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """The list row of each candidate: gates as booleans, largest anomaly, radar evidence where there is any, and its zone (candidate_id, zone)."""
    anomaly = F.round(F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in ("d_ndvi", "d_ndbi", "d_ndwi")]), 3)
    found = rows.join(zones, "candidate_id", "left")
    radar = F.when(F.col("sar_available"), F.col("vv_db"))
    return found.select(
        "candidate_id", "change_type", "confidence", "queue_score", "persistence", "decision", F.col("quality_ok").alias("gate_quality"), F.col("radiometric_ok").alias("gate_radiometric"),
        anomaly.alias("spectral_anomaly_max"), radar.alias("sar_vv_db"), F.when(F.col("zone") != "outside", F.col("zone")).alias("zone"),
    )


def is_number(value: str) -> Column:
    kind = F.schema_of_variant(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def json_levels(start: DataFrame, step: str, together: int = 4) -> Iterator[DataFrame]:
    """The levels of nested JSON, one by one, until no object or list is left.

    ``start`` has a variant ``value``; ``step`` is SQL from {level} to the next
    level, which keeps its columns.  ``together`` levels are planned at once;
    what is nested deeper is written, as text, before it is opened further, so
    the plan does not grow with the depth.
    """
    spark, level = start.sparkSession, start
    while True:
        for _ in range(together):
            level = spark.sql(step, level=level)
            yield level
        kind = F.schema_of_variant("value")
        inside = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        left = stage_table(inside.withColumn("value", F.to_json("value")), "json_level")
        if left.isEmpty():
            return
        level = left.withColumn("value", F.parse_json("value"))


def audit_rows(log: DataFrame) -> DataFrame:
    """The log without its snapshots (JSON), but with their sorted field names and whether there is one."""
    keys = F.array_sort(F.json_object_keys("snapshot"))
    return log.withColumns({"snapshot_keys": F.coalesce(F.array_join(keys, ","), F.lit("")), "has_snapshot": F.coalesce(F.size(keys) > 0, F.lit(False))}).drop("snapshot")


def first_number(rows: DataFrame, key: str, document: str, needle: str) -> DataFrame:
    """(key, found): of a JSON document the first number, level by level, whose field's name (lower case, ``:`` and ``-`` as ``_``) holds ``needle``.

    Looked for at any depth; null where there is none.  Of documents that share a key the first number of any is taken.
    """
    start = rows.select(key, F.try_parse_json(document).alias("value"), F.array().cast("array<int>").alias("at"))
    number = is_number("value")
    name = F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[:-]", "_")
    found = None
    for inner in json_levels(start, f"SELECT {key}, array_append(at, pos) AS at, key AS name, item AS value FROM (SELECT {key}, at, e.* FROM {{level}}, LATERAL variant_explode(value) AS e(pos, key, item))"):
        here = inner.where(name.contains(needle) & number).select(key, "at", F.try_variant_get("value", "$", "double").alias("number"))
        found = here if found is None else found.union(here)
    first = found.groupBy(key).agg(F.min(F.struct(F.size("at"), "at", "number")).alias("m")).select(key, F.col("m.number").alias("found"))
    return rows.select(key).join(first, key, "left")


# ---- joins of candidates, places and tiles


def tile_of_candidate(candidates: DataFrame, tiles: DataFrame, reach: float = 0.002, cell: float = 1.0) -> DataFrame:
    """(candidate_id, tile_id): an embedded tile that the box ``reach`` round the point meets, of the later observation if there is one, then by vector id; null if none."""
    boxes = tiles.where("vec_id IS NOT NULL").select("tile_id", "vec_id", "observation_id", *[(F.col(c) + d).alias(c) for c, d in (("west", -reach), ("south", -reach), ("east", reach), ("north", reach))])
    points = candidates.select("candidate_id", "lon", "lat", "later", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    met = points.join(spread_for_join(boxes, cell), ["cx", "cy"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    other = F.coalesce(F.col("observation_id") != F.col("later"), F.lit(True))
    best = met.groupBy("candidate_id").agg(F.min(F.struct(other.alias("other"), "vec_id", "tile_id")).alias("b")).select("candidate_id", "b.tile_id")
    return candidates.select("candidate_id").join(best, "candidate_id", "left")


def provenance(tiles: DataFrame, observations: DataFrame, scenes: DataFrame, collections: DataFrame) -> DataFrame:
    """Each tile with its observation, scene and collection; a missing parent is an error."""
    rows = tiles.join(observations.withColumn("_o", F.lit(1)), "observation_id", "left").join(scenes.withColumn("_s", F.lit(1)), "scene_id", "left")
    rows = rows.join(collections.withColumn("_c", F.lit(1)), "collection_id", "left")
    whole = F.col("_o").isNotNull() & F.col("_s").isNotNull() & F.col("_c").isNotNull()
    checked = F.when(whole, F.col("tile_id")).otherwise(F.raise_error(F.concat(F.lit("no parent for tile "), F.col("tile_id").cast("string"))))
    return rows.withColumn("tile_id", checked).drop("_o", "_s", "_c")


def candidate_provenance(candidates: DataFrame, chain: DataFrame, tiles: DataFrame, reach: float = 0.01, cell: float = 1.0) -> DataFrame:
    """(candidate_id, role, observation, scene, collection, tile_id) of a candidate's observation before and after.

    ``candidates`` has earlier and later; ``chain`` has observations joined to
    scene and collection; the tile is the first of that observation within
    ``reach`` of the point, null if none is.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("observation_id")) for r, c in (("before", "earlier"), ("after", "later"))]))
    asked = candidates.select("candidate_id", "lon", "lat", roles.alias("r")).select("candidate_id", "lon", "lat", "r.*")
    tiles = tiles.join(asked.select("observation_id").distinct(), "observation_id", "left_semi")
    boxes = tiles.select("tile_id", "observation_id", *[(F.col(c) + d).alias(c) for c, d in (("west", -reach), ("south", -reach), ("east", reach), ("north", reach))])
    cells = asked.withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})
    met = cells.join(spread_for_join(boxes, cell), ["observation_id", "cx", "cy"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    first = met.groupBy("candidate_id", "role").agg(F.min("tile_id").alias("tile_id"))
    return asked.select("candidate_id", "role", "observation_id").join(chain, "observation_id").join(first, ["candidate_id", "role"], "left")


def named_pairs(observations: DataFrame) -> DataFrame:
    """(place, name, earlier, later): consecutive observations and the whole span of each place, named by year.

    The first observation of a year is named by it, others by year and month; of
    those of one name the last stands at the place of the first.
    """
    year, order = F.substring("acquired_at", 1, 4), ["acquired_at", "observation_id"]
    rows = observations.withColumn("nth", F.row_number().over(Window.partitionBy("place", year).orderBy(*order)))
    named = rows.withColumn("label", F.when(F.col("nth") == 1, year).otherwise(F.substring("acquired_at", 1, 7)))
    labels = named.groupBy("place", "label").agg(F.min(F.struct(*order)).alias("at"), F.max(F.struct(*order))["observation_id"].alias("id"))
    by = Window.partitionBy("place").orderBy("at")
    span = Window.partitionBy("place").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = labels.withColumns({"n_label": F.lead("label").over(by), "n_id": F.lead("id").over(by), "l_label": F.last("label").over(span), "l_id": F.last("id").over(span), "nth": F.row_number().over(by)})
    near = pairs.where("n_id IS NOT NULL").select("place", F.concat_ws("-", "label", "n_label").alias("name"), F.col("id").alias("earlier"), F.col("n_id").alias("later"))
    far = pairs.where("nth = 1 AND l_label <> label").select("place", F.concat_ws("-", "label", "l_label").alias("name"), F.col("id").alias("earlier"), F.col("l_id").alias("later"))
    return near.union(far).distinct()


def companion_pairs(pairs: DataFrame, companions: DataFrame) -> DataFrame:
    """``pairs`` (earlier, later) with the radar observations that go with both; pairs without either drop out."""
    of = companions.select("observation_id", "companion")
    return pairs.join(of.toDF("earlier", "radar_earlier"), "earlier").join(of.toDF("later", "radar_later"), "later")


def labelled_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """``hits`` with the cluster and label of their vector; -1 and no label where it has none."""
    return hits.join(labels, "vec_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def point_relation(points: DataFrame, rings: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point_id, ring_id): points strictly inside a ring (ring_id, ring: closed array of x, y), by cell of the ring's box; rings of one shape are tried once."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    shapes, members = kinds(rings, "ring_id", ["ring"])
    boxes = shapes.select("kind", "ring", F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))
    cells = points.withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})
    met = cells.join(spread_for_join(boxes, cell), ["cx", "cy"])
    return of_members(met.where(within_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select("point_id", "kind"), members).select("point_id", "ring_id")


def sensor_dossier(observations: DataFrame, needle: str) -> DataFrame:
    """The first observation of each place and year with its catalogue fields and the first number of its metadata (JSON) named like ``needle``."""
    year = F.substring("acquired_at", 1, 4)
    order = Window.partitionBy("place", year).orderBy("acquired_at", "observation_id")
    first = observations.withColumn("year", year).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.join(first_number(first, "observation_id", "metadata", needle), "observation_id")
