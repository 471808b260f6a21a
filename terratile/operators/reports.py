"""Summaries for the console, maps and reports, and the small helpers of their text and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import normalised_difference
from terratile.operators import scan
from terratile.operators.listing import is_number, json_levels

KM_LAT, KM_LON = 110.57, 111.32


def console_metrics(tables: dict[str, DataFrame], findings: DataFrame, chain: DataFrame) -> DataFrame:
    """(metric, value): rows of each table, scenes of each collection, distinct sensors, findings of each type."""
    counts = [df.agg(F.lit(f"n_{name}").alias("metric"), F.count("*").alias("value")) for name, df in tables.items()]
    scenes = chain.select("collection_id", "scene_id").distinct().groupBy(F.concat(F.lit("scenes_of_"), F.col("collection_id").cast("string")).alias("metric")).agg(F.count("*").alias("value"))
    sensors = chain.agg(F.lit("n_sensors").alias("metric"), F.count_distinct("sensor").alias("value"))
    types = findings.groupBy(F.concat(F.lit("findings_"), F.col("change_type")).alias("metric")).agg(F.count("*").alias("value"))
    return reduce(DataFrame.union, [*counts, scenes, sensors, types])


def concept_groups(clusters: DataFrame) -> DataFrame:
    """Per top concept: clusters, tiles, and the clusters' ids, largest first (as many as there are clusters of it)."""
    item = F.struct((-F.col("size")).alias("size"), "cluster")
    rows = clusters.groupBy("concept").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_tiles"), F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("concept", "n_clusters", "n_tiles", F.array_join(F.transform("items", lambda x: x["cluster"].cast("string")), ",").alias("clusters"))


def observation_archive(tiles: DataFrame, observations: DataFrame) -> DataFrame:
    """Per observation with tiles: granule, date, tiles, mean cloud and extent."""
    rows = tiles.groupBy("observation_id").agg(
        F.count("*").alias("n_tiles"), F.avg("cloud").alias("mean_cloud"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )
    return rows.join(observations.select("observation_id", "place", "acquired_at"), "observation_id")


def view_coverage(boxes: DataFrame, view: tuple, cell: float) -> DataFrame:
    """Of the boxes that meet a view: how many, first and last date, and the share of the view's cells whose middle one of them holds.

    A box gives the cells it shares with the view, so a row costs what the view has at most.
    """
    west, south, east, north = view
    nx, ny = round((east - west) / cell), round((north - south) / cell)
    hit = boxes.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))
    first = lambda low, at: F.greatest(F.ceil((F.col(low) - at) / cell - 0.5), F.lit(0))
    last = lambda high, at, n: F.least(F.floor((F.col(high) - at) / cell - 0.5), F.lit(n - 1))
    spans = hit.select(first("west", west).alias("x0"), last("east", west, nx).alias("x1"), first("south", south).alias("y0"), last("north", south, ny).alias("y1")).where("x0 <= x1 AND y0 <= y1")
    cells = spans.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y")).distinct()
    totals = hit.agg(F.count("*").alias("n_scenes"), F.min("acquired_at").alias("first_date"), F.max("acquired_at").alias("last_date"))
    return totals.crossJoin(cells.agg((F.count("*") / (nx * ny)).alias("fraction")))  # one row each


def detection_totals(detections: DataFrame) -> DataFrame:
    """Per observation: tiles with hits, hits, hits of the commonest class, mean and largest number a tile, and score quantiles of ranked rows.

    Quantiles are the scores at place ceil(q * n), found by running positions, so no task holds an observation.
    """
    per_tile = detections.groupBy("observation_id", "tile_id").agg(F.count("*").alias("n"))
    totals = per_tile.groupBy("observation_id").agg(F.count("*").alias("n_tiles"), F.sum("n").alias("n_hits"), F.avg("n").alias("mean_per_tile"), F.max("n").alias("max_per_tile"))
    by_class = detections.groupBy("observation_id", "class_id").agg(F.count("*").alias("n"))
    top = by_class.groupBy("observation_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "class_id")).alias("t")).select("observation_id", F.col("t.class_id").alias("top_class"), (-F.col("t.n")).alias("n_top_class"))
    placed = scan.running(detections.select("observation_id", "score", "det_id"), ["observation_id"], [F.col("score"), F.col("det_id")], {"at": F.lit(1)})
    sized = placed.join(totals.select("observation_id", "n_hits"), "observation_id")
    cuts = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    found = sized.groupBy("observation_id").agg(*[F.max(F.when(F.col("at") == F.ceil(F.col("n_hits") * q), F.col("score"))).alias(k) for k, q in cuts.items()])
    return totals.join(top, "observation_id").join(found, "observation_id")


def radar_agreement(findings: DataFrame, scene_db: float, drop: float = -1.0) -> DataFrame:
    """Of water gains: how many, with radar cover, agreeing (anomaly against the scene at ``drop`` dB or less) and the median anomaly."""
    rows = findings.where("change_type = 'water_gain'").withColumn("anomaly", F.when(F.col("sar_available"), F.col("vv_db") - scene_db))
    out = rows.agg(F.count("*").alias("n_gains"), F.count("anomaly").alias("n_covered"), F.count_if(F.col("anomaly") <= drop).alias("n_agree"))
    middle = scan.quantiles(rows.withColumn("_all", F.lit(1)), ["_all"], "anomaly", {"median_anomaly": 0.5}).drop("_all")
    out = out.join(F.broadcast(middle), F.lit(True), "left")  # one row each
    return out.withColumn("agreement", F.when(F.col("n_covered") > 0, F.col("n_agree") / F.col("n_covered")))


def latency_summary(rows: DataFrame, group: str, value: str, cuts: dict[str, float]) -> DataFrame:
    """Per group the count, the quantiles ``cuts`` and the greatest value; a group may be of any size."""
    ends = rows.groupBy(group).agg(F.count(value).alias("n"), F.max(value).alias("most"))
    return ends.join(scan.quantiles(rows, [group], value, cuts), group)


def spectral_evidence(stats: DataFrame, names: list[str]) -> DataFrame:
    """Tile statistics as evidence: ``usable`` where a pixel is valid, null statistics where none is, and ``patch_m``, the side of a seventh of a tile's degree at its middle latitude."""
    usable = F.col("n_valid") > 0
    rows = stats.withColumns({"usable": usable} | {c: F.when(usable, F.col(c)) for c in names})
    return rows.withColumn("patch_m", F.cos(F.radians("mid_lat")) * 111320 / 7)


def index_table(pixels: DataFrame, side: int, clear: list[int]) -> DataFrame:
    """Per observation and tile with a valid pixel: valid share, mean indices over valid pixels (4 digits), water share."""
    ok = F.col("scl").isin(*clear)
    pairs = {"ndvi": ("b08", "b04"), "ndwi": ("b03", "b08"), "ndbi": ("b11", "b08")}
    rows = pixels.select("observation_id", F.floor(F.col("y") / side).alias("row_no"), F.floor(F.col("x") / side).alias("col_no"), ok.alias("ok"), *[F.when(ok, normalised_difference(F.col(a), F.col(b))).alias(k) for k, (a, b) in pairs.items()])
    return rows.groupBy("observation_id", "row_no", "col_no").agg(
        F.avg(F.col("ok").cast("int")).alias("valid"), *[F.round(F.avg(k), 4).alias(k) for k in pairs], F.avg((F.col("ndwi") > 0).cast("int")).alias("water"),
    ).where("valid > 0")


def extreme_tiles(table: DataFrame) -> DataFrame:
    """Per observation the tiles most like vegetation, water and built ground, and whether each of the three stands out as it should."""
    best = {"vegetation": "ndvi", "water": "ndwi", "built": "ndbi"}
    tops = [F.max(F.struct(F.col(c).alias("v"), "row_no", "col_no", "ndvi", "ndwi", "ndbi")).alias(k) for k, c in best.items()]
    rows = table.groupBy("observation_id").agg(*tops)
    sane = (F.col("vegetation.ndvi") >= F.col("water.ndvi")) & (F.col("water.ndwi") >= F.col("vegetation.ndwi")) & (F.col("built.ndbi") >= F.col("vegetation.ndbi"))
    return rows.select("observation_id", *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in best for x in ("row_no", "col_no")], sane.alias("sane"))


def stage_deltas(stages: DataFrame) -> DataFrame:
    """(stage, precision, recall, f1) in order of ``step`` with the differences to the stage before (4 digits).  A benchmark has a handful of stages."""
    order = Window.partitionBy("benchmark").orderBy("step")
    return stages.withColumns({f"delta_{c}": F.round(F.col(c) - F.lag(c).over(order), 4) for c in ("precision", "recall", "f1")})


def cluster_runs(members: DataFrame, names: DataFrame) -> DataFrame:
    """Per run of clustering (run, cluster; -1 is noise): clusters, noise and largest share in percent (1 digit), labels that several clusters have."""
    sizes = members.groupBy("run", "cluster").agg(F.count("*").alias("n"))
    real = F.col("cluster") >= 0
    rows = sizes.groupBy("run").agg(
        F.count_if(real).alias("n_clusters"), F.round(100 * F.sum(F.when(~real, F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("noise_pct"), F.round(100 * F.max("n") / F.sum("n"), 1).alias("largest_pct"),
    )
    twice = names.groupBy("run", "label").count().where("count > 1").groupBy("run").agg(F.count("*").alias("n_shared_labels"))
    return rows.join(twice, "run", "left").withColumn("n_shared_labels", F.coalesce("n_shared_labels", F.lit(0)))


# ---- trajectories and timelines


def trajectory(lookups: DataFrame) -> DataFrame:
    """Per candidate from its pair lookups (candidate_id, earlier_at, later_at, covered, changed): covered and changed pairs, first change and class.

    Persistent where all pairs after the first change changed, transient where
    one of them did not, none without a change, unknown without cover.
    """
    changed = F.col("covered") & F.col("changed")
    pair = F.struct("later_at", "earlier_at")
    rows = lookups.groupBy("candidate_id").agg(
        F.count_if("covered").alias("n_covered"), F.count_if(changed).alias("n_changed"), F.min(F.when(changed, pair)).alias("first"),
        F.max(F.when(F.col("covered"), pair)).alias("last"), F.max(F.when(F.col("covered") & ~F.coalesce("changed", F.lit(False)), pair)).alias("last_same"),
    )
    kind = (  # what follows the first change shows in the last pair, and in the last one that did not change
        F.when(F.col("n_covered") == 0, "unknown").when(F.col("n_changed") == 0, "none").when(F.col("last") <= F.col("first"), "single")
        .when(F.col("last_same") > F.col("first"), "transient").otherwise("persistent")
    )
    return rows.select("candidate_id", "n_covered", "n_changed", F.col("first.earlier_at").alias("first_earlier"), F.col("first.later_at").alias("first_later"), kind.alias("trajectory"))


def trajectory_view(lookups: DataFrame, dates: DataFrame) -> DataFrame:
    """``lookups`` with ``interval``: ``consecutive`` where no date (acquired_at) of the place lies between the two, else ``span``."""
    order = Window.partitionBy("place").orderBy("acquired_at")
    steps = dates.select("place", "acquired_at").distinct().withColumn("next_at", F.lead("acquired_at").over(order))
    steps = steps.where("next_at IS NOT NULL").select("place", F.col("acquired_at").alias("earlier_at"), F.col("next_at").alias("later_at"), F.lit(True).alias("_step"))
    found = lookups.join(steps, ["place", "earlier_at", "later_at"], "left")
    return found.withColumn("interval", F.when(F.col("_step"), "consecutive").otherwise("span")).drop("_step")


def calendar_positions(dates: DataFrame) -> DataFrame:
    """Adds ``position``: where each date of a place lies between its first (0) and last (1); 0 for a single date."""
    ends = dates.groupBy("place").agg(F.min("acquired_at").alias("_a"), F.max("acquired_at").alias("_b"))
    span = F.datediff("_b", "_a")
    rows = dates.join(ends, "place")
    return rows.withColumn("position", F.when(span > 0, F.datediff("acquired_at", "_a") / span).otherwise(0.0)).drop("_a", "_b")


def playhead(positions: DataFrame, at: float) -> DataFrame:
    """(place, acquired_at): the latest date at or before a position, the first one before all."""
    best = F.coalesce(F.max(F.when(F.col("position") <= at, F.col("acquired_at"))), F.min("acquired_at"))
    return positions.groupBy("place").agg(best.alias("acquired_at"))


def examples(tiles: DataFrame, n: int = 4, least_share: float = 0.05) -> DataFrame:
    """(cluster, tile_id, turn): up to ``n`` clear tiles a cluster; regions of at least ``least_share`` of it take turns, the largest first.

    Within a region the clearest comes first, then the least MD5 of its id.  A
    cluster without such a region shows its largest.
    """
    counts = tiles.groupBy("cluster", "region").agg(F.count("*").alias("n"))
    total = counts.groupBy("cluster").agg(F.sum("n").alias("total"))
    ranked = counts.join(total, "cluster").withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "region")))
    any_ = F.max((F.col("n") / F.col("total") >= least_share).cast("int")).over(Window.partitionBy("cluster"))
    kept = ranked.withColumn("any", any_).where(F.when(F.col("any") == 1, F.col("n") / F.col("total") >= least_share).otherwise(F.col("place") == 1)).select("cluster", "region", "place")
    clear = Window.partitionBy("cluster", "region").orderBy("cloud", F.md5(F.col("tile_id").cast("string")), "tile_id")
    pool = tiles.withColumn("depth", F.row_number().over(clear)).where(F.col("depth") <= n)  # cut in each partition before the shuffle
    turns = Window.partitionBy("cluster").orderBy("depth", "place")
    return pool.join(kept, ["cluster", "region"]).withColumn("turn", F.row_number().over(turns)).where(F.col("turn") <= n).select("cluster", "tile_id", "turn")


def draw_order(tiles: DataFrame) -> DataFrame:
    """Adds ``z``, the order of drawing: the clearest last, then the newest, then by id."""
    return scan.positions(tiles, [F.desc("cloud"), F.col("acquired_at"), F.col("tile_id")], "z")


# ---- sets


def pooled(first: DataFrame, second: DataFrame, drawn: DataFrame, k: int, n_drawn: int, seed: int) -> DataFrame:
    """(vec_id, rank_a, rank_b, drawn): two top lists and a draw of ``n_drawn`` others by hash, each id once."""
    a = first.where(F.col("rank") <= k).select("vec_id", F.col("rank").alias("rank_a"))
    b = second.where(F.col("rank") <= k).select("vec_id", F.col("rank").alias("rank_b"))
    lists = a.join(b, "vec_id", "full")
    rest = drawn.select("vec_id").join(lists, "vec_id", "left_anti").orderBy(F.md5(F.concat_ws(":", "vec_id", F.lit(str(seed)))), "vec_id").limit(n_drawn)
    return lists.withColumn("drawn", F.lit(False)).unionByName(rest.select("vec_id", F.lit(None).cast("int").alias("rank_a"), F.lit(None).cast("int").alias("rank_b"), F.lit(True).alias("drawn")))


def leaked(rows: DataFrame) -> DataFrame:
    """(source_id, n_splits) of source images that stand in more than one split."""
    return rows.groupBy("source_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def common_footprint(files: DataFrame) -> DataFrame:
    """(place, file_id, kept): files by date stay while the box common to all kept ones is not empty.

    A place's files are folded in order in one row (their boxes only).
    """
    item = F.struct("acquired_at", "file_id", "west", "south", "east", "north")
    rows = files.groupBy("place").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(-1e9).alias("w"), F.lit(-1e9).alias("s"), F.lit(1e9).alias("e"), F.lit(1e9).alias("n"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        w, s, e, n = F.greatest(acc["w"], x["west"]), F.greatest(acc["s"], x["south"]), F.least(acc["e"], x["east"]), F.least(acc["n"], x["north"])
        grown = F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), F.array_append(acc["ids"], x["file_id"]).alias("ids"))
        return F.when((w < e) & (s < n), grown).otherwise(acc)

    folded = rows.select("place", "items", F.aggregate("items", start, step)["ids"].alias("ids"))
    return folded.select("place", "ids", F.explode("items").alias("i")).select("place", F.col("i.file_id").alias("file_id"), F.array_contains("ids", F.col("i.file_id")).alias("kept"))


def footprint_reasons(files: DataFrame) -> DataFrame:
    """(place, file_id, kept, reason): ``common_footprint``, and why a file is left out: ``no_box``, ``empty_box`` or ``apart_from_common``."""
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    none, empty = F.greatest(*[c.isNull() for c in sides]), (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north"))
    own = F.when(none, "no_box").when(empty, "empty_box")
    marked = files.select("place", "file_id", own.alias("own"))
    judged = common_footprint(files.where(own.isNull()))
    out = marked.join(judged, ["place", "file_id"], "left")
    kept = F.coalesce("kept", F.lit(False))
    return out.select("place", "file_id", kept.alias("kept"), F.coalesce("own", F.when(~kept, "apart_from_common")).alias("reason"))


# ---- names, dates and text


def tile_parts(name: Column) -> dict[str, Column]:
    """Row and column of ``..._rNNN_cNNN``; another name is an error."""
    bad = F.raise_error(F.concat(F.lit("no tile id: "), name))
    part = lambda g: F.regexp_extract(name, r"_r(\d{3,})_c(\d{3,})$", g)
    return {"row_no": F.when(part(1) != "", part(1).cast("long")).otherwise(bad), "col_no": F.when(part(2) != "", part(2).cast("long")).otherwise(bad)}


def chip_parts(name: Column) -> dict[str, Column]:
    """Stem and offsets of ``stem__x_y``; another name is an error."""
    part = lambda g: F.regexp_extract(name, r"^(.*)__(\d+)_(\d+)$", g)
    bad = F.raise_error(F.concat(F.lit("no chip id: "), name))
    return {"stem": F.when(part(2) != "", part(1)).otherwise(bad), "x": part(2).cast("long"), "y": part(3).cast("long")}


def scene_parts(scene_id: Column) -> dict[str, Column]:
    """Platform, date and bare name of a scene id such as ``S2A_..._20240315T..._area``."""
    day = F.regexp_extract(scene_id, r"(20\d{6})", 1)
    return {
        "platform": F.when(scene_id.rlike("^S[12][A-D]_"), F.substring(scene_id, 1, 3)), "scene_date": F.when(day != "", F.date_format(F.to_date(day, "yyyyMMdd"), "yyyy-MM-dd")),
        "bare_name": F.regexp_replace(scene_id, r"__[a-z0-9-]+$", ""),
    }


def radii(text: Column, low: float = 10.0, high: float = 100_000.0, most: int = 8) -> Column:
    """Sorted distinct numbers of a comma-separated text; 1 to ``most`` of them within bounds, or an error."""
    values = F.array_sort(F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))))
    good = F.size(values).between(1, most) & F.forall(values, lambda v: F.coalesce(v.between(low, high), F.lit(False)))
    return F.when(good, values).otherwise(F.raise_error(F.concat(F.lit("not a list of radii: "), text)))


def bbox_of(text: Column) -> Column:
    """Struct west, south, east, north of four comma-separated numbers, or an error."""
    v = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull()) & (v[0] <= v[2]) & (v[1] <= v[3])
    box = F.struct(v[0].alias("west"), v[1].alias("south"), v[2].alias("east"), v[3].alias("north"))
    return F.when(good, box).otherwise(F.raise_error(F.concat(F.lit("not a box: "), text)))


def day_text(earlier: Column, later: Column) -> dict[str, Column]:
    """Days between two ISO dates and whether they are of one season (the same month)."""
    same = F.month(F.to_date(earlier)) == F.month(F.to_date(later))
    return {"days": F.datediff(later, earlier), "season": F.when(same, "same season").otherwise("different season")}


def padded(box: dict[str, Column], share: float) -> dict[str, Column]:
    """A box grown by a share of its sides on each side."""
    w, h = box["east"] - box["west"], box["north"] - box["south"]
    return {"west": box["west"] - w * share, "south": box["south"] - h * share, "east": box["east"] + w * share, "north": box["north"] + h * share}


def footprint_box(x: Column, y: Column, side_m: Column, least_half_m: float = 30.0) -> dict[str, Column]:
    """The degree box of a square of ``side_m`` round a point, at least ``least_half_m`` to each side."""
    half = F.greatest(side_m / 2, F.lit(least_half_m)) / 1000
    dx, dy = half / (KM_LON * F.cos(F.radians(y))), half / KM_LAT
    return {"west": x - dx, "south": y - dy, "east": x + dx, "north": y + dy}


def lexicon_terms(queries: DataFrame, stems: list[tuple[str, str]]) -> DataFrame:
    """(query_id, index, terms): indices whose stems stand in the query's text, with the stems met, sorted."""
    table = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(i).alias("index")) for s, i in stems])
    text = F.lower(F.coalesce("text", F.lit("")))
    hit = queries.select("query_id", F.explode(F.filter(table, lambda t: F.contains(text, t["stem"]))).alias("t"))
    return hit.groupBy("query_id", F.col("t.index").alias("index")).agg(F.array_join(F.array_sort(F.collect_set("t.stem")), ",").alias("terms"))


def headline(rows: DataFrame) -> DataFrame:
    """Adds a plain sentence: what changed, how surely, when, and whether radar was there."""
    what = F.initcap(F.regexp_replace("change_type", "_", " "))
    sure = F.when(F.col("confidence") >= 0.85, "high confidence").when(F.col("confidence") >= 0.6, "medium confidence").when(F.col("confidence").isNull(), "unrated").otherwise("low confidence")
    when_ = F.when(F.col("first_at").isNull(), "date not determined").otherwise(F.format_string("between %s and %s", "first_at", "last_at"))
    stay = F.when(F.col("persistence") == "persistent", "It has stayed since.").when(F.col("persistence") == "transient", "It did not last.").otherwise("It was seen once.")
    radar = F.when(F.col("sar_available"), F.format_string("Radar change %s dB.", F.format_number("vv_db", 1))).otherwise("No radar cover.")
    return rows.withColumn("headline", F.format_string("%s (%s), %s. %s %s", what, sure, when_, stay, radar))


def distinct_labels(clusters: DataFrame) -> DataFrame:
    """``clusters`` (run, cluster, concept, region) with ``label``: the concept, with its region where concepts tie, with the cluster where that ties too."""
    by = lambda *c: F.count("*").over(Window.partitionBy(*c))
    own = F.concat(F.lit(" (c"), F.col("cluster").cast("string"), F.lit(")"))
    tied = clusters.withColumn("_n", by("run", "concept"))
    first = tied.withColumn("label", F.when(F.col("_n") <= 1, F.col("concept")).otherwise(F.concat("concept", F.coalesce(F.concat(F.lit(" ("), "region", F.lit(")")), own))))
    again = first.withColumn("_m", by("run", "label"))
    return again.withColumn("label", F.when((F.col("_m") > 1) & ~F.endswith("label", own), F.concat("concept", own)).otherwise(F.col("label"))).drop("_n", "_m")


def flat_numbers(rows: DataFrame, key: str, document: str, skip: tuple = ("meta",)) -> DataFrame:
    """(key, path, value): numbers of nested JSON objects by dotted path, at any depth; lists, texts, booleans and the top sections ``skip`` are left out."""
    start = rows.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("value"))
    step = f"""SELECT {key}, CASE WHEN path = '' THEN key ELSE path || '.' || key END AS path, item AS value FROM
    (SELECT {key}, path, e.* FROM {{level}}, LATERAL variant_explode(value) AS e(pos, key, item)) WHERE key IS NOT NULL AND NOT (path = '' AND key IN ({", ".join(repr(s) for s in skip) or "NULL"}))"""
    found = None
    for inner in json_levels(start, step):
        here = inner.where(is_number("value")).select(key, "path", F.try_variant_get("value", "$", "double").alias("value"))
        found = here if found is None else found.union(here)
    return found
