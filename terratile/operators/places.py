"""Regions, zones, rings and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import haversine
from terratile.storage import stage_table

#: Endings of area names, and tokens that name no region (fixed values).
SUFFIXES = ["_scaled_82km", "-82km", "_diverse", "_scaled"]
DROPPED = ["diverse", "scaled", "82km", ""]
KM_LON, KM_LAT = 111.32, 110.57


def region_key(name: Column) -> Column:
    """The name without its endings and without a last grid token such as ``_43RGP``; ``unknown`` if nothing is left."""
    for s in SUFFIXES:
        name = F.regexp_replace(name, f"{s}$", "")
    bare = F.regexp_replace(name, "_[0-9]{2}[A-Za-z]{3}$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def region_tokens(name: Column) -> Column:
    """The name's tokens, without staging words and grid tokens, joined by underscores; the name itself if none is left."""
    kept = F.filter(F.split(name, "[_-]"), lambda t: ~F.lower(t).isin(*DROPPED) & ~F.lower(t).rlike("^[0-9]{2}[a-z]{3}$"))
    return F.coalesce(F.nullif(F.array_join(kept, "_"), F.lit("")), F.nullif(name, F.lit("")), F.lit("unknown"))


def extents(rows: DataFrame, *group: str) -> DataFrame:
    """Union of boxes and count of each group."""
    return rows.groupBy(*group).agg(
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"), F.count("*").alias("n")
    )


def first_zone(points: DataFrame, zones: DataFrame, key: str, cell: float = 10.0) -> DataFrame:
    """(key, zone): of the zones whose inclusive box holds the point, the first by name; ``outside`` if none does.

    Boxes are spread over grid cells and met by cell, so far rows never meet.
    """
    for axis, low, high in (("cx", "west", "east"), ("cy", "south", "north")):
        zones = zones.withColumn(axis, F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))
    p, z = points.select(key, "lon", "lat").alias("p"), zones.alias("z")
    same = (F.floor(F.col("lon") / cell) == F.col("cx")) & (F.floor(F.col("lat") / cell) == F.col("cy"))
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    met = p.join(z, same & inside, "left")
    return met.groupBy(key).agg(F.coalesce(F.min("zone"), F.lit("outside")).alias("zone"))


def within_rings(layers: list[tuple[str, DataFrame]], lon: float, lat: float, radii: list[float]) -> DataFrame:
    """(kind, id, distance_m, ring) of features (id, west, south, east, north) within the largest radius.

    The distance is on a sphere to the nearest point of the feature's box, 0
    inside it; ``ring`` is the first radius that holds it.  A degree box is
    filtered first and reaches the scan.
    """
    radii = sorted(radii)
    reach_lat = radii[-1] / 1000 / KM_LAT * 1.02
    near = (F.col("south") <= lat + reach_lat) & (F.col("north") >= lat - reach_lat)
    x, y = (F.greatest(F.col(a), F.least(F.col(b), F.lit(float(v)))) for a, b, v in (("west", "east", lon), ("south", "north", lat)))
    ring = F.element_at(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(r)).alias("r")) for i, r in enumerate(radii)]), lambda s: F.col("distance_m") <= s["r"]), 1)
    out = None
    for kind, features in layers:
        one = features.where(near).select(F.lit(kind).alias("kind"), "id", haversine(F.lit(float(lon)), F.lit(float(lat)), x, y).alias("distance_m"))
        out = one if out is None else out.union(one)
    return out.where(F.col("distance_m") <= radii[-1]).withColumn("ring", ring["i"])


def ring_counts(hits: DataFrame, kinds: list[str], n_rings: int) -> DataFrame:
    """(ring, kind, n): features of each kind in that ring or a nearer one, zero filled."""
    rings = hits.sparkSession.range(n_rings).select(F.col("id").cast("int").alias("ring"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    counted = rings.join(hits.groupBy("ring", "kind").agg(F.count("*").alias("m")), ["ring", "kind"], "left")
    so_far = Window.partitionBy("kind").orderBy("ring")
    return counted.select("ring", "kind", F.coalesce(F.sum("m").over(so_far), F.lit(0)).alias("n"))


def core_box(cells: DataFrame, group: str, q: float = 0.025) -> DataFrame:
    """Per group the box between the q and 1 - q quantiles of each axis of cells (group, cx, cy, n), weighted by n.

    Each axis is summed to one row a coordinate first, so a group's window is as long as its grid is wide.
    """
    out = None
    for axis in ("cx", "cy"):
        line = cells.groupBy(group, axis).agg(F.sum("n").alias("n"))
        so_far = Window.partitionBy(group).orderBy(axis)
        line = line.withColumn("acc", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
        ends = line.groupBy(group).agg(
            F.min(F.when(F.col("acc") >= q * F.col("total"), F.col(axis))).alias(f"{axis}_low"), F.min(F.when(F.col("acc") >= (1 - q) * F.col("total"), F.col(axis))).alias(f"{axis}_high")
        )
        out = ends if out is None else out.join(ends, group)
    return out


def box_size_m(ring: Column) -> tuple[Column, Column]:
    """(length, width) in metres of an oriented box given as an array of struct(x, y) in degrees, by its first three corners."""
    phi = F.radians(F.aggregate(F.slice(ring, 1, 4), F.lit(0.0), lambda s, p: s + p["y"]) / 4)
    ky = 111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi)
    kx = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi)
    edge = lambda i: F.hypot((ring[i + 1]["x"] - ring[i]["x"]) * kx, (ring[i + 1]["y"] - ring[i]["y"]) * ky)
    return F.greatest(edge(0), edge(1)), F.least(edge(0), edge(1))


# ---- medoids


def medoids(points: DataFrame, group: str, cells: int = 16) -> DataFrame:
    """(group, point_id, lon, lat, total_m) of each group's medoid: the point with the least summed great-circle distance to the others, the smallest id on a tie.

    Points (group, point_id, lon, lat) of one place count as one with a weight.
    A grid of ``cells`` by ``cells`` over a group's extent has a centre, a
    weight and a radius for each cell that holds points; with them the sum of a
    place lies between two bounds.  Only places whose lower bound does not pass
    the least upper bound are summed exactly.  Points without a place are left out.
    """
    known = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    spots = known.groupBy(group, "lon", "lat").agg(F.count("*").alias("w"), F.min("point_id").alias("point_id"))
    box = known.groupBy(group).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    part = lambda c, low, high: F.least(F.floor((F.col(c) - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9)) * cells), F.lit(cells - 1))
    placed = spots.join(box, group).select(group, "lon", "lat", "w", "point_id", part("lon", "x0", "x1").alias("cx"), part("lat", "y0", "y1").alias("cy"))
    placed = stage_table(placed, "medoid_places")
    centre = placed.groupBy(group, "cx", "cy").agg((F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("clon"), (F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("clat"), F.sum("w").alias("cw"))
    away = haversine(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
    round_ = placed.join(centre, [group, "cx", "cy"]).groupBy(group, "cx", "cy").agg(F.max(away).alias("radius"), F.first("clon").alias("clon"), F.first("clat").alias("clat"), F.first("cw").alias("cw"))
    grids = round_.groupBy(group).agg(F.collect_list(F.struct("clon", "clat", "cw", "radius")).alias("grid"))  # cells * cells at most
    fold = lambda sign: F.aggregate("grid", F.lit(0.0), lambda s, c: s + c["cw"] * F.greatest(F.lit(0.0), haversine(F.col("lon"), F.col("lat"), c["clon"], c["clat"]) + sign * c["radius"]))
    bounded = stage_table(placed.join(grids, group).select(group, "lon", "lat", "w", "point_id", fold(-1).alias("low"), fold(1).alias("high")), "medoid_bounds")
    least = bounded.groupBy(group).agg(F.min("high").alias("least"))
    asked = bounded.join(least, group).where(F.col("low") <= F.col("least") * (1 + 1e-12) + 1e-6).select(group, "point_id", "lon", "lat")
    others = placed.select(group, F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.col("w").alias("ow"))
    sums = asked.join(others, group).groupBy(group, "point_id", "lon", "lat").agg(F.sum(F.col("ow") * haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat"))).alias("total_m"))
    return sums.groupBy(group).agg(F.min(F.struct(F.round("total_m", 3).alias("total_m"), "point_id", "lon", "lat")).alias("m")).select(group, "m.point_id", "m.lon", "m.lat", "m.total_m")


def framed(points: DataFrame, group: str, outlier_m: float = 2_500_000.0, pad: float = 0.12, least_pad: float = 0.02) -> DataFrame:
    """Per group the padded box round the points within ``outlier_m`` of its medoid, and how many are kept and left outside."""
    centre = medoids(points, group).select(group, F.col("lon").alias("mlon"), F.col("lat").alias("mlat"))
    rows = points.where("lon IS NOT NULL AND lat IS NOT NULL").join(centre, group)
    near = haversine(F.col("lon"), F.col("lat"), F.col("mlon"), F.col("mlat")) <= outlier_m
    ends = {"w": F.min(F.when(near, F.col("lon"))), "s": F.min(F.when(near, F.col("lat"))), "e": F.max(F.when(near, F.col("lon"))), "n": F.max(F.when(near, F.col("lat")))}
    out = rows.groupBy(group).agg(*[v.alias(k) for k, v in ends.items()], F.count_if(near).alias("n_kept"), F.count_if(~near).alias("n_outside"))
    px, py = F.greatest(F.lit(least_pad), (F.col("e") - F.col("w")) * pad), F.greatest(F.lit(least_pad), (F.col("n") - F.col("s")) * pad)
    return out.select(group, (F.col("w") - px).alias("west"), (F.col("s") - py).alias("south"), (F.col("e") + px).alias("east"), (F.col("n") + py).alias("north"), "n_kept", "n_outside")
