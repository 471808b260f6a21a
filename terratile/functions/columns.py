"""Column functions of the catalogue, change and map operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within [-1, 1]; 0 where the sum is not positive."""
    return F.when(a + b > 0, clip((a - b) / (a + b), -1.0, 1.0)).otherwise(0.0)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "High").when(c >= 0.60, "Medium").otherwise("Low")


def compass(aspect: Column) -> Column:
    """One of 16 sectors, half-even at the borders; null for a flat (negative) aspect."""
    sector = F.pmod(F.bround(aspect / 22.5, 0).cast("int"), F.lit(16))
    return F.when(aspect >= 0, F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * 2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    phi = F.radians(lat)
    return F.floor((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * 2**zoom)


def semantic_rescale(cosine: Column) -> Column:
    return clip((cosine - 0.15) / (0.32 - 0.15), 0.0, 1.0)


def inner_product(a: Column, b: Column) -> Column:
    """In doubles, summed in element order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def geometric_mean(terms: list[tuple[Column, float]], floor: float = 1e-3) -> Column:
    """Weighted geometric mean of values raised to ``floor``."""
    logs = sum((F.lit(w) * F.ln(F.greatest(v, F.lit(floor))) for v, w in terms), F.lit(0.0))
    return F.exp(logs / sum(w for _, w in terms))


def inside(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Inclusive on all sides."""
    return lon.between(west, east) & lat.between(south, north)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring (array of struct x, y), by counting crossings."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))
    crossed = F.filter(
        edges,
        lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y))
        & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column, slack: float = 1e-9) -> Column:
    """Whether a point lies on an edge of a closed ring."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))

    def touches(e: Column) -> Column:
        px, py, qx, qy = (e[a][b] for a in "pq" for b in "xy")
        across = (qx - px) * (y - py) - (qy - py) * (x - px)
        return (F.abs(across) <= slack) & x.between(F.least(px, qx) - slack, F.greatest(px, qx) + slack) & y.between(F.least(py, qy) - slack, F.greatest(py, qy) + slack)

    return F.exists(edges, touches)


def within_ring(x: Column, y: Column, ring: Column) -> Column:
    """Inside a closed ring and not on its edge."""
    return in_ring(x, y, ring) & ~on_ring(x, y, ring)


def ring_area(ring: Column) -> Column:
    """Area of a closed ring in its own units, whichever way round it goes."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2
