"""Column functions of polygons: arrays of (x, y) points without the closing one, in the plane."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terratile.functions.ringcut import common_area, iou  # noqa: F401  (of rings as here)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def upright(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle between two corners."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def rotated(cx: Column, cy: Column, width: Column, height: Column, degrees: Column) -> Column:
    """The rectangle round a centre, turned anticlockwise."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[point(cx + i * width / 2 * c - j * height / 2 * s, cy + i * width / 2 * s + j * height / 2 * c) for i, j in corners])


def next_point(ring: Column, i: Column) -> Column:
    """The point after that of place ``i`` (from 0), the first after the last."""
    return F.get(ring, (i + 1) % F.size(ring))


def signed_area(ring: Column) -> Column:
    """Positive for an anticlockwise ring; 0 for fewer than three points."""

    def of(r: Column) -> Column:
        first = F.get(r, F.lit(0))

        def term(p: Column, i: Column) -> Column:
            return let(next_point(r, i), lambda q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))

        return F.aggregate(F.transform(r, term), F.lit(0.0), lambda s, t: s + t) / 2

    return let(ring, of)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def long_side(ring: Column) -> Column:
    """Length of the longest edge."""
    return let(ring, lambda r: F.array_max(F.transform(r, lambda p, i: F.hypot(next_point(r, i)["x"] - p["x"], next_point(r, i)["y"] - p["y"]))))


def extent(ring: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of the smallest upright box round a ring."""
    pick = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return {"x0": pick(F.array_min, "x"), "y0": pick(F.array_min, "y"), "x1": pick(F.array_max, "x"), "y1": pick(F.array_max, "y")}
