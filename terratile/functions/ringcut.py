"""Common areas of many pairs of rings at once, for batches inside tasks.

A batch is flat: the points of all rings one after the other, and where each
ring begins.  One edge of every window cuts all rings of the batch in a few
array operations, then the next edge does.  Sums run in the order of the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Rings = tuple[np.ndarray, np.ndarray, np.ndarray]  # x, y of all points, number of points of each ring


def _flat(rings: pa.ListArray) -> Rings:
    """A null ring has no points."""
    points = rings.flatten()
    x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
    size = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return x, y, size


def _next(size: np.ndarray) -> np.ndarray:
    """For each point the place of the one after it in its ring."""
    after = np.arange(1, int(size.sum()) + 1)
    ends = np.cumsum(size)
    some = size > 0
    after[ends[some] - 1] = (ends - size)[some]
    return after


def signed_areas(rings: Rings) -> np.ndarray:
    """Positive for anticlockwise rings."""
    x, y, size = rings
    row, first = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
    after, dx, dy = _next(size), x - x[first], y - y[first]
    return np.bincount(row, dx * dy[after] - dx[after] * dy, len(size)) / 2


def _turned(rings: Rings) -> Rings:
    """Anticlockwise rings: the others in reverse."""
    x, y, size = rings
    start = np.cumsum(size) - size
    at = np.arange(len(x))
    back = np.repeat(signed_areas(rings) < 0, size)
    at = np.where(back, np.repeat(2 * start + size - 1, size) - at, at)
    return x[at], y[at], size


def cut(rings: Rings, windows: Rings) -> Rings:
    """What is left of each ring inside its window, a convex anticlockwise ring."""
    x, y, size = rings
    wx, wy, edges = windows
    begin, after = np.cumsum(edges) - edges, _next(edges)
    for e in range(int(edges.max(initial=0))):
        row = np.repeat(np.arange(len(size)), size)
        open_ = (edges > e)[row]
        a = np.where(edges > e, begin + e, 0)
        b = after[a][row]
        a = a[row]
        side = (wx[b] - wx[a]) * (y - wy[a]) - (wy[b] - wy[a]) * (x - wx[a])
        to = _next(size)
        kept = ~(side < 0) | ~open_
        crossed = np.flatnonzero((kept != kept[to]) & open_)
        many = kept.astype(np.int64)
        many[crossed] += 1
        place = np.cumsum(many) - many
        new_x, new_y = np.empty(int(many.sum())), np.empty(int(many.sum()))
        new_x[place[kept]], new_y[place[kept]] = x[kept], y[kept]
        t = side[crossed] / (side[crossed] - side[to[crossed]])
        spot = place[crossed] + kept[crossed]
        new_x[spot] = x[crossed] + t * (x[to[crossed]] - x[crossed])
        new_y[spot] = y[crossed] + t * (y[to[crossed]] - y[crossed])
        x, y, size = new_x, new_y, np.bincount(row, many, len(size)).astype(np.int64)
    return x, y, size


def common_areas(ring: pa.ListArray, window: pa.ListArray) -> tuple[np.ndarray, Rings, Rings, np.ndarray]:
    """(common areas, the rings, the windows, where either is null)."""
    rings, windows = _flat(ring), _flat(window)
    none = ring.is_null().to_numpy(zero_copy_only=False) | window.is_null().to_numpy(zero_copy_only=False)
    return np.abs(signed_areas(cut(rings, _turned(windows)))), rings, windows, none


def _common(ring: pa.Array, window: pa.Array) -> pa.Array:
    area, _, _, none = common_areas(ring, window)
    return pa.array(area, pa.float64(), mask=none)


def _share(ring: pa.Array, window: pa.Array) -> pa.Array:
    common, left, right, none = common_areas(ring, window)
    union = np.abs(signed_areas(left)) + np.abs(signed_areas(right)) - common
    bad = none | ~(common > 0) | (union == 0)
    return pa.array(np.divide(common, union, where=~bad, out=np.zeros(len(common))), pa.float64(), mask=bad)


def common_area(ring: Column, window: Column) -> Column:
    """Area of what a ring and a convex ring of any direction have in common.  Not worked out again where a filter asks for it."""
    return F.arrow_udf(_common, "double").asNondeterministic()(ring, window)


def iou(left: Column, right: Column) -> Column:
    """Common area over the area of both, the right ring convex; null where they have none.  Like ``common_area`` otherwise."""
    return F.arrow_udf(_share, "double").asNondeterministic()(left, right)
