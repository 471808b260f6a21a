"""Density clusters of a sample of vectors: core distances, the spanning forest of mutual reachability, and its flat cut.

The rows are put in order of a Hilbert curve and packed in blocks of ``BLOCK``
vectors.  Two blocks meet in a task only if their balls and boxes come near
enough, and only with the vectors that lie near the other block; what is left
out cannot change a result.

A vector's core distance is that to its k-th nearest other vector.  The nearest
in the own block bound it, so a block looks as far as its own vectors lie apart,
not as far as the cut.  Two vectors are as far apart as the largest of their
distance and their two core distances.  The edges are taken in bands of length,
doubling up to the cut: of a band, two blocks keep a spanning forest of the
components of the bands before, and the components that meet are contracted.
Blocks that lie in one component do not meet again.  So the work grows with the
rows, also where the cut holds ever more of them.  The edges kept hold a minimum
spanning forest, as at any length they join what all edges join.

The sample is bounded: more than ``MOST`` rows raise an error (larger tables
are assigned to the sample's centroids, ``clusters.assign_nearest``).  Vectors
of one length are asked for; rows with a null id or vector, or a null or
non-finite component, are left out.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.curves import hilbert_keys
from terratile.operators.graph import connected_components
from terratile.storage import stage_table

BLOCK, MOST = 1024, 1 << 21
AXES, KEY_BITS, BANDS = 8, 56, 16
#: A block with the core distances and components of its vectors, in their order.
STATE = "block long, ids binary, vecs binary, core binary, comp binary"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed_blocks(vectors: DataFrame) -> DataFrame:
    """(block, ids, vecs): vectors that lie together on the curve, ``BLOCK`` a row, copies one after the other; written."""
    odd = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~odd).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("width")).first()
    if seen.n > MOST:
        raise ValueError(f"density clusters take a sample of {MOST} rows at most, not {seen.n}")
    if seen.n and seen.least != seen.width:
        raise ValueError("vectors have different lengths")
    size, bits = BLOCK, min(16, KEY_BITS // max(1, min(AXES, seen.width or 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))[:, :AXES]
            cells = ((x / (1 + np.abs(x)) + 1) * (1 << (bits - 1))).astype(np.int64)  # any number, into the grid
            yield pa.record_batch([batch.column("vec_id"), pa.array(hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)), batch.column("embedding")], names=["vec_id", "key", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids = part.column("vec_id").to_numpy().astype("<i8").tobytes()
                yield pa.record_batch([pa.array([number]), *[pa.array([v], pa.binary()) for v in (ids, _matrix(part.column("embedding")).tobytes())]], names=["block", "ids", "vecs"])
                number += 1

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, key long, embedding {kind}")
    parts = max(1, -(-seen.n // (8 * BLOCK)))
    dealt = placed.repartitionByRange(parts, "key", "embedding", "vec_id").sortWithinPartitions("key", "embedding", "vec_id")
    found = dealt.mapInArrow(pack, "block long, ids binary, vecs binary")
    # numbers without gaps: a block is a few hundred kilobytes, so its number and place are a small part of it
    staged = stage_table(found, "packed")
    number = Window.orderBy("block")
    small = staged.select("block", (F.row_number().over(number) - 1).cast("long").alias("number"))  # MOST / BLOCK rows, and one a task, at most
    return stage_table(staged.join(F.broadcast(small), "block").select(F.col("number").alias("block"), "ids", "vecs"), "vector_blocks")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] <= AXES:
        return np.sqrt(sum((x[:, None, c] - y[None, :, c]) ** 2 for c in range(x.shape[1])))
    x, y = x - x[:1], y - x[:1]
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def _gaps(low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray | float, shape: np.ndarray) -> np.ndarray:
    """No distance to what ``shape`` (low, high, centre, radius, along the last axis) holds is less; by boxes and by balls."""
    w = shape.shape[-1] // 3
    to_low, to_high, to_centre, to_radius = shape[..., :w], shape[..., w : 2 * w], shape[..., 2 * w : 3 * w], shape[..., -1]
    box = np.sqrt((np.maximum(0, np.maximum(to_low - high, low - to_high)) ** 2).sum(-1))
    ball = np.sqrt(((to_centre - centre) ** 2).sum(-1)) - to_radius - radius
    return np.maximum(box * (1 - 1e-12), ball - 1e-12 * (to_radius + radius + np.abs(to_centre).max(-1)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(c)[r].as_py() for c in batch.schema.names}


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, core distances, components) of a row's binaries."""
    core = np.frombuffer(row["core"])
    return np.frombuffer(row["vecs"]).reshape(len(core), -1), core, np.frombuffer(row["comp"], np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))


def _meetings(state: DataFrame, limits: Callable[[np.ndarray], np.ndarray], act: Callable[[dict, dict], dict | None], schema: str, own: bool = False, runs: bool = False) -> DataFrame:
    """What ``act`` says of every two blocks (with ``own``: also of a block and itself) that have vectors nearer than the limit of one of the two.

    ``limits`` of the core distances: a vector's own limit, negative for one that takes no part.  Vectors of one
    component need not meet.  ``act`` gets two rows (block, place, vecs, core, comp) with the vectors that matter.
    With ``runs`` only neighbours on the curve meet.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x, core, comp = _read(row)
            limit = limits(core)
            x, comp, limit = x[limit >= 0], comp[limit >= 0], limit[limit >= 0]
            if len(x):
                centre = x.mean(0)
                shape = [x.min(0), x.max(0), centre, [np.sqrt(((x - centre) ** 2).sum(1).max())]]
                one = comp[0] if (comp == comp[0]).all() else -1
                yield _batch({"block": [row["block"]], "shape": [np.concatenate(shape).tobytes()], "reach": [limit.max()], "one": [one]})

    known = sorted(state.mapInArrow(summary, "block long, shape binary, reach double, one long").collect(), key=lambda r: r.block)  # a row a block
    shared = state.sparkSession.sparkContext.broadcast((np.array([r.block for r in known], np.int64), np.array([np.frombuffer(r.shape) for r in known]), np.array([r.reach for r in known]), np.array([r.one for r in known], np.int64)))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shapes, reach, one = shared.value
        for row in _rows(batches):
            i = row["block"]
            at = int(np.searchsorted(number, i))
            if at == len(number) or number[at] != i:
                continue
            x, core, comp = _read(row)
            limit, w = limits(core), x.shape[1]
            mine = shapes[at]
            gap = _gaps(mine[:w], mine[w : 2 * w], mine[2 * w : 3 * w], mine[-1], shapes)
            near = (gap < np.maximum(reach, reach[at])) & ~((one == one[at]) & (one >= 0)) & (number != i)
            if runs:
                near &= np.abs(number - i) == 1
            if own and one[at] < 0:
                near[at] = True
            for j in np.flatnonzero(near):
                take = limit >= 0
                if j != at:
                    take = take & (_gaps(x, x, x, 0.0, shapes[j]) < np.maximum(limit, reach[j])) & ((one[j] < 0) | (comp != one[j]))
                if take.any():
                    low, high = sorted((i, int(number[j])))
                    yield _batch({"i": [low], "j": [high], "block": [i], "place": [np.flatnonzero(take).tobytes()], "vecs": [x[take].tobytes()], "core": [core[take].tobytes()], "comp": [comp[take].tobytes()]})

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        found = act(rows[0], rows[-1]) if len(rows) == 2 or rows[0]["i"] == rows[0]["j"] else None
        return pa.table(found if found is not None else none)

    none = {n: pa.array([], {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in schema.split(", "))}
    return state.mapInArrow(halves, "i long, j long, block long, place binary, vecs binary, core binary, comp binary").groupBy("i", "j").applyInArrow(meet, schema)


def core_distances(blocks: DataFrame, k: int, cut: float) -> DataFrame:
    """The blocks with ``STATE``: the core distance of a vector with ``k`` others within ``cut``, infinity for the rest; each vector a component, block number * 1024 + place."""
    beyond = float(np.nextafter(cut, np.inf))

    def smallest(d: np.ndarray) -> np.ndarray:
        return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = len(row["ids"]) // 8
            x = np.frombuffer(row["vecs"]).reshape(n, -1)
            d = distances(x, x)
            np.fill_diagonal(d, np.inf)
            best = np.full((n, k), np.inf)
            found = smallest(d)
            best[:, : found.shape[1]] = found
            bound = np.minimum(best.max(1), beyond)  # what is not nearer than this changes nothing
            yield _batch({**{c: [row[c]] for c in ("block", "ids", "vecs")}, "core": [bound.tobytes()], "comp": [((row["block"] << 10) + np.arange(n)).tobytes()], "best": [best.tobytes()]})

    known = stage_table(blocks.mapInArrow(inside, STATE + ", best binary"), "own_nearest")

    def nearest(one: dict, two: dict) -> dict:
        (x, bound_x, _), (y, bound_y, _) = _read(one), _read(two)
        d, out = distances(x, y), {"block": [], "place": [], "d": []}
        for side, rows, bound in ((one, d, bound_x), (two, d.T, bound_y)):
            best = smallest(rows)
            at, col = np.nonzero(best < bound[:, None])
            if len(at):
                out["block"].append(side["block"])
                out["place"].append(np.frombuffer(side["place"], np.int64)[at].tobytes())
                out["d"].append(best[at, col].tobytes())
        return {"block": pa.array(out["block"], pa.int64()), "place": pa.array(out["place"], pa.binary()), "d": pa.array(out["d"], pa.binary())}

    def merged(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        best = np.frombuffer(row.pop("best")).reshape(-1, k)
        place = np.concatenate([np.repeat(np.arange(len(best)), k), *[np.frombuffer(v, np.int64) for v in right.column("place").to_pylist()]])
        d = np.concatenate([best.ravel(), *[np.frombuffer(v) for v in right.column("d").to_pylist()]])
        order = np.lexsort((d, place))
        last = d[order][np.searchsorted(place[order], np.arange(len(best))) + k - 1]
        return pa.table({c: pa.array([v]) for c, v in {**row, "core": np.where(last <= cut, last, np.inf).tobytes()}.items()})

    found = _meetings(known.drop("best"), lambda bound: bound, nearest, "block long, place binary, d binary")
    return stage_table(known.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(merged, STATE), "cores")


def lightest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of the nodes 0 to ``n`` - 1; of equal edges the first comes first."""
    order = np.argsort(weight, kind="stable")
    a, b, root, live, kept = a[order], b[order], np.arange(n), np.arange(len(order)), []
    while True:
        one, two = root[a[live]], root[b[live]]
        apart = one != two
        live, one, two = live[apart], one[apart], two[apart]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order[:0]
        first, to = np.full(n, len(order)), np.arange(n)
        for ends in (one, two):
            last = np.full(n, len(order))
            last[ends[::-1]] = live[::-1]  # the last one written is the lightest
            first = np.minimum(first, last)
        met = np.flatnonzero(first < len(order))
        ends = root[a[first[met]]], root[b[first[met]]]
        to[met] = np.where(ends[0] == met, ends[1], ends[0])
        both = to[to] == np.arange(n)  # two that take the same edge: the smaller stays
        to = np.where(both & (np.arange(n) < to), np.arange(n), to)
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
        kept.append(np.unique(first[met]))


def band_edges(state: DataFrame, length: float) -> DataFrame:
    """(one, two, a, b, weight): edges of ``length`` at most between components, so many that they hold a minimum spanning forest of them."""

    def limits(core: np.ndarray) -> np.ndarray:
        return np.where(core <= length, np.nextafter(length, np.inf), -1.0)

    def ways(left: dict, right: dict) -> dict:
        (x, core_x, comp_x), (y, core_y, comp_y) = _read(left), _read(right)
        a, b = ((side["block"] << 10) + np.frombuffer(side["place"], np.int64) for side in (left, right))
        w = np.maximum(distances(x, y), np.maximum(core_x[:, None], core_y[None]))
        row, col = np.nonzero((w <= length) & (comp_x[:, None] != comp_y[None]))
        if left["block"] == right["block"]:
            row, col = row[row < col], col[row < col]
        names, ends = np.unique(np.append(comp_x, comp_y), return_inverse=True)
        one, two = ends[: len(x)][row], ends[len(x) :][col]
        kept = lightest(one, two, w[row, col], len(names))
        return {"one": names[one[kept]], "two": names[two[kept]], "a": a[row[kept]], "b": b[col[kept]], "weight": w[row[kept], col[kept]]}

    return stage_table(_meetings(state, limits, ways, "one long, two long, a long, b long, weight double", own=True, runs=length == 0), "band_edges")


def contracted(state: DataFrame, roots: DataFrame) -> DataFrame:
    """``state`` with the components named by ``roots`` (node, root); written."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            comp = np.unique(np.frombuffer(row["comp"], np.int64))
            yield _batch({"block": np.full(len(comp), row["block"]), "node": comp})

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if pairs := row.pop("pairs"):
                old, new = np.array(sorted((p["node"], p["root"]) for p in pairs), np.int64).T
                comp = np.frombuffer(row["comp"], np.int64)
                at = np.minimum(np.searchsorted(old, comp), len(old) - 1)
                row["comp"] = np.where(old[at] == comp, new[at], comp).tobytes()
            yield _batch({c: [v] for c, v in row.items()})

    moved = state.select("block", "comp").mapInArrow(named, "block long, node long").join(roots, "node")
    pairs = moved.groupBy("block").agg(F.collect_list(F.struct("node", "root")).alias("pairs"))  # BLOCK at most
    return stage_table(state.join(pairs, "block", "left").select(*state.columns, "pairs").mapInArrow(renamed, STATE), "forest_state")


def unpacked(state: DataFrame) -> DataFrame:
    """(node, vec_id, core, comp), a row a vector; core is null where fewer than k others lie within the cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, (_, core, comp) = np.frombuffer(row["ids"], "<i8"), _read(row)
            yield pa.record_batch([pa.array((row["block"] << 10) + np.arange(len(ids))), pa.array(ids), pa.array(core, mask=np.isinf(core)), pa.array(comp)], names=["node", "vec_id", "core", "comp"])

    return state.mapInArrow(rows, "node long, vec_id long, core double, comp long")


def components_below(vectors: DataFrame, k: int, cut: float) -> tuple[DataFrame, list[DataFrame]]:
    """(state, edges): the blocks with the components of mutual reachability below ``cut``, and the edges kept of each band."""
    state, bands = core_distances(packed_blocks(vectors), k, cut), []
    seen = unpacked(state).agg(F.min("core").alias("least"), F.percentile_approx(F.expr("nullif(core, 0)"), 0.5).alias("middle")).first()
    lengths = [cut]
    while seen.middle and lengths[0] / 2 >= seen.middle and len(lengths) < BANDS:
        lengths.insert(0, lengths[0] / 2)
    for length in [0.0] * (seen.least == 0) + lengths:  # first the copies
        edges = band_edges(state, length)
        if not edges.isEmpty():
            bands.append(edges)
            state = contracted(state, connected_components(edges.select(F.col("one").alias("a"), F.col("two").alias("b"))))
    return state, bands


def spanning_forest(vectors: DataFrame, k: int, cut: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node, vec_id, core (null where fewer than ``k`` others lie within ``cut``); a, b, weight of the minimum spanning forest below ``cut``.

    Cutting the edges at any smaller distance gives the components of that distance.  Boruvka rounds take from
    every component its shortest edge (ties by the smaller nodes), so the number of rounds is logarithmic.
    """
    state, bands = components_below(vectors, k, cut)
    nodes = unpacked(state).drop("comp")
    none = nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("core").alias("weight"))
    edges, forest = reduce(DataFrame.union, [e.select("a", "b", "weight") for e in bands], none), []
    live = stage_table(edges.select("*", F.col("a").alias("one"), F.col("b").alias("two")), "live_edges")
    while not live.isEmpty():
        ends = live.union(live.select("a", "b", "weight", F.col("two").alias("one"), F.col("one").alias("two")))
        best = stage_table(ends.groupBy("one").agg(F.min(F.struct("weight", "a", "b", "two")).alias("best")), "ways_out").select("one", "best.*")
        forest.append(best.select("a", "b", "weight").distinct())
        roots = connected_components(best.select(F.col("one").alias("a"), F.col("two").alias("b")))
        moved = live.join(roots.toDF("one", "left"), "one").join(roots.toDF("two", "right"), "two").where("left <> right")
        live = stage_table(moved.select("a", "b", "weight", F.col("left").alias("one"), F.col("right").alias("two")), "live_edges")
    return nodes, reduce(DataFrame.union, forest, none)


def density_clusters(vectors: DataFrame, k: int = 10, cut: float = 0.5, least: int = 40) -> DataFrame:
    """(vec_id, cluster, core): components of the forest below ``cut`` with ``least`` vectors, the largest first (on a tie that with the smallest id), else -1.

    A flat cut: no stability chooses between cuts of different depth.
    """
    nodes = stage_table(unpacked(components_below(vectors, k, cut)[0]), "density_nodes")
    sizes = nodes.where("core IS NOT NULL").groupBy("comp").agg(F.count("*").alias("size"), F.min("vec_id").alias("first")).where(F.col("size") >= least)
    ranked = sizes.select("comp", (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).alias("cluster"))  # MOST / least rows at most
    return nodes.join(ranked, "comp", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core")
