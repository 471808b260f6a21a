"""Hard negatives of anchors, from Hilbert-ordered blocks with zone maps.

Rows are put in order of their label and of a Hilbert curve through the
``AXES`` dimensions that vary most, and written as Parquet files in the shared
folder, a row group for each block of ``BLOCK`` rows.  A file's footer has the
zone maps of its blocks: least and largest label and, for every dimension, least
and largest component.  Interval arithmetic on them gives for each anchor and
block the bounds between which all its scores lie.  An anchor reads a block for
its positives only if the block may hold its label and its upper bound reaches
the worst of the positives found so far, and for its negatives only if the block
may hold another label and the bounds meet one of its windows
[0.8 * positive score, positive score], of which the lower end rises as
negatives are found.  What is read is scored exactly by a matrix product.

A task has a chunk of ``CHUNK`` anchors, neighbours on the curve, and a share of
the files; it holds one batch of blocks and the best rows found, so nothing in
it grows with the table.  Spark merges what the tasks of a chunk found.  In many
dimensions without clusters the bounds are wide and most blocks are read; the
result is the same.

A component x counts as floor(256 * x).  Shorter vectors end in zeros.  Rows
with a null id, label, vector or component, or a component that is not finite,
take no part; nor do rows whose squared length is 2 ** 62 or more, as their
scores would leave 64 bits.  Rows that share an id are rows of their own, but
none is a positive of an anchor of its id.  Anchors without positives or without
negatives give no row; so does an empty table.  Ties go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratile.llm.text import give_back
from terratile.storage import AtomicFile, open_fs, shared_dir, stage_table

BEST = 5
AXES, BITS = 8, 7
BLOCK, CHUNK = 1024, 128
FILE_ROWS, BATCH = 1 << 20, 16  # rows of a file at most; blocks read at a time
WORK = 1 << 36  # products of components in a task
_EXACT = 2.0**53


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, whole): the rows that take part, components as whole numbers."""
    odd = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("whole"))
    return rows.where(F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x) < 2.0**62)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of a matrix, zeros after their ends."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 21) // max(width, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


@dataclass
class Ranges:
    """What all rows together show: their number, the longest vector, and by dimension the least, largest and spread."""

    rows: int
    low: np.ndarray
    high: np.ndarray
    axes: np.ndarray  # the dimensions of the curve

    @property
    def width(self) -> int:
        return len(self.low)


def ranges(rows: DataFrame) -> Ranges:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total, square = 0, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)
        for batch in batches:
            width = max(len(low), int(np.diff(batch.column("whole").offsets.to_numpy()).max(initial=0)))
            low, high, total, square = (np.pad(x, (0, width - len(x))) for x in (low, high, total, square))
            for piece in _pieces(batch, width):
                x = matrix(piece.column("whole"), width)
                n += len(x)
                low, high = np.minimum(low, x.min(0, initial=0)), np.maximum(high, x.max(0, initial=0))
                total, square = total + x.sum(0), square + (x * x).sum(0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(low))), pa.array(np.full(len(low), n)), *map(pa.array, (low, high, total, square))], names=["pos", "n", "low", "high", "total", "square"])
            yield pa.record_batch([pa.array([-1]), pa.array([n]), *[pa.array([0.0])] * 4], names=["pos", "n", "low", "high", "total", "square"])

    parts = rows.mapInArrow(summed, "pos long, n long, low double, high double, total double, square double")
    by = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("square").alias("square"))
    found = sorted(by.collect(), key=lambda r: r.pos)  # a row a dimension
    dims = [r for r in found if r.pos >= 0]
    n = found[0].n if found else 0
    spread = np.array([r.square / n - (r.total / n) ** 2 for r in dims])
    return Ranges(n, np.array([r.low for r in dims]), np.array([r.high for r in dims]), np.sort(np.argsort(-spread, kind="stable")[:AXES]))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with ``bits``-bit coordinates (Skilling, 2004), for all points at once."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    if not axes:
        return np.zeros(cells.shape[0], np.int64)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(axes):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def placed(rows: DataFrame, seen: Ranges) -> DataFrame:
    """(vec_id, label, key, vec): components as 32-bit numbers, and the position on the curve."""
    low, span = seen.low[seen.axes], seen.high[seen.axes] - seen.low[seen.axes] + 1
    axes, width = seen.axes, seen.width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, width):
                x = matrix(piece.column("whole"), width)
                key = hilbert_keys(np.clip((x[:, axes] - low) * (1 << BITS) / span, 0, (1 << BITS) - 1).astype(np.int64))
                vec = [v.tobytes() for v in x.astype("<i4")]
                yield pa.record_batch([piece.column("vec_id"), piece.column("label"), pa.array(key), pa.array(vec, pa.binary())], names=["vec_id", "label", "key", "vec"])

    return rows.mapInArrow(place, "vec_id long, label long, key long, vec binary")


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width)


# ---- blocks

_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary())])


def file_name(base: str, number: int) -> str:
    return f"{base}/blocks-{number:06d}.parquet"


def write_blocks(rows: DataFrame, seen: Ranges, base: str, files: int) -> int:
    """Writes the files; one more than the largest file number."""
    width = seen.width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        zones: list[np.ndarray] = []
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with AtomicFile(file_name(base, number)) as out:
            writer = pq.ParquetWriter(out, _ROWS)

            def block(table: pa.Table) -> None:
                writer.write_table(table, row_group_size=BLOCK)
                x, label = _vectors(table.column("vec").combine_chunks(), width), table.column("label").to_numpy()
                zones.append(np.concatenate([[label.min(), label.max()], x.min(0), x.max(0)]).astype("<i8"))

            held, n = [first.select(_ROWS.names)], first.num_rows
            while held:
                table = pa.Table.from_batches(held, _ROWS)
                while n >= BLOCK:
                    block(table.slice(0, BLOCK))
                    table, n = table.slice(BLOCK), n - BLOCK
                more = next(batches, None)
                if more is None:
                    if n:
                        block(table)
                    break
                held, n = [*table.to_batches(), more.select(_ROWS.names)], n + more.num_rows
            writer.add_key_value_metadata({"zones": np.stack(zones).tobytes().hex()})
            writer.close()
        yield pa.record_batch([pa.array([number])], names=["number"])

    order = ["label", "key", "vec_id"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    last = dealt.mapInArrow(write, "number long").agg(F.max("number")).first()[0]
    return 0 if last is None else last + 1


class BlockFile:
    """A file's zone maps, and its blocks by number."""

    def __init__(self, path: str, width: int):
        fs, at = open_fs(path)
        self.file, self.width = pq.ParquetFile(fs.open_input_file(at)), width
        zones = np.frombuffer(bytes.fromhex(self.file.metadata.metadata[b"zones"].decode()), "<i8").reshape(-1, 2 + 2 * width)
        self.label_low, self.label_high = zones[:, 0], zones[:, 1]
        self.low, self.high = zones[:, 2 : 2 + width].astype(float), zones[:, 2 + width :].astype(float)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each row of ``x`` can have in each block."""
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        slack = 1e-12 * (np.abs(x) @ np.maximum(np.abs(self.low), np.abs(self.high)).T)
        return up @ self.low.T + down @ self.high.T - slack, up @ self.high.T + down @ self.low.T + slack

    def read(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = self.file.read_row_groups(blocks)
        return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _vectors(table.column("vec").combine_chunks(), self.width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    x, y = a.astype(float), b.astype(float)
    if np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0)) < _EXACT / 2:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """For each slot the ``BEST`` (score, id) found so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int):
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(slots, np.iinfo(np.int64).min)  # what a score must reach

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < BEST
        self.slot, self.score, self.id = slot[keep], score[order][keep], ids[order][keep]
        last = np.flatnonzero(np.append(self.slot[1:] != self.slot[:-1], True))
        full = last[np.bincount(self.slot, minlength=len(self.floor))[self.slot[last]] == BEST]
        self.floor[self.slot[full]] = self.score[full]


# ---- search


@dataclass
class Chunk:
    """Anchors, and (for negatives) their windows: rows of (place, positive score)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, width: int) -> Chunk:
        raw = {c: batch.column(c)[i].as_py() for c in ("ids", "labels", "vecs")}
        ids = np.frombuffer(raw["ids"], "<i8")
        return cls(ids, np.frombuffer(raw["labels"], "<i8"), np.frombuffer(raw["vecs"], "<i4").reshape(len(ids), width))


def files_of(base: str, files: int, group: int, groups: int) -> Iterator[str]:
    fs, at = open_fs(base)
    there = {f.base_name for f in fs.get_file_info(FileSelector(at)) if f.is_file}
    for number in range(group, files, groups):
        if file_name("", number)[1:] in there:
            yield file_name(base, number)


def nearest(chunk: Chunk, paths: Iterator[str], width: int) -> tuple[Best, int]:
    """The best rows of each anchor's label (other ids), and the number of blocks read."""
    best, blocks_read = Best(len(chunk.ids)), 0
    for path in paths:
        file = BlockFile(path, width)
        _, most = file.bounds(chunk.x)
        may = (file.label_low <= chunk.labels[:, None]) & (chunk.labels[:, None] <= file.label_high)
        most = np.where(may, most, -np.inf)
        todo = np.argsort(-most.max(0), kind="stable")
        while len(todo):
            todo = todo[(most[:, todo] >= best.floor[:, None]).any(0) & may[:, todo].any(0)]
            now, todo = np.sort(todo[:BATCH]), todo[BATCH:]
            if not len(now):
                break
            blocks_read += len(now)
            ids, labels, x = file.read(now.tolist())
            scores = products(chunk.x, x)
            fits = (scores >= best.floor[:, None]) & (labels == chunk.labels[:, None]) & (ids != chunk.ids[:, None])
            row, col = np.nonzero(fits)
            best.add(row, scores[row, col], ids[col])
    return best, blocks_read


def in_windows(chunk: Chunk, place: np.ndarray, top: np.ndarray, paths: Iterator[str], width: int) -> tuple[Best, int]:
    """For each window (anchor ``place``, positive score ``top``) the best rows of other labels in it, and the number of blocks read."""
    best, blocks_read = Best(len(place)), 0
    best.floor = -((-4 * top) // 5)  # the least whole score s with 80 * top <= 100 * s
    for path in paths:
        file = BlockFile(path, width)
        least, most = file.bounds(chunk.x)
        may = (file.label_low != file.label_high) | (file.label_low != chunk.labels[:, None])
        todo = np.arange(len(file.label_low))
        while len(todo):
            meets = (most[place][:, todo] >= best.floor[:, None]) & (least[place][:, todo] <= top[:, None]) & may[place][:, todo]
            todo = todo[meets.any(0)]
            now, todo = todo[:BATCH], todo[BATCH:]
            if not len(now):
                break
            blocks_read += len(now)
            ids, labels, x = file.read(now.tolist())
            scores = products(chunk.x, x)
            other = labels != chunk.labels[:, None]
            for a in range(0, len(place), CHUNK):
                at = place[a : a + CHUNK]
                of = scores[at]
                row, col = np.nonzero((of >= best.floor[a : a + CHUNK, None]) & (of <= top[a : a + CHUNK, None]) & other[at])
                best.add(row + a, of[row, col], ids[col])
    return best, blocks_read


def anchor_chunks(anchors: DataFrame, width: int, count: int) -> DataFrame:
    """(chunk, ids, labels, vecs): anchors that follow each other on the curve, ``CHUNK`` a row; written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, vecs = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("vec").to_pylist()
            for a in range(0, len(ids), CHUNK):
                part = slice(a, a + CHUNK)
                cells = [ids[part].astype("<i8").tobytes(), labels[part].astype("<i8").tobytes(), b"".join(vecs[part])]
                yield pa.record_batch([pa.array([number]), *[pa.array([c], pa.binary()) for c in cells]], names=["chunk", "ids", "labels", "vecs"])
                number += 1

    order = ["label", "key", "vec_id"]
    dealt = anchors.repartitionByRange(max(1, count // (CHUNK * 8)), *order).sortWithinPartitions(*order)
    return stage_table(dealt.mapInArrow(pack, "chunk long, ids binary, labels binary, vecs binary"), "anchors")


def mined(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, rows whose vec_id is divisible by ``every``.

    ``vectors``: vec_id, label, embedding.  The positives of an anchor are its
    ``BEST`` best rows of its label, the negatives of a pair the ``BEST`` best
    rows of other labels whose score is 0.8 to 1 times that of the positive.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors)
    seen = ranges(rows)
    width, parallel = seen.width, spark.sparkContext.defaultParallelism
    base = shared_dir(spark, "hilbert_blocks")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen.rows:
        return spark.createDataFrame([], schema)
    wanted = max(-(-seen.rows // FILE_ROWS), min(-(-seen.rows // (8 * BLOCK)), parallel))
    dealt = placed(rows, seen)
    files = write_blocks(dealt, seen, base, wanted)
    chunks = anchor_chunks(dealt.where(F.col("vec_id") % every == 0), width, seen.rows // every)
    n_chunks = max(1, chunks.count())
    groups = min(files, max(-(-seen.rows * CHUNK * max(width, 1) // WORK), -(-2 * parallel // n_chunks)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    tasks = min(n_chunks * groups, 4 * parallel)

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, part = Chunk.of(batch, i, width), batch.column("part")[i].as_py()
                best, _ = nearest(chunk, files_of(base, files, part, groups), width)
                number = np.full(len(best.slot), batch.column("chunk")[i].as_py())
                yield pa.record_batch([*map(pa.array, (number, best.slot, best.id, best.score))], names=["chunk", "place", "positive_id", "positive_score"])
        give_back()

    found = chunks.select("*", spread).repartition(tasks, "chunk", "part").mapInArrow(find_positives, "chunk long, place long, positive_id long, positive_score long")
    order = Window.partitionBy("chunk", "place").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("number", F.row_number().over(order)).where(F.col("number") <= BEST)
    windows = first.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "number", "positive_id", "positive_score"))).alias("windows"))  # BEST * CHUNK at most
    asked = stage_table(chunks.join(windows, "chunk"), "windows")

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, part = Chunk.of(batch, i, width), batch.column("part")[i].as_py()
                of = batch.column("windows")[i].values
                place, number, ids, top = (of.field(c).to_numpy().astype(np.int64) for c in ("place", "number", "positive_id", "positive_score"))
                best, _ = in_windows(chunk, place, top, files_of(base, files, part, groups), width)
                at = best.slot
                cells = [np.full(len(at), batch.column("chunk")[i].as_py()), place[at], number[at], chunk.ids[place[at]], ids[at], top[at], best.id, best.score]
                yield pa.record_batch([*map(pa.array, cells)], names=["chunk", "place", "number", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
        give_back()

    negatives = asked.select("*", spread).repartition(tasks, "chunk", "part").mapInArrow(
        find_negatives, "chunk long, place long, number long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("chunk", "place", "number").orderBy(F.desc("negative_score"), "negative_id")
    ranked = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the label (label + 1) % 10 where the id is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
