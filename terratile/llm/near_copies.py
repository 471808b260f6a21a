"""Near copies of texts: shingle sets with a Jaccard similarity of ``least`` or more are linked.

A text's words (ASCII-lower-cased, parted by ASCII white space) give the set of
its runs of ``WIDTH`` words; a shorter text is one shingle, an empty one has
none.  Rows of equal sets are one node.  Nodes are dealt to shards by MinHash
bands, since SimHash blocks that all pairs of similarity 0.8 share (some ten of
64 bits differ) would be too short to part anything.  A shard's SimHash
fingerprints form the BK-tree of ``simhash``, searched within ``RADIUS``.  Of
what it finds, pairs whose sizes allow ``least`` and of whose 64 MinHash values
``AGREE`` agree are candidates, which join nodes to groups; so texts that share
a boilerplate, of a similarity of 0.45 or less, hardly ever chain texts into
one group, and those of 0.8 do.  Only texts of groups are
then sent, once each, to the task of their group.  There a BK-tree of the group
gives all pairs within ``RADIUS``, and each pair that is not joined yet and can
reach ``least`` by its sizes is tried on the sets of shingles themselves (as
64-bit hashes).  So a group of copies costs one trial a copy, and no pair of
different texts is lost in it.  Groups of over ``GROUP_BYTES`` of text are cut
in chunks and each pair of chunks is a group of its own.

The written ids of rows with a candidate, and of rows to drop, are broadcast if
their counted number makes them small, else shuffled with the rows.

A pair of similarity 0.8 meets in one of 16 bands of 4 with probability 0.9998
and agrees in enough values with 0.9999, and more so the more alike it is.  No pair below ``least`` is ever linked.

Nulls: a null text counts as empty; all empty texts are equal.  A row without
an id stays only if all of its component have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratile.llm.simhash import SEED, BKForest, _majority, join_labels
from terratile.llm.text import give_back
from terratile.operators.graph import connected_components
from terratile.storage import broadcast_if_small, stage_table

WIDTH = 5
LEAST = 0.8
#: Differing bits of a pair at 0.8: 9.7 on average, deviation 2.9 (3 for texts of a few shingles).
RADIUS = 24
BANDS, ROWS = 16, 4
#: Share of a pair's MinHash values (a byte of each) that agree, below which it is no candidate: at 0.8 that is four deviations down.
AGREE = 0.6
#: Bits of the table of a set's shingles, which bounds the similarity of two sets from above.
BITS = 1024
GROUP_BYTES, SHARD_ROWS = 4 << 20, 8192
_ODD = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return {joined} if words else set()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    return {joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)}


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct XXH64 of the shingles, in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text)), np.uint64))


def jaccard(a, b) -> float:
    """Of two sets, or of two ordered arrays of distinct numbers."""
    both = len(a & b) if isinstance(a, set) else len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _least_hashes(hashes: np.ndarray) -> np.ndarray:
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at : at + 4096, None] * _ODD).min(0))
    return low


_SKETCH = T.StructType().add("fp", "long").add("size", "long").add("digest", "string").add("bands", T.ArrayType(T.LongType())).add("marks", "binary")


@F.pandas_udf(_SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        hashes = shingle_hashes(text)
        key = np.arange(BANDS, dtype=np.uint64)
        least = _least_hashes(hashes)
        for row in least.reshape(ROWS, BANDS):
            key = (key ^ row) * _MIX
            key ^= key >> np.uint64(29)
        bands = key.view(np.int64) if len(hashes) else np.empty(0, np.int64)
        fp = _majority(hashes) if len(hashes) else 0
        out.append((fp, len(hashes), xxhash.xxh3_128_hexdigest(hashes.tobytes(), SEED), bands, ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()))
    table = pd.DataFrame(out, columns=["fp", "size", "digest", "bands", "marks"])
    table = table.assign(fp=np.array([r[0] for r in out], np.uint64).view(np.int64))
    del out
    give_back()
    return table


def _dealt(rows: DataFrame, by: str, chunks: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``shard``: that of ``by``, or of each pair of chunks with their own if ``chunks`` (by, chunks) has it."""
    parts = rows.join(chunks, by, "left")
    parts = parts.withColumn("mine", F.coalesce(F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"), F.lit(0)))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    parts = parts.withColumn("other", F.explode(others))
    shard = F.xxhash64(by, F.least("mine", "other"), F.greatest("mine", "other"))
    out = parts.withColumn("shard", shard).drop(by, "chunks", "mine", "other")
    return out.repartition("shard").sortWithinPartitions("shard", key)


def _whole_shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, first row of each shard, its size); the last, open shard waits for the next batch."""
    held = None

    def cut(rows: pd.DataFrame):
        keys = rows["shard"].to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return rows, starts, np.diff(np.append(starts, len(keys)))

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        at = int(np.searchsorted(rows["shard"].to_numpy(), rows["shard"].iat[-1], "left"))
        held = rows.iloc[at:]
        if at:
            yield cut(rows.iloc[:at])
    if held is not None and len(held):
        yield cut(held)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    ends = zip(*found, strict=True) if found else ([np.empty(0, np.int64)],) * 2
    return pd.DataFrame(dict(zip("ab", map(np.concatenate, ends), strict=True)))


def _alike(asks: np.ndarray, node: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Whether the sizes of the sets allow a similarity of ``least``."""
    return np.minimum(size[asks], size[node]) >= least * np.maximum(size[asks], size[node])


def _agree(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether enough MinHash values of each pair agree."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = (marks[a[part]] == marks[b[part]]).sum(1) >= AGREE * marks.shape[1]
    return out


def _candidates(radius: int, least: float):
    """Spanning stars of what the shards' trees join."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, _ in _whole_shards(batches):
            node, fp, size = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy()
            forest = BKForest(rows["shard"].to_numpy(), fp)
            label = forest.twin.copy()
            marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)
            for asks, other in forest.hits(radius):
                near = _alike(asks, other, size, least)
                asks, other = asks[near], other[near]
                near = _agree(marks, asks, other)
                label = join_labels(label, asks[near], other[near])
            ends = np.flatnonzero(label != np.arange(len(node)))
            yield _edges([(node[label[ends]], node[ends])])

    return links


class _Group:
    """Texts of one group: their sets of shingles, and which of them are joined."""

    def __init__(self, texts: list[str], least: float):
        self.hashes, self.least = [shingle_hashes(t) for t in texts], least
        self.size, self.label = np.array([len(h) for h in self.hashes]), np.arange(len(texts))
        table = np.zeros((len(texts), BITS), np.uint8)
        for row, h in zip(table, self.hashes, strict=True):
            row[h % np.uint64(BITS)] = 1
        self.bits = np.packbits(table, axis=1).view(np.uint64)
        self.found: list[tuple[int, int]] = []

    def _can(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and bit tables allow the similarity: a bit that only one holds stands for a shingle that only it holds."""
        mine = np.bitwise_count(self.bits[a] & ~self.bits[b]).sum(1, dtype=np.int64)
        theirs = np.bitwise_count(self.bits[b] & ~self.bits[a]).sum(1, dtype=np.int64)
        both = np.minimum(self.size[a] - mine, self.size[b] - theirs)
        return both >= self.least * (self.size[a] + self.size[b] - both) - 1e-9

    def attempt(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join rows a and b one to one, where they are similar and not joined yet."""
        near = _alike(a, b, self.size, self.least)
        a, b = a[near], b[near]
        near = self._can(a, b)
        a, b = a[near], b[near]
        while len(a):
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
            for x, y in zip(a[:64].tolist(), b[:64].tolist(), strict=True):
                if self.label[x] != self.label[y] and jaccard(self.hashes[x], self.hashes[y]) >= self.least:
                    self.label = join_labels(self.label, np.array([x]), np.array([y]))
                    self.found.append((x, y))
            a, b = a[64:], b[64:]

    def link(self, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """Links enough to join all similar rows within the radius: some rows against all, then what the tree finds."""
        for turn in range(4):
            roots = np.unique(self.label)
            if len(roots) <= max(turn, 1):
                break
            others = np.flatnonzero((self.label != roots[turn]) & (np.bitwise_count(fp ^ fp[roots[turn]]) <= radius))
            self.attempt(others, np.full(len(others), roots[turn]))
        if (self.label != self.label[0]).any():
            for a, b in BKForest(np.zeros(len(fp), np.int64), fp, twins=False).hits(radius):
                apart = self.label[a] != self.label[b]
                self.attempt(a[apart], b[apart])
        return self.found


def _similar(radius: int, least: float):
    """Links of whole groups, tried on the sets of shingles; as many as join what is similar."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _whole_shards(batches):
            for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                group = rows.iloc[at : at + n]
                node, fp = group["node"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
                if found := _Group(group["text"].tolist(), least).link(fp, radius):
                    a, b = (node[np.array(v)] for v in zip(*found, strict=True))
                    yield _edges([(a, b)])

    return links


def _links(rows: DataFrame, nodes: DataFrame, least: float, radius: int, group_bytes: int) -> DataFrame:
    """(a, b) of similar nodes, enough to join all that are."""
    banded = nodes.select("node", "fp", "size", "marks", F.explode("bands").alias("band"))
    large = banded.groupBy("band").count().where(F.col("count") > SHARD_ROWS)
    large = stage_table(large.select("band", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("chunks")), "large")
    stars = _dealt(banded, "band", large, "node").mapInPandas(_candidates(radius, least), "a long, b long")
    groups = broadcast_if_small(stage_table(connected_components(stars.distinct()), "met"), 32).toDF("row_no", "group")
    met = groups.join(rows.select("row_no", "fp", F.col("_row.text").alias("text")), "row_no").withColumnRenamed("row_no", "node")
    met = stage_table(met, "groups")
    bytes_ = met.groupBy("group").agg(F.sum(F.greatest(F.length("text"), F.lit(1024))).alias("n")).where(F.col("n") > group_bytes)
    large = stage_table(bytes_.select("group", F.ceil(F.col("n") / group_bytes).cast("int").alias("chunks")), "large")
    return _dealt(met, "group", large, "node").mapInPandas(_similar(radius, least), "a long, b long")


def keep_first_similar(docs: DataFrame, least: float = LEAST, radius: int = RADIUS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``docs`` but one of each component: that with the smallest id.

    Of rows that share the smallest id (or have none) one stays.
    """
    marked = docs.select(F.struct(*docs.columns).alias("_row"), _sketch("text").alias("sketch"), F.monotonically_increasing_id().alias("row_no"))
    rows = stage_table(marked.select("_row", "row_no", "sketch.*"), "documents")  # as written, a row keeps its number
    order = F.struct(F.col("_row.doc_id").isNull().alias("null"), F.col("_row.doc_id").alias("doc_id"), "row_no")
    same = rows.groupBy("digest").agg(F.min("row_no").alias("node"), F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "marks")])
    nodes = stage_table(same, "nodes")
    roots = connected_components(_links(rows, nodes, least, radius, group_bytes)).toDF("node", "root")
    by_set = stage_table(nodes.select("digest", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sets")
    best = stage_table(by_set.groupBy("root").agg(F.min("first").alias("best")), "best")
    # a set or a group may have very many rows: these joins are followed by nothing, so that they can be split
    kept = stage_table(by_set.select("digest", "root").join(best, "root").select("digest", F.col("best.row_no").alias("stays")), "kept")
    gone = stage_table(rows.select("row_no", "digest").join(kept, "digest").where("row_no <> stays").select("row_no"), "gone")
    return rows.join(broadcast_if_small(gone, 16), "row_no", "left_anti").select("_row.*")
