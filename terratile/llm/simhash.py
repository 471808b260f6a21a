"""SimHash near-duplicate detection with banded BK-trees.

A text's words (ASCII-lower-cased, parted by ASCII white space) give shingles
of ``width`` words; bit i of its 64-bit fingerprint is set if it is set in over
half of the shingles' XXH64 values.  Fingerprints within ``radius`` differing
bits are linked, and documents of linked fingerprints form components.

Search: the 64 bits are cut in ``radius + agree`` blocks.  Two fingerprints
within the radius differ in at most ``radius`` of them, so they agree on at
least ``agree`` blocks, and every link is found in a shard of fingerprints that
agree on a set of so many blocks.  ``agree`` is the least number that leaves
``SHARD`` fingerprints a shard on average, so links are complete at every size
and a shard stays small at every size.  Each shard's fingerprints form a
BK-tree (children keyed by their integer distance to the parent); each member
asks it for the members put in before, following only edges within the radius.
A shard tree lives in the task that reads the shard; nothing is broadcast, since the
number of fingerprints has no bound.  Shards over ``shard_rows`` are cut in
chunks and each pair of chunks is a shard of its own, so no task holds more
than two chunks.  A shard gives a spanning star of each of its components, at
most one edge a fingerprint, never all pairs.

Nulls: a null text counts as empty (fingerprint zero); a null id takes part but
is never a component's id unless all ids of the component are null.  Rows with
equal ids or texts are all returned.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratile.operators.graph import connected_components
from terratile.storage import stage_table

SEED = 42
SHARD = 128


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return _majority(np.array([digest(view[a:b], SEED) for a, b in spans], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest known companion) after linking rows a and b one to one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


class BKForest:
    """One BK-tree for each shard of rows sorted by shard; all of them are grown and searched at once.

    A row is a node; its child by an edge d is the first of the later rows of
    its branch at d differing bits.  Rows that repeat a fingerprint of their
    shard are joined to its node and are no nodes themselves (without ``twins``
    they are, by edges 0).
    """

    def __init__(self, shards: np.ndarray, prints: np.ndarray, twins: bool = True):
        n = len(prints)
        self.prints, self.visits = prints, 0
        self.twin = np.arange(n)
        self.root = np.maximum.accumulate(np.where(np.append(True, shards[1:] != shards[:-1])[:n], np.arange(n), 0)) if n else np.arange(0)
        rows, branch, edges = np.arange(n), self.root.copy(), []
        while len(rows):
            begins = np.append(True, branch[1:] != branch[:-1])
            edges.append((branch[begins], rows[begins]))
            head = rows[begins][np.cumsum(begins) - 1][~begins]
            rows = rows[~begins]
            away = np.bitwise_count(prints[rows] ^ prints[head]).astype(np.int64)
            branch = n + head * 65 + away
            if twins:
                self.twin[rows[away == 0]] = head[away == 0]
                rows, branch = rows[away > 0], branch[away > 0]
            order = np.argsort(branch, kind="stable")
            rows, branch = rows[order], branch[order]
        edges = edges[1:]
        # children in order of (parent, edge); edge[i] leads to child[i]
        key = np.concatenate([k for k, _ in edges] or [np.empty(0, np.int64)]) - n
        child = np.concatenate([c for _, c in edges] or [np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]
        self.first = np.searchsorted(self.key, np.arange(n + 1) * 65)

    def hits(self, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, earlier row) of each link within the radius, some at a time."""
        asking = np.flatnonzero((self.twin == np.arange(len(self.twin))) & (self.root != np.arange(len(self.twin))))
        todo = [(asking[i : i + most], self.root[asking[i : i + most]]) for i in range(0, len(asking), most)]
        while todo:
            asks, node = todo.pop()
            self.visits += len(asks)
            away = np.bitwise_count(self.prints[asks] ^ self.prints[node]).astype(np.int64)
            near = away <= radius
            if near.any():
                yield asks[near], node[near]
            inner = self.first[node + 1] > self.first[node]
            asks, node, away = asks[inner], node[inner], away[inner]
            low = np.searchsorted(self.key, node * 65 + np.maximum(away - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(away + radius, 64), "right")
            child, asks = self.child[_ranges(low, high - low)], np.repeat(asks, high - low)
            before = child < asks  # later rows ask for this one themselves
            asks, child = asks[before], child[before]
            todo += [(asks[i : i + most], child[i : i + most]) for i in range(0, len(asks), most)]

    def link(self, radius: int) -> np.ndarray:
        """For each row the smallest row of its component of links within the radius."""
        label, held, n_held = self.twin.copy(), [], 0
        for pair in self.hits(radius):
            held.append(pair)
            n_held += len(pair[0])
            if n_held > 1 << 20:
                label, held, n_held = join_labels(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
        return join_labels(label, *map(np.concatenate, zip(*held, strict=True))) if held else label


def _stars(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components of whole shards; rows sorted by shard."""
    label = BKForest(keys, prints).link(radius)
    moved = label != np.arange(len(keys))
    return prints[label[moved]], prints[moved]


def _shard_links(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; the last, open shard waits for the next batch."""
        held = None
        for batch in batches:
            keys = batch["shard"].to_numpy()
            rows = (keys, batch["fp"].to_numpy())
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left")) if len(rows[0]) else 0
            held = tuple(x[cut:] for x in rows)
            if cut:
                a, b = _stars(rows[0][:cut], rows[1][:cut].view(np.uint64), radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        if held is not None and len(held[0]):
            a, b = _stars(held[0], held[1].view(np.uint64), radius)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return links


def _edges_of(radius: int, agree: int) -> list[int]:
    n = radius + agree
    return [64 * i // n for i in range(n + 1)]


def agreeing(radius: int, n_prints: int) -> int:
    """The least number of blocks to agree on that leaves SHARD fingerprints a shard on average."""

    def kept_bits(agree: int) -> int:
        edges = _edges_of(radius, agree)
        return sum(sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[:agree])

    return next((k for k in range(1, 64 - radius) if n_prints <= SHARD << kept_bits(k)), 63 - radius)


def _shards(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(shard, fp): a fingerprint once in the shard of each set of blocks to agree on."""
    agree = agreeing(radius, prints.count())
    edges = _edges_of(radius, agree)

    def block(i: int):
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    keys = [
        F.struct(F.lit(k).cast("int").alias("pair"), F.xxhash64(*map(block, some)).alias("bits"))
        for k, some in enumerate(combinations(range(radius + agree), agree))
    ]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.bits")
    large = rows.groupBy("pair", "bits").count().where(F.col("count") > shard_rows)
    large = stage_table(large.withColumn("chunks", F.ceil(F.col("count") / shard_rows).cast("int")).drop("count"), "large")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    parts = rows.join(large, ["pair", "bits"], "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
    parts = parts.withColumn("other", F.explode(others))
    first, last = F.least("mine", "other"), F.greatest("mine", "other")
    return parts.select(F.xxhash64("pair", "bits", first, last).alias("shard"), "fp")


def near_duplicates(rows: DataFrame, radius: int = 4, shard_rows: int = 8192) -> DataFrame:
    """Rows with ``doc_id`` and ``fp`` -> the rows with two columns more.

    ``component_id`` is the smallest ``doc_id`` reachable by links, itself
    included; ``root`` is one fingerprint of the component, the same for all.
    """
    prints = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    shards = _shards(prints, radius, shard_rows).repartition("shard").sortWithinPartitions("shard", "fp")
    edges = shards.mapInPandas(_shard_links(radius), "a long, b long")
    roots = connected_components(edges).toDF("fp", "root")
    grouped = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = grouped.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``fp``, the fingerprint as a signed long."""
    return docs.withColumn("fp", _fingerprints("text"))


def simhash_components(docs: DataFrame, radius: int = 4, shard_rows: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``."""
    rows = stage_table(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    found = near_duplicates(rows, radius, shard_rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shard_rows: int = 8192) -> DataFrame:
    """The rows of ``docs`` but one of each component: that with the smallest id.

    Of rows that share the smallest id (or have none) one stays.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    rows = fingerprinted(whole).drop("text").withColumn("row_no", F.monotonically_increasing_id())
    rows = stage_table(rows, "documents")  # as written, a row keeps its number
    found = near_duplicates(rows.select("doc_id", "fp", "row_no"), radius, shard_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_no"))
    stay = found.groupBy("root").agg(first["row_no"].alias("row_no")).select("row_no")
    return rows.join(stay, "row_no", "left_semi").select("_row.*")
