"""Token-id files in patched frame-of-reference blocks.

A file is a series of segments; a segment holds whole documents: their ids and
lengths, then the token ids of all of them in blocks of 128.  A block stores
its minimum, the bit width that 90 % of its values (less the minimum) fit in,
the values packed at that width, and for the others an exception list of
positions and values.  An index gives the byte at which each block's packed
values start, so a reader can go to any block (``read_blocks``).

Documents are sorted by doc_id over all files (nulls first, equal ids by a hash
of the text), each file is written by one task in the shared folder under an
attempt's name and moved into place, and a manifest counts what each segment
holds and where it starts, so that a file may be read by several tasks.  Texts are parted at blanks and line feeds, which never lie inside a
token of this vocabulary's pre-tokeniser; each distinct part is encoded once by
the tokenizers library and then looked up.  The lookup table of a worker starts
anew at ``WORDS`` entries.

Document ids are whole numbers (the files hold them as signed 64-bit integers).
Nulls: a null text is empty (only the end id).  Rows with equal or null ids are
all kept.  An empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratile.storage import AtomicFile, open_fs, shared_dir, stage_table

BLOCK, PERCENTILE = 128, 90
MAGIC = b"PFOR0001"
HEAD = struct.Struct("<QQQQQ")  # documents, values, blocks, exceptions, packed bytes
SEGMENT = 1 << 20
SLICE = 4 << 20  # bytes of text encoded at a time
FILE_BYTES = 24 << 20  # of text in a file, so that files grow in number with the table, not in size
WORDS = 1_000_000
END_ID = 1

# ---- blocks


def pack(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of one segment's blocks for unsigned 32-bit values."""
    n = -(-len(values) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint32)
    padded[: len(values)] = values
    padded[len(values) :] = values[-1] if len(values) else 0
    blocks = padded.reshape(n, BLOCK)
    low = blocks.min(1) if n else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = -(-PERCENTILE * BLOCK // 100) - 1
    width = np.partition(bits, at, axis=1)[:, at] if n else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), np.uint8)
    kept = np.where(over, 0, rest).astype(np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        bit = (kept[mine][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
        rows = np.packbits(bit.astype(np.uint8).reshape(len(mine), BLOCK * w), axis=1, bitorder="little")
        packed[starts[mine][:, None] + np.arange(w * BLOCK // 8)] = rows
    where = np.nonzero(over)
    return {
        "low": low.astype("<u4"), "width": width, "starts": starts[:-1].astype("<u8"), "n_over": over.sum(1).astype(np.uint8),
        "over_at": where[1].astype(np.uint8), "over": rest[where].astype("<u4"), "packed": packed,
    }


def unpack(parts: dict[str, np.ndarray], n_values: int) -> np.ndarray:
    """The values that ``pack`` was given."""
    n = len(parts["low"])
    rest = np.zeros((n, BLOCK), np.uint32)
    width, starts = parts["width"], parts["starts"].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        rows = parts["packed"][starts[mine][:, None] + np.arange(w * BLOCK // 8)]
        bit = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
        rest[mine] = (bit.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(2, dtype=np.uint32)
    rest[np.repeat(np.arange(n), parts["n_over"]), parts["over_at"]] = parts["over"]
    return (rest + parts["low"][:, None]).reshape(-1)[:n_values]


ORDER = {"low": "<u4", "width": "u1", "starts": "<u8", "n_over": "u1", "over_at": "u1", "over": "<u4", "packed": "u1"}


def write_segment(out, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
    parts = pack(values)
    out.write(HEAD.pack(len(ids), len(values), len(parts["low"]), len(parts["over"]), len(parts["packed"])))
    for x in (ids.astype("<i8"), known.astype(np.uint8), sizes.astype("<u4"), *(parts[k] for k in ORDER)):
        out.write(np.ascontiguousarray(x).tobytes())


def read_segments(data) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, known, sizes, values) of each segment of an open file."""
    if data.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := data.read(HEAD.size):
        yield _segment(data, head)


def read_segment(data, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of the one segment at byte ``at`` of an open, seekable file."""
    data.seek(at)
    return _segment(data, data.read(HEAD.size))


def _segment(data, head: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_docs, n_values, n_blocks, n_over, n_packed = HEAD.unpack(head)

    def take(kind: str, n: int) -> np.ndarray:
        return np.frombuffer(data.read(np.dtype(kind).itemsize * n), kind)

    ids, known, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    length = dict.fromkeys(ORDER, n_blocks) | {"over_at": n_over, "over": n_over, "packed": n_packed}
    return ids, known, sizes, unpack({k: take(kind, length[k]) for k, kind in ORDER.items()}, n_values)


def read_blocks(data, at: int, first: int, last: int) -> np.ndarray:
    """The values of blocks ``first`` .. ``last`` - 1 of the segment at byte ``at`` of an open, seekable file.

    The index leads to the packed bytes of just these blocks; of the rest only
    the exception counts of earlier blocks are read.
    """
    data.seek(at)
    n_docs, n_values, n_blocks, n_over, n_packed = HEAD.unpack(data.read(HEAD.size))
    last = min(last, n_blocks)
    length = dict.fromkeys(ORDER, n_blocks) | {"over_at": n_over, "over": n_over, "packed": n_packed}
    place, pos = {}, at + HEAD.size + 13 * n_docs
    for k, kind in ORDER.items():
        place[k] = pos
        pos += np.dtype(kind).itemsize * length[k]

    def take(k: str, a: int, b: int) -> np.ndarray:
        size = np.dtype(ORDER[k]).itemsize
        data.seek(place[k] + a * size)
        return np.frombuffer(data.read((b - a) * size), ORDER[k])

    counts = take("n_over", 0, last).astype(np.int64)
    over = int(counts[:first].sum()), int(counts.sum())
    starts = take("starts", first, min(last + 1, n_blocks)).astype(np.int64)
    ends = int(starts[last - first]) if last < n_blocks else n_packed
    parts = {"low": take("low", first, last), "width": take("width", first, last), "starts": starts[: last - first] - starts[0], "n_over": counts[first:]}
    parts |= {k: take(k, *over) for k in ("over_at", "over")} | {"packed": take("packed", int(starts[0]), ends)}
    return unpack(parts, min(last * BLOCK, n_values) - first * BLOCK)


# ---- encoding


class Encoder:
    """Whole texts to token ids, each distinct part encoded once."""

    #: Words of letters, and marks behind them; such a word has at least as many word ends as it has of the two.
    PLAIN, MARKED, GROUP = r"^\pL+[.,;:!?]*$", "[.,;:!?]$", 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {"": 1}
        self.flat, self.starts = array("I", [END_ID]), array("Q", [0, 1, 1])  # code 0: the end id

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids, ends) -> None:
        """``words`` with all their ids in a row, each up to its end."""
        at = len(self.flat)
        self.code.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.flat.extend(ids)
        self.starts.extend(at + e for e in ends)

    def learn(self, words: pa.Array) -> None:
        """Plain words are encoded many in a call, as their word ends tell them apart; others one by one."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        counted, whole = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        n_ends = pc.match_substring_regex(counted, self.MARKED).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        counted, step = counted.to_pylist(), self.GROUP
        groups = [counted[i : i + step] for i in range(0, len(counted), step)]
        for k, ids in enumerate(self._ids([" ".join(g) for g in groups])):
            ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(n_ends[k * step : (k + 1) * step]) - 1
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                whole += groups[k]
            else:
                self._add(groups[k], ids, ends[last].tolist())
        for w, ids in zip(whole, self._ids(whole), strict=True):
            self._add([w], ids, [len(ids)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with END_ID behind each text, ids of each text)."""
        parts = pc.split_pattern(pc.replace_substring(texts, pattern="\n", replacement=" "), pattern=" ")
        coded = parts.flatten().dictionary_encode()  # only distinct parts become Python strings
        words = coded.dictionary.to_pylist()
        if len(self.code) > WORDS:
            self.clear()
        code = np.fromiter((self.code.get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(code < 0)):
            self.learn(coded.dictionary.take(pa.array(new)))
            code[new] = [self.code[words[i]] for i in new.tolist()]
        edges = parts.offsets.to_numpy().astype(np.int64)
        codes = np.insert(code[coded.indices.to_numpy()], edges[1:] - edges[0], 0)  # code 0: the end id
        lists = pa.LargeListArray.from_arrays(pa.array(np.array(self.starts, np.int64)), pa.array(np.array(self.flat, np.uint32)))
        ids = lists.take(pa.array(codes)).flatten().to_numpy()
        starts = np.array(self.starts, np.int64)
        n_ids = np.concatenate([[0], np.cumsum(starts[codes + 1] - starts[codes])])
        return ids, np.diff(n_ids[edges - edges[0] + np.arange(len(edges))])


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of rows whose sizes add up to ``most`` at most, or of one row that is larger."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- jobs


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, n_files: int | None = None) -> DataFrame:
    """Write ``docs`` as token files of about ``FILE_BYTES`` of text each; one row (part, at, path, n_tokens) for each segment, read from the manifest."""
    spark = docs.sparkSession
    if not n_files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_files = max(1, -(-size // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, encoder = f"{folder}/part-{part:06d}.pfor", _encoder(tokenizer_path)
        rows = next(batches, None)
        if rows is None:
            return
        starts, totals = [], []
        with AtomicFile(path) as out:
            out.write(MAGIC)
            held: list = []

            def close_segment() -> None:
                starts.append(out.tell())
                totals.append(sum(len(x[3]) for x in held))
                write_segment(out, *map(np.concatenate, zip(*held, strict=True)))
                held.clear()

            while rows is not None:
                texts = rows["text"].cast(pa.large_string())
                for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE):
                    values, sizes = encoder.encode(texts.slice(a, b - a))
                    mine = (rows[c].slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("id", "known"))
                    held.append((*mine, sizes, values))
                    if sum(len(x[3]) for x in held) >= SEGMENT:
                        close_segment()
                rows = next(batches, None)
            if held:
                close_segment()
        n = len(starts)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "at": pa.array(starts, pa.int64()), "path": [path] * n, "n_tokens": pa.array(totals, pa.int64())})

    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    keyed = keyed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = keyed.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return stage_table(rows.mapInArrow(write, "part int, at long, path string, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.  A task reads some segments, of any file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, at, start in zip(rows["path"], rows["at"].tolist(), rows["start"].tolist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as data:
                    ids, known, sizes, values = read_segment(data, at)
                raw, ends = memoryview(values.astype("<u4").tobytes()), np.cumsum(sizes.astype(np.int64))
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                doc = pd.array(ids, dtype="Int64")
                doc[~known.astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": start + ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    earlier = (Window.unboundedPreceding, -1)
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)).alias("before"))  # one row for each file
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(*earlier))
    start = F.coalesce(F.col("before"), F.lit(0)) + F.coalesce(F.col("within"), F.lit(0))
    placed = manifest.withColumn("within", within).join(F.broadcast(files), "part").select("path", "at", start.alias("start"))
    return placed.repartition(max(1, manifest.count()), "path", "at").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, shared_dir(docs.sparkSession, "tokens")))
