"""SentencePiece sampling and lossless decoding over the piece lattice.

A text is prefixed by a blank, blanks become the piece mark, and it falls into
units (at marks and line feeds) whose borders no piece crosses.  In a unit's lattice an edge is a piece, or the bytes of a
character that is no piece.  The model's ranks give the weights: a piece with
id i has log probability -alpha * ln(i + 1).  Forward filtering sums the weight of
all paths to each place; backward sampling then draws the last edge, the one
before it, and so on, each with its exact conditional probability.  Draws come
from a hash of row key, seed, unit and step, so a row is cut the same way
wherever and whenever it runs.

Forward sums are made once for each distinct unit and kept within a task (which
starts anew at ``UNITS`` units).  Sampling steps all units of many texts at
once, ``CHARS`` characters of them at most; a longer text is drawn by runs of
its units, and a draw does not depend on where the runs end.  Decoding joins the bytes of the pieces and drops the leading
blank; it gives back every text exactly, also those with piece marks, control
characters or runs of blanks.

Nulls: a null text counts as empty and gives no id and an empty text back.  A
null row key is a key of its own.  Rows with equal key and text are cut alike.
An empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.llm.text import give_back
from terratile.llm.token_files import slices

MARK, HIDDEN = "▁", "\udc81"  # a literal mark is hidden, so that it is spelled in bytes
UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
UNITS, SHORT, SOME = 40_000, 48, 1 << 13
CHARS, ROWS = 1 << 18, 80
ALPHA, SEED = 1.0, 1


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """The model's pieces, the lattices of units met so far, sampling and decoding."""

    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        skip = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.weight = -alpha * np.log(np.arange(n) + 1.0)
        self.piece = {sp.id_to_piece(i): i for i in range(n) if not skip[i] and not sp.is_byte(i)}
        self.longest = max(map(len, self.piece))
        raw = [b"" if skip[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.byte_id.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        self._trie()
        self.clear()

    def _trie(self) -> None:
        """Moves over the prefixes of pieces: dense for ASCII and Latin-1 letters that are pieces themselves, sorted keys for all characters."""
        chars = [c for c in [MARK, *map(chr, range(33, 127)), *map(chr, range(0xC0, 0x100))] if c in self.piece]
        self.plain = re.compile(f"[{re.escape(''.join(chars))}]{{1,{SHORT}}}")
        self.symbol = np.zeros(0x110000, np.uint8)
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        known, node = set(chars), {"": 0}
        for p in self.piece:
            if known.issuperset(p):
                for k in range(1, len(p) + 1):
                    node.setdefault(p[:k], len(node))
        dead = len(node)
        self.move = np.full((dead + 1, len(chars) + 1), dead, np.int32)
        self.ends = np.full(dead + 1, -1, np.int32)
        for prefix, k in node.items():
            if prefix:
                self.move[node[prefix[:-1]], self.symbol[ord(prefix[-1])]] = k
            self.ends[k] = self.piece.get(prefix, -1)
        letters = sorted(set(chain.from_iterable(self.piece)))
        self.any_symbol = np.zeros(0x110000, np.int32)
        self.any_symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_symbols, number, keys = len(letters) + 1, {"": 0}, {}
        for p in self.piece:
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(number)
                    keys[number[p[: k - 1]] * self.n_symbols + int(self.any_symbol[ord(p[k - 1])])] = number[p[:k]]
        self.any_key = np.array(sorted(keys), np.int64)
        self.any_to = np.array([keys[k] for k in self.any_key.tolist()], np.int64)
        self.any_ends = np.array([self.piece.get(p, -1) for p in number], np.int32)

    def clear(self) -> None:
        self.unit: dict[str, int] = {}  # -> its number
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)  # nodes of each unit
        self.enter = np.zeros(0, np.int32)  # first edge into each node
        self.up_to, self.back, self.what = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.waiting: dict[str, list] = {x: [] for x in ("first", "last", "enter", "up_to", "back", "what")}
        self.n_nodes = self.n_edges = 0
        self.spelled: dict[str, int] = {}
        self.spelling: list[list[int]] = []

    def learn(self, units: list[str]) -> None:
        """Forward filtering of new units; short ones of common characters all at once."""
        plain, others, match = [], [], self.plain.fullmatch
        for u in units:
            (plain if match(u) else others).append(u)
        for at in range(0, len(plain), SOME):
            self._filter(plain[at : at + SOME])
        for u in others:
            self._filter_one(u)
        self._join()

    def _filter(self, units: list[str]) -> None:
        """All units at once: edges by length from walks that end where no piece goes on, sums by the place they enter."""
        size = np.array([len(u) for u in units], np.int64)
        n_nodes = int((size + 1).sum())
        first = np.cumsum(size + 1) - size - 1
        symbol = np.zeros(n_nodes + self.longest, np.uint8)  # a zero behind each unit ends every walk
        symbol[_ranges(first, size)] = self.symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        moves, dead, width = self.move.ravel(), len(self.move) - 1, self.move.shape[1]
        live, state, edges = np.arange(n_nodes), np.zeros(n_nodes, np.int64), []
        for k in range(self.longest):
            state = moves.take(state * width + symbol.take(live + k))
            on = np.flatnonzero(state != dead)
            live, state = live.take(on), state.take(on)
            ids = self.ends.take(state)
            whole = np.flatnonzero(ids >= 0)
            edges.append((live.take(whole), ids.take(whole)))
        # Sums: edges by the place they enter and their length; no two of one such run enter the same node.
        place = (np.arange(n_nodes) - np.repeat(first, size + 1)).astype(np.uint8)  # SHORT at most
        back, what = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
        length = np.repeat(np.arange(1, self.longest + 1, dtype=np.uint8), [len(e[0]) for e in edges])
        enters, odds = back + length, np.exp(self.weight).take(what)
        order = np.argsort(place.take(enters), kind="stable")
        at, to, odds_at, lengths = (x.take(order) for x in (back, enters, odds, length))
        places = place.take(to)
        forward = np.zeros(n_nodes)
        forward[first] = 1.0
        bounds = [0, *(np.flatnonzero((lengths[1:] != lengths[:-1]) | (places[1:] != places[:-1])) + 1).tolist(), len(to)]
        for a, b in pairwise(bounds):
            forward[to[a:b]] += forward.take(at[a:b]) * odds_at[a:b]
        # Edges by the node they enter, longest first: counted, then put in their places.
        count = np.bincount(enters, minlength=n_nodes)
        to_come, total, ends = np.cumsum(count) - count, len(back), len(back)
        node, run = np.repeat(np.arange(n_nodes), count), np.zeros(n_nodes)
        back_of, what_of, up_to = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total)
        for found, _ in reversed(edges):
            part = slice(ends - len(found), ends)
            ends = part.start
            to = enters[part]
            spot = to_come[to]
            run[to] = so_far = run.take(to) + forward.take(found) * odds[part]
            back_of[spot], what_of[spot], up_to[spot] = found, what[part], so_far / forward.take(to)
            to_come[to] += 1
        self._add(units, first, size, node, back_of, what_of, up_to)

    def _edges_of(self, u: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of the edges of one unit of any length and any characters, by the node they enter, longest first."""
        n = len(u)
        symbol = self.any_symbol[np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        live, state, found = np.arange(n), np.zeros(n, np.int64), []
        for k in range(self.longest):
            inside = live + k < n
            live, state = live[inside], state[inside]
            key = state * self.n_symbols + symbol[live + k]
            at = np.minimum(np.searchsorted(self.any_key, key), len(self.any_key) - 1)
            on = self.any_key[at] == key
            live, state = live[on], self.any_to[at[on]]
            piece = self.any_ends[state]
            found.append((live[piece >= 0], live[piece >= 0] + k + 1, piece[piece >= 0]))
        single = np.zeros(n, bool)
        single[found[0][0]] = True
        odd = np.flatnonzero(~single)
        for c in {u[j] for j in odd.tolist()} - self.spelled.keys():
            self.spelled[c] = len(self.spelling)
            self.spelling.append([self.byte_id[b] for b in (MARK if c == HIDDEN else c).encode()])
        found.append((odd, odd + 1, np.array([-1 - self.spelled[u[j]] for j in odd.tolist()], np.int64)))
        back, node, what = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((back, node))
        return back[order], node[order], what[order]

    def _filter_one(self, u: str) -> None:
        """The same for one unit of any length and any characters; only the last few nodes count, and are scaled up when they get small."""
        n = len(u)
        back, node, what = self._edges_of(u)
        spelled = np.array([self.weight[x].sum() for x in self.spelling])
        weight = np.exp(np.where(what >= 0, self.weight[np.maximum(what, 0)], spelled[np.maximum(-1 - what, 0)] if len(spelled) else 0.0))
        forward, total, run, at, ends = array("d", [1.0]), array("d", [1.0]), array("d"), 0, np.searchsorted(node, np.arange(1, n + 1), "right")
        for stop in ends.tolist():
            sum_ = 0.0
            for i, w in zip(back[at:stop].tolist(), weight[at:stop].tolist(), strict=True):
                sum_ += forward[i] * w
                run.append(sum_)
            total.append(sum_)
            forward.append(sum_)
            at = stop
            if sum_ < 1e-150:
                for j in range(max(0, len(forward) - self.longest - 1), len(forward)):
                    forward[j] *= 1e150
        up_to = np.frombuffer(run) / np.frombuffer(total)[node]
        self._add([u], np.zeros(1, np.int64), np.array([n]), node, back, what, up_to)

    def _add(self, units, first, size, node, back, what, up_to) -> None:
        """Edges sorted by the node they enter; each has the chance of itself and those before it."""
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        up_to = up_to.astype(np.float32)
        up_to[np.append(starts[1:], len(node)) - 1] = 2.0
        n_nodes = int((size + 1).sum())
        enter = np.full(n_nodes, -1, np.int64)
        enter[node[starts]] = starts + self.n_edges
        self.unit |= zip(units, range(len(self.unit), len(self.unit) + len(units)), strict=True)
        new = {"first": first + self.n_nodes, "last": first + size + self.n_nodes, "enter": enter, "up_to": up_to, "back": back + self.n_nodes, "what": what}
        for name, x in new.items():
            self.waiting[name].append(x.astype(getattr(self, name).dtype))
        self.n_nodes, self.n_edges = self.n_nodes + n_nodes, self.n_edges + len(node)

    def _join(self) -> None:
        for name, parts in self.waiting.items():
            if parts:
                setattr(self, name, np.concatenate([getattr(self, name), *parts]))
                parts.clear()

    def sample(self, texts: list[str], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        parts = [UNIT.findall(self._marked(t)) for t in texts]
        count = np.array([len(p) for p in parts], np.int64)
        return self._drawn(list(chain.from_iterable(parts)), count, row_keys, np.zeros(len(count), np.int64))

    def sample_long(self, text: str, row_key: int, most: int = CHARS) -> tuple[np.ndarray, str]:
        """(ids, decoded text) of one text, drawn by runs of units of about ``most`` characters."""
        key, held, size, before, ids, raw = np.array([row_key], np.uint64), [], 0, 0, [], []

        def draw() -> None:
            ids.append(self._drawn(held, np.array([len(held)]), key, np.array([before]))[0].astype(np.int32))
            raw.append(self._bytes(ids[-1])[0].tobytes())

        for m in UNIT.finditer(self._marked(text)):
            held.append(m[0])
            size += len(m[0])
            if size >= most:
                draw()
                before, held, size = before + len(held), [], 0
        if held:
            draw()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), b"".join(raw).decode()[1:]

    @staticmethod
    def _marked(text: str) -> str:
        return (" " + text).replace(MARK, HIDDEN).replace(" ", MARK) if text else ""

    def _drawn(self, units: list[str], count: np.ndarray, row_keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of texts with ``count`` units here and ``before`` units earlier."""
        if len(self.unit) > UNITS:
            self.clear()
        self.learn([u for u in dict.fromkeys(units) if u not in self.unit])
        number = np.fromiter(map(self.unit.__getitem__, units), np.int64, len(units))
        first, node = self.first[number], self.last[number]
        ordinal = _ranges(before, count).astype(np.uint64)
        stream = _mixed(np.repeat(row_keys, count) + self.seed) + ordinal * np.uint64(0xD1342543DE82EF95)
        open_, steps, drawn = np.arange(len(units)), 0, []
        length = np.zeros(len(units), np.int64)
        while len(open_):
            draw = (_mixed(stream[open_] + np.uint64(steps * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40)).astype(np.float32) / (1 << 24)
            edge = self.enter[node[open_]]
            over = np.flatnonzero(draw >= self.up_to[edge])
            while len(over):  # the longest piece stands first and is mostly the likeliest, so few go on
                edge[over] += 1
                over = over[draw[over] >= self.up_to[edge[over]]]
            drawn.append((open_, edge))
            length[open_] += 1
            node[open_] = self.back[edge]
            open_ = open_[node[open_] > first[open_]]
            steps += 1
        edges = np.zeros(int(length.sum()), np.int64)
        end = np.cumsum(length)
        for k, (who, edge) in enumerate(drawn):  # the k-th draw is the k-th piece from the unit's end
            edges[end[who] - 1 - k] = edge
        ids = self.what[edges].astype(np.int64)
        sizes = np.ones(len(ids), np.int64)
        if len(odd := np.flatnonzero(ids < 0)):
            sizes[odd] = [len(self.spelling[-1 - k]) for k in ids[odd].tolist()]
            at = np.cumsum(sizes) - sizes
            spread = np.repeat(ids, sizes)
            spread[_ranges(at[odd], sizes[odd])] = list(chain.from_iterable(self.spelling[-1 - k] for k in ids[odd].tolist()))
            ids = spread
        by_edge = np.concatenate([[0], np.cumsum(sizes)])
        by_unit = by_edge[np.concatenate([[0], end])]
        return ids, np.diff(by_unit[np.concatenate([[0], np.cumsum(count)])])

    def _bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the pieces, how many each has)."""
        size = self.raw_size[ids]
        return self.raw[_ranges(self.raw_at[ids], size)], size

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        raw, size = self._bytes(ids)
        data = raw.tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b].decode()[1:] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def row_key(key: str | None) -> int:
    return xxhash.xxh64_intdigest(b"\0" if key is None else key.encode())


def _cut(lattice: Lattice, part: pa.RecordBatch) -> pa.RecordBatch:
    keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
    hashed = [row_key(k) for k in keys]
    if len(texts) == 1 and len(texts[0]) > CHARS:
        ids, text = lattice.sample_long(texts[0], hashed[0])
        sizes, back = np.array([len(ids)]), [text]
    else:
        ids, sizes = lattice.sample(texts, np.array(hashed, np.uint64))
        back = lattice.decode(ids, sizes)
    ids = ids.astype("<i4")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    columns = {
        "doc_id": pa.array(keys, pa.string()), "n_pieces": pa.array(sizes, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in pairwise(ends.tolist())], pa.int64()),
        "text": pa.array(back, pa.string()), "lossless": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
    }
    return pa.RecordBatch.from_pydict(columns)


def sampled_pieces(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, decoded text and whether it equals the text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, alpha, seed)  # gone with the task, so that idle workers hold nothing
        give_back()
        for rows in batches:
            for at, to in slices(np.maximum(pc.utf8_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64), CHARS // ROWS), CHARS):
                yield _cut(lattice, rows.slice(at, to - at))  # only a slice is ever held as Python objects
            del rows  # before the next comes
            give_back()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "doc_id string, n_pieces long, ids array<int>, ids_crc32 long, text string, lossless boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
