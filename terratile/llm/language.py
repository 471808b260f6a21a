"""Language identification by cross-parsing entropy.

For each label a suffix automaton is built over a bounded sample of its texts.
A text is parsed from left to right against each automaton: a phrase is the
longest match with some substring of that label's sample, then the next phrase
starts.  The label whose parse needs the fewest phrases, each weighed by the
bits that name a place in the sample (log2 of its length), wins; per character
this is the cross-parsing estimate of the entropy.  Ties go to the label that
sorts first.

Texts are lower-cased and runs of non-letters become one blank; every character
of the samples is a symbol, and a character that no sample holds matches
nothing.  Long texts are cut in blocks of ``PARSE`` symbols, so that many are
stepped at once; then each block's parse runs on into the next block until it
starts a phrase where that block's own parse starts one, from where both are
the same.  So the phrases are those of the whole text parsed from its start, however long
a phrase is.

The sample takes ``DOCS`` documents of each label, by a hash of the id, of the
folds that are not held out (of rows that share an id, the least text): the
whole text of a document of up to ``MOST`` letters, and of a longer one as many
letters, in runs of ``RUN`` spread evenly over all of it.  So an automaton has a
bound, whatever the texts.  It is built once, by the task of its label, and goes
to the workers as arrays.  Text is the only input of a prediction.

Nulls: a null text or one without a letter gives ``und`` and score 0; so does
every text if nothing is labelled.  A null id is not held out and never learned
from.  Repeated rows are judged one by one.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.llm.sampling import held_out, sample_ids
from terratile.llm.token_files import slices

DOCS, PARSE, SYMBOLS = 32, 1024, 1 << 22
MOST, RUN = 1 << 14, 1 << 10
PIECE = 1 << 20  # characters looked up at a time
BLANK = 32


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with one blank for each run of anything else between them."""
    low, parts, after = (text or "").lower(), [], False
    for at in range(0, len(low), PIECE):
        points = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _is_letter()[points]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of a run of others stays, as a blank
        keep[0] |= after
        after = is_letter[-1]
        parts.append(np.where(is_letter, points, BLANK)[keep].astype(np.uint32))
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return points[:-1] if len(points) and points[-1] == BLANK else points


def share(points: np.ndarray) -> np.ndarray:
    """Of many letters ``MOST``, in runs spread over all of them."""
    if len(points) <= MOST:
        return points
    starts = np.linspace(0, len(points) - RUN, MOST // RUN).astype(np.int64)
    return np.concatenate([points[a : a + RUN] for a in starts])


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


Arrays = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def automaton_arrays(texts: list[np.ndarray]) -> Arrays:
    """(states, code points, next states, number of symbols) of the automaton of some texts' letters, parted by blanks."""
    points = np.concatenate([x for t in texts for x in (t, [BLANK])] or [np.zeros(0)]).astype(np.int64)
    moves = suffix_automaton(points.tolist())
    size = np.array([len(out) for out in moves], np.int64)
    flat = np.array([x for out in moves for pair in out.items() for x in pair], np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(moves), dtype=np.int32), size), flat[:, 0].copy(), flat[:, 1].copy(), len(points)


class Moves:
    """(state, symbol) -> state, -1 where there is none, of any number of symbols: an open hash table looked up by arrays."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, n_symbols: int):
        self.n_symbols, self.low = np.int64(n_symbols), np.int64(max(int(to.max(initial=0)), int(state.max(initial=0)), 1).bit_length())
        key = state.astype(np.int64) * n_symbols + symbol
        slot_of = (key << self.low) | to.astype(np.int64)
        bits = max(4, (3 * len(key)).bit_length())  # few keys meet, so few are looked up twice
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int64)  # key, then the state it leads to in the low bits
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = slot_of[free]  # of several that want a slot the last gets it
            left = left[self.table[slot[left]] != slot_of[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.first = self(np.zeros(n_symbols, np.int64), np.arange(n_symbols))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.n_symbols
        key += symbol
        slot = self._slot(key)
        have = self.table.take(slot)
        found = (have >> self.low) == key
        other = (~found & (have >= 0)).nonzero()[0]
        to = np.where(found, have & ((np.int64(1) << self.low) - 1), -1)
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            have = self.table[slot[other]]
            met = (have >> self.low) == key[other]
            to[other[met]] = have[met] & ((np.int64(1) << self.low) - 1)
            other = other[~met & (have >= 0)]
        return to

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase starts with this symbol); state 0: no phrase is under way."""
        to, starts = self(state, symbol), state == 0
        lost = (to < 0).nonzero()[0]
        if len(lost):
            starts[lost] = True
            to[lost] = np.maximum(self.first[symbol[lost]], 0)  # a symbol that no phrase holds is one of its own
        return to, starts


class Model:
    """One automaton for each label, and the symbols of characters."""

    def __init__(self, samples: dict[str, list[str]] | None = None, arrays: dict[str, Arrays] | None = None):
        arrays = {k: automaton_arrays([letters(t) for t in texts]) for k, texts in samples.items()} if arrays is None else arrays
        self.labels = sorted(arrays)
        known = np.unique(np.concatenate([*(np.unique(a[1]) for a in arrays.values()), [BLANK]]).astype(np.int64))
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.moves = [Moves(state, self.symbol[points], to, len(known) + 1) for state, points, to, _ in (arrays[k] for k in self.labels)]
        self.bits = np.array([np.log2(max(arrays[k][3], 2)) for k in self.labels])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (code points of ``letters``) under each label: [text, label]."""
        total = np.zeros((len(texts), len(self.labels)), np.int64)
        for a, b in slices(np.array([len(t) for t in texts], np.int64), SYMBOLS):
            total[a:b] = self._phrases([self.symbol[t] for t in texts[a:b]])
        return total

    def _phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        blocks = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), PARSE)]
        size = np.array([min(PARSE, len(texts[i]) - at) for i, at in blocks], np.int64)
        order = np.argsort(-size, kind="stable")
        column = np.empty(len(order), np.int64)  # of each block, in order of size
        column[order] = np.arange(len(order))
        grid = np.zeros((int(size.max(initial=0)), len(blocks)), np.int32)
        for col, k in enumerate(order.tolist()):
            i, at = blocks[k]
            grid[: size[k], col] = texts[i][at : at + PARSE]
        owner = np.array([i for i, _ in blocks], np.int64)
        active = np.searchsorted(-size[order], -np.arange(1, len(grid) + 1), "right")
        later = np.flatnonzero(np.append(False, owner[1:] == owner[:-1])) if len(blocks) else np.zeros(0, np.int64)
        width, before, after = size[order], np.full(len(blocks), -1, np.int64), np.full(len(blocks), -1, np.int64)
        before[column[later]], after[column[later - 1]] = column[later - 1], column[later]
        total = np.zeros((len(texts), len(self.labels)), np.int64)
        for k, moves in enumerate(self.moves):
            state, starts = np.zeros(len(blocks), np.int64), np.zeros(grid.shape, bool)
            for t, n in enumerate(active.tolist()):
                state[:n], starts[t, :n] = moves.step(state[:n], grid[t, :n])
            count = starts.sum(0)
            # the parse of the block before runs on into each later block, until both start a phrase at one place
            # The true parse enters a block in the state in which it left the one before, and is the block's own
            # from the first place where both start a phrase.  A block is done anew while that state changes.
            leaves, own_count, own_leaves = state.copy(), count.copy(), state
            entered, todo = np.zeros(len(blocks), np.int64), column[later]
            while len(todo):
                entered[todo] = leaves[before[todo]]
                here, at, more = todo, entered[todo], np.zeros(len(todo), np.int64)
                for t in range(len(grid)):
                    ended = t >= width[here]
                    if ended.any():
                        leaves[here[ended]], count[here[ended]] = at[ended], more[ended] + own_count[here[ended]]
                        here, at, more = here[~ended], at[~ended], more[~ended]
                    if not len(here):
                        break
                    at, begun = moves.step(at, grid[t, here])
                    own = starts[t, here]
                    met = begun & own
                    leaves[here[met]], count[here[met]] = own_leaves[here[met]], (more + own_count[here])[met]
                    here, at, more = here[~met], at[~met], (more + begun - own)[~met]
                leaves[here], count[here] = at, more + own_count[here]
                todo = after[todo]
                todo = todo[todo >= 0]
                todo = todo[leaves[before[todo]] != entered[todo]]
            total[:, k] = np.bincount(owner[order], count, len(texts)) if len(blocks) else 0
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        clean = [letters(t) for t in texts]
        cost = self.phrases(clean) * self.bits
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for i, t in enumerate(clean):
            if len(t) and self.labels:
                best = int(cost[i].argmin())
                rest = np.delete(cost[i], best)
                names[i] = self.labels[best]
                scores[i] = 1.0 if not len(rest) else 1 / (1 + 2 ** float(-min(rest.min() - cost[i, best], 60.0)))
        return names, scores


_models: dict[str, Model] = {}


def automata(docs: DataFrame, per_label: int = DOCS) -> dict[str, Arrays]:
    """Label -> the arrays of the automaton of at most ``per_label`` documents of it."""
    chosen = sample_ids(docs.select("doc_id", F.col("lang").alias("label")), per_label)
    texts = docs.select("doc_id", "text", "lang").dropna().join(F.broadcast(chosen), "doc_id").where("lang = label")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # per_label rows a label

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["doc_id", "label"]].assign(points=[share(letters(t)).astype("<u4").tobytes() for t in rows["text"]])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        state, points, to, n = automaton_arrays([np.frombuffer(p, "<u4") for p in rows["points"]])
        return pd.DataFrame([(rows["label"].iloc[0], state.tobytes(), points.tobytes(), to.tobytes(), n)], columns=["label", "state", "points", "to", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = texts.mapInPandas(cut, f"doc_id {kind}, label string, points binary")
    built = short.groupBy("label").applyInPandas(build, "label string, state binary, points binary, to binary, n long").collect()  # of bounded size a label
    return {r.label: (*(np.frombuffer(r[c], np.int32) for c in ("state", "points", "to")), r.n) for r in sorted(built, key=lambda r: r.label)}


def languages(docs: DataFrame, per_label: int = DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``."""
    arrays = automata(docs, per_label)
    digest = hashlib.sha1()
    for label, (state, points, to, n) in arrays.items():
        for part in (label.encode(), state, points, to, str(n).encode()):
            digest.update(part)
    name = digest.hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(arrays=shared.value)
        model = _models[name]
        for rows in batches:
            for a, b in slices(rows["text"].str.len().fillna(0).to_numpy(np.int64), SYMBOLS):
                part = rows.iloc[a:b]
                names, scores = model.predict(part["text"].tolist())
                yield part[["doc_id", "held_out"]].assign(lang_pred=names, score=scores)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    found = rows.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
