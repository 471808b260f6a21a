"""Chat formatting by schema fingerprints.

A record is a JSON object.  Its fingerprint is the XXH64 of its sorted nested
field paths (``[]`` for a step into a list), without those no layout uses; the
fingerprint selects one of the declarative ``LAYOUTS``, which says where the
turns are.  Turns become

    <|im_start|>role, a line feed, the text, <|im_end|>, a line feed

and the characters of assistant texts are under the loss mask.  Inside roles
and texts one backslash more is put between ``<`` and ``|`` (after any that
stand there), so no control string can occur in them and taking one away gives
back the original; a role's line feeds and backslashes are written as ``\\n``
and ``\\\\`` before.  List layouts map other names of the assistant and the user
to these; rows of single turns keep their roles as given.

Output is a table of pieces, one turn each, with the span of the loss mask; a
conversation's formatted text is its pieces in order.  A conversation of any
length is written and read as a stream: a reader holds one piece and the state
of two digests.  (A digest over a whole conversation is a sequential fold, so
one conversation's pieces meet in one task; everything before that is by row.)

Nulls: a null or missing text is empty, a null or missing role is empty in
single turns and ``unknown`` in lists, a null record has no turn.  Texts that are
numbers, lists or objects are their JSON.  Null conversation ids form one
conversation.  Rows of a conversation with equal turns are ordered by role and
text.  A record that is no JSON object or that no layout knows gives one piece
without text, its layout ``none`` and the reason beside it; it counts as no turn.
An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.storage import stage_table

START, END = "<|im_start|>", "<|im_end|>\n"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name -> (list field or None, [(role field or fixed role, text field)], fields that may be missing).
#: In a list layout the one pair names the fields of each list item.
LAYOUTS = {
    "turn": (None, [("$role", "text")], ["role", "text"]),
    "messages": ("messages", [("role", "content")], []),
    "shared": ("conversations", [("from", "value")], []),
    "dialogue": ("dialog", [("speaker", "utterance")], []),
    "instruction": (None, [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")], ["system", "input"]),
    "prompt": (None, [("system", "system"), ("user", "prompt"), ("assistant", "completion")], ["system"]),
    "response": (None, [("system", "system"), ("user", "prompt"), ("assistant", "response")], ["system"]),
    "question": (None, [("system", "system"), ("user", "question"), ("assistant", "answer")], ["system"]),
}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a decoded JSON value."""
    if isinstance(value, dict):
        return set(chain.from_iterable(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set(chain.from_iterable(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(fields: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(fields)))


def _known() -> dict[int, str]:
    known = {}
    for name, (inside, pairs, maybe) in LAYOUTS.items():
        names = {x.lstrip("$") for p in pairs for x in (p if inside or p[0].startswith("$") else p[1:])}
        for left_out in chain.from_iterable(combinations(maybe, n) for n in range(len(maybe) + 1)):
            have = names - {*left_out}
            known[fingerprint({f"{inside}[].{x}" if inside else x for x in have} or set())] = name
        if inside:
            known[fingerprint({f"{inside}[]"})] = name
    return known


KNOWN = _known()
VOCABULARY = {f"{inside}[].{x}" if inside else x.lstrip("$") for inside, pairs, _ in LAYOUTS.values() for p in pairs for x in (p if inside or p[0][:1] == "$" else p[1:])}
VOCABULARY |= {f"{inside}[]" for inside, _, _ in LAYOUTS.values() if inside}


def _text(value) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()  # half a surrogate pair has no UTF-8


def read_record(record: str | None) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(layout, why there is none, (role, text) of each turn) of a JSON record."""
    if record is None:
        return "null", None, []
    try:
        value = json.loads(record)
    except (ValueError, RecursionError) as e:
        return "none", f"not JSON: {e}", []
    if not isinstance(value, dict):
        return "none", "not an object", []
    fields = {path for k, v in value.items() for path in (paths(v, k) if isinstance(v, list) else {k})}
    # below a field of a list's items, anything is that field's value
    fields = {".".join(p.split(".")[:2]) if "[]." in p else p for p in fields}
    name = KNOWN.get(fingerprint(fields & VOCABULARY))
    if name is None or (name == "turn" and value and not fields & VOCABULARY):
        return "none", f"no layout for {sorted(fields)}", []
    inside, pairs, _ = LAYOUTS[name]
    if inside:
        items = value[inside]
        if not all(isinstance(x, dict) for x in items):
            return "none", f"items of {inside} are no objects", []
        role, text = pairs[0]
        return name, None, [(ROLES.get(r := _text(x.get(role)), r) or "unknown", _text(x.get(text))) for x in items]
    return name, None, [(_text(value.get(r[1:])) if r.startswith("$") else r, _text(value.get(t))) for r, t in pairs if r.startswith("$") or t in value]


def canonical(record: str | None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a JSON record."""
    return read_record(record)[2]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its loss mask; both 0 without one)."""
    line = role.replace("\\", "\\\\").replace("\n", "\\n")
    head = START + escape(line) + "\n"
    body = escape(text)
    whole = head + body + END
    return (whole, len(head), len(head) + len(body)) if role == "assistant" else (whole, 0, 0)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        yield role, unescape(text)


PIECES = "conv_id string, turn string, sub int, layout string, reason string, formatted string, mask_start int, mask_end int"


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, turn, record) -> pieces (conv_id, turn, sub, layout, reason, formatted, mask_start, mask_end)."""
    names = [x.split(" ")[0] for x in PIECES.split(", ")]

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, size = [], 0
            for conv, turn, record in rows[["conv_id", "turn", "record"]].itertuples(index=False):
                layout, reason, turns = read_record(record)
                if reason is not None:
                    out.append((conv, turn, 0, layout, reason, "", 0, 0))
                for sub, (role, text) in enumerate(turns):
                    out.append((conv, turn, sub, layout, None, *piece(role, text)))
                    size += len(text)
                if size > 1 << 24:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    kinds = {c: records.schema[c].dataType for c in ("conv_id", "turn")}
    rows = records.select(*[F.col(c).cast("string").alias(c) for c in kinds], "record")
    return rows.mapInPandas(convert, PIECES).withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation of the formatted pieces: counts and digests of turns and of what the loss mask covers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, done, begun = None, [], False
        turns = loss = None
        n = chars = length = 0

        def closed() -> tuple:
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for rows in batches:
            for conv, formatted, a, b in rows[["conv_id", "formatted", "mask_start", "mask_end"]].itertuples(index=False):
                if not begun or conv != now:
                    if begun:
                        done.append(closed())
                    now, begun, n, chars, length = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                covered = unescape(formatted[a:b])
                loss.update(covered.encode())
                chars += len(covered)
                length += len(formatted)
            yield pd.DataFrame(done, columns=names)
            done = []
        if begun:
            yield pd.DataFrame([closed()], columns=names)

    kind = pieces.schema["conv_id"].dataType
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub", "formatted")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "mask_start", "mask_end")
    out = rows.mapInPandas(read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> digests read back from the written pieces."""
    records = turns.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    return digests(stage_table(format_records(records), "chat"))
