"""The keyword gate of the license rules drops nothing: scans with and without it agree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terratile.llm import licenses

NAMES = ["ICU", "JSON", "PHP", "Ruby", "Vim", "BSD Zero Clause", "0BSD", "MIT", "PHP License 3.01", "Creative Commons Attribution-Non-Commercial",
         "Creative Commons Attribution Non-Commercial Share-Alike", "Creative Commons Attribution NonCommercial NoDerivs", "GNU LGPL v2.1"]
TEXTS = [f.format(n) for n in NAMES for f in ("Released under {}.", "the {} licence", "licensed under the {} License", "{}")] + ["nothing", ""]


def test_scan_without_the_gate_gives_equal_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.license_scan(docs).collect()}
    keys = F.array(*map(F.lit, sorted({rule[1] for rule in licenses.signatures()})))
    line = F.concat(F.lit(" "), licenses.word_line(F.col("text")), F.lit(" "))
    free = licenses._survivors(licenses._detections(docs.select(F.col("doc_id").alias("row_no"), line.alias("line"), keys.alias("present"))))
    own = {r.row_no: set(r.own) for r in free.groupBy("row_no").agg(F.collect_set("label").alias("own")).collect()}
    for i, (labels, base) in got.items():
        assert set(filter(None, labels.split(","))) == own.get(i, set()) | set(filter(None, base.split(","))), TEXTS[i]
    by_text = {TEXTS[i]: v[0] for i, v in got.items()}
    assert by_text["licensed under the BSD Zero Clause License"] == "0bsd" and by_text["Released under Vim."] == "vim"
    assert "cc-by-nc" in by_text["Released under Creative Commons Attribution-Non-Commercial."].split(",")


def some_match(parts, draw):
    """A random text that the parsed expression matches."""
    out = ""
    for op, arg in parts:
        if op.name == "LITERAL":
            out += chr(arg)
        elif op.name == "SUBPATTERN":
            out += some_match(arg[3], draw)
        elif op.name == "MAX_REPEAT":
            out += "".join(some_match(arg[2], draw) for _ in range(draw.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op.name == "BRANCH":
            out += some_match(draw.choice(arg[1]), draw)
        elif op.name == "IN":
            kind, value = draw.choice(arg)
            out += chr(value if kind.name == "LITERAL" else draw.randint(*value))
        else:
            raise NotImplementedError(op)
    return out


def test_every_match_of_a_rule_holds_its_keyword():
    draw = random.Random(3)
    for label, key, pattern, _ in licenses.signatures():
        parsed = re._parser.parse(pattern)
        for _ in range(60):
            text = some_match(parsed, draw)
            assert re.fullmatch(pattern, text) and f" {key}" in f" {text}", (label, key, text)
            assert set(text.split()) & set(licenses.GATE), (label, key, text)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_go_only_for_kept_ones(spark, seed):
    draw = random.Random(seed)
    rows = [(0, 0, 10, 95, 0, "x"), (0, 2, 12, 40, 1, "y"), (0, 8, 15, 65, 2, "z"), (1, 0, 5, 95, 0, "x"), (1, 3, 10, 40, 1, "y"), (1, 6, 9, 90, 2, "z")]
    for row in range(2, 60):
        for no in range(draw.randint(1, 12)):
            at = draw.randint(0, 25)
            rows.append((row, at, at + draw.randint(1, 8), draw.choice([30, 65, 95]), no, str(no)))
    want = set()
    for row in {r[0] for r in rows}:
        kept = []
        mine = [r for r in rows if r[0] == row]
        mine = [(*r[:3], max(x[3] for x in mine if r[1] <= x[1] and x[2] <= r[2]), *r[4:]) for r in mine]
        for r in sorted(mine, key=lambda r: (-r[3], r[1] - r[2], r[1], r[4])):
            if all(r[2] <= k[1] or k[2] <= r[1] for k in kept):
                kept.append(r)
        want |= {(r[0], r[1], r[2], r[5], r[3]) for r in kept}
    found = spark.createDataFrame(rows, "row_no long, start long, end long, rank int, no int, label string")
    assert {tuple(r) for r in licenses._survivors(found).collect()} == want
    assert {(0, 0, 10, "x", 95), (1, 6, 9, "z", 90)} <= want
