"""The row-wise operators and searches against brute force on small tables."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from terratile.llm import decontaminate, licenses, quality_rules, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, kept string"


def long_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = long_text(1, 300)
    texts = [
        base, base, base.upper(), base + " end", base.replace("w7 ", "x7 "), None, "", "  \n\t ", "one", "One two\nONE two",
        "cc by cc by general public license", "All rights  reserved.\nall RIGHTS reserved", "aé b É ÉÉ x|y <b> #1",
        "Licensed under the Apache License, Version 2.0.", "a b c d e f a b c d e x a b c d e", "!!! ### $$$ " * 40,
        long_text(2, 20000), long_text(3, 12), "a\na\nb\n\na\n b", "Release under K-license İ MIT License", base,
    ]
    rows = [(i, t, "en", None, 1, "r", "k") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None), (3, base + " end", "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_fingerprints_and_components(spark, docs):
    def fp(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = docs.collect()
    got = simhash.simhash_components(docs, shard_rows=3).collect()
    prints = [fp(r.text) for r in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i, j in combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                part[i] = part[j] = min(part[i], part[j])
    least = {p: min((rows[i].doc_id for i in range(len(rows)) if part[i] == p and rows[i].doc_id is not None), default=None) for p in part}
    want = Counter((r.doc_id, f"{x:016x}", least[p]) for r, x, p in zip(rows, prints, part, strict=True))
    assert Counter(map(tuple, got)) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(part))
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_keep_first_leaves_columns_alone(spark):
    rows = spark.createDataFrame([(1, "a b", 7, 70, 1), (2, "A b", 8, 80, 2), (3, "c", 9, 90, 3)], "doc_id long, text string, fp long, row_no long, root long")
    assert sorted(map(tuple, simhash.keep_first(rows).collect())) == [(1, "a b", 7, 70, 1), (3, "c", 9, 90, 3)]


def near_prints(rng, n):
    seeds = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = [s ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for s in seeds for b, c in rng.integers(0, 64, (12, 2))]
    return np.concatenate([seeds, np.array(near, np.uint64)])


def parts_of(prints, shards, radius):
    part = np.arange(len(prints))
    near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius) & (shards[:, None] == shards[None, :])
    while True:
        new = np.where(near, part[None, :], len(prints)).min(1)
        if (new == part).all():
            return part
        part = new


@pytest.mark.parametrize("twins", [True, False])
def test_trees_find_all_links_and_skip_branches(twins):
    rng = np.random.default_rng(5)
    prints = near_prints(rng, 40)
    prints = np.concatenate([prints, prints[:50]])
    for n_shards in (1, 7, len(prints)):
        shards = np.sort(rng.integers(0, n_shards, len(prints)))
        assert (simhash.BKForest(shards, prints, twins).link(4) == parts_of(prints, shards, 4)).all()
    forest = simhash.BKForest(np.zeros(2000, np.int64), rng.integers(0, 2**63, 2000, dtype=np.uint64))
    assert forest.link(4).tolist() == list(range(2000)) and 0 < forest.visits < 0.7 * 2000 * 1999 / 2
    assert simhash.BKForest(np.zeros(0, np.int64), np.zeros(0, np.uint64)).link(4).tolist() == []


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_links_come_through_the_trees_whatever_the_shards(spark, monkeypatch, agree):
    monkeypatch.setattr(simhash, "agreeing", lambda radius, n: agree)
    prints = near_prints(np.random.default_rng(9), 12)
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints.view(np.int64))], "doc_id long, fp long")
    part = parts_of(prints, np.zeros(len(prints), int), 4)
    for most in (3, 8192):
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 4, most).collect()} == dict(enumerate(part.tolist()))


def test_quality_counts(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(docs).collect())
    want = Counter()
    for r in docs.collect():
        text, w = r.text or "", words_of(r.text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if words_of(x)]
        n = len(w)
        want[(r.doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)] += 1
    assert got == want


def test_quality_verdicts(docs):
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 0 in kept and 16 in kept and 15 not in kept and 5 not in kept
    assert quality_rules.quality_report(docs.limit(0)).count() == 0


def test_license_base(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = licenses.license_scan(docs).collect()
    want = Counter()
    for r in docs.collect():
        w = plain_words(r.text)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        spots = [i for i, _ in at]
        want[(r.doc_id, len(w), len(at), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == want
    by_id = {g.doc_id: g for g in got}
    assert by_id[13].labels == "apache-2.0" and by_id[13].score == 0.95
    assert all(set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1 for g in got)


def test_license_suppression(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
        "GNU Lesser General Public License v2.1 and the zlib license", "nothing here", "Released under the MIT License. " * 3000,
    ]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "cc-by,cc-by-nc", 1: "gpl,gpl-3.0", 2: "mit", 3: "gpl,lgpl-2.1,zlib", 4: "", 5: "mit"}
    assert 200 < len(licenses.signatures())


def test_decontamination(spark):
    item = long_text(7, 40)
    part = " ".join(item.split()[:34])
    less = " ".join(item.split()[:20])
    rows = [
        (1, f"{long_text(8, 9000)} {item} {long_text(9, 9000)}", "k"), (2, f"x {part.upper()} y", "k"), (3, less, "k"), (4, None, "k"), (5, "", "k"),
        (6, "a b c", "k"), (7, item, "k"), (7, "more", "k"), (None, item, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, long_text(11, 30)), (12, None), (13, "a b c"), (14, " ".join([item] * 2))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}

    def sets(text):
        w = plain_words(text)
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(d, i) for d, t, _ in rows for i, u in ((r.item_id, sets(r.text)) for r in items.collect()) if u and len(u & sets(t)) >= 0.8 * len(u)}
    assert got == want and (1, 10) in got and (2, 10) in got and (6, 13) in got and (3, 10) not in got
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(3, less), (4, None), (5, ""), (7, "more")]  # rows are judged singly
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "say A, b! c now and then again"), (2, "a b x c"), (3, "b c")], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a b c"), (2, "b"), (3, "x c"), (4, "then again now and then again")], "item_id long, text string")
    assert {tuple(r)[:2] for r in decontaminate.contained_items(short, few).collect()} == {(1, 1), (1, 2), (2, 2), (3, 2), (2, 3)}
