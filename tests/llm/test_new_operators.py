"""Hard negatives, source divergence and toxicity against brute force and planted cases; samples without a hot label."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terratile.llm import divergence, hard_negatives, sampling, toxicity

VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def brute_negatives(rows, every):
    kept = []
    for vec_id, x, label, *_ in rows:
        if None in (vec_id, x, label) or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = [math.floor(256 * float(np.float32(v))) for v in x]
        if sum(v * v for v in q) < 2**62:
            kept.append((vec_id, q, label))
    out = []
    for i, (a, x, label) in enumerate(kept):
        if a % every:
            continue
        score = [sum(p * q for p, q in zip(x, y, strict=False)) for _, y, _ in kept]
        same = sorted((-score[j], b) for j, (b, _, other) in enumerate(kept) if other == label and b != a)[:5]
        rest = sorted((-score[j], b) for j, (b, _, other) in enumerate(kept) if other != label)
        for s, p in same:
            fits = [(t, b) for t, b in rest if 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fits)]
    return sorted(out)


def clustered(seed, n, groups=8, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    at = rng.integers(0, groups, n)
    x = centres[at] + 0.1 * rng.normal(size=(n, width))
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 4)), "e") for i in range(n)]


ODD = [
    (None, [1.0] * 12, 1, "x"), (7001, None, 1, "x"), (7002, [1.0] * 12, None, "x"), (7003, [1.0, None], 1, "x"), (7004, [float("nan")] + [1.0] * 11, 1, "x"),
    (7005, [float("inf")] * 12, 1, "x"), (7010, [], 2, "x"), (7011, [0.5, 2.0], 2, "x"), (7012, [1e30] * 12, 2, "x"), (0, [1.0] * 12, 3, "again"), (7013, [0.5] * 14, 1, "longer"),
]


@pytest.mark.parametrize("block", [16, 1024])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = clustered(1, 600) + ODD + [(8000 + i, [0.25] * 12, i % 3, "copy") for i in range(60)]
    got = sorted(map(tuple, hard_negatives.mined(spark.createDataFrame(rows, VECTORS), 50).collect()))
    assert got == brute_negatives(rows, 50) and len(got) > 50


def test_hard_negatives_beyond_float_precision(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=5) * 2e5], int(rng.integers(0, 2)), "") for i in range(120)]
    got = sorted(map(tuple, hard_negatives.mined(spark.createDataFrame(rows, VECTORS), 10).collect()))
    assert got == brute_negatives(rows, 10) and got


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([ODD[0], ODD[1]], VECTORS)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(100, [1.0], 1, "")], VECTORS)).collect() == []


def test_zone_maps_skip_blocks(spark):
    rows = clustered(2, 4000, groups=20, width=6)
    found = hard_negatives.prepared(spark.createDataFrame(rows, VECTORS))
    seen = hard_negatives.ranges(found)
    base = hard_negatives.shared_dir(spark, "blocks_test")
    hard_negatives.BLOCK, before = 32, hard_negatives.BLOCK
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        placed = hard_negatives.placed(found, seen)
        files = hard_negatives.write_blocks(placed, seen, base, 2)
    finally:
        hard_negatives.BLOCK = before
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    paths = list(hard_negatives.files_of(base, files, 0, 1))
    blocks = [hard_negatives.BlockFile(p, seen.width) for p in paths]
    assert sum(len(b.label_low) for b in blocks) >= 125
    for b in blocks:  # the bounds hold every score
        x = np.floor(256 * np.array([rows[k][1] for k in (0, 5, 9)]))
        low, high = b.bounds(x)
        for k in range(len(b.label_low)):
            scores = hard_negatives.products(x.astype(np.int64), b.read([k])[2])
            assert (low[:, k] <= scores.min(1)).all() and (scores.max(1) <= high[:, k]).all()
    first = rows[0]
    chunk = hard_negatives.Chunk(np.array([first[0]]), np.array([first[2]]), np.floor(256 * np.array([first[1]])).astype("<i4"))
    best, read = hard_negatives.nearest(chunk, iter(paths), seen.width)
    assert len(best.id) == 5 and read < 64
    monkey = np.array([best.score[0]])
    _, read = hard_negatives.in_windows(chunk, np.array([0]), monkey, iter(paths), seen.width)
    assert read < 100


def test_hilbert_keys_walk_the_grid_in_unit_steps():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = hard_negatives.hilbert_keys(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int"


def brute_divergence(rows, least_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t in df if df[t] >= least_docs}
        counts = defaultdict(Counter)
        whole = Counter()
        for one, source, words in docs:
            if one == lang:
                counts[source].update(t for t in words if t in kept)
                whole.update(t for t in words if t in kept)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = sorted(((-sum(abs(p(c, t) - p(o, t)) for t in kept), b.encode(), b) for b, o in counts.items() if b != s))
            out += [(lang, s, "pair", b, -v, k + 1) for k, (v, _, b) in enumerate(pairs)]
            more = sorted((-(p(c, t) - p(whole, t)), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t))[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(more)]
    return sorted(out)


@pytest.mark.parametrize("bucket,block", [(2048, 32), (7, 2)])
def test_divergence_against_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 40)
    rng = np.random.default_rng(5)
    names = [f"{c}{d}" for c in "aÄbξ日É" for d in "abcdefghij"] + ["Ab", "aB", "x"]
    rows = []
    for i in range(300):
        words = [names[int(k)] for k in rng.zipf(1.4, 25) % len(names)]
        rows.append((i, "9 ".join(words) + "\x00it's", ["en", "de", None][i % 3], [f"s{i % 5}", None][i % 7 == 0], 1, 1))
    rows += [(None, None, "en", "quiet", 1, 1), (None, "", None, None, 1, 1), (1, "lone words", "xx", "a", 1, 1), (2, "lone", "xx", "b", 1, 1), (3, "", "yy", "only", 1, 1)]
    got = sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS), 10, 6).collect()))
    assert got == brute_divergence(rows, 10, 6) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**12, 10**13 + 7, 10**6), (3 * 10**15, 9 * 10**15 + 1, 12), (6, 6, 0)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


# ---- toxicity


def corpus(n=900, seed=1):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "no") for c in ("", "na", "le")]
    vile = ["scumbag", "vermin", "filthling"]
    docs, labels = [], []
    for i in range(n):
        words = [plain[int(k)] for k in rng.integers(0, len(plain), 60)]
        toxic = int(i % 8 == 0)
        if toxic:
            for k in rng.integers(0, 60, 4):
                words[int(k)] = vile[int(rng.integers(0, 3))]
        docs.append((i, " ".join(words), "en", "s", 1, 0))
        labels.append((i, 1, toxic if i % 2 == 0 else None))
    return docs, labels


def test_toxic_texts_are_found_from_positives_alone(spark):
    docs, labels = corpus()
    docs += [(5000, None, None, None, None, None), (5001, "", "", "", 0, 0), (None, "scumbag vermin filthling", "", "", 0, 0), (5002, "kara " * 400_000 + "Vermin SCUMBAG filthling vermin", "", "", 0, 0), docs[0]]
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(d, y).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    truth = {i: int(i % 8 == 0) for i in range(900)}
    held = [i for i in truth if by[i].held_out]
    assert 200 < len(held) < 400
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.99 * len(held)
    assert by[5002].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    assert by[5000].predicted == by[5001].predicted == 0 and by[5000].score == by[5001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    # clean labels are not read at all
    flipped = y.selectExpr("doc_id", "quality", "CASE WHEN toxic = 1 THEN 1 END AS toxic")
    assert sorted(map(str, toxicity.toxicity_scores(d, flipped).collect())) == sorted(map(str, rows))
    kept = toxicity.keep_clean(d.withColumnRenamed("n_chars", "_score"), y)
    assert kept.columns == ["doc_id", "text", "lang", "source", "_score", "bucket"]
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_toxicity_without_examples(spark):
    d = spark.createDataFrame(corpus(30)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(d, none).collect()} == {0.0}
    assert toxicity.toxicity_scores(d.limit(0), none).collect() == []
    assert toxicity.toxicity_scores(d.limit(0), spark.createDataFrame([(2, 1, 1)], none.schema)).collect() == []


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(0)
    for share in (0.05, 0.3):
        p = rng.normal(4, 1, 2000)
        u = np.where(rng.random(8000) < share, rng.normal(4, 1, 8000), rng.normal(0, 1, 8000))
        assert abs(toxicity.class_prior(p, u) - share) < 0.05


# ---- samples


def test_a_sample_moves_no_label_into_one_task(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN 'b' ELSE 'a' END AS label")
    picked = sampling.sample_ids(rows, 40)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"\w+Join", plan)
    assert joins and set(joins) == {"BroadcastHashJoin"}
    got = picked.collect()
    assert Counter(r.label for r in got) == {"a": 40, "b": 40}
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in got)
    other = sampling.sample_ids(rows, 10**6, 3, 1).collect()
    assert {r.doc_id for r in other} == {i for i in range(20000) if zlib.crc32(str(i).encode()) % 3 != 1}
