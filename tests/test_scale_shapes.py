"""Operators rebuilt so that no task holds a group: counting selection, two-level components, block search, clusters, versions, deep JSON."""

import json
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from terratile.operators import change, clusters, density, listing, raster, reports, scan, search
from terratile.sources import snapshots
from terratile.storage import shared_dir


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bins,few", [(4096, 4096), (4, 3)])
def test_quantiles_by_counting(spark, monkeypatch, bins, few):
    monkeypatch.setattr(scan, "BINS", bins)
    monkeypatch.setattr(scan, "FEW", few)
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([0.0, -1.5, rng.gauss(0, 1), 1e9, -1e-9, None, float("nan")])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    got = {r.g: (r.lo, r.mid, r.hi) for r in scan.quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"lo": 0.02, "mid": 0.5, "hi": 0.98}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, three in got.items():
        own = [v for h, v in data if h == g and v is not None and not math.isnan(v)]
        assert np.allclose(three, np.quantile(own, [0.02, 0.5, 0.98]), rtol=1e-12, atol=1e-12)
    whole = scan.quantiles(spark.createDataFrame(data, "g string, v double"), [], "v", {"mid": 0.5}).first().mid
    assert math.isclose(whole, np.quantile([v for _, v in data if v is not None and not math.isnan(v)], 0.5), abs_tol=1e-12)
    assert scan.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"mid": 0.5}).collect() == []


@pytest.mark.parametrize("side", [4, 7, 256])
def test_components_in_two_levels(spark, side):
    rng = random.Random(5)
    cells = {(o, y, x) for o in (1, 2) for y in range(-9, 20) for x in range(30) if rng.random() < 0.4} | {(3, 0, x) for x in range(50)} | {(4, y, 10 if y % 2 else 9 + (y % 4)) for y in range(40)} | {(5, 10**10, 10**10)}
    left, want = set(cells), set()
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            o, y, x = todo.pop()
            for n in ((o, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if n in left and n not in seen:
                    seen.add(n)
                    todo.append(n)
        left -= seen
        want |= {(*c, *min(seen)[1:]) for c in seen}
    mask = spark.createDataFrame([*cells, *list(cells)[:20]], "observation_id long, y long, x long")
    assert {tuple(r) for r in raster.components(mask, side).collect()} == want
    assert raster.components(mask.limit(0), side).count() == 0


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_block_search_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, [float(np.float32(v)) for v in rng.integers(-3, 4, 8) / 4], i % 3) for i in range(300)] + [(400 + i, [1.0] * 8, None) for i in range(20)] + [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [1.0] * 5, 1)]
    seeds = spark.createDataFrame([(i, data[i][1]) for i in range(0, 300, 7)] + [(900, [1.0] * 8), (901, None), (902, [1.0] * 3)], "query_id long, query array<float>")

    def plain(keep):
        out = []
        for q, x in [(r.query_id, r.query) for r in seeds.collect()]:
            if x is not None and len(x) == 8:
                own = [(-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y, _ in data if y is not None and None not in y and len(y) == 8 and (keep or v != q)]
                out += [(q, v, k + 1) for k, (_, v) in enumerate(sorted(own)[:5])]
        return sorted(out)

    for keep in (False, True):
        assert rows(search.top_k(vectors(spark, data), seeds, 5, keep).select("query_id", "vec_id", "rank")) == sorted(plain(keep), key=repr)
    monkeypatch.setattr(search, "SEED_BYTES", 2000)  # many blocks of seeds
    found = search.top_k(vectors(spark, data), seeds, 5)
    assert rows(found.select("query_id", "vec_id", "rank")) == sorted(plain(False), key=repr)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert search.top_k(vectors(spark, data), seeds.limit(0), 5).count() == 0 and search.top_k(vectors(spark, []), seeds, 5).count() == 0


def test_density_clusters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 32)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (n, 3)) for c, n in ((0, 60), (4, 50), (9, 12))] + [rng.uniform(-20, 20, (20, 3)), np.zeros((8, 3))])
    data = [(i, [float(np.float32(v)) for v in p], 0) for i, p in enumerate(x)]
    k, cut, least = 4, 0.5, 10
    p = np.array([d[1] for d in data])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, k]
    ok = core <= cut
    root = np.arange(len(p))
    for _ in range(len(p)):
        new = np.where((d <= cut) & ok[:, None] & ok[None], root[None], len(p)).min(1)
        root = np.where(ok, np.minimum(root, new), root)
    sizes = {r: ((root == r) & ok).sum() for r in set(root[ok].tolist())}
    order = sorted((r for r, n in sizes.items() if n >= least), key=lambda r: (-sizes[r], r))
    want = {i: order.index(root[i]) if ok[i] and root[i] in order else -1 for i in range(len(p))}
    got = density.density_clusters(vectors(spark, [*data, (999, None, 0), (998, [1.0, None, 0.0], 0)]), k, cut, least).collect()
    assert {r.vec_id: r.cluster for r in got} == want and len(order) >= 2 and -1 in want.values()
    assert all((r.core is None) == (not ok[r.vec_id]) and (r.core is None or abs(r.core - core[r.vec_id]) < 1e-5) for r in got)
    nodes, edges = density.spanning_forest(vectors(spark, data), k, cut)
    assert edges.count() == ok.sum() - len(sizes) and edges.where(F.col("weight") > cut).count() == 0
    assert density.density_clusters(vectors(spark, [])).count() == 0
    monkeypatch.setattr(density, "MOST", 10)
    with pytest.raises(ValueError, match="sample"):
        density.density_clusters(vectors(spark, data))


def test_nearest_centroid_takes_the_smaller_label_on_a_tie(spark):
    centres = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "label int, centre array<double>")
    got = rows(clusters.assign_nearest(vectors(spark, [(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [0.0, 0.0], 0)]), centres, 0.5))
    assert got == [(1, 1, 1.0, 0.0), (2, 3, 2.0, 2.0), (3, -1, 0.0, 0.0)]
    assert rows(clusters.assign_nearest(vectors(spark, [(1, [2.0, 0.0], 0)]), centres.where("label = 2"))) == [(1, 2, 2.0, 2.0)]


def test_adjusted_information_of_small_tables(spark):
    def plain(pairs):
        n = len(pairs)
        count = lambda f: {v: sum(f(p) == v for p in pairs) for v in {f(p) for p in pairs}}
        a, b, c = count(lambda p: p[0]), count(lambda p: p[1]), count(lambda p: p)
        entropy = lambda m: -sum(v / n * math.log(v / n) for v in m.values())
        expected = 0.0
        for x in a.values():
            for y in b.values():
                for k in range(max(1, x + y - n), min(x, y) + 1):
                    expected += k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
        return (entropy(a) + entropy(b) - entropy(c) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)

    rng = random.Random(3)
    for pairs in ([(i % 3, i % 3) for i in range(30)], [(rng.randrange(4), rng.randrange(3)) for _ in range(60)], [(i // 10, (i + 3) // 11) for i in range(70)]):
        got = clusters.adjusted_information(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
        assert got.n == len(pairs) and abs(got.adjusted_information - plain(pairs)) < 1e-9
    assert clusters.adjusted_information(spark.createDataFrame([(1, 1)] * 5, "a int, b int"), "a", "b").first().adjusted_information == 1.0
    big = clusters.expected_information(10**7, np.array([10**7]), 10**9)[0]
    assert 0 < big < 1e-7


def test_numbers_at_any_depth(spark):
    deep = {"view": 5.5}
    for k in range(30):
        deep = {f"l{k}": [1, deep] if k % 2 else deep}
    docs = [(1, json.dumps(deep)), (2, json.dumps({"x": {"View-Angle": 3}, "view": "none"})), (3, "no json"), (4, None), (5, json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}, "meta": {"z": 9}}))]
    df = spark.createDataFrame(docs, "id int, doc string")
    assert rows(listing.first_number(df, "id", "doc", "view")) == [(1, 5.5), (2, 3.0), (3, None), (4, None), (5, None)]
    flat = {(r.id, r.path): r.value for r in reports.flat_numbers(df, "id", "doc").collect()}
    assert flat == {(2, "x.View-Angle"): 3.0, (5, "a.b.c.d.e.f.g"): 1.0}
    assert not [t for t in spark.catalog.listTables() if t.name in ("_level", "_flat")]


def test_persistence_needs_no_list(spark):
    flags = {1: [True], 2: [False], 3: [False, False], 4: [True, False], 5: [True, True], 6: [False, True], 7: [False, True, True]}
    data = [(c, i, f, c != 6) for c, fs in flags.items() for i, f in enumerate(fs)]
    got = dict(rows(change.persistence_classes(spark.createDataFrame(data, "candidate_id int, at int, flag boolean, span boolean"), F.max("span"))))
    assert got == {1: "single_pair", 2: "none", 3: "transient", 4: "persistent", 5: "progressive", 6: "transient", 7: "recent"}


def catalogue(spark):
    held = snapshots.Snapshots(spark, shared_dir(spark, "versions_test"), {"parents": snapshots.Rules("id"), "items": snapshots.Rules("id", ("parent",), {"parent": ("parents", "id")}, {"share is no share": F.col("share").between(0, 1)})})
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    items = spark.createDataFrame([(10, 1, 0.5), (11, 2, None)], "id int, parent int, share double")
    return held, parents, items


def test_a_failing_batch_leaves_no_trace(spark):
    held, parents, items = catalogue(spark)
    assert held.version() == 0 and held.commit(0, {"parents": parents, "items": items}) == 1
    before = held.read("items")
    folders = lambda: sorted(str(f.getPath()) for t in ("items", "parents", "versions") for f in held._fs.listStatus(held._path(f"{held.root}/{t}")))
    there = folders()
    for bad, what in (([(10, 1, 0.5), (10, 1, 0.6)], "twice"), ([(None, 1, 0.5)], "id is missing"), ([(10, None, 0.5)], "parent is missing"), ([(10, 9, 0.5)], "unknown in parents"), ([(10, 1, 1.5)], "no share")):
        with pytest.raises(snapshots.Violation, match=what):
            held.commit(1, {"items": spark.createDataFrame(bad, items.schema)})
    with pytest.raises(snapshots.Violation, match="unknown in parents"):  # a parent goes that an item still has
        held.commit(1, {"parents": parents.limit(1)})
    assert held.version() == 1 and folders() == there and rows(held.read("items")) == rows(items)
    assert held.commit(1, {"items": items.where("id = 10")}) == 2
    assert rows(before) == rows(items) and rows(held.read("items", 1)) == rows(items) and held.read("items").count() == 1


def test_of_two_writers_one_wins(spark):
    held, parents, items = catalogue(spark)
    held.commit(0, {"parents": parents, "items": items})
    results = []

    def write(k):
        try:
            results.append(held.commit(1, {"items": items.where(f"id = {10 + k}")}))
        except snapshots.Conflict:
            results.append("conflict")

    writers = [threading.Thread(target=write, args=(k,)) for k in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(str, results)) == ["2", "conflict"] and held.version() == 2 and held.read("items").count() == 1
