"""Small cases of the third part of the third review."""

import numpy as np
import pytest

from terratile.operators import density


def _table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")


def _shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def _forest_weights(w, cut):
    """Weights of the edges of a minimum spanning forest below ``cut``, one edge after the other."""
    root, out = np.arange(len(w)), []
    for a, b in sorted(zip(*np.nonzero(np.triu(w <= cut, 1)), strict=True), key=lambda e: w[e]):
        if root[a] != root[b]:
            root[root == root[a]] = root[b]
            out.append(w[a, b])
    return out, root


@pytest.mark.parametrize("width", [3, 12])
def test_density_forest_against_all_edges(spark, monkeypatch, width):
    monkeypatch.setattr(density, "BLOCK", 16)
    rng = np.random.default_rng(width)
    # a dense and a thin cloud that touch, two more apart, single vectors, and copies over several blocks
    clouds = [rng.normal(c, s, (n, width)) for c, s, n in ((0, 0.05, 150), (0.4, 0.3, 120), (5, 0.1, 60), (-5, 0.3, 40))]
    x = np.concatenate([*clouds, rng.uniform(-9, 9, (15, width)), np.full((70, width), 0.1), np.full((30, width), 5.0)])
    x = x[rng.permutation(len(x))]
    k, cut, least = 4, 0.3 * np.sqrt(width), 20
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, k]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    want, root = _forest_weights(w, cut)
    nodes, edges = density.spanning_forest(_table(spark, x), k, cut)
    got_core = {r.vec_id: r.core for r in nodes.collect()}
    assert sorted(got_core) == list(range(len(x)))
    assert all((got_core[i] is None) == (c > cut) and (c > cut or abs(got_core[i] - c) < 1e-7) for i, c in enumerate(core))
    assert np.allclose(sorted(r.weight for r in edges.collect()), sorted(want), atol=1e-7) and 0.0 in want and max(want) > 0.8 * cut
    sizes = {r: (root[core <= cut] == r).sum() for r in set(root[core <= cut].tolist())}
    order = sorted((r for r in sizes if sizes[r] >= least), key=lambda r: (-sizes[r], np.flatnonzero(root == r).min()))
    got = {r.vec_id: r.cluster for r in density.density_clusters(_table(spark, x), k, cut, least).collect()}
    assert got == {i: order.index(root[i]) if core[i] <= cut and root[i] in order else -1 for i in range(len(x))} and len(order) >= 2


def test_density_clusters_do_not_meet_all_blocks_within_the_cut(spark):
    """40 blocks of one cloud, all of them within the cut of each other: before, each round sent all pairs."""
    x = np.random.default_rng(1).uniform(0, 1, (40_000, 3))
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    began = _shuffled(spark)
    got = density.density_clusters(table, 5, 0.5, 8).select("cluster").distinct().collect()
    assert [r.cluster for r in got] == [0]
    assert _shuffled(spark) - began < 100 * 40_000 * 32, "vectors take 32 bytes each with their numbers"
