"""Clusters of vectors: assignment to centroids, agreement of labellings, purity, comparison of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratile.functions.columns import inner_product


def unit_centroids(vectors: DataFrame) -> DataFrame:
    """(label, centre): each label's mean vector at unit length."""
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("m"))  # one entry a dimension
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v)) + 1e-9
    return means.select("label", F.transform("m", lambda v: v / norm).alias("centre"))


def assign_nearest(vectors: DataFrame, centroids: DataFrame, least: float | None = None, most_centroids: int = 10000) -> DataFrame:
    """(vec_id, assigned, similarity, margin to the second): the centroid of largest inner product, -1 below ``least``.

    Ties go to the smallest label.  The centroids travel as one row, so no pair
    of rows is formed; more than ``most_centroids`` raise an error.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("all"), F.count("*").alias("k"))
    packed = packed.select(F.when(F.col("k") <= most_centroids, F.col("all")).otherwise(F.raise_error(F.lit("too many centroids for one row"))).alias("all"))
    rows = vectors.crossJoin(F.broadcast(packed))  # packed is one row of a checked length
    # one pass over the centroids keeps the best two; they come by label, so an equal score does not displace
    scored = F.transform("all", lambda c: F.struct(c["label"].alias("label"), inner_product(F.col("embedding"), c["centre"]).alias("s")))
    none = F.lit(None)
    start = F.struct(none.cast(centroids.schema["label"].dataType).alias("label"), none.cast("double").alias("best"), none.cast("double").alias("second"))

    def fold(acc: Column, c: Column) -> Column:
        better = acc["best"].isNull() | (c["s"] > acc["best"])
        second = F.when(better, acc["best"]).otherwise(F.greatest(acc["second"], c["s"]))
        return F.struct(F.when(better, c["label"]).otherwise(acc["label"]).alias("label"), F.when(better, c["s"]).otherwise(acc["best"]).alias("best"), second.alias("second"))

    near = rows.select("vec_id", F.aggregate(scored, start, fold).alias("n")).select("vec_id", "n.*")
    best, second = F.col("best"), F.coalesce("second", F.lit(0.0))
    label = F.col("label") if least is None else F.when(best < least, F.lit(-1)).otherwise(F.col("label"))
    return near.select("vec_id", label.alias("assigned"), best.alias("similarity"), (best - second).alias("margin"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, adjusted Rand index, homogeneity, completeness and V measure of two labellings, from their contingency counts."""
    cells = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("l"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("l"))
    one = whole.crossJoin(side(a).toDF("pa", "la")).crossJoin(side(b).toDF("pb", "lb"))  # one row each
    n = F.col("n")
    chance = F.col("pa") * F.col("pb") / _pairs(n)
    most = (F.col("pa") + F.col("pb")) / 2
    entropy = {c: F.ln(n) - F.col(f"l{c}") / n for c in "ab"}
    joint = F.ln(n) - F.col("l") / n
    share = lambda own, other: F.when(own <= 1e-12, 1.0).otherwise(1.0 - (joint - other) / own)
    out = one.select(
        n.cast("long").alias("n"), F.when(most == chance, 1.0).otherwise((F.col("p") - chance) / (most - chance)).alias("adjusted_rand"),
        share(entropy["a"], entropy["b"]).alias("homogeneity"), share(entropy["b"], entropy["a"]).alias("completeness"),
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    return out.withColumn("v_measure", F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0))


def expected_information(a: int, sizes: np.ndarray, total: int) -> np.ndarray:
    """For a cluster of ``a`` members and each of the other labelling's ``sizes``: the expected part of the mutual information by chance.

    The chances of the possible overlaps (hypergeometric) follow from one
    another; those beyond 40 deviations are below the precision of doubles.
    """
    out = np.zeros(len(sizes))
    for i, b in enumerate(sizes.tolist()):
        mean = a * b / total
        spread = 40 * (np.sqrt(mean * (1 - a / total) * (1 - b / total)) + 1)
        low, high = max(0, a + b - total, int(mean - spread)), min(a, b, int(mean + spread) + 1)
        n = np.arange(low, high + 1, dtype=float)
        step = np.log((a - n[:-1]) * (b - n[:-1])) - np.log((n[1:]) * (total - a - b + n[1:]))
        logs = np.concatenate([[0.0], np.cumsum(step)])
        weight = np.exp(logs - logs.max())
        part = np.where(n > 0, n / total * np.log(np.maximum(n, 1) * total / (a * b)), 0.0)
        out[i] = (weight * part).sum() / weight.sum()
    return out


def adjusted_information(rows: DataFrame, a: str, b: str, most: int = 100_000) -> DataFrame:
    """One row: adjusted mutual information of two labellings (mean of the entropies), 1 if both are constant.

    Only the distinct sizes of clusters and how often each occurs are needed:
    those of ``b`` go to every task (more than ``most`` raise an error), those
    of ``a`` are dealt over tasks.
    """
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    other = side(b).limit(most + 1).collect()
    if len(other) > most:
        raise ValueError(f"more than {most} different cluster sizes")
    sizes, often = np.array([r.n for r in other], np.int64), np.array([r.k for r in other], float)
    total = int((sizes * often).sum())

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"e": [float(k * (often * expected_information(n, sizes, total)).sum()) for n, k in zip(part["n"].tolist(), part["k"].tolist(), strict=True)]})

    chance = side(a).mapInPandas(expect, "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"))
    entropy = lambda df, weight: df.agg((F.ln(F.lit(float(max(total, 1)))) - F.sum(weight * F.col("n") * F.ln("n")) / max(total, 1)).alias("h"))
    one = entropy(side(a), F.col("k")).toDF("ha").crossJoin(entropy(side(b), F.col("k")).toDF("hb")).crossJoin(entropy(cells, F.lit(1)).toDF("hj")).crossJoin(chance)  # one row each
    information, mean = F.col("ha") + F.col("hb") - F.col("hj"), (F.col("ha") + F.col("hb")) / 2
    below = mean - F.col("e")
    return one.select(F.lit(total).cast("long").alias("n"), F.when((F.col("ha") <= 1e-12) & (F.col("hb") <= 1e-12), 1.0).otherwise((information - F.col("e")) / F.when(F.abs(below) > 1e-15, below).otherwise(1e-15)).alias("adjusted_information"))


def abstention_sweep(rows: DataFrame, reference: str, assigned: str, similarity: str, thresholds: list[float]) -> DataFrame:
    """Per threshold the agreement with ``reference`` of labels that become -1 where the similarity is below it: share of -1, adjusted Rand index, V measure, adjusted information."""
    out = None
    for tau in thresholds:
        label = F.when(F.col(similarity) < tau, F.lit(-1)).otherwise(F.col(assigned))
        cut = rows.select(F.col(reference).alias("a"), label.alias("b"))
        noise = cut.agg(F.avg((F.col("b") == -1).cast("double")).alias("noise_share"))
        both = agreement(cut, "a", "b").select("adjusted_rand", "v_measure").crossJoin(adjusted_information(cut, "a", "b").select("adjusted_information")).crossJoin(noise)  # one row each
        one = both.select(F.lit(tau).alias("threshold"), "noise_share", "adjusted_rand", "v_measure", "adjusted_information")
        out = one if out is None else out.union(one)
    return out


def purity(rows: DataFrame, cluster: str, region: str) -> DataFrame:
    """Per cluster: size, the region with most members (first by name on a tie) and its share, 4 digits."""
    counts = rows.groupBy(cluster, region).agg(F.count("*").alias("m"))
    out = counts.groupBy(cluster).agg(F.sum("m").alias("size"), F.min_by(F.struct(region, "m"), F.struct(-F.col("m"), F.col(region))).alias("top"), F.count("*").alias("n_regions"))
    return out.select(cluster, "size", F.col(f"top.{region}").alias("dominant"), F.round(F.col("top.m") / F.col("size"), 4).alias("purity"), "n_regions")


def compare_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row over vectors of both tables: count, share of identical ones, largest and mean absolute difference, least and mean cosine."""
    both = old.select("vec_id", F.col("embedding").alias("u")).join(new.select("vec_id", F.col("embedding").alias("v")), "vec_id")
    gaps = F.zip_with("u", "v", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    norm = lambda c: F.sqrt(inner_product(F.col(c), F.col(c)))
    rows = both.select(
        (F.col("u") == F.col("v")).cast("double").alias("same"), F.array_max(gaps).alias("most"), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.size("u").alias("dim"), (inner_product(F.col("u"), F.col("v")) / (norm("u") * norm("v"))).alias("cosine"),
    )
    return rows.agg(
        F.count("*").alias("n"), F.avg("same").alias("identical"), F.max("most").alias("max_diff"), (F.sum("total") / F.sum("dim")).alias("mean_diff"),
        F.min("cosine").alias("min_cosine"), F.avg("cosine").alias("mean_cosine"),
    )


def observation_clusters(assigned: DataFrame, tiles: DataFrame) -> DataFrame:
    """(observation_id, cluster, n, share): how the embedded tiles (tile_id, observation_id, vec_id) of an observation fall over clusters (vec_id, cluster); tiles without one are left out."""
    counts = tiles.where("vec_id IS NOT NULL").join(assigned, "vec_id").groupBy("observation_id", "cluster").agg(F.count("*").alias("n"))
    whole = counts.groupBy("observation_id").agg(F.sum("n").alias("all"))
    return counts.join(whole, "observation_id").select("observation_id", "cluster", "n", (F.col("n") / F.col("all")).alias("share"))
