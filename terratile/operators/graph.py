"""Connected components of an edge table by repeated contraction.

Each round every node points to the neighbour (or itself) that comes first in
a hashed order, edges are rewritten to the nodes pointed to, and loops and
repeats go.  In a random order a constant share of nodes vanishes per round, so
the number of rounds is logarithmic, also on long chains; a hub with very many
neighbours costs one ``min`` with a partial aggregate, never a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratile.storage import stage_table


def _ordered(name: str):
    return F.struct(F.xxhash64(F.col(name)).alias("h"), F.col(name).alias("n"))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): one row for each node of an edge.

    ``root`` is some node of the component, the same for all its nodes.  Null
    ends and loops link nothing; repeated edges count once; no edges, no rows.
    """
    edges = stage_table(_plain(edges.select("a", "b").dropna()), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        first = both.groupBy("node").agg(F.min(_ordered("other")).alias("m"))
        to = stage_table(first.select("node", F.least("m", _ordered("node"))["n"].alias("root")), "hooks")
        maps.append(to)
        moved = (
            edges.join(to.toDF("a", "ra"), "a")
            .join(to.toDF("b", "rb"), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
        edges = stage_table(_plain(moved), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def then(later: DataFrame, earlier: DataFrame) -> DataFrame:
        ends = later.toDF("root", "end")
        return earlier.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root"))

    return reduce(then, reversed(maps[:-1]), maps[-1])
