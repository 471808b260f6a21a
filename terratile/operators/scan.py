"""Running totals and positions over a whole table, without one task that holds a group.

A range partition puts the rows in order over many tasks; each task counts
its own part, and the parts before it, summed per part, are added.  The table
of parts has a row for each partition (and group in it), never one for a row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.storage import broadcast_if_small, stage_table

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def parted(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the number of the range in ``_part``; written, so that the ranges stay."""
    return stage_table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima (row itself included) within each group along ``order``.

    ``order`` should end in a unique key; rows that tie in it are taken in any order.
    Null values add nothing.
    """
    folds = {k: (F.sum, v) for k, v in (sums or {}).items()} | {k: (F.max, v) for k, v in (maxima or {}).items()}
    staged = parted(rows, [*map(F.col, group), *order])
    parts = staged.groupBy(*group, "_part").agg(*[f(v).alias(f"_{k}") for k, (f, v) in folds.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(*BEFORE)
    parts = parts.select(*group, "_part", *[f(f"_{k}").over(earlier).alias(f"_{k}") for k, (f, _) in folds.items()])
    here = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(*SO_FAR)
    local = staged.withColumns({k: f(v).over(here) for k, (f, v) in folds.items()})
    names = [*group, "_part"]
    parts = parts.withColumnsRenamed({c: f"_of_{c}" for c in names})
    both = local.join(parts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])).drop(*[f"_of_{c}" for c in names])
    out = {k: (F.coalesce(k, F.lit(0)) + F.coalesce(f"_{k}", F.lit(0))) if k in (sums or {}) else F.greatest(k, f"_{k}") for k in folds}
    return both.withColumns(out).drop("_part", *[f"_{k}" for k in folds])


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1..n along ``order``, which should end in a unique key."""
    return running(rows, [], order, {name: F.lit(1)})


def shard_digests(rows: DataFrame, order: list[Column], text: Column, size: int) -> DataFrame:
    """Shards of ``size`` rows along ``order``: (shard, n_rows, sha256 of the rows' texts joined by newlines)."""
    placed = positions(rows.select(*rows.columns, text.alias("_text")), order, "_at")
    shards = placed.groupBy(F.floor((F.col("_at") - 1) / size).alias("shard")).agg(
        F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("r")  # at most size rows
    )
    return shards.select("shard", "n_rows", F.sha2(F.array_join(F.transform("r", lambda x: x["_text"]), "\n"), 256).alias("sha256"))


def fingerprint(rows: DataFrame, order: list[Column], text: Column, size: int = 1000, levels: int = 3) -> DataFrame:
    """One row: row count and a digest of digests over shards in order, ``levels`` times and on until one shard is left."""
    total = rows.agg(F.count("*").alias("n_rows"))
    left = rows.count()
    while levels > 0 or left > 1:
        rows = shard_digests(rows, order, text, size).select("shard", "sha256")
        rows = stage_table(rows, "digests")
        order, text, left, levels = [F.col("shard")], F.col("sha256"), -(-left // size), levels - 1
    return total.crossJoin(rows.select("sha256"))  # one row each


BINS, FEW = 4096, 4096


def selected(rows: DataFrame, group: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(group, name, found): for each wanted rank (group, name, rank; from 1) the value that stands there in the group's order.

    No sort: the values between the least and largest that are possible are
    counted in ``BINS`` equal ranges, summed before they are shuffled; the range
    that holds a rank is looked at closer in the next round.  Where few are left
    they are put in order at once.  Each round reads ``rows`` anew and writes a
    row for each wanted rank.
    """
    known = _known(rows, group, value)
    ends = known.groupBy(*group).agg(*_ends()).withColumnsRenamed({c: f"_of_{c}" for c in group})
    todo = ranks.join(ends, _same(group)).select(*group, "name", "rank", "_n", "_low", "_high") if group else ranks.crossJoin(F.broadcast(ends))  # one row
    return _looked_up(known, group, stage_table(todo, "ranks_wanted"))


def _ends() -> list[Column]:
    return [F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]


def _known(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("_v"))


def _same(group: list[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], F.lit(True))


def _looked_up(known: DataFrame, group: list[str], todo: DataFrame) -> DataFrame:
    """The rounds of ``selected``, from wanted ranks (group, name, rank) among the ``_n`` values from ``_low`` to ``_high``; ``todo`` is written."""
    names, same = {c: f"_of_{c}" for c in group}, _same(group)
    span = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for c, o in {**names, "_low": "_l", "_high": "_h"}.items()])
    exact = F.when(F.col("rank") <= 1, F.col("_low")).when(F.col("rank") >= F.col("_n"), F.col("_high")).when(F.col("_low") == F.col("_high"), F.col("_low"))
    done = []
    while True:
        done.append(todo.withColumn("found", exact).where("found IS NOT NULL").select(*group, "name", "found"))
        todo = todo.where(exact.isNull())
        most = todo.agg(F.max("_n")).first()[0]
        if most is None:
            return reduce(DataFrame.union, done)
        spans = todo.select(*group, "_n", "_low", "_high").distinct()
        met = known.join(broadcast_if_small(spans.withColumnsRenamed(names), 64), same & F.col("_v").between(F.col("_low"), F.col("_high")))
        by = [*names.values(), "_low", "_high"]
        short = met.where(F.col("_n") <= FEW).groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("all"))  # FEW values at most
        ordered = todo.join(short.withColumnsRenamed({"_low": "_l", "_high": "_h"}), span).select(*group, "name", F.get("all", (F.col("rank") - 1).cast("int")).alias("found"))
        if most <= FEW:
            return reduce(DataFrame.union, [*done, ordered])
        done.append(stage_table(ordered, "ranks_found"))
        width = (F.col("_high") - F.col("_low")) / BINS
        bin_ = F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(BINS - 1))
        counts = met.where(F.col("_n") > FEW).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        counts = counts.withColumn("so_far", F.sum("m").over(Window.partitionBy(*by).orderBy("bin")))  # BINS rows a span
        holds = (F.col("rank") <= F.col("so_far")) & (F.col("rank") > F.col("so_far") - F.col("m"))
        closer = todo.join(counts.withColumnsRenamed({"_low": "_l", "_high": "_h"}), span & holds)
        closer = closer.select(*group, "name", (F.col("rank") - F.col("so_far") + F.col("m")).alias("rank"), F.col("m").alias("_n"), F.col("least").alias("_low"), F.col("most").alias("_high"))
        todo = stage_table(closer, "ranks_wanted")


def quantiles(rows: DataFrame, group: list[str], value: str, cuts: dict[str, float]) -> DataFrame:
    """Per group the quantiles of a value, linear between neighbours, by counting (``selected``): no task holds a group.  Nulls and NaN are left out."""
    known = _known(rows, group, value)
    sizes = stage_table(known.groupBy(*group).agg(*_ends()), "group_sizes")
    spots = F.explode(F.array(*[F.struct(F.lit(f"{name}_{side}").alias("name"), f((F.col("_n") - 1) * q + 1).cast("long").alias("rank")) for name, q in cuts.items() for side, f in (("low", F.floor), ("high", F.ceil))]))
    wanted = sizes.where("_n > 0").select("*", spots.alias("s")).select(*group, "s.*", "_n", "_low", "_high")
    found = _looked_up(known, group, wanted)
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == f"{name}_{side}", F.col("found"))).alias(f"_{name}_{side}") for name in cuts for side in ("low", "high")])
    if group:
        out = sizes.join(wide.withColumnsRenamed({c: f"_of_{c}" for c in group}), _same(group), "left")
    else:
        out = sizes.crossJoin(F.broadcast(wide))  # one row each
    at = {name: (F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q) for name, q in cuts.items()}
    out = out.select(*group, *[(F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * at[name]).alias(name) for name in cuts])
    return stage_table(out, "quantiles")  # a row a group, that callers may use more than once
