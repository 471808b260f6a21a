"""What an analyst reads: briefs, picks, archives, funnels and timelines of change candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratile.functions.columns import haversine
from terratile.operators.catalog import consecutive_pairs
from terratile.storage import stage_table

PX_M2 = 100.0
#: Persistence classes that later looks support (fixed values).
PERSISTING = ["persistent", "progressive", "recent"]


def sector_brief(rows: DataFrame) -> DataFrame:
    """Per change type: count, area in square metres (1 digit) and hectares (2 digits)."""
    out = rows.groupBy("change_type").agg(F.count("*").alias("n"), F.round(F.sum("area_px") * PX_M2, 1).alias("area_m2"))
    return out.withColumn("area_ha", F.round(F.col("area_m2") / 10000.0, 2))


def summary(candidates: DataFrame, zones: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: candidates, those of high confidence, those in a zone, and the share with a decision in force."""
    marked = candidates.join(zones, "candidate_id", "left").join(
        decided.where("status <> 'undecided'").select("candidate_id", F.lit(1).alias("reviewed")), "candidate_id", "left"
    )
    n, seen = F.count("*"), F.count("reviewed")
    return marked.agg(
        n.alias("n"), F.count_if(F.col("confidence") >= 0.85).alias("n_high"), F.count_if(F.col("zone") != "outside").alias("n_zone"),
        F.count("reviewed").alias("n_reviewed"), F.when(n > 0, F.round(100.0 * seen / n, 4)).alias("review_rate"),
    )


def diverse_picks(ranked: DataFrame, n: int = 10, per_type: int = 3, apart_m: float = 1500.0) -> DataFrame:
    """(candidate_id, change_type, score, place): at most ``per_type`` of a type, those ``apart_m`` apart, then the best of the rest up to n.

    Types do not hinder one another, so each round takes the best row of every
    type at once and drops its neighbours: ``per_type`` partially aggregated passes.
    Ties in score go to the smallest id.
    """
    best = lambda: F.max_by(F.struct("candidate_id", "change_type", "score", "lon", "lat"), F.struct("score", -F.col("candidate_id")))
    left, picks = ranked, []
    for _ in range(per_type):
        pick = stage_table(left.groupBy("change_type").agg(best().alias("b")).select("b.*"), "picks")  # one row a type
        picks.append(pick)
        far = haversine(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")) >= apart_m
        near = pick.select("change_type", F.col("candidate_id").alias("pid"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
        left = left.join(near, "change_type").where(far & (F.col("candidate_id") != F.col("pid"))).select(ranked.columns)
    chosen = reduce(DataFrame.union, picks).orderBy(F.desc("score"), "candidate_id").limit(n)
    rest = ranked.join(chosen.select("candidate_id"), "candidate_id", "left_anti").orderBy(F.desc("score"), "candidate_id").limit(n)
    both = chosen.select("candidate_id", "change_type", "score", F.lit(0).alias("filled")).union(rest.select("candidate_id", "change_type", "score", F.lit(1)))
    return both.orderBy("filled", F.desc("score"), "candidate_id").limit(n)


def featured(ranked: DataFrame, n: int = 4, least: float = 0.60) -> DataFrame:
    """The best of each type first, then the best of all, of candidates with at least that confidence."""
    rows = ranked.where(F.col("confidence") >= least)
    key = F.struct("score", -F.col("candidate_id"))
    tops = rows.groupBy("change_type").agg(F.max_by(F.struct("candidate_id", "score"), key).alias("t")).select("change_type", "t.*", F.lit(0).alias("filled"))
    marked = rows.join(tops, ["candidate_id", "change_type", "score"], "left")
    marked = marked.withColumn("filled", F.coalesce("filled", F.lit(1)))
    return marked.orderBy("filled", F.desc("score"), "candidate_id").limit(n).select("candidate_id", "change_type", "score", "filled")


def interval_archive(candidates: DataFrame, dates: DataFrame) -> DataFrame:
    """Candidates (first_from, first_to, area_px, persistence, sar) by the interval that first shows them.

    Buckets: every interval between neighbouring ``dates`` (zero filled), wider
    brackets apart (``multi``), and one row for candidates without a bracket (``none``).
    """
    days = dates.select("acquired_at").distinct().select(F.lit(0).alias("place"), "acquired_at", F.lit(0).alias("observation_id"))  # as many rows as dates
    steps = consecutive_pairs(days).select(F.col("earlier_at").alias("first_from"), F.col("later_at").alias("first_to"), F.lit(True).alias("step"))
    found = candidates.groupBy("first_from", "first_to").agg(
        F.count("*").alias("n"), F.round(F.sum("area_px") * PX_M2, 1).alias("area_m2"),
        F.count_if(F.col("persistence").isin(*PERSISTING)).alias("n_held"), F.count_if("sar").alias("n_sar"),
    )
    both = found.join(steps, ["first_from", "first_to"], "full")
    kind = F.when(F.col("step"), "interval").when(F.col("first_from").isNull(), "none").otherwise("multi")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_held", "n_sar")} | {"area_m2": F.coalesce("area_m2", F.lit(0.0))}
    return both.withColumn("bucket", kind).withColumns(zero).withColumn("days", F.datediff("first_to", "first_from")).drop("step")


def funnel(counts: DataFrame, gates: tuple = ("morphology", "quality", "registration", "radiometric", "phenology")) -> DataFrame:
    """Long form of suppression counts (pair_id, raw, one column a gate): removed, left over and share, gate by gate."""
    zero = F.lit(0).cast("long")
    removed = [F.col(g) if g in counts.columns else zero for g in gates]
    steps = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(g).alias("gate"), removed[i].alias("removed"), (F.col("raw") - reduce(Column.__add__, removed[: i + 1])).alias("remaining"))
        for i, g in enumerate(gates)
    ]
    rows = counts.select("pair_id", "raw", F.explode(F.array(*steps)).alias("s")).select("pair_id", "raw", "s.*")
    return rows.select("pair_id", "step", "gate", "removed", "remaining", F.when(F.col("raw") > 0, F.round(F.col("removed") / F.col("raw"), 4)).otherwise(0.0).alias("share"))


def earliest_supported(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per place the first changed pair of neighbours, else the changed span, else none.

    ``pairs`` and ``spans``: place, earlier, later, earlier_at, later_at, changed.
    """
    window = F.struct("earlier", "later", "earlier_at", "later_at")
    first = pairs.groupBy("place").agg(F.min_by(F.when(F.col("changed"), window), F.when(F.col("changed"), F.struct("later_at", "later"))).alias("p"))
    both = first.join(spans.select("place", F.when(F.col("changed"), window).alias("s")), "place", "full")
    source = F.when(F.col("p").isNotNull(), "pair").when(F.col("s").isNotNull(), "span").otherwise("none")
    return both.select("place", source.alias("source"), F.coalesce("p", "s").alias("w")).select("place", "source", "w.*")


def timeline(dates: DataFrame, onsets: DataFrame) -> DataFrame:
    """Role of each (place, acquired_at): baseline, no_change_seen, before_detection, first_detected, supported or not_supported.

    ``onsets``: place, onset (null: no change seen), persistence.
    """
    first = dates.groupBy("place").agg(F.min("acquired_at").alias("start"))
    rows = dates.select("place", "acquired_at").distinct().join(first, "place").join(onsets, "place", "left")
    at = F.col("acquired_at")
    role = (
        F.when(at == F.col("start"), "baseline").when(F.col("onset").isNull(), "no_change_seen").when(at < F.col("onset"), "before_detection")
        .when(at == F.col("onset"), "first_detected").when(F.col("persistence").isin(*PERSISTING), "supported").otherwise("not_supported")
    )
    return rows.select("place", "acquired_at", role.alias("role"))


def comparability(pairs: DataFrame, min_overlap: float = 0.30, min_days: int = 5, max_cloud: float = 0.20, max_shift: float = 0.5) -> DataFrame:
    """Pairs with the seven criteria; overlap, collection and ground resolution block, the others only warn.

    Columns read: a_ and b_ forms of west, south, east, north, acquired_at,
    sensor, collection_id, gsd_m, mean_cloud, shift_px and reference.
    """
    a, b = (lambda c, s=s: F.col(f"{s}_{c}") for s in "ab")
    side = lambda low, high: F.greatest(F.least(a(high), b(high)) - F.greatest(a(low), b(low)), F.lit(0.0))
    area = lambda t: (t("east") - t("west")) * (t("north") - t("south"))
    smaller = F.least(area(a), area(b))
    overlap = side("west", "east") * side("south", "north") / F.when(smaller > 0, smaller).otherwise(1.0)
    days = F.abs(F.datediff(b("acquired_at"), a("acquired_at")))
    criteria = {
        "overlap_ok": overlap >= min_overlap, "days_ok": days >= min_days, "sensor_ok": a("sensor") == b("sensor"), "collection_ok": a("collection_id") == b("collection_id"),
        "gsd_ok": a("gsd_m") == b("gsd_m"), "cloud_ok": (a("mean_cloud") <= max_cloud) & (b("mean_cloud") <= max_cloud),
        "shift_ok": (a("reference") == b("reference")) & (a("shift_px") + b("shift_px") <= max_shift),
    }
    out = pairs.withColumn("overlap", F.round(overlap, 4)).withColumn("days", days).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in criteria.items()})
    return out.withColumn("comparable", F.col("overlap_ok") & F.col("collection_ok") & F.col("gsd_ok"))
