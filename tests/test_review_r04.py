"""Findings of the fourth review: what is matched goes out by members, told matches are kept by kind, a hundred replicates."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terratile.operators import listing, rings, scoring, watch
from terratile.streaming import logs

BOX = "west double, south double, east double, north double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def watched(spark):
    """400 watches of 10 kinds that all have all of 300 candidates, as two tables."""
    watches = spark.createDataFrame([(i, 0.0, 0.0, 10.0, 10.0, i % 10 / 20, True) for i in range(400)], f"watch_id long, {BOX}, min_confidence double, active boolean")
    found = spark.createDataFrame([(k, 1 + k / 100, 1.0, 0.9) for k in range(300)], "candidate_id long, lon double, lat double, confidence double")
    return watches, found


def ringed(spark):
    """400 rings of 10 shapes about all of 300 points, open and closed, and the points."""
    corners = lambda i: [(0.0, 0.0), (9.0 + i % 10, 0.0), (9.0 + i % 10, 9.0), (0.0, 9.0)]
    kind = "ring_id long, ring array<struct<x:double,y:double>>"
    points = spark.createDataFrame([(k, 1 + k / 100, 1.0) for k in range(300)], "point_id long, lon double, lat double")
    return spark.createDataFrame([(i, corners(i)) for i in range(400)], kind), spark.createDataFrame([(i, [*corners(i), corners(i)[0]]) for i in range(400)], kind), points


def turns(df, key):
    """How often the kind changes along the rows."""
    out = [r[key] % 10 for r in df.collect()]
    return sum(a != b for a, b in zip(out, out[1:], strict=False))


@pytest.mark.parametrize("name", ["watch_matches", "point_relation", "nearest_rings"])
def test_members_of_a_kind_follow_one_another(spark, name):
    if name == "watch_matches":
        df, key = watch.watch_matches(*watched(spark)), "watch_id"
    else:
        open_, closed, points = ringed(spark)
        df, key = (listing.point_relation(points, closed) if name == "point_relation" else rings.nearest_rings(points, open_, 1000.0)), "ring_id"
    assert df.count() == df.select(*df.columns[:2]).distinct().count() == 400 * 300
    assert turns(df, key) < 300  # kinds times tasks, not kinds times candidates


def test_what_is_matched_is_not_shuffled(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, found = watched(spark)
        for watches in (few, few.where("watch_id < 20")):  # many members a kind, and few
            assert "SortMergeJoin" not in plan(watch.watch_matches(watches, found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_members_too_many_for_a_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(watch, "BROADCAST_BYTES", 1000)
    df = watch.watch_matches(*watched(spark))
    assert "SortMergeJoin" in plan(df)
    assert df.count() == df.distinct().count() == 400 * 300


def test_replicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 16)
    monkeypatch.setattr(scoring, "AT_ONCE", 40)
    rng = random.Random(6)
    data = [(d, rng.randint(0, 30), rng.choice([None, 0, 1, 2]), rng.randint(0, 15) / 15, rng.choice([True, False, None])) for d in range(300)] + [(1000, 1, 3, 0.5, False)]
    df = spark.createDataFrame(data, "det_id long, image_id long, class_id int, score double, hit boolean")
    drawn = {(r.image_id, r.replicate): r.weight for r in scoring.replicates(df.select("image_id").distinct(), "image_id", 100).collect()}
    want = {}
    for c in (None, 0, 1, 2, 3):
        for k in range(100):
            rows = sorted(((-s, d, bool(h), w) for d, i, cl, s, h in data if cl == c and (w := drawn.get((i, k), 0))), key=lambda r: r[:2])
            p = [sum(h * w for _, _, h, w in rows[: j + 1]) / sum(w for *_, w in rows[: j + 1]) for j in range(len(rows))]
            if total := sum(h * w for _, _, h, w in rows):
                want.setdefault(c, []).append(sum(max(p[j:]) * w / total for j, (_, _, h, w) in enumerate(rows) if h))
    got = {r.class_id: r for r in scoring.resampled_ap(df, 100).collect()}
    assert got.keys() == want.keys() == {None, 0, 1, 2}
    for c, aps in want.items():
        aps.sort()
        at = lambda q, a=aps: a[int(q * (len(a) - 1))] + (q * (len(a) - 1) % 1) * (a[min(int(q * (len(a) - 1)) + 1, len(a) - 1)] - a[int(q * (len(a) - 1))])
        assert got[c].n_replicates == len(aps) and math.isclose(got[c].low, at(0.025)) and math.isclose(got[c].high, at(0.975))


def test_intervals_of_a_hundred_replicates(spark):
    assert {r.n_replicates for r in entry.queries()["l17_resampled_ap"](spark, "/root/testdata/sf0.001").collect()} == {100}


def test_told_matches_are_kept_by_kind(spark, tmp_path):
    few, found = watched(spark)
    source, folder, spot = (str(tmp_path / n) for n in ("in", "told", "spot"))
    found.write.parquet(source)

    def run(watches):
        return {tuple(r) for r in logs.watch_once(spark.readStream.schema(found.schema).parquet(source), watches, folder, spot).collect()}

    assert run(few) == {(i, k) for i in range(400) for k in range(300)}
    kept = spark.read.option("recursiveFileLookup", "true").parquet(folder, f"{folder}.kinds").count()
    assert kept == 10 * 300  # not 400 * 300
    # candidate 7 again and a new one, with other watches: what was told before stays told, and is not told again
    spark.createDataFrame([(7, 1.0, 1.0, 0.9), (900, 1.0, 1.0, 0.9)], found.schema).write.mode("append").parquet(source)
    other = few.where("watch_id % 10 > 0").union(few.where("watch_id = 0").withColumn("watch_id", F.lit(1000).cast("long")))
    ids = {i for i in range(400) if i % 10} | {1000}
    assert run(other) == {(i, k) for i in range(400) for k in range(300)} | {(1000, 7)} | {(i, 900) for i in ids}
    assert spark.read.parquet(f"{folder}/part=1").count() == 1


def test_a_run_after_a_run_tells_what_changed(spark):
    few, found = watched(spark)
    before = found.where("candidate_id < 200").union(spark.createDataFrame([(299, 1.0, 1.0, 0.12), (298, 50.0, 1.0, 0.9), (297, None, 1.0, 0.9)], found.schema))
    now = found.union(spark.createDataFrame([(5, 2.0, 2.0, 0.9), (600, None, 1.0, 0.9)], found.schema))
    observed = F.col("candidate_id") % 4
    told = watch.watch_matches(few, before.where("candidate_id <> 299 OR confidence < 0.5"))
    want = {tuple(r) for r in watch.watch_matches(few, now).join(told, ["watch_id", "candidate_id"], "left_anti").distinct().collect()}
    got = [tuple(r) for r in watch.notices_after_run(few, now, before, observed).collect()]
    assert len(got) == len(set(got)) and {(w, c) for w, o, c in got if o == c % 4} == want
    assert sum(c == 299 for _, c in want) == 400 - 3 * 40 and not any(c < 200 for _, c in want)
