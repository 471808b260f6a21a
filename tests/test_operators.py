"""Small cases: nulls, empty tables, ties, repeats, round trips and errors."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terratile.operators import catalog, clusters, evaluation, places, raster, review, scan, search, stencil
from terratile.sources import features
from terratile.storage import shared_dir


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_equals_a_plain_fold(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.randrange(5), i, rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, k int, id int, v int")
    got = {r["id"]: (r["s"], r["m"]) for r in scan.running(df, ["g"], [F.col("k"), F.col("id")], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    for g in "abc":
        total, most = 0, None
        for _, _, i, v in sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])):
            total, most = total + (v or 0), v if most is None else max(most, v or most)
            assert got[i] == (total, most)


def test_positions_and_shards_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id int, t string")
    assert scan.positions(none, [F.col("id")], "n").count() == 0
    assert scan.shard_digests(none, [F.col("id")], F.col("t"), 10).count() == 0


def test_first_zone_of_ties_borders_and_nulls(spark):
    zones = spark.createDataFrame([("b", 0.0, 0.0, 20.0, 20.0), ("a", 20.0, 0.0, 30.0, 20.0)], "zone string, west double, south double, east double, north double")
    points = spark.createDataFrame([(1, 20.0, 5.0), (2, 5.0, 20.0), (3, 31.0, 5.0), (4, None, 5.0)], "id int, lon double, lat double")
    assert rows(places.first_zone(points, zones, "id")) == [(1, "a"), (2, "b"), (3, "outside"), (4, "outside")]
    assert rows(places.first_zone(points, zones.limit(0), "id")) == [(i, "outside") for i in (1, 2, 3, 4)]


def test_region_names(spark):
    names = [("north_43RGP_diverse",), ("south_44RPQ_scaled_82km",), ("43RGP",), ("",), (None,)]
    df = spark.createDataFrame(names, "n string")
    got = [tuple(r) for r in df.select(places.region_key(F.col("n")), places.region_tokens(F.col("n"))).collect()]
    assert got == [("north", "north"), ("south", "south"), ("43RGP", "43RGP"), ("unknown", "unknown"), ("unknown", "unknown")]


def test_rings_hold_a_point_on_the_border(spark):
    east = spark.createDataFrame([(1, 0.01, 0.0)], "id int, west double, south double").withColumns({"east": F.col("west"), "north": F.col("south")})
    metres = places.within_rings([("p", east)], 0.0, 0.0, [5000.0]).first()["distance_m"]
    assert 1111 < metres < 1113
    hits = places.within_rings([("p", east)], 0.0, 0.0, [500.0, metres])
    assert hits.first()["ring"] == 1
    assert rows(places.ring_counts(hits, ["p", "q"], 2)) == [(0, "p", 0), (0, "q", 0), (1, "p", 1), (1, "q", 0)]


def test_box_size(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (0.001, 0.0), (0.001, 0.0005), (0.0, 0.0005)]])
    length, width = spark.range(1).select(*places.box_size_m(ring)).first()
    assert abs(length - 111.32) < 0.05 and abs(width - 55.29) < 0.05


def test_diverse_picks_against_a_walk(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("xyz"), round(rng.random(), 2), rng.random() * 0.05, rng.random() * 0.05) for i in range(120)]
    df = spark.createDataFrame(data, "candidate_id long, change_type string, score double, lon double, lat double")

    def metres(a, b):
        import math

        h = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    order, picked = sorted(data, key=lambda d: (-d[2], d[0])), []
    for c in order:
        same = [p for p in picked if p[1] == c[1]]
        if len(same) < 3 and all(metres(p, c) >= 1500 for p in same) and len(picked) < 12:
            picked.append(c)
    picked += [c for c in order if c not in picked][: 12 - len(picked)]
    assert {r[0] for r in rows(review.diverse_picks(df, 12))} == {p[0] for p in picked}
    assert review.diverse_picks(df.limit(0)).count() == 0


def test_earliest_without_any_change(spark):
    pair = "place int, earlier int, later int, earlier_at string, later_at string, changed boolean"
    spans = spark.createDataFrame([(1, 1, 3, "a", "c", False), (2, 1, 3, "a", "c", True), (3, 1, 1, "a", "a", None)], pair)
    pairs = spark.createDataFrame([(1, 1, 2, "a", "b", True), (1, 2, 3, "b", "c", True), (2, 1, 2, "a", "b", None)], pair)
    assert [r[:3] for r in rows(review.earliest_supported(pairs, spans).select("place", "source", F.coalesce("later", F.lit(0))))] == [(1, "pair", 2), (2, "span", 3), (3, "none", 0)]


def test_slope_of_planes(spark):
    for fall, bearing in (((1, 0), 270.0), ((-1, 0), 90.0), ((0, 1), 0.0), ((0, -1), 180.0)):
        plane = spark.createDataFrame([(1, y, x, float(fall[0] * x + fall[1] * y)) for y in range(5) for x in range(5)], "observation_id int, y int, x int, z double")
        middle = stencil.slope_aspect(plane, "z").where("y = 2 AND x = 2").first()
        assert abs(middle["aspect"] - bearing) < 1e-9 and abs(middle["slope"] - 5.7106) < 1e-3
    flat = plane.withColumn("z", F.lit(3.0))
    assert {r["aspect"] for r in stencil.slope_aspect(flat, "z").collect()} == {-1.0}


def test_backscatter_of_equal_and_missing_data(spark):
    grid = spark.createDataFrame([(1, y, x, 0 if (y, x) == (0, 0) else 7, 7) for y in range(4) for x in range(9)], "observation_id int, y int, x int, a int, b int")
    got = {(r["y"], r["x"]): r["db"] for r in stencil.backscatter_change(grid, "a", "b").collect()}
    assert got.pop((0, 0)) is None and all(abs(v) < 1e-9 for v in got.values())
    plain = stencil.backscatter_change(grid.withColumn("b", F.col("b") * 10), "a", "b", speckle=False).where("x = 5").first()
    assert abs(plain["db"] - 20) < 1e-9


def test_window_plan_covers_the_edges(spark):
    images = spark.createDataFrame([(1, 1024, 1025), (2, 100, 3000)], "image_id int, width int, height int")
    assert rows(raster.window_plan(images)) == [(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, 824), (2, 0, 1648), (2, 0, 1976)]


def test_agreement_of_equal_and_single_labels(spark):
    df = spark.createDataFrame([(i % 3, (i % 3 + 1) * 5, 0) for i in range(30)], "a int, b int, c int")
    assert tuple(clusters.agreement(df, "a", "b").first())[1:] == (1.0, 1.0, 1.0, 1.0)
    one = clusters.agreement(df, "a", "c").first()
    assert abs(one["homogeneity"]) < 1e-9 and one["completeness"] == 1.0 and one["adjusted_rand"] == 0.0


def test_collapse_and_prefix(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.98, 0.199]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    ranked = spark.createDataFrame([(9, 1, 1, 0.9), (9, 2, 2, 0.1), (9, 3, 3, 0.8)], "query_id long, rank int, vec_id long, score double")
    assert rows(search.collapse_near(ranked, v).select("vec_id", "kept")) == [(1, True), (2, False), (3, True)]
    assert rows(search.prefix_above(ranked, 0.5).select("rank")) == [(1,)]


def test_verdicts(spark):
    side = "path string, value double, band double"
    base = spark.createDataFrame([("a.recall", 0.5, 0.1), ("a.x_ms", 5.0, None), ("a.y_ms", 5.0, 1.0), ("tiles_per_s", 5.0, 1.0), ("odd", 1.0, 0.1), ("gone", 1.0, None)], side)
    cand = spark.createDataFrame([("a.recall", 0.6, 0.1), ("a.x_ms", 6.0, None), ("a.y_ms", 7.0, 0.5), ("tiles_per_s", 7.0, 1.0), ("odd", 2.0, 0.1), ("new", 1.0, None)], side)
    got = {r["path"]: r["verdict"] for r in evaluation.snapshot_diff(base, cand).collect()}
    assert got.pop("a.recall") in ("within_noise", "improved")  # 0.6 - 0.5 lies on the band but for the last bit
    assert got == {"a.x_ms": "no_band", "a.y_ms": "regressed", "tiles_per_s": "improved", "odd": "changed", "gone": "only_in_baseline", "new": "only_in_candidate"}


def test_merge_keeps_what_a_removed_box_would_remove(spark):
    # 1 removes 2, so 2 cannot remove 3; chip-mates never remove one another; a tie goes to the smaller id
    data = [(1, 0.9, 0, 0.0), (2, 0.8, 1, 3.0), (3, 0.7, 2, 6.0), (4, 0.6, 2, 6.0), (6, 0.5, 3, 50.0), (5, 0.5, 4, 50.0)]
    boxes = spark.createDataFrame([(i, 1, 1, c, s, x, 0.0, x + 10, 10.0) for i, s, c, x in data], "box_id long, image_id int, class_id int, chip_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert [r["box_id"] for r in evaluation.merge_across_chips(boxes, 0.5).orderBy("box_id").collect()] == [1, 3, 4, 5]
    assert evaluation.merge_across_chips(boxes.limit(0), 0.5).count() == 0


def test_repeats_are_drawn_by_key(spark):
    chips = spark.createDataFrame([(i, 0) for i in range(1000)] + [(i, 1) for i in range(0, 1000, 100)] + [(5000, None)], "chip_id long, class_id int")
    got = {r["chip_id"]: (r["factor"], r["repeats"]) for r in evaluation.rounded_repeats(evaluation.repeat_factors(chips)).collect()}
    assert got[1] == (1.0, 1) and got[5000] == (1.0, 1) and abs(got[100][0] - (0.25 * 1001 / 10) ** 0.5) < 1e-9 and got[100][1] in (5, 6)


def test_errors_are_raised(spark):
    tiles = spark.createDataFrame([(1, 1)], "tile_id long, observation_id long")
    obs = spark.createDataFrame([(1,)], "observation_id long")
    with pytest.raises(ValueError):
        catalog.append_tiles(tiles, tiles, obs)
    with pytest.raises(ValueError):
        catalog.append_tiles(tiles, spark.createDataFrame([(2, 7)], tiles.schema), obs)
    log = spark.createDataFrame([], "decision_id long, candidate_id long, decision string, created_at timestamp")
    for bad in ("maybe", None):
        with pytest.raises(Exception, match="unknown decision"):
            catalog.append_decisions(log, spark.createDataFrame([(None, 1, bad, None)], log.schema)).collect()
    filled = catalog.append_decisions(log, spark.createDataFrame([(None, 1, "reopen", None)], log.schema)).first()
    assert filled["decision_id"] is not None and isinstance(filled["created_at"], dt.datetime)


def test_collections_and_headers_are_read(spark, tmp_path):
    spot = shared_dir(spark, "collection").removeprefix("file://")
    import json
    import os

    os.makedirs(spot)
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"tile_id": "t", "score": 0.5}}
    with open(f"{spot}/a.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": [feature, feature]}, f, indent=1)
    got = features.read_features(spark, f"file://{spot}", "tile_id: string, score: double", collections=True).collect()
    assert len(got) == 2 and got[0]["ring"] == ring and got[0]["score"] == 0.5
    labels = shared_dir(spark, "labels").removeprefix("file://")
    os.makedirs(labels)
    with open(f"{labels}/a.txt", "w") as f:
        f.write("gsd:0.3\nimagesource:x\n\n0 0 1 0 1 1 0 1 ship 1\n")
    assert features.read_label_headers(spark, f"file://{labels}").first()["gsd"] == 0.3
    only = features.read_labels(spark, f"file://{labels}").collect()
    assert len(only) == 1 and only[0]["class_id"] == "ship" and only[0]["difficult"]


def test_export_errors_of_nulls(spark):
    ring = F.lit(None).cast("array<array<double>>")
    got = spark.range(1).select(features.export_errors(ring, {"a": F.lit(None)}, [F.lit(None).cast("string")], F.lit(None).cast("string"))).first()[0]
    assert got == ["ring", "range", "missing:a", "dates", "digest"]
