"""Rings, oriented boxes, windows, medoids and layouts: hand cases and brute force."""

import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terratile.functions import polygons
from terratile.functions.curves import hilbert_keys
from terratile.operators import detection, layout, places, raster, rings
from terratile.storage import open_fs

RING = "array<struct<x:double,y:double>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def turned(cx, cy, w, h, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return ring(*[(cx + i * w / 2 * c - j * h / 2 * s, cy + i * w / 2 * s + j * h / 2 * c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


SQUARE = ring((0, 0), (1, 0), (1, 1), (0, 1))


@pytest.mark.parametrize(
    "a,b,want",
    [
        (SQUARE, turned(0.5, 0.5, 1, 1, 45), 2 * (math.sqrt(2) - 1)), (SQUARE, SQUARE, 1.0), (SQUARE, SQUARE[::-1], 1.0), (SQUARE, turned(5, 5, 1, 1, 10), 0.0), (SQUARE, turned(0.5, 0.5, 0.2, 0.1, 30), 0.02),
        (turned(0.5, 0.5, 0.2, 0.1, 30), SQUARE, 0.02), (SQUARE, ring((1, 0), (2, 0), (2, 1), (1, 1)), 0.0), (SQUARE, ring((0, 0), (2, 0), (0, 2)), 1.0), (ring((0, 0), (2, 0), (0, 2)), ring((1, -1), (3, -1), (3, 3), (1, 3)), 0.5),
        (ring((0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)), ring((0, 2), (3, 2), (3, 4), (0, 4)), 2.0), (ring((0, 0), (1, 0)), SQUARE, 0.0), ([], SQUARE, 0.0),
    ],
)
def test_common_areas(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], f"a {RING}, b {RING}")
    got = df.select(polygons.common_area(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - want) < 1e-9


def boxes(spark, data):
    return spark.createDataFrame(data, f"det_id long, image_id long, class_id int, score double, ring {RING}")


def truths(spark, data):
    return spark.createDataFrame(data, f"truth_id long, image_id long, class_id int, difficult boolean, ring {RING}")


def test_one_hit_a_truth_and_difficult_ones_do_not_count(spark):
    t = truths(spark, [(1, 1, 0, False, turned(10, 10, 8, 4, 30)), (2, 1, 0, True, turned(40, 10, 8, 4, 0)), (3, 1, 0, False, turned(70, 10, 40, 20, 60)), (4, 2, 1, False, SQUARE)])
    d = boxes(spark, [
        (1, 1, 0, 0.9, turned(10, 10, 8, 4, 30)), (2, 1, 0, 0.8, turned(10, 10, 8, 4, 31)),  # a second one of the same truth
        (3, 1, 0, 0.95, turned(40, 10, 8, 4, 0)),  # of a difficult one
        (4, 1, 0, 0.7, turned(200, 200, 8, 4, 0)), (5, 1, 0, 0.6, turned(70, 10, 40, 20, 60)), (6, 1, 2, 0.5, SQUARE), (7, 3, 0, 0.5, SQUARE),
    ])
    m = detection.matched(d, t)
    found = {r.det_id: r for r in m.collect()}
    assert {k: v.truth_id for k, v in found.items()} == {1: 1, 2: 1, 3: 2, 4: None, 5: 3, 6: None, 7: None}
    assert found[1].iou == 1.0 and found[3].difficult and abs(found[5].truth_size - 40) < 1e-9
    points = rows(detection.curve(m, t).where("class_id = 0").select("n", "det_id", "tp", "tp_so_far", "recall"))
    assert points == [(1, 1, 1, 1, 0.5), (2, 2, 0, 1, 0.5), (3, 4, 0, 1, 0.5), (4, 5, 1, 2, 1.0), (5, 7, 0, 2, 1.0)]
    ap = {(r.class_id, r.overlap, r.size): r for r in detection.average_precisions(m, t).collect()}
    assert abs(ap[0, 0.5, "all"].ap - (1 + 0.5) / 2) < 1e-12 and abs(ap[0, 0.5, "all"].ap11 - (6 * 1 + 5 * 0.5) / 11) < 1e-12
    assert ap[1, 0.5, "all"].ap == 0.0 and ap[1, 0.5, "32-96"].ap is None and ap[0, 0.5, "32-96"].n_true == 1 and ap[0, 0.5, "32-96"].ap == 1.0
    summary = {r.class_id: r for r in detection.class_summary(detection.average_precisions(m, t, sizes=["all"])).collect()}
    assert abs(summary[0].ap50_95 - 0.75) < 1e-9
    best = {r.class_id: r for r in detection.best_scores(detection.curve(m, t)).collect()}
    assert best[0].score == 0.9 and abs(best[0].f1 - 2 / 3) < 1e-9 and 2 not in best
    assert detection.average_precisions(detection.matched(d.limit(0), t), t).where("ap > 0").count() == 0


def test_turned_boxes_merge_across_chips(spark):
    kind = f"box_id long, image_id long, class_id int, chip_id int, score double, ring {RING}"
    data = [(1, 1, 0, 0, 0.9, turned(5, 5, 4, 2, 20)), (2, 1, 0, 1, 0.8, turned(5, 5, 4, 2, 22)), (3, 1, 0, 0, 0.7, turned(5, 5, 4, 2, 20)), (4, 1, 1, 1, 0.6, turned(5, 5, 4, 2, 20)), (5, 1, 0, 1, 0.5, turned(5, 5, 4, 2, 110))]
    assert rows(detection.merged_rings(spark.createDataFrame(data, kind)).select("box_id")) == [(1,), (3,), (4,), (5,)]


def test_windows_of_boxes(spark):
    images = spark.createDataFrame([(1, 1500, 900), (2, 100, 100)], "image_id long, width long, height long")
    kind = f"image_id long, box_id long, class_id int, kept boolean, ring {RING}"
    data = [(1, 1, 0, True, ring((1000, 100), (1100, 100), (1100, 200), (1000, 200))), (1, 2, 3, False, ring((400, 0), (600, 0), (600, 50), (400, 50))), (1, 3, 0, True, ring((5, 5), (5, 5), (5, 5), (5, 5))), (2, 4, 0, True, ring((0, 0), (200, 0), (200, 100), (0, 100)))]
    got = {(r.image_id, r.x0, r.y0, r.box_id): round(r.visible, 9) for r in raster.window_boxes(images, spark.createDataFrame(data, kind)).collect()}
    assert got == {(1, 0, 0, 1): 0.24, (1, 476, 0, 1): 1.0, (1, 0, 0, 2): 1.0, (1, 476, 0, 2): 0.62, (2, 0, 0, 4): 1.0}
    assert rows(raster.window_labels(images, spark.createDataFrame(data, kind))) == [(1, 0, 0, 0, 1), (1, 476, 0, 1, 1), (2, 0, 0, 1, 0)]


CONCAVE = ring((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30))


def test_rings_against_boxes_and_points(spark):
    shape = spark.createDataFrame([(1, CONCAVE), (2, ring((50, 50), (60, 50), (55, 60)))], f"ring_id long, ring {RING}")
    data = [("inside", 1, 1, 2, 2), ("notch", 12, 15, 18, 25), ("edge", 20, 15, 25, 16), ("touch", 30, 30, 40, 40), ("round", -5, -5, 35, 35), ("far", 90, 90, 91, 91), ("through", 12, 5, 18, 35)]
    b = spark.createDataFrame([(n, *map(float, v)) for n, *v in data], "box_id string, west double, south double, east double, north double")
    assert rows(rings.rings_meeting_boxes(shape, b)) == [(1, n) for n in ("edge", "inside", "round", "through", "touch")]
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 20.0), (3, 25.0, 29.0), (4, None, 1.0)], "point_id int, x double, y double")
    assert rows(rings.points_inside(shape, pts)) == [(1, 1), (1, 3)]
    boxes_ = spark.createDataFrame([(9, ring((0, 20), (30, 20), (30, 40), (0, 40))), (10, ring((100, 0), (101, 0), (101, 1)))], f"ring_id long, ring {RING}")
    got = rows(rings.overlap_shares(shape, boxes_))
    assert len(got) == 1 and got[0][:2] == (1, 9) and abs(got[0][2] - 200 / 600) < 1e-12


def test_distance_of_a_point_to_a_ring_of_many_edges(spark):
    n = 2000
    circle = ring(*[(10 + math.cos(2 * math.pi * k / n), 10 + math.sin(2 * math.pi * k / n)) for k in range(n)])
    shape = spark.createDataFrame([(1, circle)], f"ring_id long, ring {RING}")
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 11.5), (3, 10.0, 8.0), (4, 20.0, 10.0)], "point_id int, lon double, lat double")
    got = {r.point_id: r.distance_m for r in rings.nearest_rings(pts, shape, 120_000).collect()}
    degree = math.radians(1) * 6371000
    assert got[1] == 0.0 and abs(got[2] - degree / 2) < 30 and abs(got[3] - degree) < 30 and 4 not in got


def test_medoids_equal_all_pairs(spark):
    rng = random.Random(4)
    data = [("a", i, round(rng.gauss(20, 8), 2), round(rng.gauss(10, 5), 2)) for i in range(150)] + [("a", 900, 120.0, 50.0)] + [("b", i, 5.0, 5.0) for i in (4, 3)] + [("c", 1, 0.0, 0.0), ("c", 2, 1.0, 1.0), ("c", 3, None, 1.0)]
    data += [("a", 1000 + i, *data[3][2:]) for i in range(20)]
    df = spark.createDataFrame(data, "g string, point_id int, lon double, lat double")

    def far(p, q):
        a = math.sin(math.radians(q[3] - p[3]) / 2) ** 2 + math.cos(math.radians(p[3])) * math.cos(math.radians(q[3])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    want = {}
    for g in "abc":
        own = [d for d in data if d[0] == g and d[2] is not None]
        want[g] = min((round(sum(far(p, q) for q in own), 3), p[1]) for p in own)
    got = {r.g: (r.total_m, r.point_id) for r in places.medoids(df, "g").collect()}
    assert {g: p for g, (_, p) in got.items()} == {g: p for g, (_, p) in want.items()} and all(abs(got[g][0] - want[g][0]) < 1e-2 for g in want)
    frame = {r.g: r for r in places.framed(df, "g").collect()}
    assert frame["a"].n_outside == 1 and frame["a"].east < 100 and frame["b"].n_kept == 2 and abs(frame["b"].west - 4.98) < 1e-9


def test_a_layout_lets_a_box_skip_row_groups(spark):
    rng = random.Random(1)
    data = [(i, x, y, x + 0.1, y + 0.1) for i in range(20000) for x, y in [(rng.uniform(-180, 179), rng.uniform(-90, 89))]]
    df = spark.createDataFrame([*data, (-1, None, None, None, None)], "tile_id long, west double, south double, east double, north double")
    laid = layout.write_layout(df, "layout_test", group_bytes=16 << 10, file_rows=5000)
    assert laid.count() == 20001 and rows(laid.where("tile_id < 50")) == rows(df.where("tile_id < 50"))
    box = (10.0, 10.0, 30.0, 30.0)
    met = total = 0
    for path in laid.inputFiles():
        fs, name = open_fs(path)
        meta = pq.ParquetFile(fs.open_input_file(name)).metadata
        names = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(c).statistics for n, c in names.items()}
            total += 1
            met += stats["west"].has_min_max and stats["west"].min <= box[2] and stats["east"].max >= box[0] and stats["south"].min <= box[3] and stats["north"].max >= box[1]
    assert total > 30 and met < total / 4
    found = laid.where("west <= 30 AND east >= 10 AND south <= 30 AND north >= 10")
    assert "PushedFilters: [IsNotNull" in found._jdf.queryExecution().toString()
    assert rows(found.select("tile_id")) == sorted((d[0],) for d in data if d[1] <= 30 and d[3] >= 10 and d[2] <= 30 and d[4] >= 10)


def test_curve_goes_in_unit_steps():
    import numpy as np

    grid = np.stack(np.meshgrid(np.arange(16), np.arange(16), indexing="ij"), -1).reshape(-1, 2)
    walk = grid[np.argsort(hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
