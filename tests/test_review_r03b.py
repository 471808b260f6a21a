"""Small cases of the second part of the third review."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from terratile.functions import polygons
from terratile.llm import divergence
from terratile.operators import detection, evaluation, raster, reports, scoring
from terratile.plans.imagery import _round_product

POINTS = "array<struct<x:double,y:double>>"


def test_halves_are_rounded_as_in_sql(spark):
    values = [0.271875, 0.653125, 0.515625, 0.84375, 0.0, 1.0]
    got = [r.v for r in _round_product(spark.createDataFrame([(v,) for v in values], "v double"), 5, "v").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert got[:2] == [0.27187, 0.65312]


def _cut_area(ring, window):
    """Common area, one point after the other."""
    turn = sum(window[i][0] * window[(i + 1) % len(window)][1] - window[(i + 1) % len(window)][0] * window[i][1] for i in range(len(window)))
    window = window[::-1] if turn < 0 else window
    for i in range(len(window)):
        (ax, ay), (bx, by) = window[i], window[(i + 1) % len(window)]
        side, out = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring], []
        for j, (x, y) in enumerate(ring):
            k = (j + 1) % len(ring)
            if side[j] >= 0:
                out.append((x, y))
            if (side[j] >= 0) != (side[k] >= 0):
                t = side[j] / (side[j] - side[k])
                out.append((x + t * (ring[k][0] - x), y + t * (ring[k][1] - y)))
        ring = out
    return abs(sum(ring[i][0] * ring[(i + 1) % len(ring)][1] - ring[(i + 1) % len(ring)][0] * ring[i][1] for i in range(len(ring)))) / 2


def test_rings_of_any_size_are_cut_in_one_batch(spark):
    rng = random.Random(3)

    def round_ring(n):
        at = sorted(rng.uniform(0, 6.28) for _ in range(n))
        x, y, r = rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(1, 4)
        ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a in at]
        return ring[::-1] if rng.random() < 0.5 else ring

    data = [(i, [] if i % 17 == 0 else round_ring(rng.randint(3, 7)), round_ring(rng.randint(3, 6))) for i in range(300)]
    df = spark.createDataFrame([*data, (300, None, round_ring(4))], f"i int, a {POINTS}, b {POINTS}").repartition(2)
    common = polygons.common_area(F.col("a"), F.col("b"))
    got = {r.i: r.v for r in df.select("i", common.alias("v")).collect()}
    assert got.pop(300) is None
    assert all(math.isclose(got[i], _cut_area(a, b), abs_tol=1e-9) for i, a, b in data) and sum(v > 0 for v in got.values()) > 100
    plan = df.select("i", common.alias("v")).where("v > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_windows_get_only_rings_that_they_cut(spark):
    images = spark.createDataFrame([(1, 2000, 500)], "image_id long, width long, height long")
    square = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    boxes = spark.createDataFrame([(1, 1, 0, True, square(5.0, 5.0)), (1, 2, 0, True, square(1020.0, 5.0)), (1, 3, 0, True, [(3.0, 3.0)] * 4)], f"image_id long, box_id long, class_id long, kept boolean, ring {POINTS}")
    found = raster.window_boxes(images, boxes)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.box_id, r.x0, round(r.visible, 9)) for r in found.collect()) == [(1, 0, 1.0), (2, 0, 0.4), (2, 824, 1.0), (2, 976, 1.0)]


def _found(n):
    """Matched detections and truths of two classes, with ties in score, difficult truths and sizes of all ranges."""
    rng = random.Random(5)
    truths = [(t, 1, t % 2, t % 5 == 0, [(0.0, 0.0), (s := rng.choice([8.0, 20.0, 50.0, 150.0]), 0.0), (s, 4.0), (0.0, 4.0)]) for t in range(1, 41)]
    size = {t[0]: t[4][1][0] for t in truths}
    matches = []
    for d in range(n):
        c = rng.randint(0, 2)
        t = rng.choice([t for t in size if t % 2 == c]) if c < 2 and rng.random() < 0.7 else None
        matches.append((d, c, rng.randint(0, 20) / 20, rng.choice([8.0, 20.0, 50.0, 150.0]), t, rng.randint(40, 99) / 100 if t else 0.0, bool(t) and t % 5 == 0, size[t] if t else None))
    return matches, truths


def _curve(matches, truths, c, at, low, high):
    """(score, tp, tp so far, n) by falling score, and the number of truths."""
    n_true = sum(t[2] == c and not t[3] and low <= t[4][1][0] < high for t in truths)
    out, taken, tp = [], set(), 0
    for d, _, score, own, t, iou, hard, size in sorted((m for m in matches if m[1] == c), key=lambda m: (-m[2], m[0])):
        hit = t is not None and iou >= at
        if hit and (hard or not low <= size < high) or not hit and not low <= own < high:
            continue
        new = hit and t not in taken
        taken |= {t} if hit else set()
        tp += new
        out.append((score, int(new), tp, len(out) + 1))
    return out, n_true


def test_all_cases_are_counted_along_one_order(spark):
    matches, truths = _found(400)
    m = spark.createDataFrame(matches, "det_id long, class_id int, score double, det_size double, truth_id long, iou double, difficult boolean, truth_size double").repartition(3)
    t = spark.createDataFrame(truths, f"truth_id long, image_id long, class_id int, difficult boolean, ring {POINTS}")
    cases = [(at, "all") for at in detection.OVERLAPS] + [(0.5, s) for s in detection.SIZES if s != "all"]
    rows = detection.judged(m, cases)
    assert rows.count() == 400  # a row a detection, not one for each case
    ap = {(r.class_id, r.overlap, r.size): r for r in detection.average_precisions(m, t).collect()}
    best = {(r.class_id, r.size): r for r in detection.best_scores_at(m, t, sizes=list(detection.SIZES)).collect()}
    n_points = 0
    for c in (0, 1):
        for at, size in cases:
            low, high = detection.SIZES[size][0] or 0.0, detection.SIZES[size][1] or math.inf
            points, n_true = _curve(matches, truths, c, at, low, high)
            precision = [tp / n for _, _, tp, n in points]
            got = ap[c, at, size]
            assert got.n_true == n_true and math.isclose(got.ap, sum(max(precision[i:]) for i, p in enumerate(points) if p[1]) / n_true)
            assert math.isclose(got.ap11, sum(max([x for x, p in zip(precision, points, strict=True) if p[2] / n_true >= 0.1 * k], default=0.0) for k in range(11)) / 11)
            n_points += sum(p[1] for p in points)
            if at == 0.5:
                want = max((round(2 * tp / (n + n_true), 9), score) for score, _, tp, n in points)
                assert (best[c, size].f1, best[c, size].score) == want
    assert detection.hit_points(rows.where("class_id < 2"), cases).count() == n_points < 400


def test_best_score_without_any_hit(spark):
    m = spark.createDataFrame([(1, 0, 0.9, 8.0, None, 0.0, False, None), (2, 0, 0.4, 8.0, 5, 0.45, False, 8.0)], "det_id long, class_id int, score double, det_size double, truth_id long, iou double, difficult boolean, truth_size double")
    t = spark.createDataFrame([(5, 1, 0, False, [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0)])], f"truth_id long, image_id long, class_id int, difficult boolean, ring {POINTS}")
    assert [tuple(r) for r in detection.best_scores_at(m, t).collect()] == [(0, 0.5, "all", 0.0, 0.9)] == [tuple(r) for r in detection.best_scores(detection.curve(m, t)).collect()]


def test_boxes_that_meet_themselves_are_shuffled_once(spark, tmp_path):
    schema = "box_id long, image_id long, class_id int, chip_id int, score double, x0 double, y0 double, x1 double, y1 double"
    spark.createDataFrame([(i, i % 3, 0, i % 4 - 1, i / 50, x := i * 7.0 % 90, 5.0, x + 20, 25.0) for i in range(50)], schema).write.parquet(f"{tmp_path}/b")
    boxes = spark.read.parquet(f"{tmp_path}/b")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = F.when(F.col("l.chip_id") != F.col("r.chip_id"), F.col("l.chip_id") >= 0) & (F.col("l.box_id") < F.col("r.box_id"))
        met = evaluation.overlaps(boxes, boxes, asked=asked)
        got = {(r.l.box_id, r.r.box_id) for r in met.collect()}
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    all_ = boxes.collect()
    assert got == {(a.box_id, b.box_id) for a in all_ for b in all_ if a.image_id == b.image_id and a.box_id < b.box_id and a.chip_id != b.chip_id and a.chip_id >= 0 and a.x0 < b.x1 and b.x0 < a.x1}


def test_trajectories_from_the_last_pairs(spark):
    rng = random.Random(9)
    data = [(c, f"20{k:02}", f"20{k + rng.randint(1, 2):02}", rng.random() < 0.7, rng.choice([True, False, False, None])) for c in range(200) for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame(data, "candidate_id long, earlier_at string, later_at string, covered boolean, changed boolean")
    found = reports.trajectory(df)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        own = [(x[2], x[1], x[4]) for x in data if x[0] == r.candidate_id and x[3]]
        changed = sorted(p[:2] for p in own if p[2])
        after = [p[2] for p in own if changed and p[:2] > changed[0]]
        want = "unknown" if not own else "none" if not changed else "single" if not after else "persistent" if all(after) else "transient"
        assert (r.n_covered, r.n_changed, r.trajectory) == (len(own), len(changed), want) and (r.first_later, r.first_earlier) == (changed[0] if changed else (None, None))


def test_window_sends_a_pixel_to_three_places_at_a_time(spark):
    rng = random.Random(2)
    at = {(y, x): rng.randint(-2, 9) for y in range(8) for x in range(9) if rng.random() < 0.8}
    got = raster.window_mean(spark.createDataFrame([(1, y, x, v) for (y, x), v in at.items()], "observation_id int, y int, x int, v long"), "v")
    near = {p: [at[q] for q in at if abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and at[q] > 0] for p in at}
    assert {(r.y, r.x): (r.n, r["mean"]) for r in got.collect()} == {p: (len(v), sum(v) / len(v)) for p, v in near.items() if v}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2


def test_counting_of_terms_without_any(spark):
    docs = spark.createDataFrame([("a", "s", ""), ("a", "s", None), ("a", "t", "1 2"), (None, "t", "b B c")], "lang string, source string, text string").repartition(1)
    assert sorted(tuple(r) for r in divergence.term_counts(docs).collect()) == [("", "t", "b", 2, 1), ("", "t", "c", 1, 1)]
    assert divergence.term_counts(docs.limit(0)).count() == 0


def test_replicates_are_columns_of_one_order(spark):
    rng = random.Random(4)
    data = [(d, rng.randint(0, 30), rng.randint(0, 1), rng.randint(0, 15) / 15, rng.random() < 0.4) for d in range(150)]
    df = spark.createDataFrame(data, "det_id long, image_id long, class_id int, score double, hit boolean")
    drawn = {(r.image_id, r.replicate): r.weight for r in scoring.replicates(df.select("image_id").distinct(), "image_id", 18).collect()}
    got = {(r.replicate, r.class_id): r.ap for part in (range(16), range(16, 18)) for r in scoring._replicate_aps(df.withColumn("hit", F.col("hit").cast("int")), part).collect()}
    for k in range(18):
        for c in (0, 1):
            rows = sorted(((-s, d, h, w) for d, i, cl, s, h in data if cl == c and (w := drawn.get((i, k), 0))), key=lambda r: r[:2])
            tp = [sum(h * w for _, _, h, w in rows[: j + 1]) / sum(w for *_, w in rows[: j + 1]) for j in range(len(rows))]
            total = sum(h * w for _, _, h, w in rows)
            assert math.isclose(got[k, c], sum(max(tp[j:]) * w / total for j, (_, _, h, w) in enumerate(rows) if h))
