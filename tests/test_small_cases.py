"""Small cases by hand: rows that must not be lost, streams that go on, filters, fits, distances and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terratile import storage
from terratile.functions import grids
from terratile.operators import catalog, evaluation, listing, normalise, raster, reports, scan, scoring, watch
from terratile.sources import ledgers
from terratile.streaming import logs


def test_running_totals_keep_null_groups(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 4)], "g int, v int")
    got = {(r.g, r.v): r.s for r in scan.running(rows, ["g"], [F.col("v")], {"s": F.col("v")}).collect()}
    assert got == {(None, 1): 1, (None, 2): 3, (1, 3): 3, (1, 4): 7}


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in (1, 2) for v in rng.integers(0, 20, 101 if g == 1 else 4)] + [(1, None)]
    got = {r.g: (r.a, r.b) for r in scan.quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", {"a": 0.5, "b": 0.93}).collect()}
    for g in (1, 2):
        values = [v for k, v in data if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(values, [0.5, 0.93]))


def test_fingerprint_of_any_size_is_one_row(spark):
    rows = spark.range(60).withColumnRenamed("id", "k")
    one = scan.fingerprint(rows, [F.col("k")], F.col("k").cast("string"), size=3, levels=1).collect()
    other = scan.fingerprint(rows.where("k <> 7"), [F.col("k")], F.col("k").cast("string"), size=3, levels=1).collect()
    assert len(one) == 1 and one[0].n_rows == 60 and one[0].sha256 != other[0].sha256


def test_keyed_writes_keep_updates(spark):
    old = spark.createDataFrame([(1, 5, 7.0, 9.0)], "k int, a int, c double, ctx double")
    new = spark.createDataFrame([(1, None, 3.0, 0.0), (2, 4, 4.0, 0.0)], old.schema)
    got = {r.k: tuple(r) for r in catalog.keep_context(old, new, "k", ["ctx"]).collect()}
    assert got == {1: (1, None, 3.0, 9.0), 2: (2, 4, 4.0, None)}
    twice = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0)], old.schema)
    assert [tuple(r) for r in catalog.upsert(old, twice, "k").collect()] == [(1, 2, 1.0, 0.0)]
    tiles = spark.createDataFrame([(1, 1)], "tile_id long, observation_id long")
    two = spark.createDataFrame([(2, 1), (2, 1)], tiles.schema)
    with pytest.raises(ValueError, match="twice"):
        catalog.append_tiles(tiles, two, tiles.select("observation_id"))
    with pytest.raises(ValueError, match="unknown"):
        catalog.register(tiles, spark.createDataFrame([(5, 9)], tiles.schema), "tile_id", tiles, "observation_id")


def test_components_of_any_numbers(spark):
    far = 1 << 40
    cells = [(far, far, far), (far, far + 1, far + 1), (far, far + 3, far), (1, 0, 1 << 20), (1, 1, 0)]
    got = {(r.observation_id, r.y, r.x): (r.label_y, r.label_x) for r in raster.components(spark.createDataFrame(cells, "observation_id long, y long, x long")).collect()}
    assert got[cells[1]] == (far, far) and got[cells[2]] == (far + 3, far) and got[cells[3]] == (0, 1 << 20) and got[cells[4]] == (1, 0)


def test_boxes_of_unknown_chips_remove_none(spark):
    data = [(1, 0.9, -1, 0.0), (2, 0.8, 3, 1.0), (3, 0.7, -2, 1.0)]
    boxes = spark.createDataFrame([(i, 1, 1, c, s, x, 0.0, x + 10, 10.0) for i, s, c, x in data], "box_id long, image_id int, class_id int, chip_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in evaluation.merge_across_chips(boxes, 0.5).collect()) == [1, 2]


WATCHES = "watch_id int, west double, south double, east double, north double, ring array<struct<x:double,y:double>>, change_types array<string>, text_query string, min_confidence double, active boolean"
FOUND = "candidate_id int, lon double, lat double, confidence double, change_type string, rule string, detail string"


def test_watch_filters(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    watches = spark.createDataFrame(
        [
            (1, 0.0, 0.0, 2.0, 2.0, None, None, None, None, True), (2, 0.0, 0.0, 2.0, 2.0, ring, None, "", None, True), (3, None, None, None, None, None, ["water"], None, 0.5, True),
            (4, None, None, None, None, None, [], "Harbour  bridge", None, True), (5, None, None, None, None, None, None, None, None, False),
        ],
        WATCHES,
    )
    found = spark.createDataFrame(
        [(1, 0.5, 0.5, None, "water", "r", "a harbour"), (2, 1.9, 1.9, 0.9, "water", "r", None), (3, 1.0, 1.0, 0.6, "road", "bridge rule", ""), (4, -170.0, 80.0, 0.7, "water", None, None), (5, None, None, 0.9, "water", "bridge", "")], FOUND
    )
    got = {(r.watch_id, r.candidate_id) for r in watch.watch_matches(watches, found).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 2), (3, 4), (4, 1), (4, 3)}  # point 3 lies on the ring's edge
    told = spark.createDataFrame([(1, 1)], "watch_id int, candidate_id int")
    assert watch.untold(watch.watch_matches(watches, found), told).count() == 7


def test_streams_go_on_where_they_stopped(spark):
    log, told, spot = (storage.shared_dir(spark, n) for n in ("log", "told", "spot"))
    schema = "watch_id int, candidate_id int"

    def run():
        stream = spark.readStream.schema(schema).parquet(log)
        return sorted(tuple(r) for r in logs.once_only(stream, told, spot).collect())

    spark.createDataFrame([(1, 1), (1, 1), (1, 2)], schema).write.mode("append").parquet(log)
    assert run() == [(1, 1), (1, 2)]
    spark.createDataFrame([(1, 2), (2, 2)], schema).write.mode("append").parquet(log)
    assert run() == [(1, 1), (1, 2), (2, 2)] == run()
    n_told = spark.read.option("recursiveFileLookup", "true").parquet(told).count()
    assert n_told == 3
    rolls, table, mark = (storage.shared_dir(spark, n) for n in ("tiles", "table", "mark"))
    tile = "observation_id long, west double, south double, east double, north double, cloud double"

    def roll():
        stream = spark.readStream.schema(tile).parquet(rolls)
        return {r.observation_id: (r.n_tiles, r.west, r.n_clear) for r in logs.upsert_table(logs.tile_rollup(stream), "observation_id", table, mark).collect()}

    spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.0), (2, 5.0, 0.0, 6.0, 1.0, 0.5)], tile).write.mode("append").parquet(rolls)
    assert roll() == {1: (1, 0.0, 1), 2: (1, 5.0, 0)}
    spark.createDataFrame([(1, -1.0, 0.0, 1.0, 1.0, 0.9)], tile).write.mode("append").parquet(rolls)
    assert roll() == {1: (2, -1.0, 1), 2: (1, 5.0, 0)}


def test_candidate_filters(spark):
    schema = "candidate_id int, change_type string, confidence double, persistence string, first_at string, last_at string, sar_available boolean, west double, south double, east double, north double, decision string, queue_score double"
    box = (0.0, 0.0, 1.0, 1.0)
    rows = spark.createDataFrame([(1, "a", None, "p", None, None, True, *box, "undecided", None), (2, "a", 0.9, "p", "2019-01-01", "2020-01-01", None, *box, "confirm", 0.5), (3, "b", 0.4, "q", "2021-01-01", "2022-01-01", False, 5.0, 5.0, 6.0, 6.0, "undecided", 0.5)], schema)
    ids = lambda **k: sorted(r.candidate_id for r in listing.list_candidates(rows, all_dates=("2018-01-01", "2026-01-01"), **k).collect())
    assert ids() == [1, 2, 3] and ids(min_confidence=0.4) == [2, 3] and ids(min_confidence=0.0) == [1, 2, 3]
    assert ids(sensor="S1") == [1] and ids(sensor="msi") == [1, 2, 3] and ids(sensor="x") == []
    assert ids(year=2020) == [1, 2] and ids(dates=("2020-06-01", None)) == [1, 3] and ids(year=2020, dates=(None, "2025-01-01")) == [1, 2, 3]
    assert ids(first_detected=["none"]) == [1] and ids(first_detected=["2019-01-01_2020-01-01", "none"]) == [1, 2]
    assert ids(bbox=(1.0, 1.0, 2.0, 2.0)) == [1, 2] and ids(decision="confirm") == [2] and ids(ids=spark.createDataFrame([(3,)], "candidate_id int")) == [3]
    page = [r.candidate_id for r in listing.candidate_page(rows, "queue_score", 2, 0).orderBy("place").collect()]
    assert page == [2, 3] and [r.candidate_id for r in listing.candidate_page(rows, "-queue_score", 2, 1).orderBy("place").collect()] == [2, 3]


def test_missing_parents_and_records_raise(spark):
    one = lambda schema, *v: spark.createDataFrame([v], schema)
    tiles, obs, scenes = one("tile_id int, observation_id int", 1, 2), one("observation_id int, scene_id int", 2, 3), one("scene_id int, collection_id int", 3, 4)
    with pytest.raises(Exception, match="no parent for tile 1"):
        listing.provenance(tiles, obs, scenes, one("collection_id int", 5)).collect()
    done = spark.createDataFrame([(0, 10, "a", "a"), (1, 10, "b", "x")], "shard int, n_rows int, sha256 string, found string")
    assert [r.shard for r in ledgers.shards_to_redo(done.select("shard", "n_rows"), done).collect()] == [1]
    assert ledgers.shards_to_redo(done.select("shard", "n_rows"), done, False).count() == 2
    with pytest.raises(ValueError, match="1 shards"):
        ledgers.finalised(done.select("shard", "n_rows"), done, 20)
    with pytest.raises(Exception, match="not a list of radii"):
        one("t string", "5,a").select(reports.radii(F.col("t"))).collect()


def test_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(Far, "x")
    with storage.staged_tables(spark):
        kept = storage.stage_table(spark.range(3), "gone").inputFiles()[0]
    with pytest.raises(Exception, match="(?i)exist|not found|Path"):
        spark.read.parquet(kept).count()


def test_fits_find_the_line(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(500, 3000, 600)
    y = 1.1 * x - 60
    y[:20] += 2000
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "pair_id int, x double, y double")
    fit = normalise.fit_bands(rows, ["pair_id"], "ols", rounds=2).first()
    assert abs(fit.gain - 1.1) < 0.02 and abs(fit.offset + 60) < 40 and fit.n >= 570


def test_window_shifts_and_spaced_picks(spark):
    rng = np.random.default_rng(4)
    image = rng.random((16, 16))
    moved = np.roll(image, (2, -3), (0, 1))
    rows = [(1, y, x, float(image[y, x]), float(moved[y, x])) for y in range(16) for x in range(16)]
    got = normalise.window_shifts(spark.createDataFrame(rows, "pair_id long, y long, x long, ref double, sub double"), 16).collect()
    assert [(r.dy, r.dx) for r in got] == [(2.0, -3.0)]
    tiles = [(0, 0, 2.0, 0), (0, 3, 1.9, 0), (0, 7, 1.8, 0), (9, 9, 1.0, 1), (0, 1, 1.95, None)]
    picks = normalise.spaced_pick(spark.createDataFrame(tiles, "row_no long, col_no long, likeness double, tier int"), 3)
    assert [(p["row_no"], p["col_no"]) for p in picks] == [(0, 0), (0, 7), (0, 3)]


def test_distances_without_water(spark):
    cells = spark.createDataFrame([(1, y, x) for y in range(4) for x in range(4)], "observation_id long, y long, x long")
    dry = normalise.nearest_distance(cells, cells.limit(0), 40.0, "d")
    assert {r.d for r in dry.collect()} == {1e6}
    wet = {(r.y, r.x): r.d for r in normalise.nearest_distance(cells, cells.where("y = 0 AND x = 0"), 10.0, "d").collect()}
    assert all(abs(d - 10 * (y * y + x * x) ** 0.5) < 1e-9 for (y, x), d in wet.items())
    assert normalise.opened(cells).count() == 16 and normalise.opened(cells.where("y < 2")).count() == 0


def test_map_grid_of_a_known_place(spark):
    got = grids.with_grid(spark.createDataFrame([(2.2945, 48.8583), (3.0, 0.0), (-58.3816, -34.6037)], "lon double, lat double")).collect()
    assert got[0].zone == 31 and got[0].band == "U" and abs(got[0].easting - 448252) < 3 and abs(got[0].northing - 5411943) < 20 and got[0].square == "31UDQ"
    assert abs(got[1].easting - 500000) < 1e-6 and abs(got[1].northing) < 1e-6
    assert got[2].zone == 21 and got[2].band == "H" and 6.1e6 < got[2].northing < 6.2e6


def test_principal_components_are_those_of_the_decomposition(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 6)) * [5, 3, 2, 1, 1, 1]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = np.array([r.components for r in scoring.principal_components(vectors, 3).orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(data - data.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u * s)[:, :3], atol=1e-6)


def test_notices_are_recorded_and_marked(spark):
    schema = "notification_id long, watch_id int, observation_id int, seen boolean"
    log = spark.createDataFrame([(1, 1, 1, False)], schema)
    whole = watch.record_notices(log, spark.createDataFrame([(None, 2, 1, None)], schema))
    assert whole.where("notification_id IS NULL OR seen IS NULL").count() == 0
    seen = watch.mark_seen(whole, spark.createDataFrame([(1,), (99,)], "notification_id long"))
    assert sorted((r.watch_id, r.seen) for r in seen.collect()) == [(1, True), (2, False)]
