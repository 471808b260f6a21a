"""The engine's tables as projections of the driver's tables.

Each binding is a base table, expressions that Spark and DuckDB read alike, and
a filter; the queries run on the DataFrame, the SQL checks on the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BINDINGS: dict[str, tuple[str, list[str], str]] = {
    "collections": ("region", ["r_regionkey AS collection_id", "r_name AS sensor"], "true"),
    "scenes": ("nation", ["n_nationkey AS scene_id", "n_regionkey AS collection_id", "n_name AS platform"], "true"),
    "observations": (
        "customer",
        [
            "c_custkey AS observation_id", "c_nationkey AS scene_id", "c_mktsegment AS aoi_name", "c_custkey % 40 AS place",
            "concat('20', lpad(CAST(c_custkey % 7 + 18 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), '-15') AS acquired_at",
            "(c_custkey % 61) / 100.0e0 AS mean_cloud", "(c_custkey % 5) * 0.5e0 + 0.5e0 AS gsd_m",
        ],
        "true",
    ),
    "tiles": (
        "orders",
        [
            "o_orderkey AS tile_id", "o_custkey AS observation_id", "o_orderkey % 64 AS row_no", "o_orderkey % 97 AS col_no",
            "(o_orderkey % 3000) * 0.1e0 - 150.0e0 AS west", "(o_custkey % 1400) * 0.1e0 - 70.0e0 AS south",
            "(o_orderkey % 3000) * 0.1e0 - 149.95e0 AS east", "(o_custkey % 1400) * 0.1e0 - 69.95e0 AS north",
            "(o_orderkey % 101) / 100.0e0 AS cloud", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS vec_id",
        ],
        "true",
    ),
    "vectors": ("embeddings", ["vec_id", "embedding", "label"], "true"),
    "candidates": (
        "lineitem",
        [
            "l_orderkey * 10 + l_linenumber AS candidate_id", "l_orderkey % 8 AS pair_id", "CAST(floor(l_quantity) AS BIGINT) * 12 AS area_px",
            "((l_partkey % 41) - 20) / 50.0e0 AS d_ndvi", "((l_suppkey % 31) - 15) / 50.0e0 AS d_ndbi", "((l_orderkey % 37) - 18) / 40.0e0 AS d_ndwi",
            "(l_partkey % 25) / 250.0e0 AS bad_earlier", "(l_suppkey % 20) / 200.0e0 AS bad_later", "1.0e0 - (l_orderkey % 11) / 40.0e0 AS valid_fraction",
            "1.0e0 + (l_partkey % 13) / 3.0e0 AS elongation", "0.5e0 + (l_orderkey % 50) / 100.0e0 AS mean_prob", "(l_suppkey % 100) / 100.0e0 AS reliability",
            "((l_orderkey * 37 + l_partkey) % 3600) / 10.0e0 - 180.0e0 AS lon", "((l_orderkey * 53 + l_suppkey) % 1600) / 10.0e0 - 80.0e0 AS lat", "((l_partkey + l_orderkey) % 97) / 96.0e0 AS confidence",
            "(l_orderkey % 89) / 88.0e0 AS significance", "(l_orderkey % 71) / 10.0e0 - 3.5e0 AS dvv_db", "(l_partkey % 71) / 10.0e0 - 3.5e0 AS dvh_db",
            "l_shipdate AS seen_at",
        ],
        "true",
    ),
    "decisions": (
        "events",
        [
            "event_id AS decision_id", "user_id AS candidate_id", "ts AS created_at",
            "CASE WHEN event_type = 'error' THEN 'reopen' WHEN event_type = 'click' THEN 'confirm' ELSE 'reject' END AS decision", "value",
        ],
        "true",
    ),
    "pixels": (
        "lineitem",
        [
            "l_orderkey % 8 AS observation_id", "CAST(floor(l_orderkey / 32) AS BIGINT) AS y", "l_orderkey % 32 * 8 + l_linenumber AS x",
            "l_partkey % 900 + 100 AS b03", "l_suppkey % 900 + 100 AS b04", "(l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 1500 + 100 AS b08",
            "(l_partkey * 3 + l_orderkey) % 1200 + 100 AS b11", "l_partkey % 12 AS scl",
        ],
        "true",
    ),
    "watches": (
        "supplier",
        ["s_suppkey AS watch_id", "(s_suppkey % 36) * 10.0e0 - 180.0e0 AS west", "(s_suppkey % 16) * 10.0e0 - 80.0e0 AS south", "(s_suppkey % 36) * 10.0e0 - 170.0e0 AS east", "(s_suppkey % 16) * 10.0e0 - 70.0e0 AS north", "(s_suppkey % 50) / 50.0e0 AS min_confidence", "s_suppkey % 3 <> 0 AS active"],
        "true",
    ),
    "judged": ("labels", ["doc_id", "quality", "toxic"], "quality IS NOT NULL AND toxic IS NOT NULL"),
    "detections": (
        "lineitem",
        ["((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS det_id", "l_partkey % 200 AS image_id", "l_suppkey % 5 AS class_id", "(l_orderkey % 997) / 997.0e0 AS score", "l_orderkey % 3 = 0 AS hit"],
        "true",
    ),
    "lines": ("lineitem", ["l_partkey AS part_no", "l_suppkey AS supplier_no", "l_linenumber AS line_no"], "true"),
    "sites": (
        "customer",
        [
            "c_custkey AS observation_id",
            "concat(lower(c_mktsegment), CASE c_custkey % 6 WHEN 0 THEN '_43RGP_diverse' WHEN 1 THEN '_44RPQ_scaled_82km' WHEN 2 THEN '-82km' WHEN 3 THEN '_backwaters_44RKU' WHEN 4 THEN '_scaled' ELSE '' END) AS aoi_name",
        ],
        "true",
    ),
    "zones": (
        "nation",
        [
            "n_name AS zone", "(n_nationkey % 5) * 60e0 - 150e0 AS west", "(n_nationkey % 5) * 60e0 - 70e0 AS east",
            "(n_nationkey % 7) * 20e0 - 75e0 AS south", "(n_nationkey % 7) * 20e0 - 40e0 AS north",
        ],
        "true",
    ),
    "scenes_at": (
        "customer",
        [
            "c_custkey AS observation_id", "c_custkey % 40 AS place", "c_custkey % 3 AS collection_id", "concat('s', CAST(c_custkey % 4 AS STRING)) AS sensor",
            "concat('20', lpad(CAST(c_custkey % 7 + 18 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), '-15') AS acquired_at",
            "(c_custkey % 2) * 0.5e0 + 0.5e0 AS gsd_m", "(c_custkey % 61) / 200e0 AS mean_cloud", "(c_custkey % 5) / 10e0 AS shift_px", "c_nationkey % 2 AS reference",
            "(c_custkey % 17) / 10e0 AS west", "(c_custkey % 13) / 10e0 AS south", "(c_custkey % 17) / 10e0 + 1e0 AS east", "(c_custkey % 13) / 10e0 + 1e0 AS north",
        ],
        "true",
    ),
    "grid": (
        "orders",
        [
            "CAST(floor(o_orderkey / 1500) AS BIGINT) AS observation_id", "CAST(floor(o_orderkey / 50) AS BIGINT) % 30 AS y", "o_orderkey % 50 AS x",
            "(o_orderkey * 7 + o_custkey * 3) % 60 AS z", "(o_custkey * 13 + o_orderkey) % 300 AS amp1", "(o_custkey * 29 + o_orderkey * 5) % 300 AS amp2",
            "(o_custkey * 11) % 3000 + 1 AS b1", "(o_custkey * 11 + o_orderkey % 400) % 3300 + 1 AS b2", "(o_custkey % 100) / 100e0 AS prob", "o_orderkey % 12 AS scl",
        ],
        "true",
    ),
    "chips": ("lineitem", ["l_orderkey AS chip_id", "l_suppkey * l_suppkey % 97 % 6 AS class_id"], "true"),
    "images": ("part", ["p_partkey AS image_id", "p_partkey * 37 % 4000 + 200 AS width", "p_partkey * 91 % 3000 + 200 AS height"], "true"),
    "boxes": (
        "lineitem",
        [
            "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS box_id", "CAST(floor(l_orderkey / 16) AS BIGINT) AS image_id", "l_suppkey % 5 AS class_id", "l_orderkey % 4 AS chip_id",
            "(l_orderkey % 997) / 997e0 AS score", "(l_orderkey * 7 + l_suppkey * 3) % 120 * 1e0 AS x0", "(l_partkey * 3 + l_orderkey) % 120 * 1e0 AS y0",
            "(l_orderkey * 7 + l_suppkey * 3) % 120 + 20e0 + l_linenumber AS x1", "(l_partkey * 3 + l_orderkey) % 120 + 16e0 + l_linenumber * 2 AS y1",
        ],
        "true",
    ),
    "truths": (
        "orders",
        ["o_orderkey AS truth_id", "CAST(floor(o_orderkey / 16) AS BIGINT) AS image_id", "o_orderkey % 5 AS class_id", "o_orderkey * 11 % 120 * 1e0 AS x0", "o_orderkey * 3 % 120 * 1e0 AS y0", "o_orderkey * 11 % 120 + 22e0 AS x1", "o_orderkey * 3 % 120 + 20e0 AS y1"],
        "true",
    ),
    "findings": (
        "lineitem",
        [
            "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS candidate_id", "l_orderkey AS subject", "l_orderkey % 8 AS pair_id",
            "CASE l_partkey % 5 WHEN 0 THEN 'construction' WHEN 1 THEN 'vegetation_loss' WHEN 2 THEN 'water_gain' WHEN 3 THEN 'water_loss' ELSE 'other' END AS change_type",
            "CASE WHEN l_orderkey % 17 <> 0 THEN ((l_partkey + l_orderkey) % 97) / 96e0 END AS confidence", "(l_orderkey % 89) / 88e0 AS significance", "CASE WHEN l_orderkey % 13 <> 0 THEN (l_suppkey * 7 % 101) / 100e0 END AS queue_score",
            "CASE l_suppkey % 3 WHEN 0 THEN 'persistent' WHEN 1 THEN 'transient' ELSE 'single' END AS persistence",
            "CASE WHEN l_partkey % 6 <> 0 THEN concat('20', lpad(CAST(l_partkey % 4 + 18 AS STRING), 2, '0'), '-03-15') END AS first_at", "CASE WHEN l_partkey % 6 <> 0 THEN concat('20', lpad(CAST(l_partkey % 4 + l_suppkey % 3 + 19 AS STRING), 2, '0'), '-09-15') END AS last_at",
            "l_suppkey % 4 <> 0 AS sar_available", "(l_orderkey % 71) / 10e0 - 3.5e0 AS vv_db", "((l_orderkey * 37 + l_partkey) % 3600) / 10e0 - 180e0 AS lon", "((l_orderkey * 53 + l_suppkey) % 1600) / 10e0 - 80e0 AS lat",
            "((l_partkey % 41) - 20) / 50e0 AS d_ndvi", "((l_suppkey % 31) - 15) / 50e0 AS d_ndbi", "((l_orderkey % 37) - 18) / 40e0 AS d_ndwi",
            "l_partkey % 7 <> 0 AS quality_ok", "l_suppkey % 9 <> 0 AS radiometric_ok", "concat('rule ', CAST(l_linenumber AS STRING)) AS rule", "CASE l_orderkey % 3 WHEN 0 THEN 'New building footprint' WHEN 1 THEN 'river bank moved' ELSE 'crop cycle' END AS detail",
        ],
        "true",
    ),
    "watch_rules": (
        "supplier",
        [
            "s_suppkey AS watch_id", "CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 36) * 10e0 - 180e0 END AS west", "CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 16) * 10e0 - 80e0 END AS south",
            "CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 36) * 10e0 - 180e0 + s_suppkey % 4 * 5e0 + 5e0 END AS east", "CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 16) * 10e0 - 80e0 + s_suppkey % 5 * 4e0 + 4e0 END AS north",
            "CASE s_suppkey % 3 WHEN 0 THEN 'construction,water_gain' WHEN 1 THEN 'vegetation_loss' ELSE '' END AS change_types", "CASE s_suppkey % 4 WHEN 0 THEN 'Building harbour' WHEN 1 THEN 'river' ELSE '' END AS text_query",
            "CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 50) / 50e0 END AS min_confidence", "s_suppkey % 3 <> 2 AS active",
        ],
        "true",
    ),
    "measures": ("events", ["event_id", "user_id", "event_type", "value"], "value IS NOT NULL"),
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, keep = BINDINGS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(keep).selectExpr(*columns)


def sql(query: str) -> str:
    """``query`` with the bindings that it names as common tables in front."""
    used = [f"{n} AS (SELECT {', '.join(c)} FROM {t} WHERE {w})" for n, (t, c, w) in BINDINGS.items() if f"{{{n}}}" in query]
    for n in BINDINGS:
        query = query.replace(f"{{{n}}}", n)
    query = query.strip()
    if not used:
        return query
    if query.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(used)}, {query[15:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {', '.join(used)}, {query[5:]}"
    return f"WITH {', '.join(used)} {query}"
