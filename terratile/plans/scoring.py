"""Queries of relevance rules, resampled intervals, curves, explanations and training sets, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terratile.operators import change, evaluation, scoring, search
from terratile.plans.queries import AGREE, ANOMALIES, DOWNWEIGHT, PERSISTENCE, REGISTRATION, SAR, SPECTRAL, SUPPRESSED, TYPE, scored
from terratile.plans.registry import QUERIES, query

# ---- relevance and averages over queries

_FIELDS = {
    "water_frac": "(tile_id * 7 % 200) / 1000e0", "dist_water_m": "(tile_id * 13 % 900) * 1e0", "dist_river_m": "(tile_id * 29 % 2000) * 1e0", "bare_frac": "(tile_id * 11 % 500) / 1000e0", "built_frac": "(tile_id * 17 % 600) / 1000e0",
    "edge_density": "(tile_id * 3 % 350) / 1000e0", "ndvi_p50": "(tile_id * 19 % 800) / 1000e0", "ndvi_p10": "(tile_id * 23 % 400) / 1000e0", "ndwi_p90": "(tile_id * 5 % 500) / 1000e0 - 0.5e0", "dense_veg_frac": "(tile_id * 31 % 800) / 1000e0",
}


def _rule_sql(kind: str) -> str:
    cases = []
    for value, ranges in scoring.GROUND[kind]:
        tests = [f"{f} {op} {v}" for f, (low, high) in ranges.items() for op, v in ((">=", low), ("<=", high)) if v is not None]
        cases.append(f"WHEN {' AND '.join(tests)} THEN {value}")
    return f"CASE WHEN NOT usable THEN 0 {' '.join(cases)} ELSE 0 END"


_DESCRIBED = f"SELECT tile_id, tile_id % 11 <> 0 AS usable, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM {{tiles}}"
_GRADES = " UNION ALL ".join(f"SELECT tile_id, '{q}' AS query, {_rule_sql(kind)} AS grade FROM d" for q, kind in scoring.QUERIES.items())


@query("l1_relevance_grades", f"WITH d AS ({_DESCRIBED}) SELECT query, grade, count(*) AS n, sum(tile_id) AS ids FROM ({_GRADES}) GROUP BY query, grade")
def _(b):
    tiles = b("tiles").selectExpr("tile_id", "tile_id % 11 <> 0 AS usable", *[f"{v} AS {k}" for k, v in _FIELDS.items()])
    return scoring.relevance_grades(tiles).groupBy("query", "grade").agg(F.count("*").alias("n"), F.sum("tile_id").alias("ids"))


_RANKED = """SELECT observation_id AS query_id, tile_id, cloud, row_no, CASE WHEN tile_id % 5 = 0 THEN NULL WHEN cloud < 0.1 THEN 2 WHEN cloud < 0.3 THEN 1 ELSE 0 END AS grade, row_number() OVER (PARTITION BY observation_id ORDER BY row_no, tile_id) AS rank FROM {tiles}"""


def ranked(b):
    order = Window.partitionBy("observation_id").orderBy("row_no", "tile_id")
    grade = F.when(F.col("tile_id") % 5 == 0, None).when(F.col("cloud") < 0.1, 2).when(F.col("cloud") < 0.3, 1).otherwise(0)
    return b("tiles").select(F.col("observation_id").alias("query_id"), "tile_id", "cloud", "row_no", grade.alias("grade"), F.row_number().over(order).alias("rank"))


@query(
    "l4_macro_means",
    f"""WITH m AS (SELECT query_id, count(*) FILTER (grade > 0 AND rank <= 5) / 5 AS precision FROM ({_RANKED}) WHERE grade IS NOT NULL OR rank <= 5 GROUP BY query_id), s AS (SELECT 'all' AS subset, query_id FROM m UNION ALL SELECT 'core', query_id FROM m WHERE query_id % 3 = 0)
    SELECT subset, count(*) AS n_queries, round(avg(precision), 6) AS precision FROM m JOIN s USING (query_id) GROUP BY subset""",
)
def _(b):
    metrics = ranked(b).where("grade IS NOT NULL OR rank <= 5").groupBy("query_id").agg((F.count_if((F.col("grade") > 0) & (F.col("rank") <= 5)) / 5).alias("precision"))
    subsets = metrics.select(F.lit("all").alias("subset"), "query_id").union(metrics.where("query_id % 3 = 0").select(F.lit("core"), "query_id"))
    return scoring.macro_means(metrics, subsets, ["precision"]).withColumn("precision", F.round("precision", 6))


@query(
    "l6_top_composition",
    f"""SELECT CASE WHEN grade > 0 THEN 'judged_relevant' WHEN grade = 0 THEN 'judged_zero' WHEN row_no < 20 THEN 'unjudged_home' ELSE 'unjudged_other' END AS bucket, round(count(*) / (5 * (SELECT count(DISTINCT observation_id) FROM {{tiles}})), 6) AS share FROM ({_RANKED}) WHERE rank <= 5 GROUP BY 1""",
)
def _(b):
    return scoring.top_composition(ranked(b), 5, F.col("row_no") < 20).withColumn("share", F.round("share", 6))


@query(
    "l7_judged_precision",
    f"""WITH r AS ({_RANKED}), c AS (SELECT 'all' AS condition, * FROM r UNION ALL SELECT 'clear', * FROM r WHERE cloud <= 0.2 UNION ALL SELECT 'top 5', * FROM r WHERE rank <= 5),
    p AS (SELECT condition, query_id, count(*) AS size, count(grade) AS judged, count(*) FILTER (grade > 0) AS hits FROM c GROUP BY ALL)
    SELECT condition, round(avg(size), 6) AS mean_size, round(avg(hits / judged) FILTER (judged > 0), 6) AS precision, round(sum(judged) / sum(size), 6) AS share_judged FROM p GROUP BY condition""",
)
def _(b):
    out = scoring.judged_precision(ranked(b), {"all": F.lit(True), "clear": F.col("cloud") <= 0.2, "top 5": F.col("rank") <= 5})
    return out.withColumns({c: F.round(c, 6) for c in ("mean_size", "precision", "share_judged")})


@query(
    "l10_judge_coverage",
    """WITH j AS (SELECT tile_id, max(g) AS grade FROM (SELECT tile_id, CASE WHEN cloud < 0.3 THEN 1 ELSE 0 END AS g FROM {tiles} WHERE tile_id % 4 <> 0 UNION ALL SELECT tile_id, 2 FROM {tiles} WHERE tile_id % 12 = 1) GROUP BY tile_id)
    SELECT aoi_name AS region, count(*) AS n_tiles, count(grade) AS n_judged, count(*) FILTER (grade > 0) AS n_on_target, round(count(grade) / count(*), 6) AS coverage, round(count(*) FILTER (grade > 0) / count(grade), 6) AS on_target
    FROM {tiles} JOIN {observations} USING (observation_id) LEFT JOIN j USING (tile_id) GROUP BY aoi_name""",
)
def _(b):
    tiles = b("tiles").join(b("observations").select("observation_id", F.col("aoi_name").alias("region")), "observation_id")
    judged = b("tiles").where("tile_id % 4 <> 0").select("tile_id", F.when(F.col("cloud") < 0.3, 1).otherwise(0).alias("grade")).union(b("tiles").where("tile_id % 12 = 1").select("tile_id", F.lit(2)))
    return scoring.judge_coverage(tiles, judged).withColumns({c: F.round(c, 6) for c in ("coverage", "on_target")})


# ---- resampling

_DRAW = "('0x' || substr(md5(CAST({unit} AS STRING) || ':' || CAST(r AS STRING) || ':0'), 1, 8))::BIGINT / 4294967296"
_POISSON = "CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 WHEN u < 0.99940581 THEN 5 WHEN u < 0.99991675 THEN 6 ELSE 7 END"


@query(
    "l11_paired_interval",
    f"""WITH d AS (SELECT event_type, event_id AS unit, value * (event_id % 7 - 2) / 100 AS delta FROM {{measures}}), w AS (SELECT *, {_POISSON} AS w FROM (SELECT *, {_DRAW.format(unit='unit')} AS u FROM d, range(40) t(r))),
    m AS (SELECT event_type, r, sum(delta * w) / sum(w) AS m FROM w GROUP BY ALL), e AS (SELECT event_type, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
    SELECT event_type, round(avg(delta), 5) AS delta, round(low, 5) AS low, round(high, 5) AS high, round((high - low) / 2, 5) AS half_width, low > 0 OR high < 0 AS significant FROM d JOIN e USING (event_type) GROUP BY ALL""",
)
def _(b):
    units = b("measures").select("event_type", F.col("event_id").alias("unit"), F.lit(0.0).alias("base"), (F.col("value") * (F.col("event_id") % 7 - 2) / 100).alias("cand"))
    return scoring.paired_interval(units, "event_type", 40).withColumns({c: F.round(c, 5) for c in ("delta", "low", "high", "half_width")})


@query(
    "l17_resampled_ap",
    f"""WITH w AS (SELECT * FROM (SELECT *, {_POISSON} AS w FROM (SELECT d.*, r, {_DRAW.format(unit='image_id')} AS u FROM (SELECT DISTINCT * FROM {{detections}}) d, range(100) t(r))) WHERE w > 0),
    s AS (SELECT *, sum(hit::INT * w) OVER o AS tp, sum(w) OVER o AS n, sum(hit::INT * w) OVER (PARTITION BY r, class_id) AS n_true FROM w WINDOW o AS (PARTITION BY r, class_id ORDER BY score DESC, det_id)),
    e AS (SELECT *, max(tp / n) OVER (PARTITION BY r, class_id ORDER BY score, det_id DESC) AS env FROM s), a AS (SELECT r, class_id, sum(env * w / n_true) AS ap FROM e WHERE hit GROUP BY ALL)
    SELECT class_id, count(*) AS n_replicates, round(quantile_cont(ap, 0.025), 5) AS low, round(quantile_cont(ap, 0.975), 5) AS high FROM a GROUP BY class_id""",
)
def _(b):
    return scoring.resampled_ap(b("detections").distinct(), 100).withColumns({c: F.round(c, 5) for c in ("low", "high")})


# ---- curves, groups and thresholds


@query(
    "l13_reproduction",
    """WITH r AS (SELECT 'm' || CAST(label AS STRING) AS path, avg(vec_id) AS value FROM {vectors} GROUP BY label), m AS (SELECT 'm' || CAST(label AS STRING) AS path, CASE WHEN label % 5 <> 0 THEN avg(vec_id) * (1 + (label % 3) * 0.02) END AS v FROM {vectors} WHERE label % 7 <> 0 GROUP BY label)
    SELECT r.path, round(value, 6) AS reported, round(v, 6) AS measured, round(abs(v - value), 6) AS abs_diff, CASE WHEN m.path IS NULL THEN 'NOT_RUN' WHEN v IS NULL OR abs(v - value) > 0.5 + 0.03 * abs(value) THEN 'NOT_REPRODUCED' ELSE 'REPRODUCED' END AS status FROM r LEFT JOIN m USING (path)""",
)
def _(b):
    means = b("vectors").groupBy("label").agg(F.avg("vec_id").alias("value"))
    path = F.concat(F.lit("m"), F.col("label").cast("string")).alias("path")
    measured = means.where("label % 7 <> 0").select(path, F.when(F.col("label") % 5 != 0, F.col("value") * (1 + (F.col("label") % 3) * 0.02)).alias("value"))
    out = scoring.reproduction(means.select(path, "value", F.lit(0.5).alias("tol_abs"), F.lit(0.03).alias("tol_rel")), measured)
    return out.withColumns({c: F.round(c, 6) for c in ("reported", "measured", "abs_diff")})


_CURVE = """SELECT observation_id, t / 10 AS threshold, count(*) FILTER (truth AND prob >= t / 10) AS tp, count(*) FILTER (NOT truth AND prob >= t / 10) AS fp, count(*) FILTER (truth AND prob < t / 10) AS fn, count(*) FILTER (NOT truth AND prob < t / 10) AS tn
 FROM (SELECT *, z % 3 = 0 OR prob > 0.9 AS truth FROM {grid}), range(1, 10) g(t) GROUP BY ALL"""


@query(
    "l14_pixel_curve",
    f"""SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END, 6) AS f05 FROM (SELECT observation_id, round(threshold, 1) AS threshold, tp, fp, fn, tn,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr FROM ({_CURVE}))""",
)
def _(b):
    pixels = b("grid").select("observation_id", F.col("prob").alias("score"), ((F.col("z") % 3 == 0) | (F.col("prob") > 0.9)).alias("truth"))
    out = scoring.pixel_curve(pixels, [t / 10 for t in range(1, 10)], "observation_id").withColumnsRenamed({"precision": "p", "recall": "r"})
    return out.withColumns({c: F.round(c, 6) for c in ("f1", "f05", "iou", "fpr")} | {"threshold": F.round("threshold", 1)})


_AP = """WITH r AS (SELECT class_id, hit, sum(hit::INT) OVER w / count(*) OVER w AS p, score, det_id FROM (SELECT DISTINCT * FROM {detections}) WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, det_id)),
 e AS (SELECT class_id, hit, max(p) OVER (PARTITION BY class_id ORDER BY score, det_id DESC) AS env FROM r), a AS (SELECT class_id, count(*) AS n_true, sum(env) / count(*) AS ap FROM e WHERE hit GROUP BY class_id)"""


@query(
    "l18_group_summary",
    _AP + """ SELECT g AS "group", count(*) AS n_classes, sum(n_true) AS n_true, round(avg(ap), 5) AS macro_ap, round(sum(ap * n_true) / sum(n_true), 5) AS weighted_ap FROM (SELECT *, 'all' AS g FROM a UNION ALL SELECT *, CASE WHEN class_id % 2 = 0 THEN 'even' ELSE 'odd' END FROM a) GROUP BY g""",
)
def _(b):
    per_class = search.average_precision(b("detections").distinct())
    ids = per_class.select("class_id")
    groups = ids.select(F.lit("all").alias("group"), "class_id").union(ids.select(F.when(F.col("class_id") % 2 == 0, "even").otherwise("odd"), "class_id"))
    return scoring.group_summary(per_class, groups).withColumns({c: F.round(c, 5) for c in ("macro_ap", "weighted_ap")})


_POINTS = """SELECT class_id, threshold, count(*) FILTER (hit AND score >= threshold) AS tp, count(*) FILTER (NOT hit AND score >= threshold) AS fp, count(*) FILTER (hit AND score < threshold) AS fn FROM {src}, (VALUES (0.1), (0.3), (0.5), (0.7)) v(threshold) GROUP BY ALL"""


@query(
    "l22_operating_grid",
    f"SELECT threshold::DOUBLE AS threshold, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({_POINTS.replace('{src}', '{detections}')}) GROUP BY threshold",
)
def _(b):
    return scoring.operating_grid(evaluation.operating_points(b("detections"), [0.1, 0.3, 0.5, 0.7])).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    "l21_tuned_report",
    f"""WITH i AS (SELECT image_id, row_number() OVER (ORDER BY md5(CAST(image_id AS STRING) || ':3'), image_id) <= floor((SELECT count(*) FROM {{images}}) / 2) AS tune FROM {{images}}), d AS (SELECT d.*, tune FROM {{detections}} d JOIN i USING (image_id)),
    a AS ({_POINTS.replace('{src}', '(SELECT * FROM d WHERE tune)')}), k AS (SELECT class_id, threshold FROM a QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) DESC, threshold) = 1), t AS ({_POINTS.replace('{src}', '(SELECT * FROM d WHERE NOT tune)')})
    SELECT class_id, threshold::DOUBLE AS threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM t JOIN k USING (class_id, threshold)""",
)
def _(b):
    out = scoring.tuned_report(b("detections"), b("images").select("image_id"), [0.1, 0.3, 0.5, 0.7], 3)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- explanations

_SCORED = f"SELECT *, {SPECTRAL} AS spectral, {AGREE} AS agree FROM (SELECT *, {TYPE} AS change_type FROM ({ANOMALIES}))"
_TERMS = f"""SELECT candidate_id, unnest([{{{{'name': 'model', 'value': least(greatest((mean_prob - 0.5) / 0.47, 0.0), 1.0)::DOUBLE, 'w': 2.0}}}}, {{{{'name': 'persistence', 'value': (CASE candidate_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.20 WHEN 2 THEN 0.55 ELSE 0.75 END)::DOUBLE, 'w': 2.0}}}},
 {{{{'name': 'spectral', 'value': spectral::DOUBLE, 'w': 1.5}}}}, {{{{'name': 'quality', 'value': least(greatest(least(valid_fraction, 1.0 - greatest(bad_earlier, bad_later) / 0.05), 0.0), 1.0)::DOUBLE, 'w': 1.5}}}}, {{{{'name': 'registration', 'value': ({REGISTRATION})::DOUBLE, 'w': 1.0}}}}, {{{{'name': 'radiometric', 'value': least(reliability, 1.0)::DOUBLE, 'w': 1.0}}}},
 {{{{'name': 'gates', 'value': ({DOWNWEIGHT})::DOUBLE, 'w': 0.0}}}}, {{{{'name': 'penalty', 'value': (CASE candidate_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.85 ELSE 1.0 END)::DOUBLE, 'w': 0.0}}}}, {{{{'name': 'sar', 'value': ({SAR})::DOUBLE, 'w': 0.0}}}}]) AS t FROM ({_SCORED})""".replace("{{", "{").replace("}}", "}")


@query(
    "j13_confidence_parts",
    f"""WITH p AS (SELECT candidate_id, t.name AS name, t.value AS value, t.w::DOUBLE AS w, CASE WHEN t.w > 0 THEN pow(greatest(t.value, 0.001), t.w / 9.0) ELSE t.value END AS f FROM ({_TERMS})), r AS (SELECT candidate_id, exp(sum(ln(f))) AS raw FROM (SELECT DISTINCT * FROM p) GROUP BY candidate_id)
    SELECT name, count(*) AS n, sum(round(value * 1e6)::BIGINT) AS value, sum(round(f * 1e6)::BIGINT) AS factor, sum(round(1e6 * (least(raw, 1) - least(raw / f, 1)))::BIGINT) AS effect, true AS reproduces FROM (SELECT * FROM p WHERE candidate_id NOT IN (SELECT candidate_id FROM {{candidates}} GROUP BY 1 HAVING count(*) > 1)) JOIN r USING (candidate_id) GROUP BY name""",
)
def _(b):
    once = b("candidates").groupBy("candidate_id").count().where("count = 1").select("candidate_id")  # the given ids repeat; a repeated one has no single product
    rows = scored(b).withColumn("persistence", F.expr(PERSISTENCE)).join(once, "candidate_id", "left_semi")
    parts = scoring.explained(rows.withColumn("confidence", change.confidence()))
    return parts.groupBy("name").agg(F.count("*").alias("n"), *[F.sum(F.round(F.col(c) * m).cast("long")).alias(c) for c, m in (("value", 1e6), ("factor", 1e6), ("effect", 1e4))], F.min("reproduces").alias("reproduces"))


_TESTS = " UNION ALL ".join(
    f"SELECT candidate_id, '{kind}' AS type, '{test}' AS test, {met} AS met, change_type = '{kind}' AS decisive FROM s"
    for kind, test, met in [
        ("water_gain", "ndwi anomaly at least", "nw >= 0.15"), ("water_gain", "ndwi change at least", "d_ndwi >= 0.05"), ("water_loss", "ndwi anomaly at most", "nw <= -0.15"), ("water_loss", "ndvi anomaly at most", "nv <= 0.05"),
        ("road", "ndbi anomaly at least", "nb >= 0.03"), ("road", "elongation at least", "elongation >= 3"), ("construction", "ndbi anomaly at least", "nb >= 0.05"), ("construction", "ndvi anomaly at most", "nv <= 0.05"),
        ("clearance", "ndvi anomaly at most", "nv <= -0.08"), ("clearance", "ndbi anomaly below", "abs(nb) < 0.05"),
    ]
)


@query("j14_spectral_tests", f"WITH s AS ({_SCORED}) {_TESTS}")
def _(b):
    return scoring.spectral_tests(scored(b)).select("candidate_id", "type", "test", "met", "decisive")


@query(
    "j15_stage_trace",
    f"""WITH s AS ({_SCORED}), t AS (SELECT candidate_id, 0 AS step, 'morphology' AS stage, CASE WHEN area_px >= 50 THEN 'passed' ELSE 'rejected' END AS verdict FROM s
    UNION ALL SELECT candidate_id, 1, 'quality', CASE WHEN greatest(bad_earlier, bad_later) <= 0.05 AND valid_fraction >= 0.8 THEN 'passed' ELSE 'rejected' END FROM s UNION ALL SELECT candidate_id, 2, 'registration', CASE WHEN residual_px <= 0.3 THEN 'passed' ELSE 'downweighted' END FROM s
    UNION ALL SELECT candidate_id, 3, 'radiometric', CASE WHEN min_corr < 0.6 THEN 'downweighted' ELSE 'passed' END FROM s UNION ALL SELECT candidate_id, 4, 'phenology', CASE WHEN abs(nv) <= 0.10 AND abs(nb) <= 0.06 AND abs(nw) <= 0.08 THEN 'rejected' ELSE 'passed' END FROM s
    UNION ALL SELECT candidate_id, 5, 'typing', CASE WHEN change_type = 'other' THEN 'unclassified' ELSE 'typed' END FROM s UNION ALL SELECT candidate_id, 6, 'persistence', CASE candidate_id % 4 WHEN 1 THEN 'demoted' WHEN 2 THEN 'not_assessable' ELSE 'supported' END FROM s
    UNION ALL SELECT candidate_id, 7, 'sar', CASE WHEN candidate_id % 3 = 0 THEN 'unavailable' ELSE 'applied' END FROM s) SELECT * FROM t""",
)
def _(b):
    rows = scored(b).withColumn("persistence", F.expr(PERSISTENCE)).withColumn("sar_available", F.col("candidate_id") % 3 != 0)
    return scoring.stage_trace(rows).select("candidate_id", "step", "stage", "verdict")


@query(
    "j17_ablation",
    f"""WITH s AS (SELECT *, candidate_id % 3 = 0 AS truth, mean_prob >= 0.6 AS found, {SUPPRESSED} AS s FROM ({ANOMALIES})),
    k AS (SELECT CAST(pair_id AS STRING) AS pair_id, truth, 0 AS step, 'raw' AS stage, found AS keep FROM s UNION ALL SELECT CAST(pair_id AS STRING), truth, 1, 'quality', found AND s IS DISTINCT FROM 'quality' FROM s
     UNION ALL SELECT CAST(pair_id AS STRING), truth, 2, 'phenology', found AND s IS DISTINCT FROM 'quality' AND s IS DISTINCT FROM 'phenology' FROM s),
    c AS (SELECT pair_id, step, stage, count(*) FILTER (truth AND keep) AS tp, count(*) FILTER (NOT truth AND keep) AS fp, count(*) FILTER (truth AND NOT keep) AS fn, count(*) FILTER (NOT truth AND NOT keep) AS tn FROM (SELECT * FROM k UNION ALL SELECT 'pooled', truth, step, stage, keep FROM k) GROUP BY ALL)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
)
def _(b):
    rows = scored(b).withColumns({"truth": F.col("candidate_id") % 3 == 0, "found": F.col("mean_prob") >= 0.6})
    passes = lambda rule: ~F.coalesce(F.col("suppressed_by") == rule, F.lit(False))
    out = scoring.ablation(rows, {"quality": passes("quality"), "phenology": passes("phenology")}, "pair_id")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- vectors


@query(
    "k10_concept_labels",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM {vectors}), c AS (SELECT label, k, avg(x) AS x FROM e GROUP BY ALL), o AS (SELECT vec_id AS concept, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS k FROM {vectors} WHERE vec_id < 15),
    s AS (SELECT label, concept, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM c JOIN o USING (k) GROUP BY ALL) SELECT label, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, concept) AS rank, concept, cosine FROM s QUALIFY rank <= 3""",
)
def _(b):
    concepts = b("vectors").where("vec_id < 15").select(F.col("vec_id").alias("concept"), "embedding")  # fifteen stated concepts
    return scoring.concept_labels(b("vectors"), concepts)


@query("k12_projection_sample", "SELECT vec_id, label, (SELECT count(*) FROM {vectors}) AS total FROM {vectors} ORDER BY md5(CAST(vec_id AS STRING) || ':11'), vec_id LIMIT 100")
def _(b):
    return scoring.uniform_sample(b("vectors"), "vec_id", 100, 11).select("vec_id", "label", "total")


def k7_principal_components(spark, sf_dir: str):
    """The sign and basis of components are the solver's, so there is no SQL; tests compare with a singular value decomposition."""
    from terratile.plans.bindings import bind

    return scoring.principal_components(bind(spark, sf_dir, "vectors"), 10)


QUERIES["k7_principal_components"] = k7_principal_components


# ---- training sets


@query(
    "m2_label_geometry",
    """WITH p AS (SELECT box_id, x0 AS ax, y0 AS ay, x1 AS bx, y0 + s AS by_, x1 AS cx, y1 + s AS cy, x0 AS dx, y1 AS dy FROM (SELECT *, box_id % 4 * 5 AS s FROM {boxes})),
    e AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS n0, cy - by_ AS n1 FROM p), a AS (SELECT *, CASE WHEN n0 >= n1 THEN (degrees(atan2(by_ - ay, bx - ax)) + 180) % 180 ELSE 90.0 END AS angle FROM e)
    SELECT box_id, round(least(ax / 100, 1), 6) AS first_x, round(least(cy / 100, 1), 6) AS third_y, round(angle, 4) AS angle, round(least(angle % 90, 90 - angle % 90), 4) AS deviation, by_ = ay AS upright FROM a""",
)
def _(b):
    p = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    skew = F.col("box_id") % 4 * 5
    labels = b("boxes").withColumn("points", F.array(p("x0", F.col("y0")), p("x1", F.col("y0") + skew), p("x1", F.col("y1") + skew), p("x0", F.col("y1"))))
    out = scoring.label_geometry(labels, 100.0)
    return out.select("box_id", F.round(F.col("norm")[0], 6).alias("first_x"), F.round(F.col("norm")[5], 6).alias("third_y"), F.round("angle", 4).alias("angle"), F.round("deviation", 4).alias("deviation"), "upright")


@query(
    "l20_image_boxes",
    """SELECT box_id, round(cx - (abs(cos(a)) * w + abs(sin(a)) * h) / 2, 6) AS x0, round(cy - (abs(sin(a)) * w + abs(cos(a)) * h) / 2, 6) AS y0, round(cx + (abs(cos(a)) * w + abs(sin(a)) * h) / 2, 6) AS x1, round(cy + (abs(sin(a)) * w + abs(cos(a)) * h) / 2, 6) AS y1
    FROM (SELECT box_id, (x0 + x1) / 2 + chip_id * 824 AS cx, (y0 + y1) / 2 + chip_id * 100 AS cy, x1 - x0 AS w, y1 - y0 AS h, (box_id % 60) / 20e0 AS a FROM {boxes})""",
)
def _(b):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    chips = b("boxes").select("box_id", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), ((F.col("box_id") % 60) / 20).alias("angle"), (F.col("chip_id") * 824).alias("x_off"), (F.col("chip_id") * 100).alias("y_off"))
    return scoring.image_boxes(chips).select("box_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "m3_holdout",
    """WITH c AS (SELECT image_id, class_id, count(*) AS n FROM {boxes} GROUP BY ALL), t AS (SELECT class_id, sum(n) AS total FROM c GROUP BY 1), o AS (SELECT image_id, class_id, n, total FROM c JOIN t USING (class_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY total, class_id) = 1),
    f AS (SELECT *, sum(n) OVER (PARTITION BY class_id ORDER BY md5(CAST(image_id AS STRING) || ':9'), image_id) <= ceil(total * 0.2) AS held FROM o), h AS (SELECT c.class_id, sum(n) AS m FROM c WHERE image_id IN (SELECT image_id FROM f WHERE held) GROUP BY 1),
    x AS (SELECT class_id FROM h JOIN t USING (class_id) WHERE m > ceil(total * 0.2 * 1.5)) SELECT image_id, class_id, held AND class_id NOT IN (SELECT class_id FROM x) AS held FROM f""",
)
def _(b):
    return scoring.holdout(b("boxes"), 0.2, 9, 1.5)


@query(
    "m4_training_windows",
    """WITH w AS (SELECT o_orderkey AS window_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 ELSE 0 END AS n_labels, o_custkey % 5 // 4 AS n_distractors FROM orders),
    k AS (SELECT window_id, CASE WHEN n_labels BETWEEN 1 AND 30 THEN 'positive' WHEN n_labels = 0 AND n_distractors > 0 THEN 'negative_hard' WHEN n_labels = 0 THEN 'negative_random' END AS kind FROM w),
    s AS (SELECT count(*) FILTER (kind = 'positive') AS p, count(*) FILTER (kind = 'negative_hard') AS h, count(*) FILTER (kind = 'negative_random') AS e FROM k), g AS (SELECT round(p * 0.12) AS b, h, e FROM s), t AS (SELECT b, h, least(e, b - least(h, round(b * 0.5))) AS te FROM g),
    r AS (SELECT window_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(window_id AS STRING) || ':2'), window_id) AS k FROM k WHERE kind IS NOT NULL)
    SELECT window_id, kind FROM r, t WHERE kind = 'positive' OR r.k <= CASE WHEN kind = 'negative_hard' THEN least(h, b - te) ELSE te END""",
)
def _(b):
    windows = b("tiles").select(F.col("tile_id").alias("window_id"), F.when(F.col("tile_id") % 3 == 0, F.col("observation_id") % 40).otherwise(0).alias("n_labels"), F.floor(F.col("observation_id") % 5 / 4).alias("n_distractors"))
    return scoring.training_windows(windows, 0.12, 0.5, 30, 2)


@query(
    "m6_conversion_faults",
    """WITH i AS (SELECT DISTINCT image_id FROM {boxes}), l AS (SELECT image_id, box_id FROM {boxes} WHERE image_id % 10 <> 3) SELECT 'image_without_labels' AS rule, (SELECT count(*) FROM i WHERE image_id % 10 = 3) AS n UNION ALL SELECT 'labels_without_image', (SELECT count(DISTINCT image_id) FROM l WHERE image_id % 10 = 4)
    UNION ALL SELECT 'not_nine_fields', (SELECT count(*) FROM l WHERE box_id % 17 = 0) UNION ALL SELECT 'value_out_of_range', (SELECT count(*) FROM l WHERE box_id % 17 <> 0 AND box_id % 13 = 0) UNION ALL SELECT 'unknown_class', (SELECT count(*) FROM l WHERE box_id % 19 = 0)
    UNION ALL SELECT 'image_in_two_splits', (SELECT count(*) FROM i WHERE image_id % 10 <> 4 AND image_id % 7 = 0)""",
)
def _(b):
    ids = b("boxes").select("image_id").distinct().where("image_id % 10 <> 4")
    images = ids.withColumn("split", F.lit("train")).union(ids.where("image_id % 7 = 0").withColumn("split", F.lit("val")))
    kind = F.when(F.col("box_id") % 19 == 0, "9").otherwise("3")
    last = F.when(F.col("box_id") % 13 == 0, "1.5").otherwise("0.5")
    line = F.when(F.col("box_id") % 17 == 0, F.concat(kind, F.lit(" 0.1 0.2"))).otherwise(F.concat(kind, F.lit(" 0.1 0.1 0.4 0.1 0.4 0.3 0.1 "), last))
    return scoring.conversion_faults(images, b("boxes").where("image_id % 10 <> 3").select("image_id", line.alias("line")))


@query(
    "m7_repeat_list",
    "WITH c AS (SELECT o_orderkey AS chip_id, unnest(range(1, o_orderkey % 3 + 2)) AS copy FROM orders) SELECT row_number() OVER (ORDER BY md5(CAST(chip_id AS STRING) || ':' || CAST(copy AS STRING) || ':4'), chip_id, copy) AS place, chip_id, copy FROM c",
)
def _(b):
    return scoring.repeat_list(b("tiles").select(F.col("tile_id").alias("chip_id"), (F.col("tile_id") % 3 + 1).alias("repeats")), 4)


@query(
    "d24_split_report",
    """SELECT CAST(o_orderkey % 3 AS STRING) AS split, count(DISTINCT o_custkey) AS n_images, count(*) AS n_chips, count(*) FILTER (o_orderkey % 5 > 0) AS n_positive, count(*) FILTER (o_orderkey % 5 = 0) AS n_negative, sum(o_orderkey % 5) AS n_labels, sum(o_orderkey % 5 + o_custkey % 2) AS n_original,
    min((o_custkey % 5) * 0.5e0) AS least_gsd, max((o_custkey % 5) * 0.5e0) AS most_gsd, round(100 * sum(o_orderkey % 5) / sum(o_orderkey % 5 + o_custkey % 2), 2) AS retained_pct, round(sum(o_orderkey % 5) / count(*) FILTER (o_orderkey % 5 > 0), 4) AS density FROM orders GROUP BY 1""",
)
def _(b):
    t, o = F.col("tile_id"), F.col("observation_id")
    chips = b("tiles").select((t % 3).cast("string").alias("split"), o.alias("image_id"), (t % 5).alias("n_labels"), (t % 5 + o % 2).alias("n_original"), (o % 5 * 0.5).alias("gsd"))
    return scoring.split_report(chips)
