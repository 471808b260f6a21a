"""Queries of clusters, comparisons, boxes and sampling, over the bindings, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratile.operators import clusters, density, evaluation, search
from terratile.plans.analyst import _TOP, top
from terratile.plans.imagery import _round
from terratile.plans.registry import query

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_CENTRES = f"""SELECT label, list_transform(m, lambda v: v / (sqrt(list_sum(list_transform(m, lambda w: w * w))) + 1e-9)) AS centre FROM (SELECT label, list(v ORDER BY pos) AS m FROM (
 SELECT label, pos, avg(x::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM {{vectors}}) GROUP BY ALL) GROUP BY label)"""
_NEAR = f"""SELECT vec_id, label, s, row_number() OVER w AS rk, lead(s) OVER w AS next FROM (SELECT v.vec_id, c.label, {_DOT.format(a='v.embedding', b='c.centre')} AS s FROM {{vectors}} v CROSS JOIN ({_CENTRES}) c) WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, label)"""


@query("k9_nearest_centroid", f"SELECT vec_id, CASE WHEN s < 0.3 THEN -1 ELSE label END AS assigned, round(s, 6) AS similarity, round(s - coalesce(next, 0.0), 6) AS margin FROM ({_NEAR}) WHERE rk = 1")
def _(b):
    v = b("vectors")
    return _round(clusters.assign_nearest(v, clusters.unit_centroids(v), 0.3), 6, "similarity", "margin")


_LABELS = f"SELECT v.label, n.label AS assigned, v.vec_id FROM {{vectors}} v JOIN ({_NEAR}) n ON n.vec_id = v.vec_id AND rk = 1"


def labelled(b) -> DataFrame:
    v = b("vectors")
    return v.select("vec_id", "label").join(clusters.assign_nearest(v, clusters.unit_centroids(v)).select("vec_id", "assigned"), "vec_id")


@query(
    "k11_cluster_agreement",
    f"""WITH c AS (SELECT label, assigned, count(*)::DOUBLE AS n FROM ({_LABELS}) GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS l FROM c),
    a AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS l FROM (SELECT sum(n) AS n FROM c GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS l FROM (SELECT sum(n) AS n FROM c GROUP BY assigned)),
    e AS (SELECT t.n, (t.p - a.p * b.p / (t.n * (t.n - 1) / 2)) / ((a.p + b.p) / 2 - a.p * b.p / (t.n * (t.n - 1) / 2)) AS r, ln(t.n) - a.l / t.n AS ha, ln(t.n) - b.l / t.n AS hb, ln(t.n) - t.l / t.n AS hj FROM t, a, b)
    SELECT CAST(n AS BIGINT) AS n, round(r, 6) AS adjusted_rand, round(1.0 - (hj - hb) / ha, 6) AS homogeneity, round(1.0 - (hj - ha) / hb, 6) AS completeness,
    round(2 * (1.0 - (hj - hb) / ha) * (1.0 - (hj - ha) / hb) / ((1.0 - (hj - hb) / ha) + (1.0 - (hj - ha) / hb)), 6) AS v_measure FROM e""",
)
def _(b):
    return _round(clusters.agreement(labelled(b), "label", "assigned"), 6, "adjusted_rand", "homogeneity", "completeness", "v_measure")


_AMI = """WITH c AS (SELECT label, assigned, count(*)::DOUBLE AS n FROM ({src}) GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n * ln(n)) AS l FROM c), a AS (SELECT sum(n) AS n FROM c GROUP BY label), b AS (SELECT sum(n) AS n FROM c GROUP BY assigned),
    h AS (SELECT ln(n) - (SELECT sum(n * ln(n)) FROM a) / n AS ha, ln(n) - (SELECT sum(n * ln(n)) FROM b) / n AS hb, ln(n) - l / n AS hj, n FROM t),
    m AS (SELECT a.n AS x, b.n AS y, h.n AS s, unnest(range(CAST(greatest(1, a.n + b.n - h.n) AS BIGINT), CAST(least(a.n, b.n) AS BIGINT) + 1))::DOUBLE AS k FROM a, b, h),
    e AS (SELECT sum(k / s * ln(s * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(s - x + 1) + lgamma(s - y + 1) - lgamma(s + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(s - x - y + k + 1))) AS e FROM m)
    SELECT CAST(n AS BIGINT) AS n, (ha + hb - hj - e) / ((ha + hb) / 2 - e) AS v FROM h, e"""


@query("k11_adjusted_information", f"SELECT n, round(v, 6) AS adjusted_information FROM ({_AMI.format(src=_LABELS)})")
def _(b):
    return _round(clusters.adjusted_information(labelled(b), "label", "assigned"), 6, "adjusted_information")


_SWEEP = [0.1, 0.3, 0.35]
_ABSTAINED = f"SELECT v.label, CASE WHEN n.s < {{tau}} THEN -1 ELSE n.label END AS assigned FROM {{{{vectors}}}} v JOIN ({_NEAR}) n ON n.vec_id = v.vec_id AND rk = 1".replace("{{vectors}}", "{vectors}")


@query(
    "k11_abstention_sweep",
    " UNION ALL ".join(f"SELECT {tau}::DOUBLE AS threshold, (SELECT round(avg((assigned = -1)::INT), 6) FROM ({_ABSTAINED.replace('{tau}', str(tau))})) AS noise_share, round(v, 6) AS adjusted_information FROM ({_AMI.replace('{src}', _ABSTAINED.replace('{tau}', str(tau)))})" for tau in _SWEEP),
)
def _(b):
    v = b("vectors")
    rows = v.select("vec_id", "label").join(clusters.assign_nearest(v, clusters.unit_centroids(v)).select("vec_id", "assigned", "similarity"), "vec_id")
    return _round(clusters.abstention_sweep(rows, "label", "assigned", "similarity", _SWEEP), 6, "noise_share", "adjusted_information").select("threshold", "noise_share", "adjusted_information")


@query(
    "d15_region_purity",
    """SELECT label, CAST(sum(m) AS BIGINT) AS size, arg_min(region, (-m, region)) AS dominant, round(max(m) / sum(m), 4) AS purity, count(*) AS n_regions FROM (SELECT label, concat('r', vec_id % 5) AS region, count(*) AS m FROM {vectors} GROUP BY ALL) GROUP BY label""",
)
def _(b):
    rows = b("vectors").select("label", F.concat(F.lit("r"), (F.col("vec_id") % 5).cast("string")).alias("region"))
    return clusters.purity(rows, "label", "region")


@query("d14_cluster_per_observation", "SELECT vec_id % 20 AS observation_id, label, count(*) AS n FROM {vectors} GROUP BY ALL")
def _(b):
    return b("vectors").groupBy((F.col("vec_id") % 20).alias("observation_id"), "label").agg(F.count("*").alias("n"))


_COARSE = "list_transform(embedding, lambda x: round(x::DOUBLE * 64) / 64)"


@query(
    "k4_embedding_comparison",
    f"""WITH p AS (SELECT CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE) ELSE {_COARSE} END AS v, list_transform(embedding, lambda x: x::DOUBLE) AS u FROM {{vectors}}),
    g AS (SELECT u, v, list_transform(list_zip(u, v), lambda z: abs(z[1] - z[2])) AS d FROM p)
    SELECT count(*) AS n, round(avg((u = v)::INT), 6) AS identical, round(max(list_max(d)), 6) AS max_diff, round(sum(list_sum(d)) / sum(len(u)), 6) AS mean_diff,
    round(min({_DOT.format(a='u', b='v')} / sqrt({_DOT.format(a='u', b='u')} * {_DOT.format(a='v', b='v')})), 6) AS min_cosine, round(avg({_DOT.format(a='u', b='v')} / sqrt({_DOT.format(a='u', b='u')} * {_DOT.format(a='v', b='v')})), 6) AS mean_cosine FROM g""",
)
def _(b):
    old = b("vectors").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    coarse = F.transform("embedding", lambda x: F.round(x * 64) / 64)
    new = old.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).otherwise(coarse).alias("embedding"))
    return _round(clusters.compare_embeddings(old, new), 6, "identical", "max_diff", "mean_diff", "min_cosine", "mean_cosine")


# ---- metrics

_GRADED = "SELECT observation_id AS q, CASE WHEN cloud < 0.1 THEN 2 WHEN cloud < 0.3 THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY observation_id ORDER BY row_no, tile_id) AS rk FROM {tiles}"


@query(
    "l3_judged_metrics",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g DESC, rk) AS best FROM ({_GRADED})),
    s AS (SELECT q, count(*) AS n, count(*) FILTER (g > 0) AS rel, count(*) FILTER (g > 0 AND rk <= 5) AS hits, count(*) FILTER (g = 2 AND rk <= 5) AS strict, sum(g / log2(rk + 1)) FILTER (rk <= 5) AS dcg, sum(g / log2(best + 1)) FILTER (best <= 5) AS idcg FROM r GROUP BY q)
    SELECT q AS query_id, n AS n_candidates, rel AS n_relevant, hits / 5 AS precision, CASE WHEN rel > 0 THEN round(hits / rel, 6) ELSE 0.0 END AS recall, CASE WHEN rel > 0 THEN round(hits / least(rel, 5), 6) ELSE 0.0 END AS recall_capped,
    CASE WHEN idcg > 0 THEN round(dcg / idcg, 6) ELSE 0.0 END AS ndcg, strict / 5 AS precision_strict, CASE WHEN rel > 0 THEN round(hits / 5 * n / rel, 6) END AS lift FROM s""",
)
def _(b):
    order = Window.partitionBy("observation_id").orderBy("row_no", "tile_id")
    grade = F.when(F.col("cloud") < 0.1, 2).when(F.col("cloud") < 0.3, 1).otherwise(0)
    ranked = b("tiles").select(F.col("observation_id").alias("query_id"), grade.alias("grade"), F.row_number().over(order).alias("rank"))
    return _round(evaluation.judged_metrics(ranked, 5), 6, "recall", "recall_capped", "ndcg", "lift")


_TAUS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]


@query(
    "l8_threshold_curve",
    f"""WITH t AS (SELECT r.query_id, r.rank, r.score, r.vec_id % 10 = r.query_id // 100 % 10 AS hit FROM ({_TOP}) r), k AS (SELECT unnest({_TAUS}) AS tau),
    m AS (SELECT tau, t.*, max((score < tau)::INT) OVER (PARTITION BY query_id, tau ORDER BY rank) AS weak FROM t CROSS JOIN k), s AS (SELECT tau, query_id, avg(hit::INT) AS p, sum(hit::INT) AS h FROM m WHERE weak = 0 GROUP BY ALL),
    c AS (SELECT k.tau, avg(coalesce(p, 0.0)) AS precision, avg(coalesce(h, 0) / 5) AS recall FROM (SELECT DISTINCT query_id FROM t) q CROSS JOIN k LEFT JOIN s ON s.tau = k.tau AND s.query_id = q.query_id GROUP BY k.tau)
    SELECT tau::DOUBLE AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0.0 END AS f1 FROM c""",
)
def _(b):
    ranked = top(b).withColumn("hit", F.col("vec_id") % 10 == F.floor(F.col("query_id") / 100) % 10)
    seeds = b("vectors").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit(5).alias("n_relevant"))
    return _round(evaluation.threshold_curve(ranked, seeds, _TAUS), 6, "precision", "recall", "f1")


_MEASURED = """SELECT concat('user', user_id, '.', CASE event_type WHEN 'view' THEN 'latency_p50' WHEN 'click' THEN 'recall' WHEN 'error' THEN 'fn' ELSE event_type END) AS path, avg(value) AS value, CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END AS band
 FROM {{measures}} WHERE event_id % 2 = {i} GROUP BY ALL"""


@query(
    "l12_snapshot_diff",
    f"""WITH d AS (SELECT coalesce(a.path, b.path) AS path, a.value AS base, b.value AS cand, b.value - a.value AS delta, CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN greatest(a.band, b.band) END AS band0, greatest(a.band, b.band) AS band,
     split_part(coalesce(a.path, b.path), '.', 2) AS last FROM ({_MEASURED.format(i=0)}) a FULL JOIN ({_MEASURED.format(i=1)}) b ON a.path = b.path)
    SELECT path, round(base, 5) AS base, round(cand, 5) AS cand, round(delta, 5) AS delta, CASE WHEN base <> 0 THEN round(delta / abs(base), 5) END AS relative, round(band, 5) AS band,
    CASE WHEN cand IS NULL THEN 'only_in_baseline' WHEN base IS NULL THEN 'only_in_candidate' WHEN band IS NULL THEN 'no_band' WHEN abs(delta) <= band THEN 'within_noise'
    WHEN last = 'recall' THEN (CASE WHEN delta > 0 THEN 'improved' ELSE 'regressed' END) WHEN last IN ('fn', 'latency_p50') THEN (CASE WHEN delta < 0 THEN 'improved' ELSE 'regressed' END) ELSE 'changed' END AS verdict FROM d""",
)
def _(b):
    name = F.when(F.col("event_type") == "view", "latency_p50").when(F.col("event_type") == "click", "recall").when(F.col("event_type") == "error", "fn").otherwise(F.col("event_type"))
    rows = b("measures").withColumn("path", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("."), name))
    spread = F.when(F.count("*") > 1, F.stddev_samp("value") / F.sqrt(F.count("*")))
    half = lambda i: rows.where(F.col("event_id") % 2 == i).groupBy("path").agg(F.avg("value").alias("value"), spread.alias("band"))
    return _round(evaluation.snapshot_diff(half(0), half(1)), 5, "base", "cand", "delta", "relative", "band")


_POINTS = [0.2, 0.5, 0.8]


@query(
    "l16_operating_points",
    f"""SELECT class_id, threshold, n_true, tp, fp, n_true - tp AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(n_true, 0), 6) AS recall, round(2 * tp / nullif(tp + fp + n_true, 0), 6) AS f1 FROM (
    SELECT class_id, t::DOUBLE AS threshold, count(*) FILTER (hit) AS n_true, count(*) FILTER (hit AND score >= t) AS tp, count(*) FILTER (NOT hit AND score >= t) AS fp FROM {{detections}} CROSS JOIN (SELECT unnest({_POINTS}::DOUBLE[]) AS t) GROUP BY ALL)""",
)
def _(b):
    return _round(evaluation.operating_points(b("detections"), _POINTS), 6, "precision", "recall", "f1")


@query(
    "l16_best_f1",
    """SELECT class_id, f1, score FROM (SELECT class_id, score, round(2 * tp / (n + total), 6) AS f1 FROM (SELECT class_id, score, sum(hit::INT) OVER w AS tp, row_number() OVER w AS n, sum(hit::INT) OVER (PARTITION BY class_id) AS total FROM {detections}
    WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, det_id))) QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY f1 DESC, score DESC) = 1""",
)
def _(b):
    return evaluation.best_f1(b("detections"))


# ---- boxes

_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
_IOU = f"{_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER})"


@query(
    "c19_best_matches",
    f"""SELECT a.box_id, m.truth_id, coalesce(round(m.iou, 6), 0.0) AS iou FROM (SELECT DISTINCT * FROM {{boxes}}) a LEFT JOIN (SELECT a.box_id, b.truth_id, {_IOU} AS iou FROM (SELECT DISTINCT * FROM {{boxes}}) a JOIN {{truths}} b ON a.image_id = b.image_id AND a.class_id = b.class_id
    WHERE {_INTER} > 0 QUALIFY row_number() OVER (PARTITION BY a.box_id ORDER BY iou DESC, truth_id) = 1) m USING (box_id)""",
)
def _(b):
    return _round(evaluation.best_matches(b("boxes").distinct(), b("truths")), 6, "iou")


@query(
    "l19_merge_across_chips",
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, box_id) AS rk FROM (SELECT DISTINCT * FROM {{boxes}})),
    g AS (SELECT DISTINCT image_id, class_id, 0::BIGINT AS rk, 0::BIGINT AS box_id, false AS kept, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, chip_id BIGINT)[] AS held FROM o
    UNION ALL SELECT a.image_id, a.class_id, a.rk, a.box_id, ok, CASE WHEN ok THEN list_append(held, {{{{'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': a.y1, 'chip_id': a.chip_id}}}}) ELSE held END
     FROM g JOIN o a ON a.image_id = g.image_id AND a.class_id = g.class_id AND a.rk = g.rk + 1, LATERAL (SELECT len(list_filter(held, lambda b: b.chip_id <> a.chip_id AND {_IOU} > 0.3)) = 0 AS ok))
    SELECT box_id, image_id, class_id FROM g WHERE kept""".replace("{{'x0'", "{'x0'").replace("chip_id}}", "chip_id}"),
)
def _(b):
    return evaluation.merge_across_chips(b("boxes").distinct(), 0.3).select("box_id", "image_id", "class_id")


@query(
    "m5_repeat_factors",
    """WITH p AS (SELECT DISTINCT chip_id, class_id FROM {chips}), f AS (SELECT class_id, greatest(1.0, sqrt(0.25 * (SELECT count(DISTINCT chip_id) FROM {chips}) / count(*))) AS r FROM p GROUP BY class_id)
    SELECT chip_id, round(max(r), 6) AS factor FROM p JOIN f USING (class_id) GROUP BY chip_id""",
)
def _(b):
    return _round(evaluation.repeat_factors(b("chips")), 6, "factor")


@query(
    "s3_neighbour_overlap",
    f"""WITH a AS ({_TOP}), b AS (SELECT s.vec_id AS query_id, v.vec_id FROM (SELECT vec_id, {_COARSE} AS e FROM {{vectors}}) v JOIN (SELECT vec_id, {_COARSE} AS e FROM {{vectors}}) s ON s.vec_id % 100 = 0 AND s.vec_id <> v.vec_id
     QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY {_DOT.format(a='v.e', b='s.e')} DESC, v.vec_id) <= 10)
    SELECT a.query_id, count(b.vec_id) AS shared, count(b.vec_id) / count(*) AS overlap FROM a LEFT JOIN b USING (query_id, vec_id) GROUP BY a.query_id""",
)
def _(b):
    v = b("vectors").withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 64) / 64))
    coarse = search.top_k(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)
    met = top(b).select("query_id", "vec_id").join(coarse.select("query_id", "vec_id", F.lit(1).alias("both")), ["query_id", "vec_id"], "left")
    return met.groupBy("query_id").agg(F.count("both").alias("shared"), (F.count("both") / F.count("*")).alias("overlap"))


# ---- density clusters

_NEAR3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    "k6_density_clusters",
    f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM {{vectors}}),
    c AS MATERIALIZED (SELECT vec_id, d AS core FROM (SELECT a.vec_id, {_NEAR3} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_NEAR3}) AS rk FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE rk = 5 AND d <= 0.055),
    e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {_NEAR3} <= 0.055 AND a.vec_id IN (SELECT vec_id FROM c) AND b.vec_id IN (SELECT vec_id FROM c)),
    r AS (SELECT vec_id AS n, vec_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n),
    k AS (SELECT n, min(root) AS root FROM r GROUP BY n), s AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS cluster FROM k GROUP BY root HAVING count(*) >= 8)
    SELECT v.vec_id, CAST(coalesce(s.cluster, -1) AS INT) AS cluster, round(c.core, 6) AS core FROM v LEFT JOIN c ON c.vec_id = v.vec_id LEFT JOIN k ON k.n = v.vec_id LEFT JOIN s ON s.root = k.root""",
)
def _(b):
    v = b("vectors").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("embedding"))
    return _round(density.density_clusters(v, 5, 0.055, 8), 6, "core")
