"""The numbered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratile.llm import chat, decontaminate, divergence, hard_negatives, language, licenses, pieces, quality_crf, quality_rules, simhash, token_files, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_read(spark, sf_dir, "documents"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat.formatted_conversations(turns.union(more))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.sampled_pieces(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"), "lossless", "ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.relabelled(_read(spark, sf_dir, "embeddings")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_files, op2_warc, op3_simhash, op4_licenses, op5_decontamination,
        op6_language, op7_quality_crf, op8_chat, op9_pieces, op10_quality_rules, op11_hard_negatives, op12_divergence, op13_toxicity,
    )
    return {f.__name__: f for f in found}


def _words(text: str) -> str:
    """The words of the license scan as a list, in DuckDB."""
    return (
        f"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    )


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
big AS (SELECT d, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN big.d IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN big.d IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN big ON p.d = big.d
"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, t, {_words("t")} AS w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
i AS (SELECT row_number() OVER () AS item_no, item_id, w, least(len(w), 5) AS l FROM (SELECT item_id, {_words("t")} AS w FROM (SELECT DISTINCT item_id, coalesce(text, '') AS t FROM benchmark)) WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, t, l, array_to_string(list_slice(w, k, k + l - 1), ' ') AS s FROM
 (SELECT doc_id, t, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)),
si AS (SELECT DISTINCT item_no, item_id, l, array_to_string(list_slice(w, k, k + l - 1), ' ') AS s FROM (SELECT item_no, item_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM i)),
n AS (SELECT item_no, count(*) AS n_item FROM si GROUP BY item_no)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN si ON ds.s = si.s AND ds.l = si.l JOIN n USING (item_no)
GROUP BY doc_id, t, item_no, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""

HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT lang, source, no, t, count(*) AS n FROM (SELECT lang, source, no, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, sum(n)::BIGINT AS n_all FROM c GROUP BY lang, t HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n_all)::BIGINT AS n_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT c.lang, c.source, c.t, sum(c.n)::BIGINT AS n FROM c JOIN k USING (lang, t) GROUP BY ALL),
z AS (SELECT lang, source, sum(n)::BIGINT AS total FROM s GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.t, coalesce(s.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (coalesce(z.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n_all + 5)) // (l.n_lang + 5 * l.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN z ON z.lang = g.lang AND z.source = g.source
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.t = k.t),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM a JOIN a b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(m.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
      LEFT JOIN m ON m.lang = g.lang AND m.source = g.source AND m.item = h.source
      UNION ALL SELECT lang, source, 'term', t, p - q FROM a WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_divergence": DIVERGENCE_SQL}
