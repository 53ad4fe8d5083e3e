"""Queries over the given tables, one for each operator; production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embed_dedup, exact_dedup, hard_negatives, html_blocks, lang_mix, mpeg, ngram_join, packing, raking, secret_scan, toxicity, url_rules

#: The rule list that op3 applies (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_mix.identify(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix_report(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_columns(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.shifted_labels(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_of_damaged(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


_ALL = (op1_ngram_jaccard, op2_html_text, op3_url_rules, op4_language, op5_source_mixing, op6_embedding_dedup, op7_toxicity, op8_secrets, op9_mpeg_media, op10_packing, op11_hard_negatives, op12_conversation_repair, op13_exact_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL_SQL = f"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r(verdict, h, p) AS (VALUES {", ".join(map(str, URL_RULES))}),
 m AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS n
 FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
 SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND n = 1"""


def _spans_sql(rank: int, kind: str, pattern: str, least: int) -> str:
    q = pattern.replace("'", "''")
    whole, value = f"regexp_extract_all(t, '{q}')", f"regexp_extract_all(t, '{q}', 1)" if least else "h"
    row = f"{{'s': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT, 'r': {rank}, 'k': '{kind}', 'n': length(h[i]), 'v': length(v[i])}}"
    return f"(SELECT doc_id, list_filter(list_transform(range(1, len(h) + 1), lambda i: {row}), lambda z: z.v >= {least or 1}) AS z FROM (SELECT doc_id, g, h, {value} AS v FROM (SELECT doc_id, t, regexp_split_to_array(t, '{q}') AS g, {whole} AS h FROM d)))"


_SECRET_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS {_spans_sql(0, *secret_scan.PATTERNS[0])}, b AS {_spans_sql(1, *secret_scan.PATTERNS[1])}, c AS {_spans_sql(2, *secret_scan.PATTERNS[2])},
 x AS (SELECT doc_id, len(a.z) AS n_assign, len(b.z) AS n_access, len(c.z) AS n_hex, array_to_string(list_transform(list_sort(a.z || b.z || c.z), lambda y: y.k || ':' || y.s || ':' || (y.s + y.n)), ',') AS spans FROM a JOIN b USING (doc_id) JOIN c USING (doc_id))
 SELECT doc_id, n_assign, n_access, n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM x"""

_NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
 m AS (SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
 row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 10"""
_EXACT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents),
 r AS (SELECT doc_id, sha256(b) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY b) AS group_size, row_number() OVER w = 1 AS kept
 FROM d WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id NULLS LAST))
 SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r"""

#: The other operators are beyond SQL: their tests hold them against brute force, exact
#: round trips or held-out labels.
ORACLES: dict[str, str] = {"op3_url_rules": _URL_SQL, "op8_secrets": _SECRET_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op13_exact_dedup": _EXACT_SQL}
