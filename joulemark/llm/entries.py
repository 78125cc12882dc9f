"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, language_id, mixing, near_vectors, ngram_join, packing, pii, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.withColumn("held_out", language_id.fold() == 0), language_id.train(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counts ON a = e.vec_id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    names = {"_source": "source", "_lang": "lang", "_topic": "topic", "_tokens": "n_tokens"}
    return found.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()), F.round("_weight", 6).alias("weight"), F.round("_prob", 6).alias("prob"), F.col("_sampled").alias("sampled"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "key", "response_id", "verdict", shown.alias("headers"))


OP8_SQL = r"""
WITH bare AS (SELECT page_id, md5(coalesce(html, '')) AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '') AS u FROM pages),
keyed AS (SELECT page_id, tag, 1700000000 + page_id * 2 AS seen,
  regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q FROM bare),
pages2 AS (SELECT page_id, tag, seen, place || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM keyed),
revisits AS (SELECT page_id, key, seen + 3601 AS seen, CASE WHEN page_id % 7 = 0 THEN 'x' || tag ELSE 'W/' || tag END AS tag FROM pages2),
met AS (SELECT r.page_id, r.key, r.seen, r.tag, p.page_id AS of_, p.tag AS of_tag FROM revisits r ASOF LEFT JOIN pages2 p ON r.key = p.key AND r.seen > p.seen)
SELECT 'b' || page_id AS record_id, key, 'a' || of_ AS response_id,
  CASE WHEN of_ IS NULL THEN 'unresolved' WHEN regexp_replace(tag, '^W/', '') = of_tag THEN 'resolved' ELSE 'changed' END AS verdict,
  'content-type=' || CASE WHEN of_ IS NOT NULL AND regexp_replace(tag, '^W/', '') = of_tag THEN 'text/html' ELSE 'none' END
    || ';date=' || strftime(make_timestamp(seen * 1000000), '%Y-%m-%d %H:%M:%S') || ';etag=' || tag AS headers
FROM met
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_near_vectors, op4_exact_dedup, op5_pii, op6_sharding, op7_html_text, op8_warc_revisits, op9_best_fit_packing, op10_ngram_join)}
SQL = {"op2_mixing": mixing.sql(), "op3_near_vectors": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op8_warc_revisits": OP8_SQL}
