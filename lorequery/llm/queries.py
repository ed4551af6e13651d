"""The queries of the corpus operators, with production parameters, over whole tables.

Each takes a whole table through its operator and returns what that gives, so null and
empty texts, repeated rows, empty tables and extra columns are as the operator's own
docstring says: topk.top_k, secret_scan.scan, langid.identify, packing.pack_documents,
simhash.near_duplicates, wrapper_html.extract_pages, license_scan.scan, toxicity.score,
quality.judge and bpe.digest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lorequery.llm import bpe, langid, license_scan, packing, quality, secret_scan, simhash, topk, toxicity, wrapper_html
from lorequery.llm.common import held_out, table


def op1_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op4_best_fit_packing(spark, sf_dir):
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, ranks)


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return wrapper_html.extract_pages(table(spark, sf_dir, "pages"))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), machine)


def op9_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_bpe_roundtrip(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries():
    ops = (op1_exact_top_k, op2_secret_scan, op3_language_id, op4_best_fit_packing, op5_simhash_near_dedup, op6_html_extraction, op7_license_scan, op8_toxicity, op9_quality_rules, op10_bpe_roundtrip)
    return {f.__name__: f for f in ops}


#: floor(256 x) in doubles, the integer inner product, the five best by score and id.
_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5"""


def oracle_sql():
    return {"op1_exact_top_k": _TOP_K, "op7_license_scan": license_scan.oracle(), "op9_quality_rules": quality.oracle()}
