"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, packing, pii, quality, sharding, simhash, substrings, topk, url_lists, warc

#: The key of a run belongs in a secret store; this one is for demonstration.
DEMO_KEY = b"ledgerloom demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    entries = url_lists.example_entries(pages)
    found = url_lists.filter_captures(url_lists.example_captures(pages), entries)
    return found.select("page_id", "host", F.col("fetch_date").cast("string").alias("fetch_date"), "verdict", "pattern")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, DEMO_KEY).select("doc_id", "n_entities", "text")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_topk,
        op2_sharding,
        op3_warc,
        op4_url_lists,
        op5_packing,
        op6_byte_bpe,
        op7_quality,
        op8_simhash,
        op9_pii,
        op10_substrings,
    )
    return {f.__name__: f for f in every}


OP1 = """
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to FROM g
"""

OP4 = r"""
WITH RECURSIVE captures AS (
  SELECT page_id, CAST(DATE '2020-01-01' + CAST(page_id * 37 % 1461 AS INTEGER) AS DATE) AS fetch_date,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host FROM pages),
tails(host, tail) AS (
  SELECT DISTINCT host, host FROM captures WHERE host <> ''
  UNION ALL
  SELECT host, substr(tail, strpos(tail, '.') + 1) FROM tails WHERE len(tail) - len(replace(tail, '.', '')) >= 2),
firsts AS (SELECT tail AS pattern, min(page_id) AS m FROM tails JOIN captures USING (host) GROUP BY 1),
entries AS (
  SELECT pattern, k, CAST(DATE '2020-01-01' + CAST((m * 7 + k * 241) % 1461 AS INTEGER) AS DATE) AS entry_date,
    ['block', 'allow', 'drop'][(m + k) % 3 + 1] AS action
  FROM firsts, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)),
daily AS (SELECT pattern, entry_date, arg_max(action, k) AS action FROM entries GROUP BY 1, 2),
asked AS (SELECT DISTINCT c.host, c.fetch_date, t.tail AS pattern FROM captures c JOIN tails t USING (host)),
found AS (SELECT a.host, a.fetch_date, a.pattern, d.action FROM asked a ASOF JOIN daily d ON a.pattern = d.pattern AND a.fetch_date >= d.entry_date),
best AS (SELECT host, fetch_date, arg_max(pattern, len(pattern)) AS pattern, arg_max(action, len(pattern)) AS verdict
  FROM found WHERE action <> 'drop' GROUP BY 1, 2)
SELECT c.page_id, c.host, CAST(c.fetch_date AS VARCHAR) AS fetch_date, coalesce(b.verdict, 'pass') AS verdict, b.pattern
FROM captures c LEFT JOIN best b USING (host, fetch_date)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op3_warc": OP3, "op4_url_lists": OP4}
