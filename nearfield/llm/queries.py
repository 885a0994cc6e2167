"""The queries of this folder's operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, licenses, packing, pii, quality, secrets, simhash, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), RANKS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
w AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, row_number() OVER (PARTITION BY doc_id, line) AS occ FROM l),
m AS (SELECT doc_id, occ, len(ws) AS n, list_sum(list_transform(ws, lambda x: length(x))) AS size,
  length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS sym, length(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) AS letters,
  len(list_filter(ws, lambda x: x[-1] IN ('!', '?'))) AS loud, len(list_filter(ws, lambda x: x IN ('|', '›', '»', '·', '•'))) AS marks,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS stutter,
  NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}') AS upper, regexp_matches(line, '(?i)BOILERPLATE') AS boiler
  FROM w WHERE len(ws) > 0),
r AS (SELECT doc_id, occ > 1 AS again, size, (occ > 1 AND n >= 3) OR (5 * sym > n AND 5 * sym - n >= 5) OR 2 * letters < size OR (n >= 5 AND 3 * loud >= n) OR (n >= 10 AND upper)
  OR (n >= 8 AND 2 * stutter >= n) OR (marks >= 3 AND 5 * marks >= n) OR (n <= 25 AND boiler) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(size) FILTER (WHERE NOT gone), 0) AS stays FROM r GROUP BY doc_id),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
c AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM v) WHERE times > 1),
p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM c GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stays, 0) AS stays
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND stays >= 0.5 * word_chars AS kept FROM f
""".replace("BOILERPLATE", quality.BOILERPLATE.pattern)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_packing, op3_exact_dedup, op4_licenses, op5_toxicity, op6_simhash, op7_quality, op8_html, op9_pii, op10_bpe)}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op7_quality": OP7_SQL}
