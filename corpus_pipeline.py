"""A corpus pipeline over ``documents``: quality rules, exact and near deduplication, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.

Defined results: what each operator's docstring says of nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns holds for its stage; columns other than doc_id and text pass through the filters as they are.
Quality judges a document by its lines and keeps or drops it whole: texts go on as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import exact_dedup, packing, quality, secrets, simhash
from nearfield.llm.common import cut_at, drop_table
from nearfield.llm.queries import BYTE_BPE, RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their texts as they were: lines that fail count against a document, but stay in it; ``quality.clean_text``, which takes them out, is not a stage."""
    return quality.filter_documents(docs)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without secrets."""
    return secrets.drop_documents(docs, RANKS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack_documents(docs, BYTE_BPE, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_deduplication), ("simhash_near_dedup", near_deduplication), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can express neither the fingerprints nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = cut_at(docs)
            if last:
                drop_table(spark, last)
            last = path
    return docs
