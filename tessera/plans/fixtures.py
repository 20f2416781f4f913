"""The driver's documents as chunks, with tenant, permission, validity and year by fixed formulas of doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 2000
QUESTIONS = [(1, "the and that tion of"), (2, "der und nicht die"), (3, "que la de los 2023"), (4, "licensed under the license version 2024"), (5, "zzqx wwvk")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, ord, doc, content and the columns that filters use; four neighbouring documents are chunks 1 to 4 of one document."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("chunk"),
        d.alias("ord"),
        F.floor(d / 4).alias("doc"),
        F.lit(1).alias("version"),
        (d % 4 + 1).cast("int").alias("chunk_index"),
        F.coalesce("text", F.lit("")).alias("content"),
        "lang",
        "source",
        F.when(d % 3 == 0, "public").when(d % 3 == 1, "internal").otherwise("secret").alias("permission"),
        F.concat(F.lit("t"), (d % 2).cast("string")).alias("tenant_id"),
        F.when(F.floor(d / 2) % 4 == 0, 1000).when(F.floor(d / 2) % 4 == 1, 3000).otherwise(0).alias("effective_time"),
        (F.lit(2022) + F.floor(d / 8) % 4).cast("int").alias("doc_year"),
        F.lit(True).alias("is_valid"),
        F.lit("general").alias("category"),
        F.lit("").alias("department"),
    )


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


CHUNKS_SQL = """chunks AS (SELECT doc_id AS chunk, doc_id AS ord, doc_id // 4 AS doc, doc_id % 4 + 1 AS chunk_index, coalesce(text, '') AS content, lang, source,
  ['public', 'internal', 'secret'][doc_id % 3 + 1] AS permission, 't' || (doc_id % 2) AS tenant_id,
  CASE (doc_id // 2) % 4 WHEN 0 THEN 1000 WHEN 1 THEN 3000 ELSE 0 END AS effective_time, 2022 + (doc_id // 8) % 4 AS doc_year FROM documents)"""
QUESTIONS_SQL = "questions(query_id, question) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"
