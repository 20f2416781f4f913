"""Reciprocal rank fusion of two roads, year adjudication, relaxed pass, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

RRF_K, TOP = 60, 8


def rrf(vector: DataFrame, bm25: DataFrame, top: int = TOP, k: int = RRF_K) -> DataFrame:
    """query_id, chunk, vector_rank, bm25_rank, score, rank; both roads: query_id, chunk, rank. Ties go by vector rank, then BM25 rank."""
    v = vector.select("query_id", "chunk", F.col("rank").alias("vector_rank"))
    b = bm25.select("query_id", "chunk", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = v.join(b, ["query_id", "chunk"], "full_outer").withColumn("score", part("vector_rank") + part("bm25_rank"))
    order = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("vector_rank").asc_nulls_last(), "bm25_rank")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def adjudicate_years(base: DataFrame, by_year: DataFrame) -> DataFrame:
    """Items of each question: those of its year pass where that isn't empty and holds the document of the base pass's first item, else the base's. Both: query_id, doc, rank, ..."""
    first = base.filter(F.col("rank") == 1).select("query_id", "doc")
    adopted = first.join(by_year.select("query_id", "doc").distinct(), ["query_id", "doc"], "left_semi").select("query_id")
    taken = by_year.join(adopted, "query_id", "left_semi").withColumn("year_pass", F.lit(True))
    kept = base.join(adopted, "query_id", "left_anti").withColumn("year_pass", F.lit(False))
    return taken.unionByName(kept)


def relaxed_where_empty(questions: DataFrame, items: DataFrame, relaxed: DataFrame) -> DataFrame:
    """Expired items of the relaxed pass for questions without items (query_id)."""
    empty = questions.select("query_id").join(items.select("query_id").distinct(), "query_id", "left_anti")
    return relaxed.join(empty, "query_id", "left_semi").filter(F.col("validity") == "expired")


def neighbours(items: DataFrame, chunks: DataFrame, top: int = 3, limit: int = 4) -> DataFrame:
    """Chunks just before and after each question's first items, that aren't items themselves. items: query_id, rank, doc, version, chunk_index; chunks: doc, version, chunk_index, valid ones only."""
    near = items.filter(F.col("rank") <= top).select("query_id", "rank", "doc", "version", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).filter("chunk_index >= 1")
    near = near.groupBy("query_id", "doc", "version", "chunk_index").agg(F.min("rank").alias("of_rank"))
    found = near.join(chunks, ["doc", "version", "chunk_index"]).join(items.select("query_id", "doc", "version", "chunk_index"), ["query_id", "doc", "version", "chunk_index"], "left_anti")
    order = W.Window.partitionBy("query_id").orderBy("of_rank", "doc", "chunk_index")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
