"""The vector road: deterministic byte-bigram embedding and exact cosine top-k."""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


@functools.lru_cache(1)
def _buckets() -> np.ndarray:
    """Bucket 0..255 of each byte bigram (first * 256 + second): the first byte of its MD5."""
    return np.array([hashlib.md5(bytes((i >> 8, i & 255))).digest()[0] for i in range(1 << 16)], np.uint8)


def mock_embedding(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, value: the non-zero parts of the unit vector of byte-bigram counts, from one pass over Arrow buffers without a shuffle; no rows for texts under two bytes or null."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _buckets()
        for batch in batches:
            rows, buckets, values = [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = t.as_buffer() if t.is_valid else None
                if raw is None or raw.size < 2:
                    continue
                x = np.frombuffer(raw, np.uint8)
                n = np.bincount(table[(x[:-1].astype(np.uint16) << 8) | x[1:]], minlength=256)
                at = np.flatnonzero(n)
                rows.append(np.full(len(at), i))
                buckets.append(at.astype(np.int32))
                values.append(n[at] / np.sqrt((n.astype(float) ** 2).sum()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(values))], ["_key", "bucket", "value"])

    found = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, bucket int, value double")
    return found.withColumnRenamed("_key", key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(table: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """query_id, vec_id, score, rank: for questions (query_id, query) the k nearest rows of table (vec_id, embedding), ties to the smaller vec_id. A stated, small set of questions meets every row."""
    scored = table.join(F.broadcast(questions)).select("query_id", "vec_id", cosine(F.col("query"), F.col("embedding")).alias("score"))
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def sparse_topk(vectors: DataFrame, questions: DataFrame, allowed: DataFrame, k: int = 20) -> DataFrame:
    """Cosine over sparse unit vectors by an equi-join on bucket. vectors: chunk, bucket, value; questions: query_id, bucket, value; allowed: query_id, chunk, ord."""
    q = questions.select("query_id", "bucket", F.col("value").alias("qv"))
    scored = vectors.join(q, "bucket").groupBy("query_id", "chunk").agg(F.sum(F.col("value") * F.col("qv")).alias("score"))
    scored = scored.join(allowed, ["query_id", "chunk"])
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def embed(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = 10, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """chunk, embedding of texts (chunk, content) by a provider's call, in batches from the workers; a failed call is tried again after 1, 2, ... waits."""

    def ask(some: list[str]) -> list[list[float]]:
        for n in range(tries):
            try:
                return call(some)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(wait * 2**n)
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts_ = frame["content"].fillna("").tolist()
            yield pd.DataFrame({"chunk": frame["chunk"], "embedding": [v for i in range(0, len(texts_), batch) for v in ask(texts_[i : i + batch])]})

    return texts.select("chunk", "content").mapInPandas(run, f"chunk {texts.schema['chunk'].dataType.simpleString()}, embedding array<float>")
