"""The dense road over stored embeddings: cells around centroids, searched exactly with the filters inside.

The index holds each chunk that has an embedding with the columns filters use, in files partitioned by cell; a cell's bound is the least cosine of its members
with its centroid. A question's cosine with any member is at most cos(max(0, angle to the centroid - the cell's widest angle)), so a search reads the question's PROBES nearest cells, takes the k-th
best score of eligible chunks there, and then only cells whose bound reaches it: the result is the exact one. Only cells that some question needs are read (static partition pruning).

Centroids come from a bounded sample (SAMPLE vectors, at most CELLS centroids); they decide cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.operators import filters
from tessera.operators.scratch import kept

SAMPLE, CELLS, STEPS, PROBES = 20_000, 1024, 8, 4
SPEC = ("tenant_id", "user_permission", "category", "department", "now", "include_expired", "years")


def usable(e: Column) -> Column:
    """A vector that has a direction: no null or non-finite component, and one that isn't 0."""
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def _units(col: pa.Array) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def centroids(vectors: DataFrame, n: int) -> np.ndarray:
    """Directions of at most CELLS groups of a sample of vectors (chunk, embedding), by spherical k-means; n: how many vectors there are."""
    share = F.pmod(F.xxhash64("chunk", F.lit(5)), F.lit(max(1, n // SAMPLE))) == 0
    x = _units(vectors.filter(share).select("embedding").toArrow()["embedding"].combine_chunks())
    if not len(x):
        return x
    rng = np.random.default_rng(3)
    held = x[rng.permutation(len(x))[: min(CELLS, max(1, math.isqrt(n)))]]
    for _ in range(STEPS):
        own = (x @ held.T).argmax(1)
        sums = np.zeros_like(held)
        np.add.at(sums, own, x)
        length = np.sqrt((sums**2).sum(1))
        held = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], held)
    return held


@dataclass
class DenseIndex:
    """rows: chunk columns, embedding, cell. centers: a unit vector a cell. least: the least cosine of a cell's members with it; 2 for cells without any."""

    rows: DataFrame
    centers: np.ndarray
    least: np.ndarray

    def cells(self, questions: DataFrame, near: bool) -> DataFrame:
        """qp, cell for questions (qp, query, kth): the PROBES nearest cells, or of all others those whose bound reaches kth."""
        centers, angle = self.centers, np.arccos(np.clip(self.least, -1, 1))
        live = self.least < 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cos = np.where(live, np.clip(_units(batch.column(1)) @ centers.T, -1, 1), -np.inf)
                nearest = np.argsort(-cos, axis=1, kind="stable")[:, :PROBES]
                chosen = np.zeros(cos.shape, bool)
                np.put_along_axis(chosen, nearest, True, 1)
                if not near:
                    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(cos, -1, 1)) - angle))
                    chosen = ~chosen & (bound >= batch.column(2).to_numpy()[:, None] - 1e-9)
                row, cell = np.nonzero(chosen & live)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["qp", "cell"])

        return questions.select("qp", "query", "kth").mapInArrow(run, "qp string, cell int")

    def _scored(self, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
        needed = [r[0] for r in cells.select("cell").distinct().collect()]  # CELLS at most
        held = filters.eligible(self.rows.filter(F.col("cell").isin(needed)), asked.select("sig", *SPEC).distinct())
        met = held.join(asked.select("qp", "sig", "query").join(cells, "qp"), ["sig", "cell"])
        cosine = _dot("query", "embedding") / (F.sqrt(_dot("query", "query")) * F.sqrt(_dot("embedding", "embedding")))
        rank = F.row_number().over(W.Window.partitionBy("qp").orderBy(F.desc(F.round("score", 9)), "ord"))
        return met.select("qp", "chunk", "ord", cosine.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)

    def search(self, asked: DataFrame, k: int = 20, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
        """qp, chunk, score, rank: the k eligible chunks nearest to each question (qp, sig, query and the filters of SPEC)."""
        if not len(self.centers):
            kind = self.rows.schema["chunk"].dataType.simpleString()
            return asked.sparkSession.createDataFrame([], f"qp string, chunk {kind}, score double, rank int")
        none = F.lit(float("-inf"))
        first = keep(self._scored(asked, keep(self.cells(asked.withColumn("kth", none), True)), k))
        last = first.filter(F.col("rank") == k).select("qp", F.col("score").alias("kth"))
        more = keep(self.cells(asked.join(last, "qp", "left").withColumn("kth", F.coalesce("kth", none)), False))
        both = first.drop("rank").unionByName(self._scored(asked, more, k).drop("rank"))
        rank = F.row_number().over(W.Window.partitionBy("qp").orderBy(F.desc(F.round("score", 9)), "ord"))
        return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("qp", "chunk", "score", "rank")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def assigned(chunks: DataFrame, centers: np.ndarray) -> DataFrame:
    """chunks with cell, the nearest centroid, and _cos, the cosine with it."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _units(batch.column(batch.schema.get_field_index("embedding"))) @ centers.T if batch.num_rows else np.zeros((0, 1))
            own = cos.argmax(1)
            extra = [pa.array(own.astype(np.int32)), pa.array(cos[np.arange(len(own)), own])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", "_cos"])

    return chunks.mapInArrow(run, schema)


def build(chunks: DataFrame, put: Callable[[DataFrame, list[str]], DataFrame]) -> DenseIndex:
    """An index of chunks (chunk, ord, embedding and what filters use), written by put(rows, partition columns). Chunks without a usable embedding, or of another size than most, aren't in it."""
    some = chunks.filter(usable(F.col("embedding")))
    sizes = some.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return DenseIndex(some.withColumn("cell", F.lit(0)), np.zeros((0, 1)), np.zeros(0))
    some = some.filter(F.size("embedding") == sizes["d"])
    centers = centroids(some, sizes["count"])
    if not len(centers):  # a hash that spares every row of a small table
        centers = _units(some.limit(1).select("embedding").toArrow()["embedding"].combine_chunks())
    rows = put(assigned(some, centers).hint("rebalance", "cell"), ["cell"])
    least = np.full(len(centers), 2.0)
    for r in rows.groupBy("cell").agg(F.min("_cos").alias("c")).collect():  # CELLS rows at most
        least[r["cell"]] = r["c"] - 1e-12
    return DenseIndex(rows.drop("_cos"), centers, least)


def road(index: DenseIndex, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """A vector road over the index; embed takes (chunk, content) to (chunk, embedding) and is called for the different questions alone."""

    def run(asked: DataFrame, k: int) -> DataFrame:
        texts = asked.select(F.col("question").alias("chunk"), F.col("question").alias("content")).distinct()
        said = embed(texts).filter(usable(F.col("embedding"))).select(F.col("chunk").alias("question"), F.col("embedding").cast("array<double>").alias("query"))
        return index.search(kept(asked.join(said, "question")), k)

    return run
