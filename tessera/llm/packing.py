"""Operator 7, best-fit packing: vector best-fit over residual tokens, document counts and attention costs.

A piece's demand is (length, 1, length squared), so pieces of one length are alike and the whole input is described by
its histogram of lengths: at most `max_tokens` rows, whatever the corpus. The driver packs that histogram, longest
first. Bins with the same content form a group; a length goes to the group that fits every capacity and scores
best (smallest weighted norm of what would be left, or largest weighted dot product of demand and what is left), to as many of
its bins as there are pieces. Hence a plan of a few thousand placements (length, ranks) -> (bins, offset).
Pieces get their rank in their length through counts of salts, of which a length has as many as the root of its pieces, so a length that a third of all pieces share is no hot key, and
meet the plan in a broadcast join whose size is bounded by max_tokens * ln(max_tokens) and the number of lengths.

Defined cases: null or empty text is a document of the end id alone; a very long text is encoded in parts and cut into pieces; repeated rows and null doc_ids are documents of
their own; pieces of one length tie in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import doc_text, materialize, string_buffers, trim_memory
from tessera.llm.tokenization import TABLE_WORDS, encoder, spread

VOCABULARY, SEPARATOR, END_ID, MAX_TOKENS = "byte_bpe_50k.json", "\n", 0, 2048


def cut_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str = VOCABULARY, separator: str = SEPARATOR, end_id: int = END_ID, words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; only documents over max_tokens are cut, the first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()  # of what earlier operators freed in this worker
        enc = encoder(vocabulary, separator, words)
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j, border, ids in enc.rows_with_end(data, off, end_id):
                size = np.diff(border)
                many = -(-size // max_tokens)
                row = np.repeat(np.arange(j - i), many)
                piece = spread(np.zeros(j - i, np.int64), many)
                first = (size - 1) % max_tokens + 1  # tokens of the first piece
                start = np.where(piece > 0, first[row] + (piece - 1) * max_tokens, 0)
                stop = first[row] + piece * max_tokens
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((border[row] + start).tolist(), (border[row] + stop).tolist(), strict=True)]
                cols = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())]
                trim_memory()  # a range's temporaries are many times its bytes
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, rank_from, rank_to, first_bin, offset): the piece of that length and rank r goes to bin first_bin + r - rank_from."""
    cap = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens * max_tokens], float)
    weight = np.array(weights) / cap**2
    base, size, left = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3))
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        todo, rank = counts[length], 0
        keep = left[:, 0] > 0
        base, size, left = base[keep], size[keep], left[keep]
        while todo:
            fits = np.flatnonzero((left >= need).all(1))
            if not len(fits):
                many = -(-todo // int((cap // need).min()))
                base, size, left = np.append(base, bins), np.append(size, many), np.vstack([left, cap])
                bins += many
                fits = np.array([len(base) - 1])
            score = ((left[fits] - need) ** 2 @ weight) if rule == "norm" else -(left[fits] * need @ weight)
            g = fits[np.lexsort((base[fits], score))[0]]
            n = min(todo, int(size[g]))
            if n < size[g]:  # only the first n bins of the group get one
                base, size, left = np.append(base, base[g] + n), np.append(size, size[g] - n), np.vstack([left, left[g]])
                size[g] = n
            out.append((length, rank, rank + n, int(base[g]), int(max_tokens - left[g, 0])))
            left[g] -= need
            todo, rank = todo - n, rank + n
    return out


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), words: int = TABLE_WORDS) -> DataFrame:
    """Pieces of docs with sequence_id and offset. Capacities that are None don't bind. words: size of each worker's word table."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, max_tokens, words=words).withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())))  # written: every later plan sees the same deal
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    plan = plan_bins(counts, max_tokens, max_docs, max_cost, rule, weights)
    plan_df = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _first long, offset long")
    salts = spark.createDataFrame([(n, math.isqrt(c) + 1) for n, c in counts.items()] or [(0, 1)], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod("_deal", F.col("_salts")))
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # for a length, no more rows than the root of its pieces
    before = by_salt.select("length", "_salt", (F.sum("_n").over(W.Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_within", within).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_within") + F.col("_before")).select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    placed = ranked.join(F.broadcast(plan_df), (ranked["length"] == plan_df["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(plan_df["length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
