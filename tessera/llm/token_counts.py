"""Operator 3, token counts: batch encoding in Arrow functions that return lengths only.

Batches are cut by bytes, long texts at safe boundaries (see tokenization). One pass over the scan: no shuffle,
no join, memory bounded by the batch and the word table.

Defined cases: null or empty text has 0 bytes and 0 tokens; a very long text is counted whole, in pieces cut at safe places; rows with null doc_id keep a row; repeated rows each
keep theirs (there are no ties to break); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, string_buffers
from tessera.llm.tokenization import encoder

VOCABULARY, SEPARATOR = "byte_bpe_50k.json", "\n"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, separator: str = SEPARATOR) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, separator)
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j, n, _ in enc.rows(data, off, lengths_only=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
