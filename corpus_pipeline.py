"""Documents to packed training sequences: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, n_chars kept true to the text.

Defined cases, in every stage: null and empty texts (and texts without a letter) have no language and go in the first stage; very long texts are
worked on whole; where doc_ids are null or repeat, rows are told apart by their place in order of (doc_id, text's hash), ties in any order, so each is
judged by itself; repeated rows are near-duplicates of each other and the first stays; columns beside doc_id, text and n_chars keep
their values whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, line_dedup, minmax_dedup, packing
from tessera.llm.common import keyed_rows, materialize

#: Texts that cost more bits a byte than this in their best language are no text of any learned language; prose costs 2 to 4.
MAX_BITS = 7.0
#: Words of a shingle in near-duplicates.
SHINGLE_WORDS = 5
#: Words in each worker's table of token ids: less than packing alone takes, as executors' memory has grown in the stages before.
TABLE_WORDS = 300_000


def _without(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows, as they came, whose key isn't among the verdicts' doc_id."""
    return rows.join(verdicts.select(F.col("doc_id").alias("_doc")), "_doc", "left_anti").select("row.*")


def _keys_and_texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_doc").alias("doc_id"), F.col("row.text").alias("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those far from every learned language."""
    rows = keyed_rows(docs)
    model = language_id.fit(docs.filter(language_id.fold("doc_id", 3) != 1))
    found = language_id.predict(_keys_and_texts(rows), model)
    strange = (F.col("lang_pred") == language_id.UNDETERMINED) | (F.col("bits_per_byte") > MAX_BITS) if model is not None else F.col("lang_pred").isNull()
    return _without(rows, found.filter(strange))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents repeat, but for the last that holds them."""
    out = line_dedup.dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    rows = keyed_rows(docs)
    found = minmax_dedup.near_duplicates(_keys_and_texts(rows), k=SHINGLE_WORDS)
    return _without(rows, found.filter("NOT kept"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    rows = keyed_rows(docs)
    found = decontamination.contamination(_keys_and_texts(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.filter("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, words=TABLE_WORDS)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("packing", packed)]

#: Language models, component search and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
