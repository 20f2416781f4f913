"""Ingest of a batch of files as one plan: decide, parse, chunk, describe, embed new chunks only, swap versions, mark.

Each step is a DataFrame over the whole batch. A document that can't be read is a row with status failed and an error, and the rest goes on.
The chunk table gets new versions and loses old ones in one commit; the registry is committed after it, so that a run cut short is repeated as a retry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions import text as T
from tessera.operators import registry as R
from tessera.operators.chunking import chunk_documents
from tessera.operators.scratch import kept
from tessera.sources.files import parse_blocks, pdf_blocks, pictures
from tessera.sources.pdf import pdf_pages
from tessera.sources.transcription import fill_images

STATUSES = ("processing", "done", "failed")
REGISTRY = "tenant_id string, doc_key string, doc_id string, version int, status string, content_hash string, is_deleted boolean, created_at long, updated_at long, error string"
#: Columns of a chunk and what stands for a missing value, so that filters can compare them.
SENTINELS = {"doc_title": "", "source": "", "file_path": "", "page_num": 0, "start_offset": 0, "end_offset": 0, "image_ids": "", "category": "general", "department": "", "permission": "internal", "effective_time": 0, "embedding_model": "", "doc_date": "", "doc_year": -1, "author": ""}
#: Columns where zero counts as missing too.
FALSY = {"effective_time": 0, "doc_year": -1}


def doc_meta(docs: DataFrame) -> DataFrame:
    """docs (tenant_id, doc_key, format, ...) with doc_id, doc_title (the file's stem), source (its format), doc_date and doc_year from the key, category; given ones stay."""
    date, year = T.filename_date(F.col("doc_key"))
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(_maybe(docs, "file_path"), F.col("doc_key")), "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    given = lambda name, default: F.coalesce(F.when(_maybe(docs, name) != "", _maybe(docs, name)), default)
    return docs.withColumns(
        {"doc_id": T.doc_id(F.col("tenant_id"), F.col("doc_key")), "doc_title": given("doc_title", stem), "source": given("source", F.col("format")), "doc_date": date, "doc_year": year, "category": given("category", F.lit("general"))}
    )


def _maybe(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def with_sentinels(chunks: DataFrame) -> DataFrame:
    """chunks whose missing metadata are written as their sentinels; lists become comma-joined strings."""
    out = {}
    for name, value in SENTINELS.items():
        if name not in chunks.columns:
            out[name] = F.lit(value)
            continue
        c = F.col(name)
        if chunks.schema[name].dataType.typeName() == "array":
            c = F.array_join(c, ",")
        empty = c.isNull() | ((c == 0) if name in FALSY else F.lit(False))
        out[name] = F.when(empty, F.lit(value)).otherwise(c)
    return chunks.withColumns(out)


def with_offsets(chunks: DataFrame) -> DataFrame:
    """chunks (doc, chunk_index, content) with start_offset and end_offset in a text of all chunks two characters apart."""
    before = F.sum(F.length("content") + 2).over(W.Window.partitionBy("doc").orderBy("chunk_index")) - F.length("content") - 2
    return chunks.withColumn("start_offset", before.cast("int")).withColumn("end_offset", (F.col("start_offset") + F.length("content")).cast("int"))


def chunk_ids(chunks: DataFrame, doc: str, version: int | None = None) -> DataFrame:
    """chunk_id of a document, of one version or all, sorted."""
    rows = chunks.filter(F.col("doc") == doc)
    return (rows if version is None else rows.filter(F.col("version") == version)).select("chunk_id").orderBy("chunk_id")


# The registry: one row for each (tenant_id, doc_key).


def reserve(registry: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """registry with a row of version 1 in processing for incoming documents (tenant_id, doc_key, doc_id, content_hash) it doesn't hold; held ones stay as they are."""
    new = incoming.join(registry.select("tenant_id", "doc_key"), ["tenant_id", "doc_key"], "left_anti").dropDuplicates(["tenant_id", "doc_key"])
    return registry.unionByName(_fresh(new, now))


def _fresh(new: DataFrame, now: Column) -> DataFrame:
    return new.select("tenant_id", "doc_key", "doc_id", F.lit(1).alias("version"), F.lit("processing").alias("status"), "content_hash", F.lit(False).alias("is_deleted"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("error"))


def begin_version(registry: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """registry with the next version in processing, under the new hash, for changed documents (tenant_id, doc_key, content_hash)."""
    c = changed.select("tenant_id", "doc_key", F.col("content_hash").alias("_hash")).dropDuplicates(["tenant_id", "doc_key"])
    out = registry.join(c, ["tenant_id", "doc_key"], "left")
    hit = F.col("_hash").isNotNull()
    return out.withColumns({"version": F.col("version") + hit.cast("int"), "status": F.when(hit, "processing").otherwise(F.col("status")), "content_hash": F.coalesce("_hash", "content_hash"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(registry.columns)


def mark(registry: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """registry with the status and error of marks (tenant_id, doc_key, status, error); an unknown status raises in the task that meets it."""
    m = marks.select("tenant_id", "doc_key", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("status")))).alias("_status"), F.col("error").alias("_error"))
    out = registry.join(m, ["tenant_id", "doc_key"], "left")
    hit = F.col("_status").isNotNull()
    return out.withColumns({"status": F.coalesce("_status", "status"), "error": F.when(hit, F.col("_error")).otherwise(F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(registry.columns)


def mark_deleted(registry: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """registry with is_deleted for documents of gone (tenant_id, doc_id); again is no change."""
    out = registry.join(gone.select("tenant_id", "doc_id").distinct().withColumn("_gone", F.lit(True)), ["tenant_id", "doc_id"], "left")
    new = F.coalesce("_gone", F.lit(False)) & ~F.col("is_deleted")
    return out.withColumns({"is_deleted": F.col("is_deleted") | F.coalesce("_gone", F.lit(False)), "updated_at": F.when(new, now).otherwise(F.col("updated_at"))}).select(registry.columns)


def delete_documents(chunks: DataFrame, registry: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, registry, answers): documents of asked (tenant_id, doc_id) lose their current version's chunks. answers: tenant_id, doc_id, status 204 or, for unknown ones, 404."""
    known = registry.select("tenant_id", "doc_id", F.col("version").alias("_v"))
    found = asked.join(known, ["tenant_id", "doc_id"], "left")
    gone = found.filter("_v IS NOT NULL").select(F.col("doc_id").alias("doc"), F.col("_v").alias("version"))
    answers = found.select("tenant_id", "doc_id", F.when(F.col("_v").isNull(), 404).otherwise(204).alias("status"))
    return R.soft_delete(chunks, gone, now), mark_deleted(registry, asked, now), answers


def patch_documents(chunks: DataFrame, registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, answers): effective_time and other fields of the current version of changes (tenant_id, doc_id, ...). answers: tenant_id, doc_id, chunks_updated."""
    now_at = changes.join(registry.select("tenant_id", "doc_id", "version"), ["tenant_id", "doc_id"])
    new = now_at.withColumnRenamed("doc_id", "doc")
    counted = chunks.groupBy("doc", "version").agg(F.count("*").alias("_n"))
    answers = now_at.join(counted, (counted["doc"] == now_at["doc_id"]) & (counted["version"] == now_at["version"]), "left").select("tenant_id", "doc_id", F.coalesce("_n", F.lit(0)).alias("chunks_updated"))
    return R.patch(chunks, new.drop("tenant_id")), answers


# The batch.


@dataclass
class Ingested:
    """chunks and registry after the batch; report: tenant_id, doc_key, action, version, status, chunks, embedded, error for each file."""

    chunks: DataFrame
    registry: DataFrame
    report: DataFrame


def _blocks(sources: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc, page, seq, block_type, text, warning of sources (doc, format, text, content): PDF files by pages, whose numbers stay, others without."""
    columns = ["doc", "page", "seq", "block_type", "text", "warning"]
    plain = parse_blocks(sources.filter("format <> 'pdf'")).withColumn("page", F.lit(None).cast("int")).withColumn("seq", F.col("seq").cast("long"))
    pages = keep(pdf_pages(sources.filter("format = 'pdf'")))
    broken = pages.filter("error IS NOT NULL").select("doc", "page", F.lit(0).cast("long").alias("seq"), F.lit("error").alias("block_type"), F.lit("").alias("text"), F.col("error").alias("warning"))
    paged = pdf_blocks(pages.filter("error IS NULL")).withColumn("seq", F.col("page").cast("long") * (1 << 20) + F.col("seq"))
    return plain.select(columns).unionByName(paged.select(columns)).unionByName(broken)


def ingest(files: DataFrame, registry: DataFrame, chunks: DataFrame | None, now: int, embed: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = kept, read: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """files: tenant_id, doc_key, format, text, content, content_hash, force and metadata if wanted. embed: (chunk, content) to (chunk, embedding), called for chunks that aren't held.

    read: images (doc, page, ref, image) to transcripts (doc, page, ref, text); pictures of word-processing files become paragraphs of them, and those without one go. Without it the places of pictures stay.

    keep writes and rereads what later steps read more than once (parsed blocks and new chunks). Where a key comes twice, its first hash in order counts.
    """
    at = F.lit(now).cast("long")
    one = files.withColumn("_n", F.row_number().over(W.Window.partitionBy("tenant_id", "doc_key").orderBy("content_hash"))).filter("_n = 1").drop("_n")
    decided = R.decide(one.withColumn("force", F.coalesce("force", F.lit(False))), registry).withColumn("version", F.col("version").cast("int")).transform(keep)
    todo = doc_meta(one).join(decided.filter(F.col("action").isin("create", "new_version", "retry")), ["tenant_id", "doc_key"])
    sources = todo.select(F.col("doc_id").alias("doc"), "format", "text", "content")
    blocks = keep(_blocks(sources, keep))
    if read is not None:
        texts = keep(read(keep(pictures(sources))))
        docx = sources.filter("format = 'docx'").select("doc")
        blocks = keep(blocks.join(docx, "doc", "left_anti").unionByName(fill_images(blocks.join(docx, "doc", "left_semi"), texts)))
    errors = blocks.filter(F.col("block_type") == "error").groupBy(F.col("doc").alias("doc_id")).agg(F.min("warning").alias("error"))
    pieces = with_offsets(chunk_documents(blocks.filter(F.col("block_type") != "error")))
    described = pieces.join(todo.withColumnRenamed("doc_id", "doc").drop("text", "content", "format", "content_hash", "force", "action"), "doc")
    new = described.withColumns({"chunk_id": T.chunk_id(F.col("doc"), F.col("version"), F.col("chunk_index")), "is_valid": F.lit(True), "create_time": at, "update_time": at})
    new = keep(with_sentinels(new))
    if embed is not None:
        missing = new if chunks is None else new.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
        vectors = keep(embed(missing.select(F.col("chunk_id").alias("chunk"), "content"))).withColumnRenamed("chunk", "chunk_id")
        made = vectors.groupBy(F.substring_index("chunk_id", "_", 2).alias("doc_id")).agg(F.count("*").alias("embedded"))
        new = new.join(vectors, "chunk_id", "left")
        if chunks is not None and "embedding" in chunks.columns:
            new = new.join(chunks.select("chunk_id", F.col("embedding").alias("_held")), "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_held")).drop("_held")
    if chunks is not None and ("embedding" in chunks.columns) != ("embedding" in new.columns):  # an engine without an embedder, or its first run with one
        kind = (chunks if "embedding" in chunks.columns else new).schema["embedding"].dataType
        new, chunks = (df if "embedding" in df.columns else df.withColumn("embedding", F.lit(None).cast(kind)) for df in (new, chunks))
    counted = new.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("chunks"))
    outcome = todo.select("tenant_id", "doc_key", "doc_id", "content_hash", "action", "version").join(errors, "doc_id", "left").join(counted, "doc_id", "left")
    outcome = outcome.withColumn("error", F.coalesce("error", F.when(F.col("chunks").isNull(), F.lit("no content"))))
    outcome = keep(outcome.withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed")))
    good = outcome.filter(F.col("status") == "done").select(F.col("doc_id").alias("doc"))
    coming = new.join(good, "doc", "left_semi")
    after = coming if chunks is None else R.swap_version(chunks.join(coming.select("chunk_id"), "chunk_id", "left_anti"), coming, at)
    begun = begin_version(reserve(registry, outcome, at), outcome.filter(F.col("action") == "new_version"), at)
    revived = begun.join(outcome.filter(F.col("status") == "done").select("tenant_id", "doc_key", F.lit(True).alias("_in")), ["tenant_id", "doc_key"], "left")
    begun = revived.withColumn("is_deleted", F.col("is_deleted") & F.col("_in").isNull()).drop("_in")
    marked = keep(mark(begun, outcome, at))
    after = keep(after)
    report = decided.join(outcome.select("tenant_id", "doc_key", "doc_id", "status", "chunks", "error"), ["tenant_id", "doc_key"], "left")
    report = report.withColumns({"status": F.coalesce("status", F.when(F.col("action") == "skip", "skipped").otherwise("conflict")), "chunks": F.coalesce("chunks", F.lit(0))})
    if embed is not None:
        report = report.join(made, "doc_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(0)))
    return Ingested(after, marked, report.drop("doc_id"))


def task_status(report: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, code (404 for unknown ones), status, phase, percent, chunks_done, error for tasks (task_id, tenant_id, doc_key)."""
    out = tasks.join(report, ["tenant_id", "doc_key"], "left")
    status = F.when(F.col("status").isin("done", "skipped"), "done").when(F.col("status") == "processing", "processing").otherwise("failed")
    return out.select("task_id", F.when(F.col("status").isNull(), 404).otherwise(200).alias("code"), F.when(F.col("status").isNotNull(), status).alias("status"), F.when(status == "processing", "parse").otherwise("finished").alias("phase"), F.when(status == "done", 100).otherwise(0).alias("percent"), F.coalesce("chunks", F.lit(0)).alias("chunks_done"), "error", (F.col("status") == "skipped").alias("duplicated"))
