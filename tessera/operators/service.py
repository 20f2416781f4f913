"""The service edge as rows: request and upload checks, history pages, upload states, log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.conversation import last_messages

INVALID, UNSUPPORTED, TOO_LARGE, BUSY = "VALIDATION_INVALID_ARGUMENT", "DOC_UNSUPPORTED_TYPE", "DOC_TOO_LARGE", "INGEST_IN_PROGRESS"
STATUS = {INVALID: 422, UNSUPPORTED: 415, TOO_LARGE: 413, BUSY: 409}
QUESTION_CHARS, TOP_K, HISTORY_LIMIT, UPLOAD_BYTES, QUERY_CHARS = 4000, 50, 200, 50 << 20, 200
#: Types of upload by suffix; any text type is taken besides.
MIME = {
    "pdf": ["application/pdf"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "application/octet-stream"],
    "md": ["text/markdown", "text/plain", "application/octet-stream"],
    "markdown": [],
    "txt": ["text/plain", "text/markdown", "application/octet-stream"],
}
#: Milliseconds from which an event of a kind is logged; other kinds always are.
SLOW = {"slow_query": 500, "llm_call": 3000, "ingest_slow": 5000}


def http_status(code: Column) -> Column:
    """Status of an error code, 200 for none."""
    out = F.lit(200)
    for name, status in STATUS.items():
        out = F.when(code == name, status).otherwise(out)
    return out


def same_tenant(thread: Column, tenant: Column) -> Column:
    """A thread with a prefix before a colon belongs to the tenant of that name, others to anyone."""
    return ~F.contains(thread, F.lit(":")) | (F.substring_index(thread, ":", 1) == tenant)


def request_error(question: Column, top_k: Column, effective_time: Column, thread: Column, tenant: Column) -> Column:
    """Error code of a request, null for a good one; top_k and effective_time may be null."""
    length = F.coalesce(F.length(question), F.lit(0))
    bad = (length < 1) | (length > QUESTION_CHARS) | ~F.coalesce(top_k.between(1, TOP_K), F.lit(True)) | ~F.coalesce(effective_time >= 0, F.lit(True)) | ~F.coalesce(same_tenant(thread, tenant), F.lit(True))
    return F.when(bad, INVALID)


def upload_error(name: Column, mime: Column, size: Column, limit: int = UPLOAD_BYTES) -> Column:
    """Error code of an upload by suffix, declared type and size, in that order; null for a good one."""
    suffix = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    fits = (kind == "") | F.startswith(kind, F.lit("text/"))
    for s, kinds in MIME.items():
        fits = fits | ((suffix == s) & kind.isin(kinds))
    return F.when(~suffix.isin(list(MIME)) | ~fits, UNSUPPORTED).when(size > limit, TOO_LARGE).when(size == 0, INVALID)


def error_body(code: Column, message: Column, request_id: Column) -> Column:
    """The uniform error body in JSON."""
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message"), request_id.alias("request_id")).alias("error")))


def history_page(messages: DataFrame, limit: int = 50) -> DataFrame:
    """The last messages of each thread (thread, seq, ...), limit held to 1..200."""
    return last_messages(messages, min(HISTORY_LIMIT, max(1, limit)))


def upload_state(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """tenant_id, doc_key, http, version of uploads (tenant_id, doc_key, content_hash): 409 in progress, 200 already there, else 202 with the version to come."""
    r = registry.select("tenant_id", "doc_key", F.col("version").alias("_v"), "status", F.col("content_hash").alias("_hash"), "is_deleted")
    same = F.col("content_hash") == F.col("_hash")
    http = F.when(F.col("status") == "processing", 409).when(same & ~F.col("is_deleted") & (F.col("status") == "done"), 200).otherwise(202)
    stays = same & ((F.col("status") == "failed") | ~F.col("is_deleted"))
    version = F.when(F.col("_v").isNull(), 1).when((F.col("http") != 202) | stays, F.col("_v")).otherwise(F.col("_v") + 1)
    return incoming.join(r, ["tenant_id", "doc_key"], "left").withColumn("http", http).select("tenant_id", "doc_key", "http", version.cast("int").alias("version"))


def logged(events: DataFrame) -> DataFrame:
    """Events (event, duration_ms, query, ...) that are written: slow kinds from their threshold, others always; queries are cut."""
    limit = F.lit(0)
    for kind, ms in SLOW.items():
        limit = F.when(F.col("event") == kind, ms).otherwise(limit)
    return events.filter(F.coalesce("duration_ms", F.lit(0)) >= limit).withColumn("query", F.substring("query", 1, QUERY_CHARS))


def json_lines(events: DataFrame) -> DataFrame:
    """line: one JSON object for each row, columns in order."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("line"))


def warning_pages(warning: Column) -> Column:
    """Page number that a warning names, null without one."""
    found = F.regexp_extract(warning, "(?i)(?:page|第)\\s*(\\d+)", 1)
    return F.when(found != "", found.cast("int"))
