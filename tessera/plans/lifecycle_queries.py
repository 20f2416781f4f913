"""Registry, snapshots and the deterministic answer flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import conversation as C
from tessera.operators import registry, scratch
from tessera.plans.fixtures import CHUNKS_SQL, NOW, QUESTIONS_SQL, chunks, table
from tessera.plans.retrieval_queries import _T0, _bm25, _eligible, _lexical, ONE_SIG
from tessera.streaming import streams


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("done", "processing", "failed", "pending"))), (d % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").filter("doc_id % 10 <> 9").select(F.concat(F.lit("t"), (d % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), d.cast("string")).alias("doc_key"), (d % 3 + 1).cast("int").alias("version"), status.alias("status"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), (d % 7 == 0).alias("is_deleted"), (d * 37 % 1000).alias("updated_at"))


def registry_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(d % 5 == 0, "!").otherwise(""))
    incoming = table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), (d % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), d.cast("string")).alias("doc_key"), F.md5(text).alias("content_hash"), (d % 11 == 0).alias("force"))
    return registry.decide(incoming, _registry(spark, sf_dir))


def registry_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.list_page(_registry(spark, sf_dir), "t0", 20, 5).select("doc_key", "version", "updated_at")


def soft_delete_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("update_time", F.lit(0))
    gone = spark.createDataFrame([(i, 1) for i in range(0, 40, 3)] + [(5, 2)], "doc long, version int")
    return registry.soft_delete(c, gone, F.lit(NOW)).groupBy("is_valid", "update_time").agg(F.count("*").alias("n"))


def patch_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(i, 1, 7000 + i) for i in range(0, 60, 4)], "doc long, version int, effective_time int")
    return registry.patch(chunks(spark, sf_dir), changes).select("chunk", "effective_time")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("content"))


def thread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream, a minute between turns: what each question's thread held before it."""
    given, out = table(spark, sf_dir, "conversations"), scratch.folder(spark)
    given.write.parquet(f"{out}/in")  # a stream's source is a folder, and a table may be one file
    said = spark.readStream.schema(given.schema).parquet(f"{out}/in").withColumn("at", F.timestamp_seconds(1_000_000 + F.col("turn") * 60))
    query = streams.started(streams.thread_states(said), f"{out}/rows", f"{out}/checkpoint")
    query.awaitTermination()
    chars = F.aggregate("messages", F.lit(0), lambda n, m: n + F.coalesce(F.length(m["text"]), F.lit(0)))
    return spark.read.parquet(f"{out}/rows").select("conv_id", "turn", F.size("messages").alias("n_messages"), chars.alias("chars"), "last_answer", "pending")


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_messages(_messages(spark, sf_dir), 3).select("thread", "seq", F.col("n").cast("long").alias("n"))


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history_budget(_messages(spark, sf_dir), budget=400).groupBy("thread").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


def rule_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("seq") % 4 == 0, F.lit("hello you")).when(F.col("seq") % 4 == 1, F.concat(F.lit("Your email, "), F.col("content"))).otherwise(F.col("content"))
    return _messages(spark, sf_dir).select("thread", "seq", C.rule_intent(said).alias("intent"))


def skip_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).filter("role = 'user'")
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("what is this "), F.col("content"))).otherwise(F.col("content"))
    return m.select("thread", "seq", C.skip_rewrite(said, F.col("thread") % 2 == 0, F.col("seq") > 0, F.col("seq") % 2).alias("skip"))


def confirm_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = F.when(F.col("thread") % 2 == 0, "Only expired documents match. Show them?").otherwise("Here you are.")
    reply = F.when(F.col("seq") % 3 == 0, "Yes, please").when(F.col("seq") % 3 == 1, "please show").otherwise("no")
    return _messages(spark, sf_dir).select("thread", "seq", C.confirms_expired(offer, reply).alias("confirmed"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lexical(spark, sf_dir, ONE_SIG[0]).join(chunks(spark, sf_dir).select("chunk", "content", "doc_year"), "chunk")
    return found.withColumn("title", F.concat(F.lit("Doc "), F.col("doc").cast("string")))


def evidence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = C.evidence_line(F.concat(F.lit("c"), F.col("rank").cast("string")), F.col("title"), F.col("chunk_index"), F.col("doc_year").cast("string"), F.col("effective_time").between(1, NOW - 1), F.col("content"))
    return _items(spark, sf_dir).select("query_id", "rank", F.md5(line).alias("line_md5"))


def citations_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("query_id", "rank", "chunk", "title")
    cited = items.filter("rank IN (1, 4)").groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list("chunk"))).alias("c")).select("query_id", F.concat("c", F.array(F.lit(-1).cast("long")), "c").alias("cites"))
    return C.enrich_citations(cited, items).select("query_id", F.col("pos").cast("long").alias("pos"), "chunk", "title")


def stub_qa_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    answers = C.stub_answers(items.select("query_id", "rank", "chunk", "title"))
    expired = items.filter(F.col("effective_time").between(1, NOW - 1)).select("query_id", "chunk").groupBy("query_id").agg(F.collect_set("chunk").alias("old"))
    full = answers.join(expired, "query_id", "left").withColumn("n_old", F.size(F.array_intersect("cites", F.coalesce("old", F.array().cast("array<bigint>")))))
    checked = C.verify(F.size("cites"), F.col("n_old"), F.col("confidence"))
    return full.select("query_id", C.disclose(F.col("answer"), F.size("cites")).alias("answer"), *[checked[k].alias(k) for k in ("grounded", "degraded")], C.route(checked["grounded"], checked["confidence"], F.lit(0)).alias("route"))


def citation_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("query_id", "rank", "chunk", "title")
    return C.reverse_citations(C.stub_answers(items).select("query_id", "answer"), items.select("query_id", "title", "chunk"))


_REG = "reg AS (SELECT 't' || (doc_id % 2) AS tenant_id, 'k' || doc_id AS doc_key, (doc_id % 3 + 1)::INT AS version, ['done', 'processing', 'failed', 'pending'][doc_id % 4 + 1] AS status, md5(coalesce(text, '')) AS content_hash, doc_id % 7 = 0 AS is_deleted, doc_id * 37 % 1000 AS updated_at FROM documents WHERE doc_id % 10 <> 9)"
_MSG = "m AS (SELECT conv_id AS thread, turn AS seq, role, coalesce(text, '') AS content FROM conversations)"
_ITEMS = f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_bm25(_eligible(_T0), '0', 8)}, it AS (SELECT query_id, rank, chunk, 'Doc ' || doc AS title, chunk_index, doc_year, effective_time, content FROM bm JOIN chunks USING (chunk))"
_ANS = "an AS (SELECT query_id, 'See ' || string_agg('[source: ' || title || ']', '; ' ORDER BY rank) AS answer FROM it WHERE rank <= 2 GROUP BY query_id)"

QUERIES = {
    "registry_decide": (registry_decide, f"WITH {_REG}, i AS (SELECT 't' || (doc_id % 2) AS tenant_id, 'k' || doc_id AS doc_key, md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS h, doc_id % 11 = 0 AS force FROM documents), a AS (SELECT i.tenant_id, i.doc_key, version, CASE WHEN version IS NULL THEN 'create' WHEN force AND status = 'processing' THEN 'conflict' WHEN force OR h <> content_hash OR is_deleted THEN 'new_version' WHEN status = 'done' THEN 'skip' WHEN status = 'processing' THEN 'conflict' ELSE 'retry' END AS action FROM i LEFT JOIN reg USING (tenant_id, doc_key)) SELECT tenant_id, doc_key, action, CASE action WHEN 'create' THEN 1 WHEN 'new_version' THEN version + 1 ELSE version END AS version FROM a"),
    "registry_list_page": (registry_list_page, f"WITH {_REG} SELECT doc_key, version, updated_at FROM reg WHERE tenant_id = 't0' AND NOT is_deleted ORDER BY updated_at DESC, doc_key LIMIT 20 OFFSET 5"),
    "soft_delete_version": (soft_delete_version, f"WITH {CHUNKS_SQL} SELECT NOT (doc < 40 AND doc % 3 = 0) AS is_valid, CASE WHEN doc < 40 AND doc % 3 = 0 THEN 2000 ELSE 0 END AS update_time, count(*) AS n FROM chunks GROUP BY ALL"),
    "patch_effective": (patch_effective, f"WITH {CHUNKS_SQL} SELECT chunk, CASE WHEN doc < 60 AND doc % 4 = 0 THEN 7000 + doc ELSE effective_time END::INT AS effective_time FROM chunks"),
    "thread_states": (
        thread_states,
        """WITH w AS (SELECT conv_id, turn, role, count(*) OVER p AS n_messages, coalesce(sum(coalesce(length(text), 0)) OVER p, 0)::BIGINT AS chars, max_by(struct_pack(t := text), turn) FILTER (role = 'assistant') OVER p AS a FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, n_messages, chars, a.t AS last_answer, coalesce(contains(lower(a.t), 'expired') AND contains(a.t, '?'), false) AS pending FROM w WHERE role = 'user'""",
    ),
    "history_window": (history_window, f"WITH {_MSG} SELECT thread, seq, row_number() OVER (PARTITION BY thread ORDER BY seq DESC) AS n FROM m QUALIFY n <= 3"),
    "history_budget": (history_budget, f"WITH {_MSG}, l AS (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY seq DESC) AS n, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(content, 1, 150) AS line FROM m WHERE role IN ('user', 'assistant') QUALIFY n <= 20), f AS (SELECT *, n = 1 OR sum(length(line) + 1) OVER (PARTITION BY thread ORDER BY n) - 1 <= 400 AS fits FROM l), g AS (SELECT *, min(fits::INT) OVER (PARTITION BY thread ORDER BY n) AS ok FROM f) SELECT thread, count(*) AS kept, sum(length(line))::BIGINT AS chars FROM g WHERE ok = 1 GROUP BY thread"),
    "rule_intent": (rule_intent, f"WITH {_MSG}, s AS (SELECT thread, seq, CASE seq % 4 WHEN 0 THEN 'hello you' WHEN 1 THEN 'Your email, ' || content ELSE content END AS q FROM m) SELECT thread, seq, CASE WHEN trim(q) = '' THEN 'chitchat' WHEN regexp_matches(lower(q), 'phone|email|contact|hotline') THEN 'contact_guidance' WHEN length(q) <= 12 AND regexp_matches(lower(q), 'hello|hi|thanks|bye|hallo|merci|hola') THEN 'chitchat' END AS intent FROM s"),
    "skip_rewrite": (skip_rewrite, f"WITH {_MSG}, s AS (SELECT thread, seq, CASE seq % 3 WHEN 0 THEN 'what is this ' || content ELSE content END AS q FROM m WHERE role = 'user') SELECT thread, seq, CASE WHEN seq % 2 > 0 THEN false WHEN q = '' THEN false WHEN NOT (regexp_matches(lower(q), 'the above|as before|the former|the latter') OR list_has_any(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), ['it', 'this', 'that', 'these', 'those', 'they', 'he', 'she'])) AND length(q) > 6 AND thread % 2 = 0 THEN true ELSE NOT seq > 0 END AS skip FROM s"),
    "confirm_expired": (confirm_expired, f"WITH {_MSG} SELECT thread, seq, thread % 2 = 0 AND seq % 3 IN (0, 1) AS confirmed FROM m"),
    "evidence_render": (evidence_render, f"{_ITEMS} SELECT query_id, rank, md5('[c' || rank || '] ' || title || ' | p. ' || chunk_index || ' | ' || doc_year || ' | ' || replace(substr(content, 1, 500), chr(10), ' ')) AS line_md5 FROM it"),
    "citations_enrich": (citations_enrich, f"{_ITEMS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk DESC) - 1 AS pos, chunk, title FROM it WHERE rank IN (1, 4)"),
    "citation_reverse": (citation_reverse, f"{_ITEMS}, {_ANS}, c AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[source:\\s*([^\\]]+)\\]', 1)) AS cited FROM an) SELECT query_id, cited, arg_max(chunk, (length(title), title, chunk)) AS chunk FROM c JOIN it USING (query_id) WHERE contains(cited, title) GROUP BY ALL"),
    "stub_qa_flow": (stub_qa_flow, f"{_ITEMS}, {_ANS} SELECT query_id, answer || ' (Sources may not cover every point.)' AS answer, length(answer) > 20 AS grounded, false AS degraded, CASE WHEN length(answer) > 20 THEN 'ok' ELSE 'retry' END AS route FROM an"),
}
