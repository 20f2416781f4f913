"""Whole retrieval, the service edge, transcripts, answer parsing and further evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, conversation, evaluation, filters, fusion, gate, registry, service
from tessera.plans.evaluation_queries import _CASES, _LOC, _cases
from tessera.plans.fixtures import CHUNKS_SQL, NOW, chunks, questions, table
from tessera.plans.lifecycle_queries import _MSG, _REG, _messages, _registry
from tessera.plans.retrieval_queries import _HEAD, _T0, _VEC, _all, _bm25, _eligible, _roads, _spec
from tessera.sources import transcription

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def _one_of(i: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def bm25_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(_all(spark, sf_dir), questions(spark).withColumn("sig", F.lit(0)))
    return found.filter("score = 0").select("query_id", "chunk", "rank")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    fused = fusion.rrf(*_roads(spark, sf_dir)).join(c.select("chunk", "doc", "version", "chunk_index"), "chunk")
    ok = filters.eligible(c, _spec(spark, [(0, "t0", "internal", NOW, False, None, None, None), (1, "t1", "internal", NOW, False, None, None, None)]))
    near = fusion.neighbours(fused.select("query_id", "rank", "doc", "version", "chunk_index"), ok.select("doc", "version", "chunk_index", "chunk"))
    items = fused.select("query_id", "chunk", "rank", F.round("score", 6).alias("score"), F.lit(False).alias("is_context"))
    return items.unionByName(near.select("query_id", "chunk", F.col("n").alias("rank"), F.lit(0.0).alias("score"), F.lit(True).alias("is_context")))


def chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = filters.eligible(chunks(spark, sf_dir), _spec(spark, [(0, "t0", "internal", NOW, False, None, None, None)]))
    return bm25.by_ids(ok, spark.createDataFrame([(i,) for i in (0, 2, 3, 4, 4, 12, 16, 999999999)], "chunk long")).select("chunk", "score")


def disclose_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", conversation.disclose(F.concat(F.lit("A"), d.cast("string")), d % 3).alias("answer"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    parts = T.split_pages(F.replace("text", F.lit("\n"), F.lit("\n\f")), (d % 5 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("page", "text")).select("doc_id", F.col("page").cast("long").alias("page"), F.md5("text").alias("digest"))


def page_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = T.join_lines(F.concat(F.lit("年\n假\nof a\nb\nc \n\n"), "text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(joined).cast("long").alias("n"), F.md5(joined).alias("digest"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pages = _docs(spark, sf_dir).select(F.floor(d / 20).alias("doc"), (d % 20).alias("page"), F.when(d % 3 == 0, "red").otherwise("green").alias("level"))
    return transcription.red_pages(pages, 4).select("doc", "page")


def ocr_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    images = table(spark, sf_dir, "pages").select(F.floor(p / 25).alias("doc"), (p % 25).alias("page"), (p % 7).alias("ref"), (40 + p % 60).alias("width"), (30 + p % 80).alias("height"), F.when(p % 9 == 0, "red").otherwise("green").alias("level"))
    return transcription.inline_images(images, 3).select("doc", "page", "ref")


def ocr_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    blocks = _docs(spark, sf_dir).select(F.floor(d / 6).alias("doc"), F.floor(d % 6 / 2).alias("page"), (d % 2).alias("seq"), "text")
    above = F.when(d % 4 == 0, F.concat(F.substring("text", 1, 12), F.lit(" "), F.substring("text", 13, 30))).when(d % 4 == 2, "xy")
    images = _docs(spark, sf_dir).filter("doc_id % 2 = 0 OR doc_id % 5 = 0").select(F.floor(d / 6).alias("doc"), F.floor(d % 6 / 2).alias("page"), d.alias("ref"), above.alias("above"))
    return transcription.insert_positions(images, blocks).select("ref", F.col("pos").cast("long").alias("pos"))


def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = _docs(spark, sf_dir).withColumns({"doc": F.floor(d / 6), "page": F.floor(d % 6 / 2)}).withColumn("level", F.when((F.col("doc") + F.col("page")) % 3 == 0, "red").otherwise("green"))
    blocks = docs.select("doc", "page", d.alias("seq"), F.concat(F.lit("b"), d.cast("string")).alias("text"), "level")
    pages = docs.filter("level = 'red' AND doc_id % 2 = 0").select("doc", "page", F.concat(F.lit("p"), d.cast("string")).alias("text"))
    inline = docs.filter("level <> 'red' AND doc_id % 2 = 0").select("doc", "page", (F.col("doc") % 5 - 1).alias("pos"), F.lit("r").alias("ref"), F.concat(F.lit("i"), d.cast("string")).alias("text"))
    return transcription.merge_transcripts(blocks, pages, inline).select("doc", F.col("seq").cast("long").alias("seq"), "page", "origin", "text")


def docx_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ref = F.when(d % 3 == 0, F.concat(F.lit("r"), (d % 4).cast("string")))
    blocks = _docs(spark, sf_dir).select(F.floor(d / 50).alias("doc"), d.alias("seq"), F.when(ref.isNull(), "heading").otherwise("image").alias("block_type"), F.concat(F.lit("t"), d.cast("string")).alias("text"), ref.alias("ref"))
    texts = _docs(spark, sf_dir).select(F.floor(d / 50).alias("doc")).distinct().crossJoin(F.broadcast(spark.createDataFrame([("r1", "one"), ("r2", "two")], "ref string, text string")))  # two rows
    return transcription.replace_images(blocks, texts).select("seq", "block_type", "text")


def verify_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return evaluation.first_pass(table(spark, sf_dir, "events").select("event_type", (e % 4 != 0).alias("reached"), (e % 3).alias("retries")), "event_type")


def bm25_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, c = _cases(spark, sf_dir), chunks(spark, sf_dir)
    asked = cases.select(F.col("case").alias("query_id"), F.lit(0).alias("sig"), F.array_join(F.slice(F.split("anchor", " "), 1, 3), " ").alias("question"))
    expected = evaluation.locate(cases, c).withColumnRenamed("case", "query_id")
    firsts = bm25.first_ranks(c.withColumn("sig", F.lit(0)), asked, expected).withColumnRenamed("query_id", "case")
    return evaluation.probe(cases, firsts).withColumn("type", F.coalesce("type", F.lit("all")))


def calibrate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select((F.col("value") + F.when(F.col("event_id") % 2 == 0, 30.0).otherwise(0.0)).alias("score"), (F.col("event_id") % 2 == 0).alias("in_scope"))
    grid = spark.createDataFrame([(float(t),) for t in range(0, 100, 5)], "threshold double")
    return evaluation.best_threshold(gate.sweep(scores, grid)).select("threshold", F.round("survive", 6).alias("survive"), F.round("detect", 6).alias("detect"))


def rewrite_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.substring("content", 1, F.col("thread").cast("int") % 12)
    cases = _messages(spark, sf_dir).filter("role = 'user'").select(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("amount of the rule "), said)).otherwise(said).alias("q"), (F.col("thread") % 2 == 0).alias("expected"))
    grid = spark.createDataFrame([(t,) for t in range(4, 11)], "threshold int")
    return evaluation.agreement(cases, grid, conversation.self_contained(F.col("q"), F.lit(True), F.col("threshold")))


def _notes(seq: Column, content: Column) -> Column:
    note = F.when(seq % 3 == 0, F.concat(F.lit("rewrite: "), content)).when(seq % 3 == 1, "rewrite: rule skip").otherwise("verify: ok")
    return F.when(seq % 5 == 4, F.array(F.lit("route: x"))).otherwise(F.array(F.lit("route: x"), note, F.lit("verify: ok")))


def rewrite_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.rewrite_trace(_notes(F.col("seq"), F.concat(F.lit("q"), F.col("thread").cast("string"))))
    return _messages(spark, sf_dir).select("thread", "seq", t["mode"].alias("mode"), t["query"].alias("query"))


def multi_turn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("q"), (F.col("thread") % 2).cast("string"))
    turns = conversation.last_messages(_messages(spark, sf_dir), 1).select(q.alias("question"), _notes(F.col("seq"), F.lit("q1")).alias("notes"), (F.col("seq") % 2 == 0).alias("verifiable"), (F.col("thread") % 3 == 0).alias("anchor_hit"))
    return evaluation.multi_turn(turns)


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    files = _docs(spark, sf_dir).select(_one_of(d, "done", "skip", "failed").alias("status"), (d % 10).alias("chunks"))
    return evaluation.ingest_report(files).withColumn("status", F.coalesce("status", F.lit("all")))


def usage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("role").agg(F.sum(evaluation.est_usage(F.col("content"))).alias("tokens"))


def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    body = F.concat(F.lit('{"answer": "A'), d.cast("string"), F.lit('", "confidence": 0.5}'))
    raw = F.when(d % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\nmore"))).when(d % 4 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(d % 4 == 2, body).otherwise("no object")
    got = conversation.strict_json(raw, "answer string, confidence double")
    return _docs(spark, sf_dir).select("doc_id", got["answer"].alias("answer"), got["confidence"].alias("confidence"))


def intent_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.concat(F.when(d % 3 == 0, "<intent>fact</intent>\n ").when(d % 3 == 1, F.concat(F.lit("<intent>"), F.repeat(F.lit("x"), 300), F.lit("</intent>"))).otherwise("  "), F.lit("body <q>in"), d.cast("string"), F.lit("</q> end"))
    got = conversation.split_intent(raw)
    return _docs(spark, sf_dir).select("doc_id", got["intent"].alias("intent"), F.md5(got["answer"]).alias("answer_md5"), conversation.extract_tag(raw, "q").alias("tagged"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    made = conversation.prompt("answer", F.concat(F.lit("q"), d.cast("string")), F.substring("text", 1, 100), F.when(d % 2 == 0, "said"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(made).alias("prompt_md5"))


def upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    incoming = _docs(spark, sf_dir).select(F.concat(F.lit("t"), (d % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), d.cast("string")).alias("doc_key"), F.md5(F.concat("text", F.when(d % 5 == 0, "!").otherwise(""))).alias("content_hash"))
    return service.upload_state(incoming, _registry(spark, sf_dir))


def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("f."), _one_of(d, "PDF", "txt", "exe", "docx"))
    code = service.upload_error(name, _one_of(d, "application/pdf; q=1", "TEXT/html", "", "image/png", None), d % 6 * 20_000_000)
    return _docs(spark, sf_dir).select("doc_id", code.alias("code"), service.http_status(code).cast("int").alias("http"))


def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    thread = F.concat(_one_of(d, "t0:", "t1:", ""), F.lit("x"))
    code = service.request_error(F.col("text"), F.when(d % 7 > 0, d % 60), F.when(d % 11 == 0, -1), thread, F.lit("t0"))
    body = service.error_body(code, F.lit("bad"), d.cast("string"))
    return _docs(spark, sf_dir).select("doc_id", code.alias("code"), F.when(code.isNotNull(), body).alias("body"))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.history_page(_messages(spark, sf_dir), 0).select("thread", "seq", "role")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select(e.alias("id"), _one_of(e, "slow_query", "llm_call", "ingest_slow", "kb_gap").alias("event"), (e * 37 % 7000).alias("duration_ms"), F.repeat(F.lit("ab"), (e % 150).cast("int")).alias("query"))
    return service.json_lines(service.logged(events)).select(F.md5("line").alias("line_md5"))


def warning_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    warning = F.concat(_one_of(d, "Page ", "第 ", "block "), (d % 90).cast("string"), F.lit(" 页 is red"))
    return _docs(spark, sf_dir).select("doc_id", service.warning_pages(warning).alias("page"))


def embed_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return registry.new_only(c.filter("chunk % 3 = 0").withColumn("is_valid", F.lit(False)), c.filter("chunk % 2 = 0")).select("chunk")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _docs(spark, sf_dir).select(F.floor(d / 5).alias("doc"), (d * 7 % 5).alias("version"), F.coalesce("lang", F.lit("-")).alias("lang"))
    return registry.latest(rows).select("doc", "version", "lang")


def version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("update_time", F.lit(0))
    new = c.filter("doc % 3 = 0").withColumns({"version": F.lit(2), "effective_time": F.lit(0)})
    return registry.swap_version(c, new, F.lit(NOW)).groupBy("version", "is_valid", "update_time").agg(F.count("*").alias("n"), F.count_if(F.col("effective_time") > 0).alias("timed"))


_PROBE = f"""WITH {CHUNKS_SQL}, {_CASES}, questions AS (SELECT "case" AS query_id, array_to_string(string_split(anchor, ' ')[1:3], ' ') AS question FROM cases), {_LOC}, {_bm25(_eligible('true'), '0', 1 << 30)},
firsts AS (SELECT type, min(rank) AS r FROM loc JOIN bm ON bm.query_id = loc."case" AND bm.chunk = loc.chunk JOIN cases ON cases."case" = loc."case" GROUP BY loc."case", type)"""
_OCR = "d AS (SELECT doc_id, doc_id // 6 AS doc, doc_id % 6 // 2 AS page, (doc_id // 6 + doc_id % 6 // 2) % 3 = 0 AS red FROM documents)"
_TRACE = "CASE WHEN seq % 5 = 4 THEN 'none' WHEN seq % 3 = 0 THEN 'llm' WHEN seq % 3 = 1 THEN 'skip' ELSE 'none' END"
_X = "repeat('x', 300)"

QUERIES = {
    "bm25_zero_fill": (bm25_zero_fill, f"{_HEAD}, {_bm25(_eligible('true'), '0', 20)} SELECT query_id, chunk, rank FROM bm WHERE score = 0"),
    "hybrid_topk": (hybrid_topk, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 20)}, {_VEC}, x AS (SELECT query_id, doc, ci, min(rank) AS of_rank FROM (SELECT query_id, rank, chunk // 4 AS doc, chunk % 4 + 1 + unnest([-1, 1]) AS ci FROM f WHERE rank <= 3) WHERE ci >= 1 GROUP BY ALL), y AS (SELECT x.query_id, c.chunk, of_rank, x.doc, ci FROM x JOIN chunks c ON c.doc = x.doc AND c.chunk_index = ci WHERE permission <> 'secret' AND (effective_time = 0 OR effective_time >= 2000) AND (x.query_id, c.chunk) NOT IN (SELECT query_id, chunk FROM f)), nb AS (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY of_rank, doc, ci) AS n FROM y QUALIFY n <= 4) SELECT query_id, chunk, rank, round(score, 6) AS score, false AS is_context FROM f UNION ALL SELECT query_id, chunk, n, 0.0::DOUBLE, true FROM nb"),
    "chunks_by_ids": (chunks_by_ids, f"WITH {CHUNKS_SQL} SELECT chunk, 0.0::DOUBLE AS score FROM chunks WHERE {_T0} AND chunk IN (0, 2, 3, 4, 12, 16)"),
    "disclose_suffix": (disclose_suffix, "SELECT doc_id, 'A' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ' (Sources may not cover every point.)' ELSE ' (No source was found for this.)' END AS answer FROM documents"),
    "page_split": (page_split, "WITH s AS (SELECT doc_id, doc_id % 5 + 1 AS n, list_transform(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(12)), chr(12)), lambda x: trim(x, chr(10))) AS p FROM documents), q AS (SELECT doc_id, CASE WHEN len(p) < n THEN list_concat(p, list_transform(range(n - len(p)), lambda i: '')) WHEN len(p) > n THEN list_concat(list_slice(p, 1, n - 1), [array_to_string(list_slice(p, n, len(p)), chr(12))]) ELSE p END AS p FROM s) SELECT doc_id, unnest(range(len(p))) AS page, md5(unnest(p)) AS digest FROM q"),
    "page_paragraph": (page_paragraph, r"WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split('年' || chr(10) || '假' || chr(10) || 'of a' || chr(10) || 'b' || chr(10) || 'c ' || chr(10) || chr(10) || coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS s FROM documents), t AS (SELECT doc_id, regexp_replace(s, '([\x00-\x7f])\n([\x00-\x7f])', '\1 \2', 'g') AS s FROM l), u AS (SELECT doc_id, replace(regexp_replace(s, '([\x00-\x7f])\n([\x00-\x7f])', '\1 \2', 'g'), chr(10), '') AS s FROM t) SELECT doc_id, length(s)::BIGINT AS n, md5(s) AS digest FROM u"),
    "ocr_pages": (ocr_pages, "SELECT doc_id // 20 AS doc, doc_id % 20 AS page FROM documents WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) <= 4"),
    "ocr_images": (ocr_images, "WITH i AS (SELECT page_id // 25 AS doc, page_id % 7 AS ref, min(page_id % 25) AS page FROM pages WHERE page_id % 9 <> 0 AND 40 + page_id % 60 >= 64 AND 30 + page_id % 80 >= 64 GROUP BY ALL) SELECT doc, page, ref FROM i QUALIFY row_number() OVER (PARTITION BY doc ORDER BY page, ref) <= 3"),
    "ocr_positions": (ocr_positions, r"WITH b AS (SELECT doc_id // 2 AS pg, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS i, regexp_replace(coalesce(text, ''), '[\s\x0b\x{00a0}\x{3000}]+', '', 'g') AS t FROM documents), im AS (SELECT doc_id AS ref, doc_id // 2 AS pg, CASE doc_id % 4 WHEN 0 THEN substr(coalesce(text, ''), 1, 12) || ' ' || substr(coalesce(text, ''), 13, 30) WHEN 2 THEN 'xy' END AS above FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0), s AS (SELECT *, substr(regexp_replace(above, '[\s\x0b\x{00a0}\x{3000}]+', '', 'g'), 1, 16) AS sn FROM im) SELECT ref, CASE WHEN any_value(above) IS NULL THEN 0 ELSE coalesce(max(i) FILTER (length(sn) >= 4 AND contains(t, sn)), max(i)) END AS pos FROM s JOIN b USING (pg) GROUP BY ref"),
    "ocr_merge": (ocr_merge, f"WITH {_OCR}, b AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY doc_id) * 2 - 1 AS slot, 'block' AS origin, 'b' || doc_id AS text FROM d WHERE NOT red), i AS (SELECT d.doc, d.page, greatest(0, least(d.doc % 5 - 1, n)) * 2 AS slot, 'image' AS origin, 'i' || doc_id AS text FROM d JOIN (SELECT doc, page, count(*) AS n FROM d GROUP BY ALL) USING (doc, page) WHERE NOT red AND doc_id % 2 = 0), p AS (SELECT doc, page, 1000000 AS slot, 'page' AS origin, 'p' || doc_id AS text FROM d WHERE red AND doc_id % 2 = 0), u AS (FROM b UNION ALL FROM i UNION ALL FROM p) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, slot) - 1 AS seq, page, origin, text FROM u"),
    "docx_images": (docx_images, "SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'paragraph' ELSE 'heading' END AS block_type, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 1 THEN 'one' ELSE 'two' END ELSE 't' || doc_id END AS text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 IN (1, 2)"),
    "verify_first_pass": (verify_first_pass, "SELECT event_type, count(*) AS reached, count(*) FILTER (event_id % 3 = 0) AS first_pass, sum(event_id % 3 + 1)::BIGINT AS judgements, max(event_id % 3) AS most_retries, round(avg(event_id % 3), 4) AS avg_retries, round(count(*) FILTER (event_id % 3 = 0) / count(*), 4) AS first_pass_rate, count(*) FILTER (event_id % 3 > 0) AS retried FROM events WHERE event_id % 4 <> 0 GROUP BY event_type"),
    "bm25_probe": (bm25_probe, f"{_PROBE} SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg((r <= 1)::INT), 6) AS recall_1, round(avg((r <= 5)::INT), 6) AS recall_k, round(avg(1 / r), 6) AS mrr FROM firsts GROUP BY ROLLUP (type)"),
    "calibrate_best": (calibrate_best, "WITH g AS (SELECT threshold::DOUBLE AS threshold, avg((value + 30 >= threshold)::INT) FILTER (event_id % 2 = 0) AS s, avg((value < threshold)::INT) FILTER (event_id % 2 <> 0) AS d FROM events, (SELECT unnest(range(0, 100, 5)) AS threshold) GROUP BY 1) SELECT threshold, round(s, 6) AS survive, round(d, 6) AS detect FROM g WHERE s >= 0.98 ORDER BY d DESC, threshold LIMIT 1"),
    "rewrite_replay": (rewrite_replay, f"WITH {_MSG}, q AS (SELECT CASE WHEN seq % 3 = 0 THEN 'amount of the rule ' ELSE '' END || substr(content, 1, thread % 12) AS q, thread % 2 = 0 AS expected FROM m WHERE role = 'user'), v AS (SELECT t AS threshold, expected, NOT regexp_matches(lower(q), 'the above|as before|the former|the latter') AND NOT list_has_any(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), ['it', 'this', 'that', 'these', 'those', 'they', 'he', 'she']) AND length(q) > t AND NOT regexp_matches(lower(q), '\\b(of the|for the|of)\\s+({'|'.join(conversation.HEADS)})\\b') AS skip FROM q, (SELECT unnest(range(4, 11)) AS t)) SELECT threshold, count(*) FILTER (skip) AS skipped, count(*) FILTER (skip = expected) AS agreed FROM v GROUP BY threshold"),
    "rewrite_modes": (rewrite_modes, f"WITH {_MSG} SELECT thread, seq, {_TRACE} AS mode, CASE WHEN {_TRACE} = 'llm' THEN 'q' || thread ELSE '' END AS query FROM m"),
    "multi_turn_report": (multi_turn_report, f"WITH {_MSG}, l AS (SELECT thread, max(seq) AS seq FROM m GROUP BY thread) SELECT count(*) AS cases, round(avg(({_TRACE} = 'skip')::INT), 4) AS skip_rate, count(*) FILTER ({_TRACE} = 'llm' AND thread % 2 = 1) AS identity_rewrites, count(*) FILTER (seq % 2 = 0) AS verifiable, count(*) FILTER (thread % 3 = 0) AS anchor_hit FROM l"),
    "ingest_totals": (ingest_totals, "WITH f AS (SELECT ['done', 'skip', 'failed'][doc_id % 3 + 1] AS status, doc_id % 10 AS chunks FROM documents) SELECT coalesce(status, 'all') AS status, count(*) AS files, sum(chunks)::BIGINT AS chunks FROM f GROUP BY ROLLUP (status)"),
    "usage_estimate": (usage_estimate, f"WITH {_MSG} SELECT role, sum(length(content) // 2)::BIGINT AS tokens FROM m GROUP BY role"),
    "answer_json": (answer_json, "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'A' || doc_id END AS answer, CASE WHEN doc_id % 4 < 3 THEN 0.5::DOUBLE END AS confidence FROM documents"),
    "intent_tag": (intent_tag, f"WITH b AS (SELECT doc_id, 'body <q>in' || doc_id || '</q> end' AS b FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fact' END AS intent, md5(CASE WHEN doc_id % 3 = 1 THEN '<intent>' || {_X} || '</intent>' ELSE '' END || b) AS answer_md5, 'in' || doc_id AS tagged FROM b"),
    "prompt_build": (prompt_build, "SELECT doc_id, md5('Answer from the evidence alone and cite it.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '<history>said</history>' ELSE '' END || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || '<evidence>' || substr(text, 1, 100) || '</evidence>' ELSE '' END || chr(10) || '<question>q' || doc_id || '</question>') AS prompt_md5 FROM documents"),
    "upload_states": (upload_states, f"WITH {_REG}, i AS (SELECT 't' || (doc_id % 2) AS tenant_id, 'k' || doc_id AS doc_key, md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS h FROM documents), j AS (SELECT i.tenant_id, i.doc_key, version AS v, status, is_deleted, h = content_hash AS same FROM i LEFT JOIN reg USING (tenant_id, doc_key)) SELECT tenant_id, doc_key, CASE WHEN status = 'processing' THEN 409 WHEN same AND NOT is_deleted AND status = 'done' THEN 200 ELSE 202 END AS http, CASE WHEN v IS NULL THEN 1 WHEN status = 'processing' THEN v WHEN same AND (status = 'failed' OR NOT is_deleted) THEN v ELSE v + 1 END AS version FROM j"),
    "upload_check": (upload_check, f"WITH u AS (SELECT doc_id, ['pdf', 'txt', 'exe', 'docx'][doc_id % 4 + 1] AS s, ['application/pdf', 'text/html', '', 'image/png', ''][doc_id % 5 + 1] AS k, doc_id % 6 * 20000000 AS size FROM documents), c AS (SELECT doc_id, CASE WHEN s = 'exe' OR NOT (k IN ('', 'text/html') OR s = 'pdf' AND k = 'application/pdf') THEN '{service.UNSUPPORTED}' WHEN size > 52428800 THEN '{service.TOO_LARGE}' WHEN size = 0 THEN '{service.INVALID}' END AS code FROM u) SELECT doc_id, code, CASE code WHEN '{service.UNSUPPORTED}' THEN 415 WHEN '{service.TOO_LARGE}' THEN 413 WHEN '{service.INVALID}' THEN 422 ELSE 200 END AS http FROM c"),
    "request_check": (request_check, f"WITH c AS (SELECT doc_id, length(coalesce(text, '')) NOT BETWEEN 1 AND 4000 OR doc_id % 7 > 0 AND doc_id % 60 NOT BETWEEN 1 AND 50 OR doc_id % 11 = 0 OR doc_id % 3 = 1 AS bad FROM documents) SELECT doc_id, CASE WHEN bad THEN '{service.INVALID}' END AS code, CASE WHEN bad THEN '{{\"error\":{{\"code\":\"{service.INVALID}\",\"message\":\"bad\",\"request_id\":\"' || doc_id || '\"}}}}' END AS body FROM c"),
    "history_page": (history_page, f"WITH {_MSG} SELECT thread, seq, role FROM m QUALIFY row_number() OVER (PARTITION BY thread ORDER BY seq DESC) = 1"),
    "event_lines": (event_lines, "WITH e AS (SELECT event_id, ['slow_query', 'llm_call', 'ingest_slow', 'kb_gap'][event_id % 4 + 1] AS event, event_id * 37 % 7000 AS ms, substr(repeat('ab', (event_id % 150)::INT), 1, 200) AS query FROM events) SELECT md5('{\"id\":' || event_id || ',\"event\":\"' || event || '\",\"duration_ms\":' || ms || ',\"query\":\"' || query || '\"}') AS line_md5 FROM e WHERE ms >= CASE event WHEN 'slow_query' THEN 500 WHEN 'llm_call' THEN 3000 WHEN 'ingest_slow' THEN 5000 ELSE 0 END"),
    "warning_pages": (warning_pages, "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN (doc_id % 90)::INT END AS page FROM documents"),
    "embed_new_only": (embed_new_only, f"WITH {CHUNKS_SQL} SELECT chunk FROM chunks WHERE chunk % 2 = 0 AND chunk % 3 <> 0"),
    "latest_version": (latest_version, "SELECT doc_id // 5 AS doc, max(doc_id * 7 % 5) AS version, arg_max(coalesce(lang, '-'), doc_id * 7 % 5) AS lang FROM documents GROUP BY 1"),
    "version_swap": (version_swap, f"WITH {CHUNKS_SQL}, t AS (SELECT doc, max(effective_time) AS time FROM chunks GROUP BY doc) SELECT 1 AS version, doc % 3 <> 0 AS is_valid, CASE WHEN doc % 3 = 0 THEN 2000 ELSE 0 END AS update_time, count(*) AS n, count(*) FILTER (effective_time > 0) AS timed FROM chunks GROUP BY ALL UNION ALL SELECT 2, true, 0, count(*), count(*) FILTER (time > 0) FROM chunks JOIN t USING (doc) WHERE doc % 3 = 0"),
}
