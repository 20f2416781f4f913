"""Whole retrieval, the gate's fallback, whole anchor vocabularies, ingest of a batch, answers with retries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import agent, bm25, dense, evaluation, gate, ingest, retrieval, scratch, vector
from tessera.plans.fixtures import CHUNKS_SQL, NOW, QUESTIONS, chunks, table
from tessera.plans.retrieval_queries import _bm25, _mock
from tessera.plans.text_queries import TOKENS
from tessera.sources import files

ASKED = [(i, q, "t0", "internal") for i, q in QUESTIONS] + [(6, "the and of das und", "t2", "internal"), (7, "nobody is here", "t9", "internal")]
REAL_ASKED = [*ASKED, (8, "zzqx vvkk", "t0", "internal"), (9, "xxqw the", "t1", "secret")]
BLOCKED = ["document", "source"]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired chunks of every third document belong to a tenant of their own, which has nothing current."""
    expired = (F.col("effective_time") == 1000) & (F.col("chunk") % 3 == 0)
    return chunks(spark, sf_dir).withColumn("tenant_id", F.when(expired, "t2").otherwise(F.col("tenant_id")))


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, question string, tenant_id string, user_permission string")


def _retrieved(spark: SparkSession, sf_dir: str, provider: str = "mock") -> retrieval.Retrieved:
    c = _chunks(spark, sf_dir)
    return retrieval.retrieve(_questions(spark), c, vector.mock_embedding(c.select("chunk", "content"), "chunk", "content"), NOW, provider)


def retrieve_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).items.select("query_id", "kind", "rank", "chunk", F.round("score", 6).alias("score"), "year_pass")


def retrieve_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _retrieved(spark, sf_dir).verdicts
    return v.select("query_id", "n_item", "n_expired", "n_context", "year_pass", "no_relevant", F.array_join("used_roads", ",").alias("used_roads"), F.size("notes").alias("n_notes"))


def retrieve_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector road fails: the lexical one alone answers, and the failure is a row."""
    c = _chunks(spark, sf_dir)
    out = retrieval.retrieve(_questions(spark), c, None, NOW)
    failed = spark.createDataFrame(out.degraded or [("", "")], "road string, error string").select("road")
    return out.items.filter("kind = 'item'").groupBy("query_id").agg(F.count("*").alias("n"), F.sum("chunk").alias("chunk_sum")).crossJoin(failed)  # a row


def retrieve_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = retrieval.relaxed_retrieve(_questions(spark), c, None, NOW)
    return out.items.filter("kind <> 'context'").select("query_id", "kind", "rank", "chunk", "validity")


def retrieve_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    vectors = vector.mock_embedding(c.select("chunk", "content"), "chunk", "content")
    shown = retrieval.debug_retrieve(_questions(spark), c, vectors, NOW, True, "mock")
    return shown.filter(F.col("pass") == "base").select("query_id", "rank", "chunk", "vector_rank", "bm25_rank", F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), F.md5("content").alias("content_md5"))


def _real(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with stored embeddings (every eleventh superseded, some without a vector), questions, and the vectors that a provider has for the questions."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = e.agg(F.count("*").alias("_n"))
    c = _chunks(spark, sf_dir).withColumns({"is_valid": F.col("chunk") % 11 != 3, "department": F.concat(F.lit("d"), (F.col("chunk") % 17).cast("string"))}).crossJoin(n)  # a row
    held = c.withColumn("vec_id", F.when(F.col("chunk") % 13 != 5, F.col("chunk") % F.col("_n"))).join(e, "vec_id", "left").drop("vec_id", "_n")
    questions = spark.createDataFrame(REAL_ASKED, "query_id int, question string, tenant_id string, user_permission string")
    turned = F.when(F.col("query_id") == 5, F.transform("embedding", lambda x, i: F.when(i % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))).otherwise(F.col("embedding"))
    said = questions.join(e, F.col("vec_id") == F.col("query_id") * 20).select("query_id", "question", turned.alias("embedding"))
    return held, questions, said


def _put(df: DataFrame, by: list[str]) -> DataFrame:
    where = scratch.folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(where)
    return df.sparkSession.read.parquet(where)


def _provider(said: DataFrame):
    return lambda texts: texts.join(said.select(F.col("question").alias("chunk"), "embedding"), "chunk").select("chunk", "embedding")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 20 nearest of stored embeddings through cells, for a filter that leaves under 1 % of chunks and one that leaves many."""
    held, questions, said = _real(spark, sf_dir)
    index = dense.build(held.drop("content"), _put)
    spec = {"category": F.lit(None).cast("string"), "now": F.lit(NOW).cast("long"), "include_expired": F.lit(False), "years": F.lit(None).cast("array<int>")}
    narrow = questions.withColumns({"department": F.lit("d3"), **spec})
    wide = questions.withColumns({"department": F.lit(None).cast("string"), **spec})
    every = narrow.withColumn("kind", F.lit("narrow")).unionByName(wide.withColumn("kind", F.lit("wide"))).join(said.select("query_id", F.col("embedding").alias("query")), "query_id")
    asked = every.withColumns({"qp": F.concat_ws(":", F.col("query_id").cast("string"), "kind"), "sig": F.xxhash64("tenant_id", "user_permission", "kind")})
    return index.search(asked).select("qp", "rank", "chunk", F.round("score", 6).alias("score"))


def retrieve_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole retrieval on stored embeddings with a provider that isn't the mock: what the gate judges, with superseded chunks present."""
    held, questions, said = _real(spark, sf_dir)
    index = dense.build(held.filter("is_valid").drop("content"), _put)
    v = retrieval.retrieve(questions, held, dense.road(index, _provider(said)), NOW, "real").verdicts
    return v.select("query_id", "coverage", F.round("top_cosine", 6).alias("top_cosine"), "no_relevant")


GATE_QUESTIONS = [(1, "the thation licensed qqxv"), (2, "onre zzqx"), (3, "of the"), (4, "license versionen")]


def coverage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(GATE_QUESTIONS, "query_id int, question string")
    covered = gate.coverage(asked, chunks(spark, sf_dir), fallback=True)
    return covered.select("query_id", "coverage", F.array_join("absent", ",").alias("absent"))


def coverage_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index after documents that were valid once have gone: all are committed, then the expired ones leave, and the questions meet no text."""
    asked = spark.createDataFrame(GATE_QUESTIONS, "query_id int, question string")
    held = chunks(spark, sf_dir)
    index = bm25.PostingsIndex(spark, scratch.folder(spark))
    index.commit(held.select("chunk", "content"))
    index.commit(held.select("chunk", "content").limit(0), held.filter("effective_time = 1000").select("chunk"))
    return gate.coverage(asked, held, index=index).select("query_id", "coverage", F.array_join("absent", ",").alias("absent"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc", F.concat(F.lit("Document "), F.col("source"), F.lit(" Größe 年假")).alias("title")).distinct()


def anchor_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.whole_anchor_vocabulary(chunks(spark, sf_dir), _titles(spark, sf_dir), BLOCKED).select("source", "term", "docs")


def anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.anchor_counts(gate.whole_anchor_vocabulary(chunks(spark, sf_dir), _titles(spark, sf_dir), BLOCKED))


def anchor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = gate.whole_anchor_vocabulary(chunks(spark, sf_dir), _titles(spark, sf_dir), BLOCKED).filter(F.col("source").isin("title", "title_gram"))
    asked = spark.createDataFrame([(1, "what of Größe here"), (2, "年假 src3"), (3, "xq"), (4, None)], "query_id int, question string")
    return gate.anchors(asked, terms).select("query_id", F.array_join("terms", ",").alias("terms"))


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("dir/file"), d.cast("string"), F.lit("_20"), F.lpad((d % 30).cast("string"), 2, "0"), F.lit("-05-01.v1.md")).alias("doc_key"), F.lit("md").alias("format"), F.when(d % 3 == 0, "hr").when(d % 3 == 1, "").alias("category"))
    return ingest.doc_meta(docs).select("doc_key", "doc_id", "doc_title", "source", "doc_date", "doc_year", "category")


def metadata_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 2 == 0, "hr").alias("department"), F.when(d % 3 == 0, 0).when(d % 3 == 1, 2020).alias("doc_year"), F.when(d % 5 != 0, d).alias("effective_time"), F.when(d % 4 == 0, F.array(F.lit("a"), F.lit("b"))).alias("image_ids"), F.lit(None).cast("string").alias("author"))
    return ingest.with_sentinels(rows).select("doc_id", "department", "doc_year", "effective_time", "image_ids", "author", "category", "permission")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of files: in the second, every fifth has changed and every seventh can't be parsed."""
    d = F.col("doc_id")
    base = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    make = lambda text, kind: base.select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("f"), d.cast("string"), F.lit(".txt")).alias("doc_key"), kind.alias("format"), text.alias("text"), F.lit(None).cast("binary").alias("content"), F.sha2(text, 256).alias("content_hash"), F.lit(False).alias("force"))
    first = make(F.col("text"), F.when(d % 7 == 3, "exe").otherwise("txt"))
    second = make(F.when(d % 5 == 0, F.concat(F.col("text"), F.lit("\n\nmore"))).otherwise(F.col("text")), F.lit("txt"))
    return first, second


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the registry after two runs: broken files of the first are retried by the second, changed ones get a version."""
    first, second = _batches(spark, sf_dir)
    one = ingest.ingest(first, spark.createDataFrame([], ingest.REGISTRY), None, 100)
    two = ingest.ingest(second, one.registry, one.chunks, 200)
    return two.registry.groupBy("version", "status", "updated_at").agg(F.count("*").alias("n"), F.sum(F.xxhash64("content_hash") * 0 + F.length("doc_key")).alias("key_chars"))


def ingest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _batches(spark, sf_dir)
    one = ingest.ingest(first, spark.createDataFrame([], ingest.REGISTRY), None, 100)
    two = ingest.ingest(second, one.registry, one.chunks, 200)
    both = one.report.withColumn("run", F.lit(1)).unionByName(two.report.withColumn("run", F.lit(2)))
    return both.groupBy("run", "action", "status").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks by document and a registry that holds their documents but every sixth."""
    c = chunks(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc"), (1 + F.col("chunk") % 2).cast("int").alias("version"), "chunk", "is_valid", "effective_time", F.lit(1).cast("long").alias("update_time"))
    docs = chunks(spark, sf_dir).filter(F.col("doc") % 6 != 5).select("doc").distinct()
    reg = docs.select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("k"), F.col("doc").cast("string")).alias("doc_key"), F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc_id"), F.lit(2).alias("version"), F.lit("done").alias("status"), F.lit("h").alias("content_hash"), F.lit(False).alias("is_deleted"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    return c, reg


def delete_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, reg = _registry(spark, sf_dir)
    asked = chunks(spark, sf_dir).filter("doc % 2 = 1").select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc_id")).distinct()
    after, marked, answers = ingest.delete_documents(c, reg, asked, F.lit(9).cast("long"))
    again, same, _ = ingest.delete_documents(after, marked, asked, F.lit(10).cast("long"))  # a second time changes nothing
    lines = [
        again.agg(F.lit("valid chunks").alias("what"), F.count_if("is_valid").alias("n")),
        same.agg(F.lit("deleted at 9").alias("what"), F.count_if(F.col("is_deleted") & (F.col("updated_at") == 9)).alias("n")),
        answers.agg(F.lit("unknown").alias("what"), F.count_if(F.col("status") == 404).alias("n")),
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def patch_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, reg = _registry(spark, sf_dir)
    changes = reg.filter("CAST(substring(doc_id, 2) AS LONG) % 4 = 0").select("tenant_id", "doc_id", F.lit(77).cast("long").alias("effective_time"))
    after, answers = ingest.patch_documents(c, reg, changes)
    return answers.join(after.filter("effective_time = 77").groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n")), "doc_id").select("doc_id", "chunks_updated", "n")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    report = docs.filter("doc_id % 5 <> 4").select(F.lit("t0").alias("tenant_id"), d.cast("string").alias("doc_key"), F.element_at(F.array(*map(F.lit, ("done", "failed", "skipped", "processing"))), (d % 4 + 1).cast("int")).alias("status"), (d % 9).alias("chunks"), F.when(d % 4 == 1, "broken").alias("error"))
    tasks = docs.select(d.alias("task_id"), F.lit("t0").alias("tenant_id"), d.cast("string").alias("doc_key"))
    return ingest.task_status(report, tasks).select("task_id", "code", "status", "percent", "chunks_done", "error")


def load_test_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    results = table(spark, sf_dir, "events").select(F.when(e % 10 == 3, 500).when(e % 7 == 0, 202).otherwise(200).alias("status"), F.col("value").alias("duration_ms"), F.when(e % 20 == 3, "timeout").alias("err"), F.array("event_type", F.lit("done")).alias("events"))
    r = evaluation.load_test(results)
    totals = r["totals"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.round(F.col(c).cast("double"), 6).alias("n")) for c in ("n", "ok", "bad", "error_pct", "p50", "p90", "p99", "max", "mean")])).alias("x")).select("x.*")
    rest = r["errors"].select(F.col("error").alias("what"), F.col("n").cast("double").alias("n")).unionByName(r["events"].select(F.col("event").alias("what"), F.col("n").cast("double").alias("n")))
    return totals.unionByName(rest)


def replay_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("question")
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.coalesce("text", F.lit("")).alias("question"), (F.col("conv_id") % 2 == 0).alias("expected"), F.concat(F.lit("type"), (F.col("turn") % 3).cast("string")).alias("type"))
    rules = {"long": n > F.col("threshold") * 10, "even": n % 2 == 0, "never": F.lit(False)}
    return evaluation.replay(said, rules, [4, 6, 8, 10], "type")


def answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greeting, contact, no data, confirmation, answered, and disclosed after retries, as the questions reach them without a model."""
    c = _chunks(spark, sf_dir)
    q = _questions(spark).unionByName(spark.createDataFrame([(8, "hello", "t0", "internal"), (9, "what is your phone number", "t0", "internal")], "query_id int, question string, tenant_id string, user_permission string"))
    got = retrieval.retrieve(q, c, None, NOW)
    titled = c.select("chunk", F.when(F.col("chunk") % 4 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("doc").cast("string"))).alias("doc_title"), F.lit(0).alias("page_num"), F.lit("").alias("doc_date"), "content")
    lines = agent.evidence(got.items, titled)
    history = q.select("query_id", F.lit("").alias("text"))
    out = agent.answer(q.withColumn("include_expired", F.lit(False)), got, lines, history, agent.stub_ask, _strict_judge)
    return out.select("query_id", "route", "intent", F.array_join("citations", ",").alias("citations"), "grounded", "confidence", "degraded", "retries")


def _strict_judge(answers: DataFrame) -> DataFrame:
    """Not sure of answers that cite a document without a title."""
    sure = ~F.contains("answer", F.lit("[source: ]"))
    return answers.select("query_id", sure.alias("grounded"), F.when(sure, 0.9).otherwise(0.3).alias("confidence"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, F.lit("x")).when(d % 4 == 1, F.concat(F.lit("���"), F.repeat(F.lit("y"), 150))).when(d % 4 == 2, F.repeat(F.lit("z"), 50)).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(files.grade_signals(text, d % 5), ",").alias("signals"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents whose pages are whole texts under a repeated head and foot; every ninth document is encrypted."""
    d = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.floor(d / 4).cast("string")).alias("doc"), (d % 4).alias("page"), F.concat(F.lit("HEAD\n\n第一章 总则\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#|`!\n]+", " "), F.lit("\n\nFOOT")).alias("text"), F.lit(0).alias("image_count"), (F.floor(d / 4) % 9 == 0).alias("encrypted"))
    blocks = files.pdf_blocks(pages)
    return blocks.groupBy("block_type", "warning").agg(F.count("*").alias("n"), F.count_if(F.col("text").isin("HEAD", "FOOT")).alias("edges"))


def head_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of heads of every kind: UTF-8 cut within a character, GBK, binary, archives, old office files, whole page sources."""
    p = F.col("page_id")
    utf = F.encode(F.repeat(F.lit("年"), 400), "UTF-8")
    gbk = F.unhex(F.repeat(F.lit("C4EABCD9"), 300))
    kinds = F.array(utf, gbk, F.unhex(F.lit("00FF0102FE")), F.unhex(F.lit("504B0304FFFF")), F.unhex(F.lit("D0CF11E0A1B1")), F.unhex(F.lit("25504446")), F.encode("html", "UTF-8"))
    raw = F.element_at(kinds, (p % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit(""))).select("page_id", files.detect_format(F.lit("upload"), raw).alias("format"))


def chunk_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chunking must keep, by document: its characters other than white space where nothing overlaps, numbers from 1, bounded sizes, offsets that follow."""
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = files.parse_blocks(base.select("doc", F.lit("txt").alias("format"), "text", F.lit(None).cast("binary").alias("content"))).withColumn("page", F.lit(None).cast("int"))
    from tessera.operators.chunking import chunk_documents

    made = ingest.with_offsets(chunk_documents(blocks, 256, 0))
    bare = lambda c: F.regexp_replace(c, "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x1c-\\x1f\\x85]+", "")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    got = made.groupBy("doc").agg(F.md5(bare(whole)).alias("letters"), (F.max("chunk_index") == F.count("*")).alias("numbered"), F.bool_and(F.col("end_offset") - F.col("start_offset") == F.length("content")).alias("offsets"))
    return got.select(F.col("doc").cast("long").alias("doc_id"), "letters", "numbered", "offsets")


def _vec(name: str, sig: str) -> str:
    return f"""vm{name} AS (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk) AS rank FROM sc JOIN (SELECT query_id, {sig} AS sig FROM questions) USING (query_id) JOIN (SELECT sig, chunk FROM e{name}) USING (sig, chunk) QUALIFY rank <= 20),
fu{name} AS (SELECT query_id, chunk, vm{name}.rank AS vector_rank, bm{name}.rank AS bm25_rank, coalesce(1 / (60 + vm{name}.rank), 0) + coalesce(1 / (60 + bm{name}.rank), 0) AS score, vm{name}.score AS vscore, bm{name}.score AS bscore FROM vm{name} FULL JOIN bm{name} USING (query_id, chunk)),
f{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_rank NULLS LAST, bm25_rank) AS rank FROM fu{name} QUALIFY rank <= 8)"""


_HEAD = f"""WITH {CHUNKS_SQL}, ck AS (SELECT * REPLACE (CASE WHEN effective_time = 1000 AND chunk % 3 = 0 THEN 't2' ELSE tenant_id END AS tenant_id) FROM chunks),
questions(query_id, question) AS (VALUES {', '.join(f"({i}, '{q}')" for i, q, _, _ in ASKED)})"""
_SIG = "CASE query_id WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"
_YEAR = "CASE query_id WHEN 3 THEN 2023 WHEN 4 THEN 2024 END"
_SEEN = "permission <> 'secret' AND (effective_time = 0 OR effective_time >= 2000)"
_BASE = f"SELECT 0 AS sig, * FROM ck WHERE tenant_id = 't0' AND {_SEEN} UNION ALL SELECT 1, * FROM ck WHERE tenant_id = 't2' AND {_SEEN}"
_BY_YEAR = f"SELECT doc_year AS sig, * FROM ck WHERE tenant_id = 't0' AND {_SEEN} AND doc_year IN (2023, 2024)"
_RELAXED = "SELECT 0 AS sig, * FROM ck WHERE tenant_id = 't0' AND permission <> 'secret' UNION ALL SELECT 1, * FROM ck WHERE tenant_id = 't2' AND permission <> 'secret'"
_SCORES = f"cv AS ({_mock('ck', 'chunk', 'content')}), qv AS ({_mock('questions', 'query_id', 'question')}), sc AS (SELECT query_id, chunk, sum(cv.value * qv.value) AS score FROM cv JOIN qv USING (bucket) GROUP BY ALL)"
_PASSES = f"""{_HEAD}, {_SCORES}, {_bm25(_BASE, _SIG, 20)}, {_vec('', _SIG)}, {_bm25(_BY_YEAR, _YEAR, 20, 'y')}, {_vec('y', _YEAR)}, {_bm25(_RELAXED, _SIG, 20, 'r')}, {_vec('r', _SIG)},
ad AS (SELECT DISTINCT f.query_id FROM f JOIN fy ON f.query_id = fy.query_id AND f.chunk // 4 = fy.chunk // 4 WHERE f.rank = 1),
it AS (SELECT query_id, chunk, rank, score, true AS year_pass FROM fy WHERE query_id IN (FROM ad) UNION ALL SELECT query_id, chunk, rank, score, false FROM f WHERE query_id NOT IN (FROM ad)),
ex AS (SELECT query_id, chunk, rank, score FROM fr JOIN (SELECT chunk, effective_time FROM ck) USING (chunk) WHERE effective_time <> 0 AND effective_time < 2000 AND query_id NOT IN (SELECT query_id FROM it)),
nx AS (SELECT query_id, doc, ci, min(rank) AS of_rank FROM (SELECT query_id, rank, chunk // 4 AS doc, chunk % 4 + 1 + unnest([-1, 1]) AS ci FROM it WHERE rank <= 3) WHERE ci >= 1 GROUP BY ALL),
nb AS (SELECT query_id, c.chunk, row_number() OVER (PARTITION BY query_id ORDER BY of_rank, nx.doc, ci) AS rank FROM nx JOIN ck c ON c.doc = nx.doc AND c.chunk_index = ci WHERE {_SEEN} AND tenant_id = CASE query_id WHEN 6 THEN 't2' WHEN 7 THEN 't9' ELSE 't0' END AND (query_id, c.chunk) NOT IN (SELECT query_id, chunk FROM it) QUALIFY rank <= 4)"""
_GATE = ", ".join(f"({i}, '{q}')" for i, q in GATE_QUESTIONS)
_STOP = ", ".join(f"'{x}'" for x in gate.STOP)
_ANCHORS = f"""{CHUNKS_SQL}, ti AS (SELECT DISTINCT doc, 'Document ' || source || ' Größe 年假' AS title FROM chunks), tk AS (SELECT doc, {TOKENS.format('title')} AS t, lower(title) AS title FROM ti), bt AS (SELECT doc, {TOKENS.format('content')} AS t FROM chunks),
al AS (SELECT doc, 'title' AS source, unnest(t) AS term FROM tk UNION SELECT doc, 'title_gram', term FROM (SELECT doc, unnest(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS term FROM tk) WHERE regexp_full_match(term, '[\\p{{L}}\\p{{N}}]{{2}}') UNION SELECT doc, 'body', unnest(t) FROM bt UNION SELECT doc, 'pair', unnest(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1])) FROM bt),
vo AS (SELECT source, term, count(*) AS docs FROM al WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9_]+') AND term NOT IN ({_STOP}, 'document', 'source') GROUP BY ALL HAVING source IN ('title', 'title_gram') OR count(*) <= 8)"""

_COVERAGE = f"""v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('content')})) AS term FROM chunks) GROUP BY term), w AS (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM questions),
bg AS (SELECT DISTINCT substr(c, i, 2) AS g FROM (SELECT lower(content) AS c, unnest(range(1, length(content))) AS i FROM chunks)),
tb AS (SELECT term, unnest(list_transform(range(1, length(term)), lambda i: substr(term, i, 2))) AS g FROM (SELECT DISTINCT term FROM w WHERE term NOT IN (SELECT term FROM v) AND length(term) >= 2)), nf AS (SELECT term FROM tb GROUP BY term HAVING bool_and(g IN (SELECT g FROM bg))),
d AS (FROM v UNION ALL SELECT term, 1 FROM nf),
c AS (SELECT query_id, term, df, ln(((SELECT count(*) FROM chunks) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM w LEFT JOIN d USING (term) WHERE term NOT IN ({_STOP}) AND length(term) >= 2 AND NOT regexp_full_match(term, '[0-9_]+'))
SELECT q.query_id, round(CASE WHEN count(idf) = 0 THEN 1.0 ELSE coalesce(sum(idf) FILTER (df > 0), 0) / sum(idf) END, 4) AS coverage, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (df IS NULL AND term IS NOT NULL))[1:8], ','), '') AS absent FROM questions q LEFT JOIN c ON q.query_id = c.query_id GROUP BY q.query_id"""
_REAL = f"""{CHUNKS_SQL.replace("chunks AS (", "every_chunk AS (", 1)},
chunks AS (FROM every_chunk WHERE chunk % 11 <> 3),
held AS (SELECT chunk, department, permission, effective_time, tenant_id, embedding::DOUBLE[] AS embedding
  FROM (SELECT chunk, 'd' || chunk % 17 AS department, permission, effective_time, CASE WHEN effective_time = 1000 AND chunk % 3 = 0 THEN 't2' ELSE tenant_id END AS tenant_id FROM chunks)
  JOIN embeddings ON vec_id = chunk % (SELECT count(*) FROM embeddings) WHERE chunk % 13 <> 5 AND (effective_time = 0 OR effective_time >= {NOW})),
questions(query_id, question, tenant_id, allowed) AS (VALUES {", ".join(f"({i}, '{q}', '{t}', {['public', 'internal', 'secret'].index(u)})" for i, q, t, u in REAL_ASKED)}),
said AS (SELECT query_id, tenant_id, allowed, CASE WHEN query_id = 5 THEN list_transform(range(len(embedding)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[] ELSE embedding::DOUBLE[] END AS query
  FROM questions JOIN embeddings ON vec_id = query_id * 20),
scored AS (SELECT query_id, chunk, department, list_cosine_similarity(query, embedding) AS score
  FROM said JOIN held ON held.tenant_id = said.tenant_id AND list_position(['public', 'internal', 'secret'], permission) - 1 <= allowed)"""

QUERIES = {
    "retrieve_whole": (retrieve_whole, f"{_PASSES} SELECT query_id, 'item' AS kind, rank, chunk, round(score, 6) AS score, year_pass FROM it UNION ALL SELECT query_id, 'expired', rank, chunk, round(score, 6), false FROM ex UNION ALL SELECT query_id, 'context', rank, chunk, 0.0::DOUBLE, false FROM nb"),
    "retrieve_verdicts": (
        retrieve_verdicts,
        f"""{_PASSES}, nn AS (SELECT query_id, (SELECT count(*) FROM it WHERE it.query_id = q.query_id) AS n_item, (SELECT count(*) FROM ex WHERE ex.query_id = q.query_id) AS n_expired, (SELECT count(*) FROM nb WHERE nb.query_id = q.query_id) AS n_context, query_id IN (FROM ad) AS year_pass, false AS no_relevant,
  CASE WHEN query_id = 7 THEN '' ELSE array_to_string(list_filter([CASE WHEN EXISTS (FROM f WHERE f.query_id = q.query_id AND vector_rank > 0) OR EXISTS (FROM fr WHERE query_id = 6 AND fr.query_id = q.query_id AND vector_rank > 0) THEN 'vector' END, CASE WHEN EXISTS (FROM f WHERE f.query_id = q.query_id AND bm25_rank > 0) OR EXISTS (FROM fr WHERE query_id = 6 AND fr.query_id = q.query_id AND bm25_rank > 0) THEN 'bm25' END], lambda x: x IS NOT NULL), ',') END AS used_roads FROM questions q)
SELECT *, ((query_id IN (3, 4))::INT + (n_expired > 0)::INT + (n_context > 0)::INT)::INT AS n_notes FROM nn""",
    ),
    "retrieve_degraded": (retrieve_degraded, f"{_HEAD}, {_bm25(_BASE, _SIG, 20)}, {_bm25(_BY_YEAR, _YEAR, 20, 'y')}, ad AS (SELECT DISTINCT b.query_id FROM bm b JOIN bmy y ON b.query_id = y.query_id AND b.chunk // 4 = y.chunk // 4 WHERE b.rank = 1 AND y.rank <= 8), it AS (SELECT query_id, chunk FROM bmy WHERE rank <= 8 AND query_id IN (FROM ad) UNION ALL SELECT query_id, chunk FROM bm WHERE rank <= 8 AND query_id NOT IN (FROM ad)) SELECT query_id, count(*) AS n, sum(chunk)::BIGINT AS chunk_sum, 'vector' AS road FROM it GROUP BY query_id"),
    "retrieve_relaxed": (retrieve_relaxed, f"{_HEAD}, {_bm25(_RELAXED, _SIG, 8)} SELECT query_id, CASE WHEN effective_time <> 0 AND effective_time < 2000 THEN 'expired' ELSE 'item' END AS kind, rank, chunk, CASE WHEN effective_time <> 0 AND effective_time < 2000 THEN 'expired' ELSE 'valid' END AS validity FROM bm JOIN (SELECT chunk, effective_time FROM ck) USING (chunk)"),
    "retrieve_debug": (retrieve_debug, f"{_PASSES} SELECT query_id, rank, chunk, vector_rank, bm25_rank, round(vscore, 6) AS vector_score, round(bscore, 6) AS bm25_score, md5(substr(content, 1, 200)) AS content_md5 FROM f JOIN (SELECT chunk, content FROM ck) USING (chunk)"),
    "coverage_stored": (
        coverage_stored,
        f"""WITH {CHUNKS_SQL.replace("chunks AS (", "every_chunk AS (", 1)}, chunks AS (FROM every_chunk WHERE effective_time <> 1000), questions(query_id, question) AS (VALUES {_GATE}), {_COVERAGE}""",
    ),
    "coverage_fallback": (
        coverage_fallback,
        f"WITH {CHUNKS_SQL}, questions(query_id, question) AS (VALUES {_GATE}), {_COVERAGE}",
    ),
    "dense_topk": (
        dense_topk,
        f"""WITH {_REAL}, both_kinds AS (SELECT query_id || ':wide' AS qp, chunk, score FROM scored UNION ALL SELECT query_id || ':narrow', chunk, score FROM scored WHERE department = 'd3')
SELECT qp, row_number() OVER w::INT AS rank, chunk, round(score, 6) AS score FROM both_kinds WINDOW w AS (PARTITION BY qp ORDER BY round(score, 9) DESC, chunk) QUALIFY row_number() OVER w <= 20""",
    ),
    "retrieve_real": (
        retrieve_real,
        f"""WITH {_REAL}, {_COVERAGE.replace("SELECT q.query_id, round(", ", covered AS (SELECT q.query_id, round(")}), tops AS (SELECT query_id, max(score) AS top FROM scored GROUP BY query_id)
SELECT covered.query_id, coverage, round(top, 6) AS top_cosine, coverage < 0.2 AND coalesce(top, 0) < 0.4 AS no_relevant FROM covered LEFT JOIN tops ON covered.query_id = tops.query_id""",
    ),
    "anchor_whole": (anchor_whole, f"WITH {_ANCHORS} SELECT source, term, docs FROM vo"),
    "anchor_counts": (anchor_counts, f"WITH {_ANCHORS} SELECT source, count(DISTINCT term) AS terms FROM vo GROUP BY source"),
    "anchor_list": (anchor_list, f"WITH {_ANCHORS}, q(query_id, question) AS (VALUES (1, 'what of Größe here'), (2, '年假 src3'), (3, 'xq'), (4, NULL)), g AS (SELECT query_id, unnest(list_transform(range(1, length(question) - n + 2), lambda i: substr(lower(question), i, n))) AS term FROM q, (VALUES (2), (3), (4)) s(n)) SELECT q.query_id, coalesce(string_agg(DISTINCT g.term, ',' ORDER BY g.term) FILTER (g.term IN (SELECT term FROM vo WHERE source IN ('title', 'title_gram'))), '') AS terms FROM q LEFT JOIN g ON q.query_id = g.query_id GROUP BY q.query_id"),
    "doc_meta": (doc_meta, "WITH k AS (SELECT *, 'dir/file' || doc_id || '_20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || '-05-01.v1.md' AS doc_key FROM documents) SELECT doc_key, 'doc_' || substr(sha256('t0:' || doc_key), 1, 12) AS doc_id, regexp_replace(doc_key[5:], '\\.md$', '') AS doc_title, 'md' AS source, regexp_extract(doc_key, '(20\\d{2})[-_]?(\\d{2})?[-_]?(\\d{2})?', 1) || '-05-01' AS doc_date, regexp_extract(doc_key, '(20\\d{2})', 1)::INT AS doc_year, CASE doc_id % 3 WHEN 0 THEN 'hr' ELSE 'general' END AS category FROM k"),
    "metadata_sentinels": (metadata_sentinels, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'hr' ELSE '' END AS department, CASE WHEN doc_id % 3 = 1 THEN 2020 ELSE -1 END AS doc_year, CASE WHEN doc_id % 5 <> 0 THEN doc_id ELSE 0 END AS effective_time, CASE WHEN doc_id % 4 = 0 THEN 'a,b' ELSE '' END AS image_ids, '' AS author, 'general' AS category, 'internal' AS permission FROM documents"),
    "ingest_runs": (ingest_runs, r"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') <> '' AS filled, length('f' || doc_id || '.txt') AS k FROM documents), r AS (SELECT *, doc_id % 5 = 0 AS changed, doc_id % 7 <> 3 AND filled AS one, filled OR doc_id % 5 = 0 AS two FROM d) SELECT version, status, updated_at, count(*) AS n, sum(k)::BIGINT AS key_chars FROM (SELECT k, CASE WHEN changed THEN 2 ELSE 1 END AS version, CASE WHEN one AND NOT changed OR two THEN 'done' ELSE 'failed' END AS status, CASE WHEN one AND NOT changed THEN 100 ELSE 200 END::BIGINT AS updated_at FROM r) GROUP BY ALL"),
    "ingest_reports": (ingest_reports, r"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') <> '' AS filled FROM documents), r AS (SELECT 1 AS run, 'create' AS action, CASE WHEN doc_id % 7 <> 3 AND filled THEN 'done' ELSE 'failed' END AS status FROM d UNION ALL SELECT 2, CASE WHEN doc_id % 5 = 0 THEN 'new_version' WHEN doc_id % 7 <> 3 AND filled THEN 'skip' ELSE 'retry' END, CASE WHEN doc_id % 5 = 0 THEN 'done' WHEN doc_id % 7 <> 3 AND filled THEN 'skipped' WHEN filled THEN 'done' ELSE 'failed' END FROM d) SELECT run, action, status, count(*) AS n FROM r GROUP BY ALL"),
    "delete_flow": (delete_flow, "WITH c AS (SELECT doc_id // 4 AS doc, 1 + doc_id % 2 AS version FROM documents) SELECT 'valid chunks' AS what, count(*) FILTER (NOT (doc % 2 = 1 AND doc % 6 <> 5 AND version = 2)) AS n FROM c UNION ALL SELECT 'deleted at 9', count(DISTINCT doc) FILTER (doc % 2 = 1 AND doc % 6 <> 5) FROM c UNION ALL SELECT 'unknown', count(DISTINCT doc) FILTER (doc % 2 = 1 AND doc % 6 = 5) FROM c"),
    "patch_flow": (patch_flow, "SELECT 'd' || doc AS doc_id, count(*) AS chunks_updated, count(*) AS n FROM (SELECT doc_id // 4 AS doc, 1 + doc_id % 2 AS version FROM documents) WHERE doc % 4 = 0 AND doc % 6 <> 5 AND version = 2 GROUP BY doc"),
    "task_states": (task_states, "SELECT doc_id AS task_id, CASE WHEN doc_id % 5 = 4 THEN 404 ELSE 200 END AS code, CASE WHEN doc_id % 5 <> 4 THEN ['done', 'failed', 'done', 'processing'][doc_id % 4 + 1] END AS status, CASE WHEN doc_id % 5 <> 4 AND doc_id % 2 = 0 THEN 100 ELSE 0 END AS percent, CASE WHEN doc_id % 5 <> 4 THEN doc_id % 9 ELSE 0 END AS chunks_done, CASE WHEN doc_id % 5 <> 4 AND doc_id % 4 = 1 THEN 'broken' END AS error FROM documents"),
    "load_test_totals": (
        load_test_totals,
        """WITH r AS (SELECT event_id % 10 <> 3 AS ok, value AS v, CASE WHEN event_id % 20 = 3 THEN 'timeout' ELSE 'status=500' END AS err, event_type FROM events), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM r WHERE ok AND v IS NOT NULL)
SELECT 'n' AS what, count(*)::DOUBLE AS n FROM r UNION ALL SELECT 'ok', count(*) FILTER (ok) FROM r UNION ALL SELECT 'bad', count(*) FILTER (NOT ok) FROM r UNION ALL SELECT 'error_pct', round(100.0 * count(*) FILTER (NOT ok) / count(*), 1) FROM r
UNION ALL SELECT 'p' || p, round(v, 6) FROM s, (VALUES (50), (90), (99)) q(p) WHERE i = least(n * p // 100, n - 1) UNION ALL SELECT 'max', round(max(v), 6) FROM s UNION ALL SELECT 'mean', round(avg(v), 6) FROM s
UNION ALL SELECT err, count(*) FROM r WHERE NOT ok GROUP BY err UNION ALL SELECT event_type, count(*) FROM r GROUP BY event_type UNION ALL SELECT 'done', count(*) FROM r""",
    ),
    "replay_rules": (replay_rules, "WITH c AS (SELECT length(coalesce(text, '')) AS n, conv_id % 2 = 0 AS expected, 'type' || (turn % 3) AS type FROM conversations WHERE role = 'user'), g AS (SELECT unnest([4, 6, 8, 10]) AS threshold), s AS (SELECT 'long' AS rule, threshold, type, n > threshold * 10 AS skip, expected FROM c, g UNION ALL SELECT 'even', threshold, type, n % 2 = 0, expected FROM c, g UNION ALL SELECT 'never', threshold, type, false, expected FROM c, g) SELECT rule, threshold, type, count(*) AS n, count(*) FILTER (skip) AS skipped, count(*) FILTER (skip = expected) AS agreed FROM s GROUP BY ALL"),
    "answer_flow": (
        answer_flow,
        f"""{_HEAD}, {_bm25(_BASE, _SIG, 20)}, {_bm25(_BY_YEAR, _YEAR, 20, 'y')}, {_bm25(_RELAXED, _SIG, 20, 'r')}, ad AS (SELECT DISTINCT b.query_id FROM bm b JOIN bmy y ON b.query_id = y.query_id AND b.chunk // 4 = y.chunk // 4 WHERE b.rank = 1 AND y.rank <= 8), it AS (SELECT query_id, chunk, rank FROM bmy WHERE rank <= 8 AND query_id IN (FROM ad) UNION ALL SELECT query_id, chunk, rank FROM bm WHERE rank <= 8 AND query_id NOT IN (FROM ad)),
an AS (SELECT query_id, string_agg(chunk::VARCHAR, ',' ORDER BY rank) AS citations, bool_or(chunk % 4 = 0) AS poor FROM it WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, CASE WHEN poor THEN 'disclose' ELSE 'answer' END AS route, 'kb_qa' AS intent, citations, NOT poor AS grounded, CASE WHEN poor THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence, poor AS degraded, CASE WHEN poor THEN 2 ELSE 0 END AS retries FROM an
UNION ALL SELECT query_id, CASE WHEN query_id = 6 AND EXISTS (FROM bmr r JOIN ck USING (chunk) WHERE r.query_id = 6 AND r.rank <= 8) THEN 'confirm' ELSE 'no_data' END, 'kb_qa', '', query_id = 6, CASE query_id WHEN 6 THEN 1.0 ELSE 0.0 END, query_id <> 6, 0 FROM questions WHERE query_id NOT IN (SELECT query_id FROM an)
UNION ALL SELECT 8, 'direct', 'chitchat', '', true, 1.0, false, 0 UNION ALL SELECT 9, 'direct', 'contact_guidance', '', true, 1.0, false, 0""",
    ),
    "page_signals": (page_signals, r"WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN repeat('�', 3) || repeat('y', 150) WHEN 2 THEN repeat('z', 50) ELSE coalesce(text, '') END AS t FROM documents), g AS (SELECT doc_id, length(trim(translate(t, chr(9) || chr(10) || chr(13), ''), ' ')) AS n, length(t) - length(regexp_replace(t, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS bad FROM p) SELECT doc_id, array_to_string(list_filter([CASE WHEN n > 0 AND round(bad / n, 4) > 0.01 THEN 'garbled' END, CASE WHEN n < 20 THEN 'nearly empty' END, CASE WHEN n >= 20 AND n < 100 THEN 'thin' END, CASE WHEN doc_id % 5 >= 3 THEN 'many images' END], lambda x: x IS NOT NULL), ',') AS signals FROM g"),
    "pdf_pages": (pdf_pages, None),
    "head_sniff": (head_sniff, "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'txt' WHEN 1 THEN 'txt' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'pdf' ELSE CASE WHEN regexp_matches(substr(coalesce(html, ''), 1, 1024), '(?m)^\\s*# ') THEN 'md' ELSE 'txt' END END AS format FROM pages"),
    "chunk_shape": (chunk_shape, r"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x{85}\x0b]+', '', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS letters, true AS numbered, true AS offsets FROM d WHERE t <> ''"),
}
