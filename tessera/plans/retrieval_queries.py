"""Predicates, both roads, fusion and the passes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25, filters, fusion, gate, scratch, vector
from tessera.plans.fixtures import CHUNKS_SQL, NOW, QUESTIONS_SQL, chunks, questions, table
from tessera.plans.text_queries import TOKENS


def perm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    users = spark.createDataFrame([("public",), ("internal",), ("secret",), ("guest",)], "user_permission string")
    return c.crossJoin(F.broadcast(users)).filter(filters.visible(F.col("user_permission"), F.col("permission"))).groupBy("user_permission", "permission").agg(F.count("*").alias("n"))


def validity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk", filters.validity(F.col("effective_time"), F.lit(NOW)).alias("validity"))


def _spec(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "sig int, tenant_id string, user_permission string, now int, include_expired boolean, years array<int>, category string, department string")


ONE_SIG = [(0, "t0", "internal", NOW, False, None, None, None)]
SIGS = [(0, "t0", "internal", NOW, False, None, None, None), (1, "t1", "secret", NOW, False, None, "", None), (2, "t0", "secret", NOW, True, [2023, 2024], "general", "")]


def current_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.eligible(chunks(spark, sf_dir), _spec(spark, SIGS)).groupBy("sig").agg(F.count("*").alias("n"), F.sum("chunk").alias("chunk_sum"))


def relaxed_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.eligible(chunks(spark, sf_dir), _spec(spark, [(0, "t0", "internal", NOW, True, None, None, None)]))
    return found.filter(filters.validity(F.col("effective_time"), F.lit(NOW)) == "expired").select("chunk", F.col("effective_time").alias("expired_at"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("sig", F.lit(0))


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.idf_table(_all(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(_all(spark, sf_dir), questions(spark).withColumn("sig", F.lit(0)))
    return found.select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index after three commits: all chunks but every third with a stale text for some, the rest with those changed, then every tenth deleted; searched with filters."""
    c = chunks(spark, sf_dir)
    index = bm25.PostingsIndex(spark, scratch.folder(spark))
    index.commit(c.filter("chunk % 3 <> 0").withColumn("content", F.when(F.col("chunk") % 7 == 1, F.lit("stale text of the old version")).otherwise(F.col("content"))))
    index.commit(c.filter("chunk % 3 = 0 OR chunk % 7 = 1"))
    index.commit(c.limit(0), c.filter("chunk % 10 = 7").select("chunk"))
    q = questions(spark).withColumn("sig", F.col("query_id") % 3)
    return index.search(filters.eligible(c, _spec(spark, SIGS)), q).select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark).withColumn("sig", F.col("query_id") % 3)
    found = bm25.search(filters.eligible(chunks(spark, sf_dir), _spec(spark, SIGS)), q)
    return found.select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return vector.mock_embedding(docs, "doc_id", "text").select("doc_id", "bucket", F.round("value", 6).alias("value"))


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.cosine_topk(table(spark, sf_dir, "embeddings"), _vector_questions(spark, sf_dir))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def cosine_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.cosine_topk(table(spark, sf_dir, "embeddings").filter("label % 2 = 0"), _vector_questions(spark, sf_dir))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _roads(spark: SparkSession, sf_dir: str, sigs: list[tuple] = ONE_SIG) -> tuple[DataFrame, DataFrame]:
    """Both roads for all questions under the first signature."""
    ok = filters.eligible(chunks(spark, sf_dir), _spec(spark, sigs))
    q = questions(spark).withColumn("sig", F.lit(sigs[0][0]))
    lexical = bm25.search(ok, q)
    vectors = vector.mock_embedding(ok.select("chunk", "content"), "chunk", "content")
    asked = vector.mock_embedding(q.select("query_id", "question"), "query_id", "question")
    allowed = ok.select("sig", "chunk", "ord").join(F.broadcast(q.select("query_id", "sig")), "sig").drop("sig")  # a few questions
    return vector.sparse_topk(vectors, asked, allowed), lexical


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_roads(spark, sf_dir)).select("query_id", "chunk", "vector_rank", "bm25_rank", F.round("score", 6).alias("score"), "rank")


def debug_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b = _roads(spark, sf_dir)
    fused = fusion.rrf(v, b)
    shown = fused.join(v.select("query_id", "chunk", F.round("score", 6).alias("vector_score")), ["query_id", "chunk"], "left").join(b.select("query_id", "chunk", F.round("score", 6).alias("bm25_score")), ["query_id", "chunk"], "left")
    return shown.join(chunks(spark, sf_dir).select("chunk", F.substring("content", 1, 200).alias("content")), "chunk").select("query_id", "rank", "chunk", "vector_score", "bm25_score", F.md5("content").alias("content_md5"))


def _lexical(spark: SparkSession, sf_dir: str, spec: tuple) -> DataFrame:
    found = bm25.search(filters.eligible(chunks(spark, sf_dir), _spec(spark, [spec])), questions(spark).withColumn("sig", F.lit(spec[0])), 8)
    return found.join(chunks(spark, sf_dir).select("chunk", "doc", "version", "chunk_index", "effective_time"), "chunk")


def year_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _lexical(spark, sf_dir, ONE_SIG[0]).select("query_id", "rank", "chunk", "doc")
    year = _lexical(spark, sf_dir, (0, "t0", "internal", NOW, False, [2023], None, None)).select("query_id", "rank", "chunk", "doc")
    return fusion.adjudicate_years(base, year).select("query_id", "rank", "chunk", "year_pass")


def auto_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _lexical(spark, sf_dir, ONE_SIG[0]).filter("score > 0")
    relaxed = _lexical(spark, sf_dir, (0, "t0", "internal", NOW, True, None, None, None)).withColumn("validity", filters.validity(F.col("effective_time"), F.lit(NOW)))
    return fusion.relaxed_where_empty(questions(spark), items, relaxed).select("query_id", "rank", "chunk")


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _lexical(spark, sf_dir, ONE_SIG[0])
    ok = filters.eligible(chunks(spark, sf_dir), _spec(spark, [(0, "t0", "internal", NOW, False, None, None, None), (1, "t1", "internal", NOW, False, None, None, None)]))
    return fusion.neighbours(items.select("query_id", "rank", "doc", "version", "chunk_index"), ok.select("doc", "version", "chunk_index", "chunk")).select("query_id", "chunk", "of_rank", "n")


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = gate.coverage(questions(spark), chunks(spark, sf_dir))
    low = covered.select("query_id", (F.col("coverage") / 2).alias("cosine"))
    return gate.assess(covered, low).select("query_id", "coverage", F.array_join("absent", ",").alias("absent"), "no_relevant")


def calibrate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("in_scope"))
    grid = spark.createDataFrame([(float(t),) for t in range(0, 100, 10)], "threshold double")
    return gate.sweep(scores, grid).select("threshold", F.round("survive", 6).alias("survive"), F.round("detect", 6).alias("detect"))


def _eligible(cond: str) -> str:
    return f"SELECT 0 AS sig, * FROM chunks WHERE {cond}"


_T0 = "tenant_id = 't0' AND permission <> 'secret' AND (effective_time = 0 OR effective_time >= 2000)"


def _bm25(eligible: str, sig: str, k: int, name: str = "") -> str:
    """CTEs that end in bm{name}(query_id, chunk, score, rank)."""
    return f"""e{name} AS ({eligible}), t{name} AS (SELECT sig, chunk, ord, {TOKENS.format('content')} AS terms FROM e{name}),
n{name} AS (SELECT sig, count(*) AS n, avg(len(terms)) AS avgdl FROM t{name} GROUP BY sig),
p{name} AS (SELECT sig, chunk, ord, dl, term, count(*) AS tf FROM (SELECT sig, chunk, ord, len(terms) AS dl, unnest(terms) AS term FROM t{name}) GROUP BY ALL),
r{name} AS (SELECT sig, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT sig, term, count(*) AS df FROM p{name} GROUP BY ALL) JOIN n{name} USING (sig)),
i{name} AS (SELECT sig, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sig) ELSE raw END AS idf FROM r{name}),
a{name} AS (SELECT query_id, sig, term, count(*) AS times FROM (SELECT query_id, {sig} AS sig, unnest({TOKENS.format('question')}) AS term FROM questions) GROUP BY ALL),
s{name} AS (SELECT query_id, chunk, ord, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p{name} JOIN a{name} USING (sig, term) JOIN i{name} USING (sig, term) JOIN n{name} USING (sig) GROUP BY ALL),
z{name} AS (SELECT q.query_id, t.chunk, t.ord, coalesce(score, 0) AS score FROM (SELECT query_id, {sig} AS sig FROM questions) q JOIN t{name} t ON q.sig = t.sig LEFT JOIN s{name} s ON s.query_id = q.query_id AND s.chunk = t.chunk),
bm{name} AS (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM z{name} QUALIFY rank <= {k})"""


def _mock(src: str, key: str, text: str) -> str:
    return f"""SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM (SELECT {key}, bucket, count(*) AS n FROM (SELECT {key}, ('0x' || substr(md5(b[i:i + 1]), 1, 2))::INT AS bucket FROM (SELECT {key}, encode({text}) AS b, unnest(range(1, strlen({text}))) AS i FROM {src})) GROUP BY ALL)"""


_VEC = f"""cv AS ({_mock('e', 'chunk', 'content')}), qv AS ({_mock('questions', 'query_id', 'question')}),
vs AS (SELECT query_id, chunk, sum(cv.value * qv.value) AS score FROM cv JOIN qv USING (bucket) GROUP BY ALL),
vm AS (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk) AS rank FROM vs QUALIFY rank <= 20),
fused AS (SELECT query_id, chunk, vm.rank AS vector_rank, bm.rank AS bm25_rank, coalesce(1 / (60 + vm.rank), 0) + coalesce(1 / (60 + bm.rank), 0) AS score, vm.score AS vscore, bm.score AS bscore FROM vm FULL JOIN bm USING (query_id, chunk)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_rank NULLS LAST, bm25_rank) AS rank FROM fused QUALIFY rank <= 8)"""
_HEAD = f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}"
_SIGS = """SELECT 0 AS sig, * FROM chunks WHERE tenant_id = 't0' AND permission <> 'secret' AND (effective_time = 0 OR effective_time >= 2000)
UNION ALL SELECT 1, * FROM chunks WHERE tenant_id = 't1' AND (effective_time = 0 OR effective_time >= 2000)
UNION ALL SELECT 2, * FROM chunks WHERE tenant_id = 't0' AND doc_year IN (2023, 2024)"""
_COS = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 10), s AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM embeddings, q WHERE {0}) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 20"
_BM_OUT = "SELECT query_id, chunk, round(score, 6) AS score, rank FROM bm"

QUERIES = {
    "perm_filter": (perm_filter, f"WITH {CHUNKS_SQL}, u(user_permission, l) AS (VALUES ('public', 0), ('internal', 1), ('secret', 2), ('guest', 1)), p(permission, l) AS (VALUES ('public', 0), ('internal', 1), ('secret', 2)) SELECT user_permission, permission, count(*) AS n FROM chunks JOIN p USING (permission) JOIN u ON p.l <= u.l GROUP BY ALL"),
    "validity_flag": (validity_flag, f"WITH {CHUNKS_SQL} SELECT chunk, CASE WHEN effective_time <> 0 AND effective_time < 2000 THEN 'expired' ELSE 'valid' END AS validity FROM chunks"),
    "current_only": (current_only, f"WITH {CHUNKS_SQL}, e AS ({_SIGS}) SELECT sig, count(*) AS n, sum(chunk)::BIGINT AS chunk_sum FROM e GROUP BY sig"),
    "relaxed_expired": (relaxed_expired, f"WITH {CHUNKS_SQL} SELECT chunk, effective_time AS expired_at FROM chunks WHERE tenant_id = 't0' AND permission <> 'secret' AND effective_time <> 0 AND effective_time < 2000"),
    "bm25_idf": (bm25_idf, f"{_HEAD}, {_bm25(_eligible('true'), '0', 20)} SELECT term, df, round(idf, 6) AS idf FROM i"),
    "bm25_topk": (bm25_topk, f"{_HEAD}, {_bm25(_eligible('true'), '0', 20)} {_BM_OUT}"),
    "bm25_index": (bm25_index, f"{_HEAD}, {_bm25(f'SELECT * FROM ({_SIGS}) WHERE chunk % 10 <> 7', 'query_id % 3', 20)} {_BM_OUT}"),
    "bm25_filtered_idf": (bm25_filtered, f"{_HEAD}, {_bm25(_SIGS, 'query_id % 3', 20)} {_BM_OUT}"),
    "mock_embedding": (mock_embedding, f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, bucket, round(value, 6) AS value FROM ({_mock('d', 'doc_id', 'text')})"),
    "cosine_topk": (cosine_topk, _COS.format("true")),
    "cosine_filtered_topk": (cosine_filtered_topk, _COS.format("label % 2 = 0")),
    "rrf_fuse": (rrf_fuse, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 20)}, {_VEC} SELECT query_id, chunk, vector_rank, bm25_rank, round(score, 6) AS score, rank FROM f"),
    "debug_lanes": (debug_lanes, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 20)}, {_VEC} SELECT query_id, rank, chunk, round(vscore, 6) AS vector_score, round(bscore, 6) AS bm25_score, md5(substr(content, 1, 200)) AS content_md5 FROM f JOIN chunks USING (chunk)"),
    "year_adjudication": (year_adjudication, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 8)}, {_bm25(_eligible(_T0 + ' AND doc_year = 2023'), '0', 8, '2')}, ad AS (SELECT DISTINCT b.query_id FROM bm b JOIN bm2 y ON b.query_id = y.query_id AND b.chunk // 4 = y.chunk // 4 WHERE b.rank = 1) SELECT query_id, rank, chunk, true AS year_pass FROM bm2 WHERE query_id IN (FROM ad) UNION ALL SELECT query_id, rank, chunk, false FROM bm WHERE query_id NOT IN (FROM ad)"),
    "auto_relaxed": (auto_relaxed, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 8)}, {_bm25(_eligible(chr(116) + 'enant_id = ' + chr(39) + 't0' + chr(39) + ' AND permission <> ' + chr(39) + 'secret' + chr(39)), '0', 8, '2')} SELECT query_id, rank, chunk FROM bm2 JOIN chunks USING (chunk) WHERE effective_time <> 0 AND effective_time < 2000 AND query_id NOT IN (SELECT query_id FROM bm WHERE score > 0)"),
    "neighbour_context": (neighbour_context, f"{_HEAD}, {_bm25(_eligible(_T0), '0', 8)}, x AS (SELECT query_id, doc, ci, min(rank) AS of_rank FROM (SELECT query_id, rank, chunk // 4 AS doc, chunk % 4 + 1 + unnest([-1, 1]) AS ci FROM bm WHERE rank <= 3) WHERE ci >= 1 GROUP BY ALL), y AS (SELECT x.query_id, c.chunk, of_rank, x.doc, ci FROM x JOIN chunks c ON c.doc = x.doc AND c.chunk_index = ci WHERE permission <> 'secret' AND (effective_time = 0 OR effective_time >= 2000) AND (x.query_id, c.chunk) NOT IN (SELECT query_id, chunk FROM bm)) SELECT query_id, chunk, of_rank, row_number() OVER (PARTITION BY query_id ORDER BY of_rank, doc, ci) AS n FROM y QUALIFY n <= 4"),
    "coverage_gate": (coverage_gate, f"""{_HEAD}, v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('content')})) AS term FROM chunks) GROUP BY term), w AS (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM questions),
c AS (SELECT query_id, term, df, ln(((SELECT count(*) FROM chunks) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM w LEFT JOIN v USING (term) WHERE term NOT IN ({', '.join(f"'{x}'" for x in gate.STOP)}) AND length(term) >= 2 AND NOT regexp_full_match(term, '[0-9_]+')),
g AS (SELECT q.query_id, round(CASE WHEN count(idf) = 0 THEN 1.0 ELSE coalesce(sum(idf) FILTER (df > 0), 0) / sum(idf) END, 4) AS coverage, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (df IS NULL AND term IS NOT NULL))[1:8], ','), '') AS absent FROM questions q LEFT JOIN c ON q.query_id = c.query_id GROUP BY q.query_id)
SELECT query_id, coverage, absent, coverage < 0.2 AND coverage / 2 < 0.4 AS no_relevant FROM g"""),
    "calibrate_grid": (calibrate_grid, "SELECT threshold::DOUBLE AS threshold, round(avg((value >= threshold)::INT) FILTER (event_id % 2 = 0), 6) AS survive, round(avg((value < threshold)::INT) FILTER (event_id % 2 <> 0), 6) AS detect FROM events, (SELECT unnest(range(0, 100, 10)) AS threshold) GROUP BY 1"),
}
