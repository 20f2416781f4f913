"""Golden cases from the benchmark table, metrics, and roll-ups over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25, evaluation
from tessera.plans.fixtures import CHUNKS_SQL, chunks, table
from tessera.plans.retrieval_queries import _bm25, _eligible


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("case"), i.alias("ord"), F.col("text").alias("anchor"), F.element_at(F.array(F.lit("semantic"), F.lit("exact"), F.lit("year")), (i % 3 + 1).cast("int")).alias("type"))


def anchor_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.locate(_cases(spark, sf_dir), chunks(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    c = chunks(spark, sf_dir)
    asked = cases.select(F.col("case").alias("query_id"), F.lit(0).alias("sig"), F.array_join(F.slice(F.split("anchor", " "), 1, 12), " ").alias("question"))
    hits = bm25.search(c.withColumn("sig", F.lit(0)), asked, 10).select(F.col("query_id").alias("case"), "chunk", "rank")
    return evaluation.case_metrics(cases, evaluation.locate(cases, c), hits)


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.recall_mrr(_metrics(spark, sf_dir))
    return out.withColumn("verdict", evaluation.verdict(F.col("recall"), F.lit(False)))


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_mrr(_metrics(spark, sf_dir), "type")


def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified(_cases(spark, sf_dir), 10).select("case", "type")


def citation_verifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    none = F.array().cast("array<bigint>")
    cites = F.when(d % 5 == 0, none).when(d % 5 == 1, F.array(d, d + 1)).otherwise(F.array(d))
    shown = table(spark, sf_dir, "documents").select("doc_id", evaluation.citations_verifiable(cites, F.array(d, d + 2)).alias("ok"))
    return shown.groupBy("ok").agg(F.count("*").alias("n"))


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), "value", "event_type")


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.load_report(table(spark, sf_dir, "events"), "value", "event_type")


def token_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    model = F.element_at(F.array(*map(F.lit, ("m-turbo", "m-plus", "m-flash", "other"))), (e % 4 + 1).cast("int"))
    used = table(spark, sf_dir, "events").select(model.alias("model"), (e % 900).alias("prompt"), (e % 130).alias("completion"))
    out = used.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"))
    return out.withColumn("est_cost", F.round(evaluation.cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")), 6))


def usage_running_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    meter = table(spark, sf_dir, "events").select(F.col("user_id").alias("req"), F.col("event_id").alias("seq"), (F.col("event_id") % 500).alias("tokens"))
    return evaluation.usage_deltas(meter).select("req", "seq", "total", "added")


def slow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("event_type") == "purchase", 50.0).otherwise(80.0)
    return table(spark, sf_dir, "events").filter(F.col("value") >= limit).groupBy("event_type").agg(F.count("*").alias("slow"), F.round(F.max("value"), 6).alias("slowest"))


def kb_gap_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").select(F.concat(F.lit("gap "), (F.col("user_id") % 17).cast("string")).alias("query"))
    return gaps.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10)


def label_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


_CASES = "cases AS (SELECT item_id AS \"case\", item_id AS ord, text AS anchor, ['semantic', 'exact', 'year'][item_id % 3 + 1] AS type FROM benchmark)"
_NORM = r"lower(regexp_replace({0}, '[\s\x{{3000}}\x{{00a0}}\x0b]+', '', 'g'))"
_LOC = f"loc AS (SELECT \"case\", chunk FROM (SELECT chunk, {_NORM.format('content')} AS t FROM chunks) JOIN (SELECT \"case\", {_NORM.format('anchor')} AS a FROM cases) ON contains(t, a))"
_MET = f"""WITH {CHUNKS_SQL}, {_CASES}, questions AS (SELECT "case" AS query_id, array_to_string(string_split(anchor, ' ')[1:12], ' ') AS question FROM cases), {_LOC}, {_bm25(_eligible('true'), '0', 10)},
m AS (SELECT c."case", type, c."case" IN (SELECT "case" FROM loc) AS located, coalesce(r <= 5, false) AS hit, CASE WHEN r <= 5 THEN 1 / r ELSE 0 END AS rr FROM cases c LEFT JOIN (SELECT "case", min(rank) AS r FROM loc JOIN bm ON bm.query_id = loc."case" AND bm.chunk = loc.chunk GROUP BY 1) f ON c."case" = f."case")"""
_QUANT = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, count(*) AS n, {0}, round(avg(value), 6) AS mean, max(value) AS max FROM r GROUP BY event_type"

QUERIES = {
    "anchor_locate": (anchor_locate, f"WITH {CHUNKS_SQL}, {_CASES}, {_LOC} SELECT * FROM loc"),
    "recall_mrr": (recall_mrr, f"{_MET} SELECT count(*) AS n, round(avg(hit::INT), 6) AS recall, round(avg(rr), 6) AS mrr, CASE WHEN round(avg(hit::INT), 6) >= 0.8 THEN 'pass' ELSE 'fail' END AS verdict FROM m WHERE located"),
    "recall_by_type": (recall_by_type, f"{_MET} SELECT type, count(*) AS n, round(avg(hit::INT), 6) AS recall, round(avg(rr), 6) AS mrr FROM m WHERE located GROUP BY type"),
    "stratified_subset": (stratified_subset, f"WITH {_CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS t, min(ord) OVER (PARTITION BY type) AS f FROM cases) SELECT \"case\", type FROM (SELECT * FROM r ORDER BY t, f LIMIT 10)"),
    "citation_verifiable": (citation_verifiable, "SELECT doc_id % 5 NOT IN (0, 1) AS ok, count(*) AS n FROM documents GROUP BY 1"),
    "latency_quantiles": (latency_quantiles, _QUANT.format("max(value) FILTER (i = c // 2) AS p50, max(value) FILTER (i = ceil(c * 0.95) - 1) AS p95")),
    "load_report": (load_report, _QUANT.format(", ".join(f"max(value) FILTER (i = least(c * {p} // 100, c - 1)) AS p{p}" for p in (50, 90, 99)))),
    "token_cost_rollup": (token_cost_rollup, "WITH u AS (SELECT ['m-turbo', 'm-plus', 'm-flash', 'other'][event_id % 4 + 1] AS model, event_id % 900 AS p, event_id % 130 AS c FROM events), g AS (SELECT model, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens FROM u GROUP BY model) SELECT *, round(CASE model WHEN 'm-turbo' THEN prompt_tokens / 1000 * 0.003::DOUBLE + completion_tokens / 1000 * 0.006::DOUBLE WHEN 'm-flash' THEN prompt_tokens / 1000 * 0.0008::DOUBLE + completion_tokens / 1000 * 0.0027::DOUBLE WHEN 'm-plus' THEN prompt_tokens / 1000 * 0.004::DOUBLE + completion_tokens / 1000 * 0.012::DOUBLE ELSE prompt_tokens / 1000 * 0.01::DOUBLE + completion_tokens / 1000 * 0.03::DOUBLE END, 6) AS est_cost FROM g"),
    "usage_running_diff": (usage_running_diff, "SELECT user_id AS req, event_id AS seq, (sum(event_id % 500) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS total, event_id % 500 AS added FROM events"),
    "slow_events": (slow_events, "SELECT event_type, count(*) AS slow, round(max(value), 6) AS slowest FROM events WHERE value >= CASE event_type WHEN 'purchase' THEN 50 ELSE 80 END GROUP BY event_type"),
    "kb_gap_top": (kb_gap_top, "SELECT 'gap ' || (user_id % 17) AS query, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, query LIMIT 10"),
    "label_quality_report": (label_quality_report, "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang"),
}
