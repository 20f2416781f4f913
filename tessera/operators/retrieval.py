"""Whole retrieval for a table of questions: base pass, relevance, year pass, relaxed pass and context, each one plan for all questions.

Every question asks up to three passes. A pass is a filter signature; signatures that questions share are met once by the corpus,
and both roads run once over all passes. What a pass decides (relevance, adoption of the year pass, expired candidates) are joins on query_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions import text as T
from tessera.operators import bm25, filters, fusion, gate, vector
from tessera.operators.scratch import kept

ROAD_TOP = 20
#: The mock embedding's vectors (chunk, bucket, value), or a road of its own: passes and k to (qp, chunk, score, rank), as dense.road makes.
Vectors = DataFrame | Callable[[DataFrame, int], DataFrame] | None
SPEC = ("tenant_id", "user_permission", "category", "department")
NOTES = {
    "no_relevant": "nothing relevant: say so instead of answering",
    "year_adopted": "year pass adopted: it holds the document of the base pass's first item",
    "year_rejected": "year pass empty or off topic: items of the base pass stay",
    "expired": "nothing current, expired documents found: to be confirmed",
    "context": "neighbouring chunks added as context",
}


@dataclass
class Retrieved:
    """items: query_id, kind (item, context, expired), rank, chunk, score, validity, year_pass. verdicts: a row for each question.
    degraded: (road, error) of roads that failed. lanes: query_id, pass, rank, chunk, vector_rank, bm25_rank, vector_score, bm25_score."""

    items: DataFrame
    verdicts: DataFrame
    degraded: list[tuple[str, str]]
    lanes: DataFrame


def passes(questions: DataFrame, now: int, relaxed_only: bool = False) -> DataFrame:
    """qp, query_id, pass, sig, question and the filter columns. questions: query_id, question, tenant_id, user_permission and, if wanted, category, department."""
    q = questions.select("query_id", "question", *[(F.col(c) if c in questions.columns else F.lit(None)).cast("string").alias(c) for c in SPEC])
    years = T.years(F.col("question"))
    none = F.lit(None).cast("array<int>")
    kinds = [("relaxed", F.lit(True), none)] if relaxed_only else [("base", F.lit(False), none), ("year", F.lit(False), F.when(F.size(years) > 0, years)), ("relaxed", F.lit(True), none)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), e.alias("include_expired"), y.alias("years")) for k, e, y in kinds])).alias("p")
    out = q.select("*", each).select("query_id", "question", *SPEC, "p.*").filter((F.col("pass") != "year") | F.col("years").isNotNull()).withColumn("now", F.lit(now).cast("long"))
    sig = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*SPEC, "include_expired", "years")])
    return out.withColumn("sig", sig).withColumn("qp", F.concat_ws(":", F.col("query_id").cast("string"), "pass"))


def lexical_road(eligible: DataFrame, asked: DataFrame, index: bm25.PostingsIndex | None = None, k: int = ROAD_TOP) -> DataFrame:
    """From a stored index, which holds the chunks' valid texts, or from the texts themselves."""
    found = (index.search if index else bm25.search)(eligible, asked.select(F.col("qp").alias("query_id"), "sig", "question"), k)
    return found.select(F.col("query_id").alias("qp"), "chunk", "score", "rank")


def vector_road(eligible: DataFrame, asked: DataFrame, vectors: DataFrame, k: int = ROAD_TOP) -> DataFrame:
    """The mock embedding's road; vectors: chunk, bucket, value. Filters come first, so a question meets the chunks of its own signature alone."""
    q = vector.mock_embedding(asked.select("question").distinct(), "question", "question").select("question", "bucket", F.col("value").alias("qv"))
    mine = asked.select("qp", "sig", "question").join(q, "question").select("qp", "sig", "bucket", "qv")
    held = vectors.join(eligible.select("sig", "chunk", "ord"), "chunk")
    met = held.join(mine, ["sig", "bucket"]).groupBy("qp", "chunk", "ord").agg(F.sum(F.col("value") * F.col("qv")).alias("score"))
    rank = F.row_number().over(W.Window.partitionBy("qp").orderBy(F.desc(F.round("score", 9)), "ord"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("qp", "chunk", "score", "rank")


def run_roads(roads: dict[str, Callable[[], DataFrame]], keep: Callable[[DataFrame], DataFrame] = kept) -> tuple[dict[str, DataFrame | None], list[tuple[str, str]]]:
    """Each road's rows, None where it failed, and (road, error). keep executes a road (it writes and rereads it), so that failures of its tasks count too and later plans don't compute it again."""
    found: dict[str, DataFrame | None] = {}
    degraded = []
    for name, make in roads.items():
        try:
            found[name] = keep(make())
        except Exception as e:  # a failed road is an empty road
            found[name] = None
            degraded.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return found, degraded


def search_once(asked: DataFrame, chunks: DataFrame, vectors: Vectors, keep: Callable[[DataFrame], DataFrame] = kept, top: int = fusion.TOP, index: bm25.PostingsIndex | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(qp, chunk, ranks, scores, rank) of the fused roads for all passes, the best vector score of each (qp, cosine), and roads that failed."""
    eligible = filters.eligible(chunks, asked.select("sig", *SPEC, "now", "include_expired", "years").distinct())
    roads = {"vector": lambda: vectors(asked, ROAD_TOP) if callable(vectors) else vector_road(eligible, asked, vectors), "bm25": lambda: lexical_road(eligible, asked, index)}
    found, degraded = run_roads(roads, keep)
    spark = chunks.sparkSession
    kind = chunks.schema["chunk"].dataType.simpleString()
    v, b = (f if f is not None else spark.createDataFrame([], f"qp string, chunk {kind}, score double, rank int") for f in (found["vector"], found["bm25"]))
    fused = fusion.rrf(v.withColumnRenamed("qp", "query_id"), b.withColumnRenamed("qp", "query_id"), top).withColumnRenamed("query_id", "qp")
    named = fused.join(v.select("qp", "chunk", F.col("score").alias("vector_score")), ["qp", "chunk"], "left").join(b.select("qp", "chunk", F.col("score").alias("bm25_score")), ["qp", "chunk"], "left")
    return named, v.groupBy("qp").agg(F.max("score").alias("cosine")), degraded


def trim(items: DataFrame, top_n: int | None) -> DataFrame:
    """The first top_n of each question; none or 0 is all."""
    return items.filter(F.col("rank") <= top_n) if top_n else items


def _verdicts(questions: DataFrame, chunks: DataFrame, top: DataFrame, judged: bool, index: bm25.PostingsIndex | None = None) -> DataFrame:
    """query_id, coverage, top_cosine, no_relevant; valid chunks alone say what the corpus covers. top: query_id, cosine of the vector road. Not judged: the vectors say nothing (mock or degraded provider)."""
    if not judged:
        return questions.select("query_id", F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("top_cosine"), F.lit(False).alias("no_relevant"))
    return gate.assess(gate.coverage(questions, chunks.filter("is_valid"), fallback=True, index=index), top).select("query_id", "coverage", F.col("cosine").alias("top_cosine"), "no_relevant")


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: Vectors, now: int, provider: str = "real", top_n: int | None = None, keep: Callable[[DataFrame], DataFrame] = kept, index: bm25.PostingsIndex | None = None) -> Retrieved:
    """All passes for questions (query_id, question, tenant_id, user_permission, category, department) over chunks and their vectors (chunk, bucket, value; or a road over stored ones).

    provider "mock", or a vector road that failed: relevance isn't judged. index: stored postings of the valid chunks. keep: see run_roads; every step that several later ones read is executed once.
    """
    asked = passes(questions, now)
    lanes, tops, degraded = search_once(asked, chunks, vectors, keep, index=index)
    lanes = keep(lanes)
    where = chunks.select("chunk", "doc", "version", "chunk_index", filters.validity(F.col("effective_time"), F.lit(now)).alias("validity"))
    found = lanes.join(asked.select("qp", "query_id", "pass"), "qp").join(where, "chunk").drop("qp")
    base, year, relaxed = (found.filter(F.col("pass") == p) for p in ("base", "year", "relaxed"))
    judged = provider != "mock" and not any(road == "vector" for road, _ in degraded)
    top = tops.join(asked.filter(F.col("pass") == "base").select("qp", "query_id"), "qp").select("query_id", "cosine")
    verdicts = keep(_verdicts(questions, chunks, top, judged, index))
    live = verdicts.filter("NOT no_relevant").select("query_id")
    items = keep(trim(fusion.adjudicate_years(base, year.join(live, "query_id", "left_semi")), top_n))
    empty = live.join(items.select("query_id").distinct(), "query_id", "left_anti")
    expired = trim(relaxed.filter(F.col("validity") == "expired").join(empty, "query_id", "left_semi"), top_n)
    context = _context(items, chunks, asked.filter(F.col("pass") == "base"))
    shown = [_rows(items, "item"), _rows(expired.withColumn("year_pass", F.lit(False)), "expired"), context]
    rows = keep(shown[0].unionByName(shown[1]).unionByName(shown[2]))
    used = lanes.join(asked.select("qp", "query_id", "pass"), "qp").groupBy("query_id").agg(_used("base").alias("_b"), _used("relaxed").alias("_r"))
    counts = rows.groupBy("query_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("item", "expired", "context")], F.bool_or("year_pass").alias("year_pass"))
    asked_year = asked.filter(F.col("pass") == "year").select("query_id", F.lit(True).alias("_year"))
    out = verdicts.join(counts, "query_id", "left").join(used, "query_id", "left").join(asked_year, "query_id", "left")
    out = out.withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in ("item", "expired", "context")}).withColumn("year_pass", F.coalesce("year_pass", F.lit(False)))
    note = lambda name, cond: F.when(cond, F.lit(NOTES[name]))
    year_asked = F.coalesce("_year", F.lit(False)) & ~F.col("no_relevant")
    notes = F.array_compact(F.array(note("no_relevant", F.col("no_relevant")), note("year_adopted", year_asked & F.col("year_pass")), note("year_rejected", year_asked & ~F.col("year_pass")), note("expired", F.col("n_expired") > 0), note("context", F.col("n_context") > 0)))
    none = F.array().cast("array<string>")
    roads = F.when(F.col("n_item") > 0, F.coalesce("_b", none)).otherwise(F.coalesce(F.when(F.size("_r") > 0, F.col("_r")), F.col("_b"), none))
    out = out.withColumns({"notes": notes, "used_roads": roads}).drop("_b", "_r", "_year")
    return Retrieved(rows, out, degraded, lanes.join(asked.select("qp", "query_id", "pass"), "qp").drop("qp"))


def relaxed_retrieve(questions: DataFrame, chunks: DataFrame, vectors: Vectors, now: int, provider: str = "real", top_n: int | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> Retrieved:
    """The pass with expired documents alone, on a caller's request: expired ones as candidates, current ones as items, with relevance and context."""
    asked = passes(questions, now, relaxed_only=True)
    lanes, tops, degraded = search_once(asked, chunks, vectors, keep)
    where = chunks.select("chunk", "doc", "version", "chunk_index", filters.validity(F.col("effective_time"), F.lit(now)).alias("validity"))
    found = lanes.join(asked.select("qp", "query_id"), "qp").join(where, "chunk").drop("qp").withColumn("year_pass", F.lit(False))
    expired, items = (trim(found.filter(c), top_n) for c in (F.col("validity") == "expired", F.col("validity") != "expired"))
    judged = provider != "mock" and not any(road == "vector" for road, _ in degraded)
    rows = _rows(items, "item").unionByName(_rows(expired, "expired")).unionByName(_context(items, chunks, asked.withColumn("include_expired", F.lit(False))))
    return Retrieved(rows, _verdicts(questions, chunks, tops.join(asked.select("qp", "query_id"), "qp").select("query_id", "cosine"), judged), degraded, lanes.join(asked.select("qp", "query_id", "pass"), "qp").drop("qp"))


def debug_retrieve(questions: DataFrame, chunks: DataFrame, vectors: Vectors, now: int, include_relaxed: bool = False, provider: str = "real") -> DataFrame:
    """Both roads' ranks and scores beside the fused rank, for the base pass whole and, if asked, the relaxed one; contents are cut to 200 characters for display."""
    lanes = retrieve(questions, chunks, vectors, now, provider).lanes
    shown = lanes.filter(F.col("pass").isin("base", "relaxed") if include_relaxed else F.col("pass") == "base")
    return shown.join(chunks.select("chunk", F.substring("content", 1, 200).alias("content")), "chunk")


def _used(name: str) -> Column:
    """Roads of a pass that had hits."""
    had = lambda rank: F.bool_or((F.col("pass") == name) & F.col(rank).isNotNull())
    return F.array_compact(F.array(F.when(had("vector_rank"), F.lit("vector")), F.when(had("bm25_rank"), F.lit("bm25"))))


def _rows(items: DataFrame, kind: str) -> DataFrame:
    return items.select("query_id", F.lit(kind).alias("kind"), "rank", "chunk", "score", "validity", "year_pass")


def _context(items: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Neighbours of the first items that the question may see and that aren't expired."""
    place = chunks.select("doc", "version", "chunk_index", "chunk", "is_valid", "tenant_id", "permission", "effective_time")
    near = fusion.neighbours(items.select("query_id", "rank", "doc", "version", "chunk_index"), place, limit=6)  # two beside each of three items
    seen = near.join(asked.select("query_id", F.col("tenant_id").alias("_tenant"), "user_permission", "now"), "query_id")
    ok = seen.filter(F.col("is_valid") & (F.col("tenant_id") == F.col("_tenant")) & filters.visible(F.col("user_permission"), F.col("permission")) & filters.current(F.col("effective_time"), F.col("now")))
    order = W.Window.partitionBy("query_id").orderBy("of_rank", "doc", "chunk_index")
    cut = ok.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 4)
    return cut.select("query_id", F.lit("context").alias("kind"), "rank", "chunk", F.lit(0.0).alias("score"), F.lit("valid").alias("validity"), F.lit(False).alias("year_pass"))
