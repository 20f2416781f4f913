"""Golden cases, retrieval metrics and operational roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions.text import normalize
from tessera.operators.scratch import kept

MIN_ANCHOR, RECALL_PASS, RANGES = 6, 0.8, 200
#: Runs of an anchor that are looked up, and bits of the table that says which are.
PICKED, SLOTS = 8, 1 << 22
#: Default price of 1000 tokens by model family, matched in this order: (family, prompt, completion).
PRICES = [("turbo", 0.003, 0.006), ("plus", 0.004, 0.012), ("long", 0.0005, 0.002), ("flash", 0.0008, 0.0027), ("max", 0.02, 0.06)]
DEFAULT_PRICE = (0.01, 0.03)
GOLDEN = "meta struct<case_count: int>, cases array<struct<id: string, query: string, expected_doc: string, anchor: string, type: string>>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a golden file; raises on none, a missing field, a repeated id or a short anchor."""
    cases = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.inline("cases")).withColumn("type", F.coalesce("type", F.lit("semantic")))
    bad = cases.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("id").isNull() | F.col("query").isNull() | F.col("expected_doc").isNull() | F.col("anchor").isNull()).alias("missing"),
        (F.count("id") - F.count_distinct("id")).alias("repeated"),
        F.count_if(F.length(normalize(F.col("anchor"))) < MIN_ANCHOR).alias("short"),
    ).first()
    if not bad["n"] or bad["missing"] or bad["repeated"] or bad["short"]:
        raise ValueError(f"golden cases: {bad.asDict()}")
    return cases


def _hashes(text: str, size: int) -> np.ndarray:
    """Hashes of a text's runs of `size` characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _posted(texts: DataFrame, key: str, pick: Callable[[str], np.ndarray]) -> DataFrame:
    """key, gram of texts (key, t): the distinct hashes that pick takes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [np.unique(pick(t)) for t in part.column("t").to_pylist()]
                where = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(key).take(where), pa.array(np.concatenate(found), pa.int64())], [key, "gram"])

    kept_key = texts.schema[key].dataType.simpleString()
    return texts.select(key, "t").mapInArrow(run, f"{key} {kept_key}, gram long")


def locate(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case, chunk for chunks (chunk, content) whose normalized text holds a case's normalized anchor (case, anchor).

    A chunk can hold an anchor only if it holds any run of MIN_ANCHOR characters of it (of all, if it is shorter). Of PICKED runs of each anchor the rarest one's postings are the
    candidates, and `contains` confirms them. Tasks emit runs that a bit table of fixed size lets through; a join takes its false hits away. Work grows with the texts and the
    candidates, not with cases times chunks. Null and empty anchors are nowhere, null texts hold nothing.
    """
    anchors = kept(cases.select("case", normalize(F.col("anchor")).alias("t")).filter("t <> ''"))
    texts = chunks.select("chunk", normalize(F.col("content")).alias("t")).filter("t <> ''")
    sizes = [r[0] for r in anchors.select(F.least(F.length("t"), F.lit(MIN_ANCHOR))).distinct().collect()]  # MIN_ANCHOR at most
    each = kept(_posted(anchors, "case", lambda t: np.sort(_hashes(t, min(len(t), MIN_ANCHOR)))[:PICKED]))
    wanted = each.select("gram").distinct()
    table = np.zeros(SLOTS, bool)
    table[[r[0] for r in wanted.select(F.col("gram").bitwiseAND(SLOTS - 1)).distinct().collect()]] = True  # SLOTS at most
    shared = chunks.sparkSession.sparkContext.broadcast(np.packbits(table))

    def listed(t: str) -> np.ndarray:
        bits = shared.value
        every = [h[(bits[(h & (SLOTS - 1)) >> 3] >> (7 - (h & 7))) & 1 > 0] for h in (_hashes(t, n) for n in sizes)]
        return np.concatenate(every) if every else np.zeros(0, np.int64)

    postings = kept(_posted(texts, "chunk", listed).join(wanted, "gram", "left_semi"))
    held = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rare = each.join(held, "gram", "left").groupBy("case").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("case", "r.gram")
    near = kept(rare.join(postings, "gram").select("case", "chunk"))
    return near.join(anchors.withColumnRenamed("t", "a"), "case").join(texts, "chunk").filter(F.contains(F.col("t"), F.col("a"))).select("case", "chunk")


def stratified(cases: DataFrame, limit: int) -> DataFrame:
    """`limit` cases (case, type, ord) by turns over types in order of first sight, in their old order."""
    by_type = W.Window.partitionBy("type")
    ranked = cases.withColumns({"_turn": F.row_number().over(by_type.orderBy("ord")), "_first": F.min("ord").over(by_type)})
    return ranked.orderBy("_turn", "_first").limit(limit).drop("_turn", "_first").orderBy("ord")


def case_metrics(cases: DataFrame, expected: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """case, type, located, hit, rr: first rank within k of any expected chunk. expected: case, chunk; hits: case, chunk, rank."""
    found = expected.join(hits, ["case", "chunk"]).groupBy("case").agg(F.min("rank").alias("r"))
    located = expected.select("case", F.lit(True).alias("located")).distinct()
    out = cases.join(located, "case", "left").join(found, "case", "left")
    in_k = F.coalesce(F.col("r") <= k, F.lit(False))
    return out.select("case", "type", F.coalesce("located", F.lit(False)).alias("located"), in_k.alias("hit"), F.when(in_k, 1.0 / F.col("r")).otherwise(0.0).alias("rr"))


def recall_mrr(metrics: DataFrame, *by: str) -> DataFrame:
    """n, recall, mrr over located cases."""
    return metrics.filter("located").groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def verdict(recall: Column, degraded: Column) -> Column:
    return F.when(degraded, "skipped").when(recall >= RECALL_PASS, "pass").otherwise("fail")


def citations_verifiable(cites: Column, retrieved: Column) -> Column:
    return (F.size(cites) > 0) & (F.size(F.array_except(cites, retrieved)) == 0)


def _pick(events: DataFrame, value: str, by: list[str], picks: dict[str, Column]) -> DataFrame:
    """Values at exact places (from 0, by group size `_n`) of each group. Equal values are summed first, and a group is ranked in RANGES ranges of
    its own apart, whose sizes alone are added up, so no task sorts a group; null values don't count."""
    keys = by or ["_all"]
    rows = events.filter(F.col(value).isNotNull()).withColumns({} if by else {"_all": F.lit(0)}).select(*keys, F.col(value).alias("_v"))
    cuts = F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)])
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), cuts.alias("_cuts"), F.round(F.avg("_v"), 6).alias("mean"), F.max("_v").alias("max"))
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).join(groups, keys)
    ranged = counts.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_size"))
    before = F.sum("_size").over(W.Window.partitionBy(*keys).orderBy("_range")) - F.col("_size")
    offsets = sizes.select(*keys, "_range", before.alias("_before"))
    upto = F.sum("_c").over(W.Window.partitionBy(*keys, "_range").orderBy("_v"))
    placed = ranged.withColumn("_upto", upto).join(offsets, [*keys, "_range"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    at = lambda place: F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c")), F.col("_v")))
    out = placed.groupBy(*keys).agg(F.max("_n").alias("n"), *[at(place).alias(name) for name, place in picks.items()], F.max("mean").alias("mean"), F.max("max").alias("max"))
    return out.select(*by, "n", *picks, "mean", "max")


def latency(events: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50 (upper median), p95 (nearest rank), mean, max."""
    return _pick(events, value, list(by), {"p50": F.floor(F.col("_n") / 2), "p95": F.ceil(F.col("_n") * 0.95) - 1})


def load_test(results: DataFrame) -> dict[str, DataFrame]:
    """The report of a load test (status, duration_ms, err, events array): totals (n, ok, bad, error_pct, mean, p50, p90, p99 of the good ones, max, qps), errors by count, events by count."""
    good = F.col("status").isin(200, 202)
    counted = results.agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), F.count_if(~good).alias("bad"), (F.max("duration_ms") - F.min("duration_ms")).alias("_wall"))
    times = load_report(results.filter(good), "duration_ms").drop("n")
    wall = F.when(F.col("_wall") > 0, F.col("_wall")).otherwise(1.0)
    totals = counted.join(times, how="left").withColumns({"error_pct": F.round(100 * F.col("bad") / F.greatest("n", F.lit(1)), 1), "qps": F.round(F.col("ok") / (wall / 1000), 1)}).drop("_wall")  # a row beside a row
    errors = results.filter(~good).groupBy(F.coalesce("err", F.concat(F.lit("status="), F.col("status").cast("string"))).alias("error")).agg(F.count("*").alias("n"))
    events = results.select(F.explode("events").alias("event")).groupBy("event").agg(F.count("*").alias("n"))
    return {"totals": totals, "errors": errors.orderBy(F.desc("n"), "error").limit(5), "events": events}


def load_report(events: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50, p90, p99 by position floor(p * n), mean, max."""
    return _pick(events, value, list(by), {f"p{p}": F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1) for p in (50, 90, 99)})


def cost(model: Column, prompt: Column, completion: Column, prices: list[tuple[str, float, float]] = PRICES, default: tuple[float, float] = DEFAULT_PRICE) -> Column:
    """Estimated cost by the first family that a model's name holds, else the default price."""
    price = prompt / 1000 * default[0] + completion / 1000 * default[1]
    for family, a, b in reversed(prices):
        price = F.when(F.contains(F.lower(model), F.lit(family)), prompt / 1000 * a + completion / 1000 * b).otherwise(price)
    return price


def usage_deltas(meter: DataFrame) -> DataFrame:
    """Running totals by request (req, seq, tokens) and what each turn added."""
    w = W.Window.partitionBy("req").orderBy("seq")
    total = F.sum("tokens").over(w)
    return meter.withColumn("total", total).withColumn("added", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))


def probe(cases: DataFrame, firsts: DataFrame, k: int = 5) -> DataFrame:
    """type (null for all), n, recall_1, recall_k, mrr over located cases by the first rank of an expected chunk in the whole corpus (firsts: case, rank; see bm25.first_ranks)."""
    found = firsts.select("case", F.col("rank").alias("r"))
    within = lambda n: F.round(F.avg((F.col("r") <= n).cast("double")), 6)
    return cases.join(found, "case").rollup("type").agg(F.count("*").alias("n"), within(1).alias("recall_1"), within(k).alias("recall_k"), F.round(F.avg(1.0 / F.col("r")), 6).alias("mrr"))


def first_pass(answers: DataFrame, *by: str) -> DataFrame:
    """Of answers (reached, retries) that reached verification: how many passed at once, were retried, and how often they were judged."""
    r = F.col("retries")
    out = answers.filter("reached").groupBy(*by).agg(F.count("*").alias("reached"), F.count_if(r == 0).alias("first_pass"), F.sum(r + 1).alias("judgements"), F.max(r).alias("most_retries"), F.round(F.avg(r), 4).alias("avg_retries"))
    return out.withColumns({"first_pass_rate": F.round(F.col("first_pass") / F.col("reached"), 4), "retried": F.col("reached") - F.col("first_pass")})


def best_threshold(grid: DataFrame, survive: float = 0.98) -> DataFrame:
    """The row of a sweep (threshold, survive, detect) that keeps enough and detects most, the lowest of equals; none if none keeps enough."""
    return grid.filter(F.col("survive") >= survive).orderBy(F.desc("detect"), "threshold").limit(1)


def agreement(cases: DataFrame, thresholds: DataFrame, rule: Column) -> DataFrame:
    """threshold, skipped, agreed: a rule over case columns and `threshold` against `expected`, for a short list of thresholds."""
    return cases.crossJoin(F.broadcast(thresholds)).withColumn("_skip", rule).groupBy("threshold").agg(F.count_if("_skip").alias("skipped"), F.count_if(F.col("_skip") == F.col("expected")).alias("agreed"))


def replay(cases: DataFrame, rules: dict[str, Column], thresholds: list[int], *by: str) -> DataFrame:
    """rule, threshold, by, n, skipped, agreed: several skip rules, each over case columns and `threshold`, against `expected` (a case's types are in by)."""
    grid = cases.crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")))  # a short list
    each = grid.select("threshold", "expected", *by, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("skip")) for n, c in rules.items()])).alias("r"))
    return each.groupBy("r.rule", "threshold", *by).agg(F.count("*").alias("n"), F.count_if("r.skip").alias("skipped"), F.count_if(F.col("r.skip") == F.col("expected")).alias("agreed"))


def rewrite_trace(notes: Column) -> dict[str, Column]:
    """mode (skip, llm or none) and query of the last rewrite note."""
    last = F.try_element_at(F.filter(notes, lambda n: F.startswith(n, F.lit("rewrite:"))), F.lit(-1))
    body = F.trim(F.substring(last, len("rewrite:") + 1, F.length(last)))
    skip = F.contains(body, F.lit("rule skip"))
    return {"mode": F.when(last.isNull(), "none").when(skip, "skip").otherwise("llm"), "query": F.when(last.isNull() | skip, "").otherwise(body)}


def multi_turn(turns: DataFrame) -> DataFrame:
    """cases, skip_rate, identity_rewrites, verifiable, anchor_hit over last turns (question, notes, verifiable, anchor_hit)."""
    t = rewrite_trace(F.col("notes"))
    return turns.withColumns({"_mode": t["mode"], "_query": t["query"]}).agg(
        F.count("*").alias("cases"),
        F.round(F.avg((F.col("_mode") == "skip").cast("double")), 4).alias("skip_rate"),
        F.count_if((F.col("_mode") == "llm") & (F.col("_query") == F.trim("question"))).alias("identity_rewrites"),
        F.count_if("verifiable").alias("verifiable"),
        F.count_if("anchor_hit").alias("anchor_hit"),
    )


def ingest_report(files: DataFrame) -> DataFrame:
    """status (null for all), files, chunks of ingested files (status, chunks)."""
    return files.rollup("status").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


def est_usage(text: Column) -> Column:
    """Tokens of a text where a provider reports none."""
    return F.floor(F.length(text) / 2)


def read_golden_turns(spark: SparkSession, path: str) -> DataFrame:
    """Multi-turn cases; raises as read_golden does, and on cases of one turn."""
    turns = "cases array<struct<id: string, category: string, turns: array<string>, expected_doc: string, anchor: string>>"
    cases = spark.read.schema(turns).json(path, multiLine=True).select(F.inline("cases"))
    bad = cases.agg(F.count("*").alias("n"), (F.count("id") - F.count_distinct("id")).alias("repeated"), F.count_if(F.col("id").isNull() | F.col("anchor").isNull() | (F.coalesce(F.size("turns"), F.lit(0)) < 2)).alias("missing"), F.count_if(F.length(normalize(F.col("anchor"))) < MIN_ANCHOR).alias("short")).first()
    if not bad["n"] or bad["missing"] or bad["repeated"] or bad["short"]:
        raise ValueError(f"golden cases: {bad.asDict()}")
    return cases
