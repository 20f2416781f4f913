"""One object that holds a deployment's tables and settings, and the command line over it.

python -m tessera.engine ingest FOLDER TENANT SOURCE...    ingest files; exit 1 if any failed
python -m tessera.engine eval FOLDER GOLDEN REPORT         recall@5 and MRR of the lexical road on a golden file; exit 1 below the limit
python -m tessera.engine ask FOLDER TENANT PERMISSION CONVERSATION QUESTION    the reply to a turn of a conversation, without a model
python -m tessera.engine health FOLDER                     exit 1 if a table can't be read
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize_mixed
from tessera.operators import agent, bm25, conversation, dense, evaluation, gate, ingest, retrieval, sinks, vector
from tessera.operators.registry import SnapshotTable, list_page
from tessera.operators.scratch import kept
from tessera.operators.service import SLOW
from tessera.operators.store import Store
from tessera.sources import files
from tessera.sources.transcription import TranscriptCache

Embed = Callable[[DataFrame], DataFrame]
#: Share of chunks that are no longer valid from which maintain drops them.
INVALID = 0.3
MESSAGES = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Provider:
    """What embeds: name mock or remote; degraded where a remote one was asked for without a key."""

    name: str
    degraded: bool = False


def provider(asked: str, key: str | None) -> Provider:
    """The provider for a setting (mock, remote); remote without a key falls back to mock and says so, any other name raises."""
    if asked == "mock":
        return Provider("mock")
    if asked == "remote":
        return Provider("remote") if (key or "").strip() else Provider("mock", True)
    raise ValueError(f"unknown provider {asked}")


@contextmanager
def timed(name: str, log: list[dict] | None = None, clock: Callable[[], float] = time.monotonic, **attributes: object) -> Iterator[dict]:
    """A span with its duration in milliseconds, put in log if it is as slow as its kind's limit; kinds without one always are."""
    span: dict = {"event": name, **attributes}
    began = clock()
    try:
        yield span
    finally:
        span["duration_ms"] = round((clock() - began) * 1000, 3)
        if log is not None and span["duration_ms"] >= SLOW.get(name, 0):
            log.append(span)


@dataclass
class Engine:
    """Tables below `folder`: chunks, registry, vocabulary. Settings and stores can be put in for tests."""

    spark: SparkSession
    folder: str
    embedder: Provider = field(default_factory=lambda: Provider("mock"))
    embed: Embed | None = None
    transcriber: Callable[[list[bytes]], list[str | None]] | None = None
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.folder)
        self.chunks = SnapshotTable(self.spark, f"{self.folder}/chunks", self.store)
        self.registry = SnapshotTable(self.spark, f"{self.folder}/registry", self.store)
        self.scratch = SnapshotTable(self.spark, f"{self.folder}/scratch")
        self.threads = SnapshotTable(self.spark, f"{self.folder}/threads")
        self.index = bm25.PostingsIndex(self.spark, f"{self.folder}/postings", tokenize_mixed, self.store)
        self.store.table("vocabulary", lambda name: [f"{self.folder}/{name}"])
        self.transcripts = TranscriptCache(self.spark, f"{self.folder}/transcripts")
        self._dense: tuple[str, dense.DenseIndex] | None = None

    def _registry(self) -> DataFrame:
        held = self.registry.current()
        return self.spark.createDataFrame([], ingest.REGISTRY) if held is None else held

    def collect(self, sources: list[str], tenant: str) -> tuple[DataFrame, list[str]]:
        """Files as rows for ingest, and the sources that don't exist."""
        found, missing = files.collect(self.spark, sources)
        kind = files.detect_format(F.col("path"), F.col("content"))
        rows = found.select(F.lit(tenant).alias("tenant_id"), F.regexp_replace("path", "^[a-z]+:/*", "/").alias("doc_key"), F.col("path").alias("file_path"), kind.alias("format"), "content")
        readable = F.when(F.col("format").isin("md", "txt"), files.decode_text(F.when(F.col("format").isin("md", "txt"), F.col("content"))))
        return rows.select("*", readable.alias("text"), F.sha2("content", 256).alias("content_hash"), F.lit(False).alias("force")), missing

    def ingest(self, rows: DataFrame, now: int | None = None) -> DataFrame:
        """Commits chunks, registry, the postings of new chunks and the anchor vocabulary (whose failure is only logged) as one version; returns the report. Conflict if another writer was faster."""
        with timed("ingest_slow", self.log), self.store.transaction():
            out = ingest.ingest(rows, self._registry(), self.chunks.current(), int(time.time()) if now is None else now, self.embed, self.scratch.put, self.transcriber and (lambda images: self.transcripts.transcribe(images, self.transcriber)))
            report = self.scratch.put(out.report)
            chunks = self._commit(out.chunks, self.scratch.put(out.registry))
            try:
                self.build_vocabulary(chunks)
            except Exception as e:  # the documents are in; the vocabulary can be built again
                self.log.append({"event": "vocabulary_failed", "error": str(e).splitlines()[0]})
        return report

    def _commit(self, chunks: DataFrame, registry: DataFrame) -> DataFrame:
        """Chunks, registry and the postings of valid chunks, in the open transaction."""
        after = self.chunks.commit(chunks)
        self.registry.commit(registry)
        self.index.sync(after.filter("is_valid").select(F.col("chunk_id").alias("chunk"), "content"))
        return after

    def build_vocabulary(self, chunks: DataFrame) -> None:
        valid = chunks.filter("is_valid")
        titles = valid.select("doc", F.col("doc_title").alias("title")).distinct()
        name = f"vocabulary-{uuid.uuid4().hex}"
        sinks.write_vocabulary(gate.whole_anchor_vocabulary(valid, titles, []), f"{self.folder}/{name}")
        self.store.set("vocabulary", name)

    def vocabulary(self) -> DataFrame:
        """term of the anchor vocabulary; none before the first ingest."""
        return sinks.read_vocabulary(self.spark, f"{self.folder}/{self.store.get('vocabulary')}")

    def table(self) -> DataFrame | None:
        """The chunk table in the form retrieval takes: chunk is chunk_id, ord its order."""
        held = self.chunks.current()
        return None if held is None else held.withColumn("chunk", F.col("chunk_id")).withColumn("ord", F.col("chunk_id"))

    def retrieve(self, questions: DataFrame, now: int | None = None, top_n: int | None = None) -> retrieval.Retrieved:
        """Questions: query_id, question, tenant_id, user_permission. Where embeddings are stored, questions alone are embedded and meet the index; without any, the mock embedding's vectors are made from the chunks themselves and relevance isn't judged."""
        chunks = self.table()
        if chunks is None:
            raise ValueError("nothing has been ingested")
        with timed("slow_query", self.log):
            at = int(time.time()) if now is None else now
            if self.embed is not None and self.embedder.name != "mock" and "embedding" in chunks.columns:
                return retrieval.retrieve(questions, chunks, dense.road(self.dense_index(chunks), self.embed), at, self.embedder.name, top_n, index=self.index)
            vectors = vector.mock_embedding(chunks.filter("is_valid").select("chunk", "content"), "chunk", "content")
            return retrieval.retrieve(questions, chunks, vectors, at, "mock", top_n, index=self.index)

    def dense_index(self, chunks: DataFrame) -> dense.DenseIndex:
        """The index of the current snapshot's valid chunks, built once for it."""
        name = self.chunks.snapshot() or ""
        if self._dense is None or self._dense[0] != name:
            held = chunks.filter("is_valid").drop("content")
            self._dense = name, dense.build(held, lambda rows, by: self.scratch.put(rows, by))
        return self._dense[1]

    def count(self) -> int:
        """Valid chunks."""
        held = self.chunks.current()
        return 0 if held is None else held.filter("is_valid").count()

    def answer(self, questions: DataFrame, ask: Embed = agent.stub_ask, judge: Embed = agent.stub_judge, rewrite: Callable[[list[str]], list[tuple[str, str]]] | None = None, now: int | None = None) -> DataFrame:
        """A turn of each conversation (conv_id, question, tenant_id, user_permission), from question to reply: rewritten by its history, retrieved, answered and verified, and kept with its thread.

        Returns conv_id, rewritten and the columns of agent.FIELDS; ask, judge and rewrite are the model's adapters (see agent).
        """
        held = self.threads.current()
        held = self.spark.createDataFrame([], MESSAGES) if held is None else held
        asked = kept(questions.dropDuplicates(["conv_id"]).withColumn("query_id", F.col("conv_id").cast("long")))
        mine = kept(held.join(asked.select(F.col("query_id").alias("conv_id")), "conv_id", "left_semi"))
        history = self._history(mine)
        terms = self.vocabulary()
        new = kept(agent.rewritten(asked.select("query_id", "question"), history, gate.has_anchor(asked.select("query_id", F.lower("question").alias("question")), terms), rewrite))
        turned = kept(asked.drop("question").join(new, "query_id").withColumn("question", F.col("rewritten")))
        found = self.retrieve(turned.select("query_id", "question", "tenant_id", "user_permission"), now)
        told = asked.select("query_id").join(history.select("query_id", "text"), "query_id", "left")
        lines = agent.evidence(found.items, self.table())
        out = kept(agent.answer(turned.select("query_id", "question", "include_expired"), found, lines, told, ask, judge))
        last = mine.groupBy("conv_id").agg(F.max("turn").alias("_last"))
        said = asked.select(F.col("query_id").alias("conv_id"), F.col("question").alias("text")).join(last, "conv_id", "left")
        said = said.select("conv_id", (F.coalesce("_last", F.lit(-1)) + 1).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
        after = agent.finalized(mine.unionByName(said), out.select(F.col("query_id").alias("conv_id"), "answer"))
        self.threads.commit(held.join(asked.select(F.col("query_id").alias("conv_id")), "conv_id", "left_anti").unionByName(after))
        return out.join(new.select("query_id", "rewritten"), "query_id").withColumnRenamed("query_id", "conv_id")

    @staticmethod
    def _history(messages: DataFrame) -> DataFrame:
        """query_id, text, last_answer of messages (conv_id, turn, role, text): what fits of a thread, oldest first, and what the assistant said last."""
        told = conversation.history_budget(messages.select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")))
        text = told.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "line"))), lambda x: x["line"]), "\n").alias("text"))
        last = messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_answer"))
        return text.join(last.withColumnRenamed("conv_id", "thread"), "thread", "left").withColumnRenamed("thread", "query_id")

    def messages(self, conv_id: int) -> DataFrame:
        """turn, role, text of a thread, oldest first."""
        held = self.threads.current()
        held = self.spark.createDataFrame([], MESSAGES) if held is None else held
        return held.filter(F.col("conv_id") == conv_id).select("turn", "role", "text").orderBy("turn")

    def delete(self, asked: DataFrame, now: int | None = None) -> DataFrame:
        """tenant_id, doc_id, status (204, or 404 for unknown ones) for documents asked to go (tenant_id, doc_id); their chunks leave both roads."""
        at = F.lit(int(time.time()) if now is None else now).cast("long")
        with self.store.transaction():
            chunks, registry, answers = ingest.delete_documents(self.chunks.current(), self._registry(), asked, at)
            answers = kept(answers)
            self._commit(chunks, kept(registry))
        return answers

    def patch(self, changes: DataFrame) -> DataFrame:
        """tenant_id, doc_id, chunks_updated for changes (tenant_id, doc_id, effective_time, ...)."""
        with self.store.transaction():
            chunks, answers = ingest.patch_documents(self.chunks.current(), self._registry(), changes)
            answers = kept(answers)
            self.chunks.commit(chunks)
        return answers

    def documents(self, tenant: str, limit: int = 50, offset: int = 0, deleted: bool = False) -> tuple[DataFrame, int]:
        """A page of a tenant's documents, last updated first, and how many there are in all."""
        held = self._registry()
        rows = held.filter(F.col("tenant_id") == tenant)
        return list_page(held, tenant, limit, offset, deleted), (rows if deleted else rows.filter("NOT is_deleted")).count()

    def rebuild(self) -> None:
        """The stored postings anew from the valid chunks."""
        with self.store.transaction():
            chunks = self.chunks.current()
            if chunks is None:
                return
            self.index.rebuild(chunks.filter("is_valid").select(F.col("chunk_id").alias("chunk"), "content"))

    def purge(self) -> None:
        """Drops chunks that aren't valid."""
        with self.store.transaction():
            self.chunks.compact()

    def maintain(self, keep: int = 2, invalid: float = INVALID) -> list[str]:
        """Purges if at least that share of the chunks isn't valid, then removes all but the newest versions; returns the folders that went."""
        held = self.chunks.current()
        if held is not None and (held.agg(F.avg((~F.col("is_valid")).cast("double"))).first()[0] or 0.0) >= invalid:
            self.purge()
        return self.store.expire(keep)

    def health(self) -> dict:
        """status, code and checks: a table that can't be read is 503, a degraded provider 200 but degraded; a table that doesn't exist yet is up."""
        checks = {}
        for name, held in (("chunks", self.chunks), ("registry", self.registry)):
            try:
                rows = held.current()
                if rows is not None:
                    rows.limit(1).collect()
                checks[name] = "up"
            except Exception:
                checks[name] = "down"
        checks["embedder"] = "degraded" if self.embedder.degraded else "up"
        down = "down" in checks.values()
        return {"status": "ok" if set(checks.values()) == {"up"} else "degraded", "code": 503 if down else 200, "checks": checks}

    def evaluate(self, golden: str, report: str | None = None, k: int = 5, tokenizer: Callable[[Column], Column] = tokenize_mixed) -> tuple[float, float]:
        """recall@k and MRR of the lexical road over the located cases of a golden file."""
        chunks = self.table().filter("is_valid")
        cases = evaluation.read_golden(self.spark, golden).select(F.col("id").alias("case"), "query", "anchor", "type")
        expected = evaluation.locate(cases, chunks)
        found = bm25.search(chunks.withColumn("sig", F.lit(0)), cases.select(F.col("case").alias("query_id"), F.lit(0).alias("sig"), F.col("query").alias("question")), tokenizer=tokenizer)
        metrics = self.scratch.put(evaluation.case_metrics(cases, expected, found.select(F.col("query_id").alias("case"), "chunk", "rank"), k))
        total = evaluation.recall_mrr(metrics)
        if report:
            sinks.write_report(self.spark, report, total.unionByName(evaluation.recall_mrr(metrics, "type"), allowMissingColumns=True), metrics)
        row = total.first()
        return float(row["recall"] or 0.0), float(row["mrr"] or 0.0)


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, argv[1])
    if argv[0] == "ingest":
        rows, missing = engine.collect(argv[3:], argv[2])
        for path in missing:
            print(f"no such path: {path}", file=sys.stderr)
        report = engine.ingest(rows)
        report.groupBy("action", "status").count().show(truncate=False)
        return int(bool(missing) or not report.filter("status IN ('failed', 'conflict')").isEmpty())
    if argv[0] == "eval":
        recall, mrr = engine.evaluate(argv[2], argv[3] if len(argv) > 3 else None)
        print(f"recall@5 {recall:.3f} MRR {mrr:.3f}")
        return int(recall < evaluation.RECALL_PASS)
    if argv[0] == "ask":
        turn = spark.createDataFrame([(int(argv[4]), " ".join(argv[5:]), argv[2], argv[3])], "conv_id long, question string, tenant_id string, user_permission string")
        reply = engine.answer(turn).first()
        print(reply["answer"])
        for chunk in reply["citations"]:
            print(f"  {chunk}")
        return int(reply["degraded"])
    if argv[0] == "health":
        state = engine.health()
        print(state)
        return int(state["code"] != 200)
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
