"""Optional streams: versioned ingest by micro-batches, event counts with late data, and the state of conversations."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.conversation import HISTORY_MESSAGES
from tessera.operators.registry import SnapshotTable


def ingest(stream: DataFrame, table: SnapshotTable, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a snapshot table; one batch at a time is the one writer, and a repeated batch gives the same table."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.merge(batch, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """n and total value by window and event_type of events (ts, event_type, value)."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


THREAD = "conv_id long, turn long, question string, last_answer string, pending boolean, messages array<struct<turn: long, role: string, text: string>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThreadState(StatefulProcessor):
    """The state of a conversation: its last messages, at most `keep`, and whether the assistant waits for a confirmation. Silence of `ttl` between two messages ends a thread:
    what was said before it is forgotten, and a timer on the watermark clears threads that nobody comes back to.

    A question's row says what the thread held before it. Messages of a thread in one micro-batch are taken in order of turn; a turn that the state holds already is a repeated row
    and says nothing again, and one that comes late takes its place among the others for the questions after it.
    """

    def __init__(self, keep: int, ttl: timedelta) -> None:
        self.keep, self.ttl = keep, int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn long, role string, text string, ms long")
        self.pending = handle.getValueState("pending", "pending boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(m) for m in self.messages.get()]
        text = lambda x: None if pd.isna(x) else x
        new = {t: (t, text(r), text(x), int(ms)) for f in rows for t, r, x, ms in f[["turn", "role", "text", "ms"]].itertuples(index=False)}  # what a micro-batch holds of one thread
        out = []
        for m in sorted(new.values(), key=lambda m: m[0]):
            if any(m[0] == h[0] for h in held):
                continue
            if held and m[3] - max(h[3] for h in held) > self.ttl:
                held = []
            if m[1] == "user":
                answer = self._answer(held)
                out.append((key[0], m[0], m[2], answer, offers_expired(answer), [{"turn": t, "role": r, "text": x} for t, r, x, _ in held]))
            held = sorted([*held, m], key=lambda m: m[0])[-self.keep :]
        if new:
            self.messages.put(held)
            self.pending.update((held[-1][1] == "assistant" and offers_expired(held[-1][2]),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(h[3] for h in held) + self.ttl)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "last_answer", "pending", "messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.messages.clear()
        self.pending.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "question", "last_answer", "pending", "messages"])

    @staticmethod
    def _answer(held: list[tuple]) -> str | None:
        return next((x for _, r, x, _ in reversed(held) if r == "assistant"), None)

    def close(self) -> None:
        pass


def offers_expired(answer: str | None) -> bool:
    """The first half of conversation.confirms_expired: what the assistant said last offers expired documents."""
    return answer is not None and "expired" in answer.lower() and "?" in answer


def thread_states(messages: DataFrame, keep: int = HISTORY_MESSAGES, ttl: timedelta = timedelta(days=7), late: str = "1 hour") -> DataFrame:
    """A row for each question of a stream of messages (conv_id, turn, role, text, at: a timestamp): its thread's last answer, whether that waits for a confirmation, and the messages before it.

    Rows without a conversation, turn or time take no part; rows later than `late` behind the newest are dropped by the watermark. State is kept by conversation; it needs the
    RocksDB provider (see started). A task holds one thread's messages of one micro-batch, which the source's rate limit bounds.
    """
    known = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "at").filter("conv_id IS NOT NULL AND turn IS NOT NULL AND at IS NOT NULL")
    timed = known.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("conv_id").transformWithStateInPandas(ThreadState(keep, ttl), THREAD, "Append", "EventTime")


def started(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What has come, as Parquet files below path, each row once; started again with the same checkpoint it goes on from its state."""
    conf = states.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)  # a query takes its settings when it starts
    try:
        return states.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        conf.set(name, before)
