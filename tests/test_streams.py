from datetime import timedelta

from pyspark.sql import functions as F

from tessera.operators.registry import SnapshotTable
from tessera.streaming.streams import event_counts, ingest, started, thread_states


def test_ingest_is_idempotent(spark, tmp_path):
    src, table = str(tmp_path / "in"), SnapshotTable(spark, f"file://{tmp_path}/t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string").coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest(spark.readStream.schema("id int, x string").parquet(src), table, ["id"], str(tmp_path / "c")).awaitTermination(60)
    spark.createDataFrame([(2, "c")], "id int, x string").coalesce(1).write.mode("append").parquet(src)
    ingest(spark.readStream.schema("id int, x string").parquet(src), table, ["id"], str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r.id, r.x) for r in table.current().collect()) == [(1, "a"), (2, "c")]


def test_event_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_thread_states_against_plain(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    said = ["how long is leave", "Only an expired document was found: x. Show expired content anyway?", "yes", "Twenty days.", None, "", "and travel?"]
    hour = lambda c, t: t + (100 if c == 2 and t >= 6 else 0)  # noqa: E731  thread 2 is silent for 101 hours before its turn 6
    rows = [(c, t, "assistant" if t % 2 else "user", said[(c + t) % len(said)], hour(c, t)) for c in range(6) for t in range(9 + c)]
    schema = "conv_id long, turn long, role string, text string, hour int"

    def more(part):
        made = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds((1000 + F.col("hour")) * 3600)).drop("hour")
        made.repartition(3).write.mode("append").parquet(src)
        query = started(thread_states(spark.readStream.schema(made.schema).parquet(src), 4, timedelta(hours=48), "20 hours"), out, checkpoint)
        assert query.awaitTermination(100) and query.exception() is None

    more([r for r in rows if r[1] < 5] + [(None, 1, "user", "x", 1), (1, None, "user", "x", 1), (1, 50, "user", "x", None)])
    more([r for r in rows if 3 <= r[1]])  # after a restart, with turns that came before
    want = []
    for c in range(6):
        held, before = [], None
        for _, t, role, text, at in (r for r in rows if r[0] == c):
            held = [] if before is not None and at - before > 48 else held
            if role == "user":
                answers = [x for _, r, x in held if r == "assistant"]
                last = answers[-1] if answers else None
                want.append((c, t, text, last, bool(last and "expired" in last), held[:]))
            held, before = [*held, (t, role, text)][-4:], at
    got = [(r.conv_id, r.turn, r.question, r.last_answer, r.pending, [tuple(m) for m in r.messages]) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[4] for r in got) > 3 and [] in [r[5] for r in got if r[:2] == (2, 6)]
    # the watermark has passed the other threads' silence, so their state went with the timers: a repeated question finds nothing before it
    more([(9, 0, "user", "later", 400)])
    more([(0, 8, "user", "again", 400)])
    again = spark.read.parquet(out).filter("question = 'again'").first()
    assert again.messages == [] and again.last_answer is None
