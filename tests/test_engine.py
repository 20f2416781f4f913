"""The engine over real files, the model adapters, retries, sinks and byte-level detection."""

import io
import json
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera import engine as engine_module
from tessera.engine import Engine, Provider, provider, timed
from tessera.functions import text as T
from tessera.operators import agent, bm25, chunking, dense, sinks
from tessera.sources import files, pdf

LEAVE = "# Annual leave\n\nEmployees get twenty days of annual leave every year.\n\n# Travel\n\nTravel expenses are paid after approval by the manager."


def office(inner="word/document.xml"):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr(inner, '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Office hours are flexible for everyone.</w:t></w:r></w:p></w:body></w:document>')
    return raw.getvalue()


def test_detection_of_bytes(spark):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "x")
    heads = {
        "cut": ("a" + "年" * 600).encode(), "cut2": ("ab" + "年" * 600).encode(), "four": ("a" + "😀" * 400).encode(), "gbk": "年假制度".encode("gbk") * 300, "gbkodd": b"a" + "年假".encode("gbk") * 400, "binary": bytes(range(256)) * 5,
        "docx": office(), "xlsx": office("xl/workbook.xml"), "zip": other.getvalue(), "notzip": b"PK\x03\x04rest", "ole": bytes.fromhex("D0CF11E0A1B11AE1"), "pdf": b"%PDF-1.7", "md": b"# Title\ntext", "empty": b"", "null": None,
    }
    rows = spark.createDataFrame(list(heads.items()), "name string, content binary").withColumn("path", F.lit("upload"))
    got = {r[0]: r[1] for r in rows.select("name", files.detect_format(F.col("path"), F.col("content"))).collect()}
    want = {"cut": "txt", "cut2": "txt", "four": "txt", "gbk": "txt", "gbkodd": "txt", "binary": "unsupported", "docx": "docx", "xlsx": "docx", "zip": "unsupported", "notzip": "unsupported", "ole": "unsupported", "pdf": "pdf", "md": "md", "empty": "txt"}
    assert {k: v for k, v in got.items() if k != "null"} == want
    assert rows.select(files.detect_format(F.lit("/x/NOTE.MD"), F.col("content"))).distinct().collect()[0][0] == "md"


def test_chinese_headings():
    assert [files.cjk_heading(x) for x in ("第一章 总则", "第一千章", "第3节 范围", "1.2 适用范围", "1.2.3.4 细则", "1. 总则", "1、总则", "一、目的", "正文", "", "第一章" + "长" * 40)] == [1, 1, 2, 2, 3, 2, 1, 3, None, None, None]
    kinds = [(k, n) for k, _, n, _, _ in files.markdown_blocks("第一章 总则\n正文一\n正文二\n1.1 范围\n其余", cjk=True)]
    assert kinds == [("heading", 1), ("paragraph", None), ("heading", 2), ("paragraph", None)]


def test_mixed_tokens(spark):
    row = spark.createDataFrame([("年假制度 HR_1 假 ok",)], "t string").select(T.tokenize_mixed(F.col("t"))).first()[0]
    assert row == ["年假", "假制", "制度", "hr_1", "假", "ok"]
    chunks = spark.createDataFrame([(0, 1, 1, "关于年假的规定"), (0, 2, 2, "差旅报销标准"), (0, 3, 3, "考勤制度")], "sig int, chunk int, ord int, content string")
    asked = spark.createDataFrame([(1, 0, "年假怎么算")], "query_id int, sig int, question string")
    assert bm25.search(chunks, asked, 1, T.tokenize_mixed).first()["chunk"] == 1


def test_engine(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    (tmp_path / "in" / "leave_2024.md").write_text(LEAVE)
    (src / "notes.txt").write_bytes("年假制度说明文件".encode("gbk"))
    (src / "broken.docx").write_bytes(b"no archive")
    (src / "skipped.png").write_bytes(b"png")
    (tmp_path / "bare").write_bytes(office())
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.health()["code"] == 200 and engine.count() == 0
    rows, missing = engine.collect([f"file://{tmp_path}/in", f"file://{tmp_path}/bare", f"file://{tmp_path}/nowhere"], "t0")
    assert missing == [f"file://{tmp_path}/nowhere"]
    first = {r.doc_key.rsplit("/", 1)[-1]: (r.action, r.status) for r in engine.ingest(rows, 100).collect()}
    assert first == {"leave_2024.md": ("create", "done"), "notes.txt": ("create", "done"), "broken.docx": ("create", "failed"), "bare": ("create", "done")}
    (tmp_path / "in" / "leave_2024.md").write_text(LEAVE + "\n\nNew rule about sick leave.")
    rows, _ = engine.collect([f"file://{tmp_path}/in", f"file://{tmp_path}/bare"], "t0")
    second = {r.doc_key.rsplit("/", 1)[-1]: (r.action, r.status) for r in engine.ingest(rows, 200).collect()}
    assert second == {"leave_2024.md": ("new_version", "done"), "notes.txt": ("skip", "skipped"), "broken.docx": ("retry", "failed"), "bare": ("skip", "skipped")}
    held = engine.chunks.current().filter("is_valid").collect()
    assert {r.version for r in held if r.doc_title == "leave_2024"} == {2} and any("sick leave" in r.content for r in held)
    assert all(r.end_offset - r.start_offset == len(r.content) for r in held)
    assert {r.doc_year for r in held} == {2024, -1}
    asked = spark.createDataFrame([(1, "annual leave days", "t0", "internal")], "query_id int, question string, tenant_id string, user_permission string")
    best = engine.retrieve(asked, 300).items.filter("kind = 'item' AND rank = 1").first()
    assert any(r.chunk_id == best.chunk and "annual leave" in r.content for r in held)
    terms = {r.term for r in engine.vocabulary().collect()}
    assert "travel" in terms and "the" not in terms
    golden = {"meta": {"case_count": 1}, "cases": [{"id": "a", "query": "annual leave every year", "expected_doc": "x", "anchor": "twenty days of annual leave"}]}
    (tmp_path / "golden.json").write_text(json.dumps(golden))
    assert engine.evaluate(f"file://{tmp_path}/golden.json", f"file://{tmp_path}/report.json") == (1.0, 1.0)
    assert json.loads((tmp_path / "report.json").read_text())["summary"]
    before = engine.chunks.current().count()
    engine.purge()
    assert engine.chunks.current().count() == engine.count() < before
    engine.store.set("registry", "snapshot-none")
    assert engine.health()["code"] == 503


def test_providers_and_spans():
    assert provider("remote", " ").degraded and not provider("mock", None).degraded and provider("remote", "k").name == "remote"
    with pytest.raises(ValueError, match="unknown provider"):
        provider("other", "k")
    log, now = [], iter([0.0, 0.1, 1.0, 2.0])
    with timed("slow_query", log, lambda: next(now)):
        pass
    with timed("slow_query", log, lambda: next(now), query="q"):
        pass
    assert [(s["query"], s["duration_ms"]) for s in log] == [("q", 1000.0)]


def test_model_calls(spark):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "query_id int, prompt string")

    def call(prompts):
        call.n = getattr(call, "n", 0) + 1
        return [("no json", "stop") if p == "p3" or p == "p1" and call.n == 1 else (f'said {{"grounded": true, "confidence": 0.{len(p)}}}', "length" if p == "p2" else "stop") for p in prompts]

    got = {r.query_id: r for r in agent.complete_json(asked.coalesce(1), call, agent.VERDICT_SCHEMA).collect()}
    assert got[0].parsed.confidence == 0.2 and got[1].parsed.grounded and got[1].tries == 2 and got[2].truncated
    assert got[3].tries == 2 and (got[3].parsed is None or got[3].parsed.confidence is None)


def test_frames_and_history(spark):
    done = spark.createDataFrame([(1, "answer", "word " * 20, "kb_qa", ["c1"], True, 0.9, False, 0)], "query_id int, route string, answer string, intent string, citations array<string>, grounded boolean, confidence double, degraded boolean, retries int")
    frames = [r.frame for r in agent.event_frames(done).orderBy("seq").collect()]
    assert [f.split("\n")[0] for f in frames] == ["event: ready", "event: token", "event: token", "event: token", "event: citation", "event: done"]
    assert "".join(json.loads(f.split("data: ")[1])["text"] for f in frames[1:4]) == "word " * 20
    old = spark.createDataFrame([(1, i, "user", "x") for i in range(25)] + [(2, 0, "user", "y")], "conv_id int, turn long, role string, text string")
    new = agent.finalized(old, spark.createDataFrame([(1, "a"), (3, "b")], "conv_id int, answer string"))
    assert {r.conv_id: r.n for r in new.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {1: 20, 2: 1, 3: 1}


def test_sinks(spark, tmp_path):
    where = f"file://{tmp_path}"
    for raw in (b"one", b"two"):
        sinks.write_file(spark, f"{where}/pointer", raw)
    assert (tmp_path / "pointer").read_bytes() == b"two"
    assert sinks.read_vocabulary(spark, f"{where}/none").count() == 0
    sinks.write_vocabulary(spark.createDataFrame([("a",), ("a",), ("b",)], "term string"), f"{where}/terms")
    assert sorted(r.term for r in sinks.read_vocabulary(spark, f"{where}/terms").collect()) == ["a", "b"]
    up = sinks.write_uploads(spark.createDataFrame([("t0", "x/y.txt", bytearray(b"hi"))], "tenant_id string, name string, content binary"), f"{where}/up").collect()
    assert open(up[0].path, "rb").read() == b"hi" and "t0" in up[0].path
    sinks.write_log(spark.createDataFrame([("{}",)], "line string"), f"{where}/log")
    sinks.write_log(spark.createDataFrame([("{}",)], "line string"), f"{where}/log")
    assert spark.read.text(f"{where}/log").count() == 2


def test_rewriting(spark):
    q = spark.createDataFrame([(1, "how many days of leave"), (2, "and this?"), (3, "yes")], "query_id int, question string")
    history = spark.createDataFrame([(2, "user: leave", "It is 20 days."), (3, "user: old", "Only an expired document. Show it?")], "query_id int, text string, last_answer string")
    anchors = spark.createDataFrame([(1, 1)], "query_id int, anchors int")
    got = {r.query_id: r for r in agent.rewritten(q, history, anchors, lambda ps: [('{"rewritten_query": "leave of this year"}', "stop")] * len(ps)).collect()}
    assert (got[1].mode, got[1].rewritten) == ("skip", "how many days of leave")
    assert (got[2].mode, got[2].rewritten) == ("llm", "leave of this year") and got[3].include_expired
    assert agent.rewritten(q, history, anchors).filter("rewritten IS NULL").isEmpty()


def pdf_stream(head, body, flate=False):
    body = zlib.compress(body) if flate else body
    return b"<< /Length %d %s %s>>\nstream\n" % (len(body), head, b"/Filter /FlateDecode " if flate else b"") + body + b"\nendstream"


def pdf_file(objects, trailer=b""):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects) + b"trailer << /Root 1 0 R " + trailer + b">>\n%%EOF"


CMAP = b"begincmap 1 beginbfrange <0001> <0003> <5E74> endbfrange 1 beginbfchar <0010> <5047> endbfchar"
LEAVE_PDF = [
    (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>"), (3, b"<< /Type /Page /Contents 4 0 R >>"),
    (4, pdf_stream(b"", b"BT /F1 12 Tf 72 700 Td (Parental \\(leave\\) is paid in full for the) Tj 0 -14 Td [(whole per) 10 (iod of) -300 (twelve weeks.)] TJ 0 -40 Td (It starts with the birth of the child, at the latest.) Tj ET", True)),
    (6, b"<< /Type /Page /Contents [5 0 R] /Resources << /Font << /F2 8 0 R >> /XObject << /I 11 0 R >> >> >>"), (5, pdf_stream(b"", b"BT /F2 10 Tf 1 0 0 1 50 600 Tm <00010010> Tj ET")),
    (7, b"<< /Type /Font /Subtype /Type1 >>"), (8, b"<< /Subtype /Type0 /ToUnicode 9 0 R >>"), (9, pdf_stream(b"", CMAP, True)), (11, pdf_stream(b"/Subtype /Image", b"x")),
]


def test_pdf_pages():
    assert pdf.read_pages(pdf_file(LEAVE_PDF)) == [(1, "Parental (leave) is paid in full for the\nwhole period of twelve weeks.\n\nIt starts with the birth of the child, at the latest.", 0), (2, "年假", 1)]
    packed = b"<< /Type /Catalog /Pages 2 0 R >>   << /Kids [3 0 R] >>"
    head = b"1 0 2 %d " % packed.index(b"<< /Kids")
    inner = [(10, pdf_stream(b"/Type /ObjStm /N 2 /First %d" % len(head), head + packed, True)), (3, b"<< /Contents 4 0 R /Resources << /Font << /F1 7 0 R >> >> >>"), (4, pdf_stream(b"", b"BT /F1 12 Tf (compressed <a> \\101) Tj ET")), (7, b"<< /Subtype /Type1 >>")]
    assert pdf.read_pages(pdf_file(inner)) == [(1, "compressed <a> A", 0)]
    later = [*inner, (4, pdf_stream(b"", b"BT /F1 12 Tf (updated) Tj ET"))]  # the later object of a number counts
    assert pdf.read_pages(pdf_file(later)) == [(1, "updated", 0)]
    assert pdf.read_pages(pdf_file([(1, b"<< >>")], b"/Encrypt 5 0 R ")) is None
    for raw in (b"", None, b"no pdf", b"%PDF-1.4 junk", pdf_file([(1, b"<< /Type /Catalog /Pages 1 0 R >>")])[:30]):
        with pytest.raises(ValueError):
            pdf.read_pages(raw)


def test_long_lines():
    text = "第一条。第二条。" * 500
    assert "".join(chunking.cut(text)) == text
    assert chunking.cut("one two. " * 2 + "end") == ["one two. one two. end"]
    began = time.perf_counter()
    parts = chunking.cut("x" * 1_000_000)
    assert "".join(parts) == "x" * 1_000_000 and max(map(chunking.tokens, parts)) <= chunking.CHUNK_TOKENS and time.perf_counter() - began < 5


def embed(texts):
    """Vectors for texts about leave, travel or neither; of a nonsense question one that points away from all."""

    def run(frames):
        def axes(t):
            return [0.0, 0.0, 0.0, -1.0] if "qqzx" in t else [float("leave" in t), float("travel" in t.lower()), float("leave" not in t and "travel" not in t.lower()), 0.01 * (len(t) % 7)]

        for f in frames:
            f["embedding"] = [axes(t) for t in f["content"]]
            yield f[["chunk", "embedding"]]

    return texts.select("chunk", "content").mapInPandas(run, "chunk string, embedding array<float>")


def test_engine_on_stored_embeddings(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "leave_2024.md").write_text(LEAVE + "\n\nXylophone quota.")
    (src / "parents.pdf").write_bytes(pdf_file(LEAVE_PDF))
    (src / "locked.pdf").write_bytes(pdf_file([(1, b"<< >>")], b"/Encrypt 5 0 R "))
    (src / "cut.pdf").write_bytes(b"%PDF-1.4 nothing")
    engine = Engine(spark, f"file://{tmp_path}/store", Provider("remote"), embed)
    report = {r.doc_key.rsplit("/", 1)[-1]: r for r in engine.ingest(engine.collect([f"file://{src}"], "t0")[0], 100).collect()}
    assert {k: r.status for k, r in report.items()} == {"leave_2024.md": "done", "parents.pdf": "done", "locked.pdf": "failed", "cut.pdf": "failed"}
    assert report["locked.pdf"].error == "encrypted" and "no pages" in report["cut.pdf"].error
    held = engine.table().filter("is_valid").collect()
    assert {r.page_num for r in held if r.doc_title == "parents"} >= {1} and any("twelve weeks" in r.content for r in held)
    # a superseded version's words say nothing, and its vectors aren't found
    (src / "leave_2024.md").write_text(LEAVE)
    engine.ingest(engine.collect([f"file://{src}/leave_2024.md"], "t0")[0], 200)
    asked = spark.createDataFrame([(1, "paid leave for parents", "t0", "internal"), (2, "xylophone quota", "t0", "internal"), (3, "qqzx wwkv", "t0", "internal")], "query_id int, question string, tenant_id string, user_permission string")
    got = engine.retrieve(asked, 300)
    verdicts = {r.query_id: r for r in got.verdicts.collect()}
    assert verdicts[1].top_cosine > 0.99 and not verdicts[1].no_relevant
    assert verdicts[3].no_relevant and verdicts[3].coverage == 0.0 and verdicts[3].top_cosine < 0.4
    assert verdicts[2].coverage < 1.0  # only the old version held it
    valid = {r.chunk for r in engine.table().filter("is_valid").select("chunk").collect()}
    assert {r.chunk for r in got.items.collect()} <= valid
    # from question to reply, twice in one thread
    turn = lambda q: spark.createDataFrame([(7, q, "t0", "internal")], "conv_id long, question string, tenant_id string, user_permission string")
    first = engine.answer(turn("how long is parental leave paid"), now=300).first()
    assert first["route"] in ("answer", "disclose") and first["citations"]
    second = engine.answer(turn("hello"), now=301).first()
    assert second["route"] == "direct"
    assert [(r.turn, r.role) for r in engine.messages(7).collect()] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    # documents that go leave both roads
    page, total = engine.documents("t0")
    assert total == 4 and page.count() == 4
    doc = engine.registry.current().filter("doc_key LIKE '%parents.pdf'").select("tenant_id", "doc_id")
    answers = engine.delete(doc.unionByName(spark.createDataFrame([("t0", "doc_none")], "tenant_id string, doc_id string")), 400)
    assert {r.status for r in answers.collect()} == {204, 404}
    assert engine.documents("t0")[1] == 3
    after = {r.chunk for r in engine.retrieve(asked, 500).items.collect()}
    assert after and not after & {r.chunk_id for r in held if r.doc_title == "parents"}
    assert {r.chunk for r in engine.index.lengths().collect()} == {r.chunk for r in engine.table().filter("is_valid").select("chunk").collect()}
    assert engine_module.main(["health", engine.folder]) == 0
    assert engine_module.main(["ask", engine.folder, "t0", "internal", "9", "travel", "expenses", "approval"]) in (0, 1)
    assert "[source:" in capsys.readouterr().out
    assert engine_module.main(["ingest", engine.folder, "t0", f"file://{src}", f"file://{tmp_path}/none"]) == 1
    assert engine_module.main(["nothing", engine.folder]) == 2


def test_index_of_postings(spark, tmp_path):
    words = [(i, i, f"w{i % 3} w{i % 5} common {'rare' if i == 4 else ''}", "t0" if i % 4 else "t1") for i in range(30)]
    chunks = spark.createDataFrame(words, "chunk int, ord int, content string, tenant string")
    asked = spark.createDataFrame([(1, 0, "rare w1 common"), (2, 0, "w2 w2 nothing"), (3, 1, "common w0")], "query_id int, sig int, question string")
    index = bm25.PostingsIndex(spark, f"file://{tmp_path}/postings")
    index.commit(chunks.filter("chunk < 20").withColumn("content", F.when(F.col("chunk") == 3, "old words").otherwise(F.col("content"))))
    index.commit(chunks.filter("chunk >= 20 OR chunk = 3"))
    index.commit(chunks.limit(0), chunks.filter("chunk IN (4, 9)").select("chunk"))

    def both(live):
        eligible = live.withColumn("sig", F.lit(0)).unionByName(live.filter("tenant = 't1'").withColumn("sig", F.lit(1)))
        rows = lambda df: sorted((r.query_id, r["rank"], r.chunk, round(r.score, 9)) for r in df.collect())
        return rows(index.search(eligible, asked, 5)), rows(bm25.search(eligible, asked, 5))

    live = chunks.filter("chunk NOT IN (4, 9)")
    got, want = both(live)
    assert got == want
    plan = index.postings(asked.select(F.lit("rare").alias("term")).distinct())._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
    index.sync(chunks)  # 4 and 9 come again
    assert both(chunks)[0] == both(chunks)[1]
    index.rebuild(chunks)
    assert len(index.manifest()) == 1 and both(chunks)[0] == both(chunks)[1]


def test_dense_index(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 6)) * 10.0 ** rng.integers(-30, 30, (400, 1))
    rows = [(i, i, "t0", "public", 0, 2020, i % 9 != 0, "general", f"d{i % 3}", x.tolist()) for i, x in enumerate(v)] + [(400, 400, "t0", "public", 0, 2020, True, "general", "d0", None), (401, 401, "t0", "public", 0, 2020, True, "general", "d0", [0.0] * 6), (402, 402, "t0", "public", 0, 2020, True, "general", "d0", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk int, ord int, tenant_id string, permission string, effective_time int, doc_year int, is_valid boolean, category string, department string, embedding array<double>")
    index = dense.build(chunks, lambda df, by: df)
    spec = (0, "t0", "public", None, None, 10, False, None)
    asked = spark.createDataFrame([(f"q{i}", *spec[:4], f"d{i % 3}", *spec[5:], rng.standard_normal(6).tolist()) for i in range(6)], "qp string, sig int, tenant_id string, user_permission string, category string, department string, now int, include_expired boolean, years array<int>, query array<double>")
    asked = asked.withColumn("sig", F.xxhash64("department"))
    got = {(r.qp, r["rank"]): r.chunk for r in index.search(asked, 20).collect()}
    for r in asked.collect():
        q = np.array(r.query)
        cos = (v @ q) / np.sqrt((v**2).sum(1)) / np.sqrt((q**2).sum())
        ok = [i for i in range(400) if i % 9 != 0 and f"d{i % 3}" == r.department]
        assert [got[r.qp, n + 1] for n in range(20)] == sorted(ok, key=lambda i: (-round(cos[i], 9), i))[:20]
    assert dense.build(chunks.limit(0), lambda df, by: df).search(asked).count() == 0


def test_chunks_of_many_documents_are_one_stream(spark):
    """Documents of any number and size, whose blocks come in any order and batches, are chunked as each alone, and not in a Python call for each."""
    texts = {f"d{i}": [("table" if (i + k) % 7 == 0 else "paragraph", f"{'wort ' * (i * k % 400)}年假 {i}. Ende! {k}", k % 3 or None) for k in range(i % 13 + 1)] for i in range(200)}
    rows = [(d, k, *b) for d, blocks in texts.items() for k, b in reversed(list(enumerate(blocks)))]
    made = chunking.chunk_documents(spark.createDataFrame(rows, "doc string, seq int, block_type string, text string, page int").repartition(7))
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {(d, i + 1, k, p, chunking.tokens(t), t) for d, blocks in texts.items() for i, (k, t, p) in enumerate(chunking.chunk_blocks(blocks))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = [tuple(r) for r in made.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and len(got) == len(want)
    assert chunking.counts("aß_9 年。-�😀") == (2, 3) and chunking.tail("wort " * 300) == ("wort " * 300)[-322:]
