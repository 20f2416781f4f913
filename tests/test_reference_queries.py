"""Every query that isn't of the llm subpackage against its DuckDB statement, and the parts SQL can't say."""

import decimal
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking, conversation, evaluation, fusion, registry
from tessera.plans import catalog
from tessera.sources import files


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_markdown_blocks():
    text = "# A\npara one\n![i](http://x/y.png)\nmore\n| a | b |\n|---|---|\n| 1 | 2 |\n| lone |\n\n```py\nx\n```\n## B\n| no table\nkept\n```\nopen"
    kinds = [(k, level) for k, _, level, _, _ in files.markdown_blocks(text)]
    assert kinds == [("heading", 1), ("paragraph", None), ("image", None), ("paragraph", None), ("table", None), ("code", None), ("heading", 2), ("paragraph", None), ("code", None)]
    assert files.markdown_blocks(text)[-1][4] == "fence not closed"
    assert "kept" in files.markdown_blocks(text)[-2][1]


def test_docx(spark):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", xml)
    df = spark.createDataFrame([("d", "docx", None, bytearray(raw.getvalue())), ("bad", "docx", None, bytearray(b"zz")), ("p", "pdf", None, None)], "doc string, format string, text string, content binary")
    rows = {(r.doc, r.seq): (r.block_type, r.text, r.heading_level) for r in files.parse_blocks(df).collect()}
    assert rows["d", 0] == ("heading", "Top", 1) and rows["d", 1][0] == "paragraph" and rows["d", 2][0] == "table"
    assert rows["bad", 0][0] == rows["p", 0][0] == "error"
    kinds = df.select("doc", files.sniff_zip("content").alias("k")).collect()
    assert [r.k for r in kinds] == ["docx", "unsupported", "unsupported"]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("年假\r\nx".encode("gbk")),), (bytearray("é\r".encode()),)], "c binary")
    assert [r[0] for r in df.select(files.decode_text("c")).collect()] == ["年假\nx", "é\n"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["paragraph", "heading", "table", "code"]), st.text("ab c。\n.年", min_size=1, max_size=400)), max_size=8))
def test_chunks(blocks):
    out = chunking.chunk_blocks([(k, t, 1) for k, t in blocks], 40, 8)
    assert [t for k, t, _ in out if k in chunking.ATOMIC] == [t for k, t in blocks if k in chunking.ATOMIC]
    assert all(chunking.tokens(t) <= 40 + 8 + chunking.SLACK + 1 for k, t, _ in out if k not in chunking.ATOMIC)


def test_rrf_invariants(spark):
    v = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcdefghij", 1)], "query_id int, chunk string, rank int")
    b = spark.createDataFrame([(1, c, i) for i, c in enumerate("jkbal", 1)], "query_id int, chunk string, rank int")
    rows = sorted(fusion.rrf(v, b).collect(), key=lambda r: r["rank"])
    assert len(rows) == 8 and all(x.score >= y.score for x, y in zip(rows, rows[1:], strict=False))
    assert rows[0].chunk in "abj"


def test_snapshots(spark, tmp_path):
    t = registry.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.current() is None
    new = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, x string, is_valid boolean")
    t.merge(new, ["id"])
    t.merge(spark.createDataFrame([(2, "c", False), (3, "d", True)], "id int, x string, is_valid boolean"), ["id"])
    assert sorted((r.id, r.x) for r in t.current().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    t.compact()
    assert sorted(r.id for r in t.current().collect()) == [1, 3]


def test_golden(spark, tmp_path):
    import json

    def write(cases):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps({"meta": {"case_count": len(cases)}, "cases": cases}))
        return str(p)

    case = {"id": "q1", "query": "q", "expected_doc": "d", "anchor": "long anchor"}
    assert evaluation.read_golden(spark, write([case])).first()["type"] == "semantic"
    for bad in ([], [case, case], [case | {"anchor": "ab c"}], [{k: v for k, v in case.items() if k != "query"}]):
        with pytest.raises(ValueError):
            evaluation.read_golden(spark, write(bad))


def test_route(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 0, 0.9), (2, 0, 0.9), (2, 1, 0.9), (2, 2, 0.9)], "n int, old int, c double")
    v = conversation.verify(F.col("n"), F.col("old"), F.col("c"))
    rows = df.select(v["confidence"].alias("c"), v["degraded"].alias("d"), conversation.route(v["grounded"], v["confidence"], F.lit(2)).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(0.0, False, "disclose"), (0.9, False, "ok"), (0.5, False, "disclose"), (0.9, True, "ok")]


def test_golden_turns(spark, tmp_path):
    import json

    case = {"id": "m1", "category": "anaphora", "turns": ["a", "b"], "expected_doc": "d", "anchor": "long anchor"}

    def write(cases):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps({"cases": cases}))
        return str(p)

    assert evaluation.read_golden_turns(spark, write([case])).first()["turns"] == ["a", "b"]
    for bad in ([], [case, case], [case | {"turns": ["a"]}], [case | {"anchor": "x"}]):
        with pytest.raises(ValueError):
            evaluation.read_golden_turns(spark, write(bad))


def test_adapters(spark):
    from tessera.operators import vector
    from tessera.sources import transcription

    texts = spark.createDataFrame([(i, f"t{i}") for i in range(25)] + [(99, None)], "chunk long, content string")
    got = {r.chunk: r.embedding for r in vector.embed(texts, lambda some: [[float(len(t)), float(len(some))] for t in some]).collect()}
    assert len(got) == 26 and got[99][0] == 0.0 and got[12][0] == 3.0 and max(v[1] for v in got.values()) <= 10
    images = spark.createDataFrame([("d", 1, "a", bytearray(b"xx")), ("d", 2, "b", bytearray(b""))], "doc string, page int, ref string, image binary")
    said = transcription.transcribe(images, lambda some: [x.decode() or None for x in some]).collect()
    assert [(r.ref, r.text) for r in said] == [("a", "xx")]
    assert transcription.transcribe(images).count() == 0


def test_red_page_keeps_its_transcript(spark):
    from tessera.sources import transcription

    blocks = spark.createDataFrame([("d", 1, 0, "raw", "red"), ("d", 2, 0, "kept", "green")], "doc string, page int, seq int, text string, level string")
    pages = spark.createDataFrame([("d", 1, "read")], "doc string, page int, text string")
    inline = spark.createDataFrame([("d", 2, 9, "r", "image")], "doc string, page int, pos int, ref string, text string")
    rows = sorted(transcription.merge_transcripts(blocks, pages, inline).collect(), key=lambda r: r.seq)
    assert [r.text for r in rows] == ["read", "kept", "image"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5) | st.integers(-1000, 1000) | st.none()), min_size=1, max_size=60))
def test_latency_places(spark, rows):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95, r["max"]) for r in evaluation.latency(df, "v", "k").collect()}
    want = {}
    for k in "ab":
        if s := sorted(float(v) for x, v in rows if x == k and v is not None):
            want[k] = (len(s), s[len(s) // 2], s[-(-len(s) * 95 // 100) - 1], s[-1])
    assert got == want
    whole = sorted(float(v) for _, v in rows if v is not None)
    assert [(r.n, r.p50) for r in evaluation.latency(df, "v").collect()] == ([(len(whole), whole[len(whole) // 2])] if whole else [])


def test_date_of_a_key_is_its_first_match(spark):
    from tessera.operators import ingest

    keys = ["dir/file7_2027-05-01.v1.md", "dir/file2000_2020-05-01.v1.md", "dir/file12034_2004-05-01.v1.md", "dir/file120201_2021-05-01.v1.md", "dir/none.md"]
    docs = spark.createDataFrame([("t0", k, "md") for k in keys], "tenant_id string, doc_key string, format string")
    got = {r.doc_key: (r.doc_date, r.doc_year) for r in ingest.doc_meta(docs).collect()}
    assert [got[k] for k in keys] == [("2027-05-01", 2027), ("2000-20-20", 2000), ("2034-20-04", 2034), ("2020", 2020), (None, None)]
