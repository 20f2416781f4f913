"""Anchors by their rarest run of characters, exact first ranks, and the gate on a stored vocabulary, against plain versions."""

import io
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.text import normalize
from tessera.operators import bm25, evaluation, gate
from tessera.operators.store import Conflict


def test_locate_against_contains(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab 年😀") for _ in range(rnd.randrange(0, 60))) for _ in range(120)] + [None, "", "aaaaaaaaaaaa", "x" * 5000 + "needle in it"]
    anchors = [t[i : i + n] for t in texts if t for i, n in [(rnd.randrange(len(t)), rnd.choice((1, 3, 6, 9, 20)))]] + [None, "", "  ", "nowhere at all", "needle in it"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk int, content string")
    cases = spark.createDataFrame(list(enumerate(anchors)), "case int, anchor string")
    got = sorted(map(tuple, evaluation.locate(cases, chunks).collect()))
    t = [r[0] for r in chunks.orderBy("chunk").select(normalize(F.col("content"))).collect()]
    a = [r[0] for r in cases.orderBy("case").select(normalize(F.col("anchor"))).collect()]
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(t) if x and y and x in y)
    assert got == want and len(want) > 100
    assert evaluation.locate(cases.filter("anchor = ''"), chunks).count() == 0
    assert evaluation.locate(cases, chunks.limit(0)).count() == 0


@pytest.mark.parametrize("words", ["a b c d e f", "a a a a b"])  # a word in over half of the corpus has the mean idf, which may be below 0
def test_first_ranks_against_whole_ranking(spark, words):
    rnd = random.Random(len(words))
    every = words.split()
    rows = [(sig, c, c * 7 % 101, " ".join(rnd.choice(every) for _ in range(rnd.randrange(0, 5)))) for sig in (0, 1) for c in range(60)]
    eligible = spark.createDataFrame(rows, "sig int, chunk int, ord int, content string")
    asked = spark.createDataFrame([(q, q % 2, t) for q, t in enumerate(("a", "b c", "zz", "f f a", "d", "a b e"))], "query_id int, sig int, question string")
    expected = spark.createDataFrame([(q, rnd.randrange(60)) for q in range(5) for _ in range(3)] + [(5, 999), (9, 1)], "query_id int, chunk int")
    ranks = bm25.search(eligible, asked, 1 << 30)
    want = {r[0]: r[1] for r in expected.join(ranks, ["query_id", "chunk"]).groupBy("query_id").agg(F.min("rank")).collect()}
    assert {r.query_id: r["rank"] for r in bm25.first_ranks(eligible, asked, expected).collect()} == want and len(want) == 5


def test_stored_vocabulary_against_texts(spark, tmp_path):
    texts = ["annual leave days", "travel costs and leave", "parental leave is paid", None, "", "xylophone quota", "café leave leave", "Paid xylograph"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk int, content string").withColumn("content", F.coalesce("content", F.lit("")))
    asked = spark.createDataFrame([(1, "xylophone leave"), (2, "paidle quota"), (3, "zzqx wwvk"), (4, ""), (5, "the and"), (6, "trav xylog café nnual")], "query_id int, question string")
    index = bm25.PostingsIndex(spark, f"file://{tmp_path}/postings")
    rows = lambda df: sorted((r.query_id, r.coverage, r.absent) for r in df.collect())

    def holds(live):
        got = rows(gate.coverage(asked, live, index=index))
        assert got == rows(gate.coverage(asked, live, fallback=True))
        return got

    index.commit(chunks.filter("chunk < 5"))
    holds(chunks.filter("chunk < 5"))
    index.commit(chunks.filter("chunk >= 5"))
    before = holds(chunks)
    index.commit(chunks.limit(0), chunks.filter("chunk IN (5, 7)").select("chunk"))  # the pairs of their words go with them
    assert holds(chunks.filter("chunk NOT IN (5, 7)")) != before
    changed = chunks.filter("chunk = 0").withColumn("content", F.lit("xylophone"))
    index.commit(changed)
    holds(chunks.filter("chunk NOT IN (0, 5, 7)").unionByName(changed))
    index.sync(chunks.filter("chunk <> 0").unionByName(changed))
    holds(chunks.filter("chunk <> 0").unionByName(changed))
    index.rebuild(chunks)
    assert holds(chunks) == before and len(index.manifest()) == 1


def test_one_commit_over_tables(spark, tmp_path):
    where, src = f"file://{tmp_path}/store", tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("first rule about leave")
    one, two = Engine(spark, where), Engine(spark, where)
    rows = lambda e: e.collect([f"file://{src}"], "t0")[0]
    one.ingest(rows(one), 100)
    assert one.store.numbers() == [1] and set(one.store.state()[1]) == {"chunks", "registry", "postings", "vocabulary"}
    seen = lambda e: (sorted(r.content for r in e.table().filter("is_valid").collect()), e.documents("t0")[1], e.index.lengths().count())
    old = seen(one)
    (src / "b.txt").write_text("second rule about travel")
    # a writer that dies after any of its writes leaves all tables as they were
    for place, name in ((one.chunks, "commit"), (one.registry, "commit"), (one.index, "sync"), (one.store, "_claim")):
        whole = getattr(place, name)

        def dies(*a, _whole=whole, _last=name == "_claim", **k):
            if not _last:
                _whole(*a, **k)
            raise OSError("killed")

        setattr(place, name, dies)
        with pytest.raises(OSError):
            one.ingest(rows(one), 200)
        setattr(place, name, whole)
        assert one.store.numbers() == [1] and seen(one) == seen(two) == old
    # two writers from one state: the second fails and changes nothing
    build = one.build_vocabulary
    one.build_vocabulary = lambda chunks: (two.ingest(rows(two), 300), build(chunks))
    with pytest.raises(Conflict):
        one.ingest(rows(one), 300)
    one.build_vocabulary = build
    assert one.store.numbers() == [1, 2] and seen(one) == seen(two) and one.documents("t0")[1] == 2
    # changes to different tables don't meet
    with one.store.transaction():
        one.store.set("left", "x")
        two.store.set("right", "y")
    assert one.store.state()[1].items() >= {"left": "x", "right": "y"}.items()
    doc = one.registry.current().filter("doc_key LIKE '%a.txt'").select("tenant_id", "doc_id")
    one.delete(doc, 400)
    snapshots = lambda: {p.name for p in (tmp_path / "store" / "chunks").iterdir() if p.name.startswith("snapshot")}
    assert one.count() == 1 and one.table().count() == 2
    one.maintain(keep=1)  # half of the chunks aren't valid
    assert one.table().count() == 1 and one.store.numbers()[0] > 4 and len(one.store.numbers()) == 1
    assert one.chunks.snapshot() in snapshots() and one.index.lengths().count() == 1 and seen(two) == seen(one)


def picture_file(paragraphs, media, rels=None):
    """A word-processing file of (text, ids of pictures) and its pictures by id."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r>" + "".join(f'<w:r><w:drawing><a:blip r:embed="{i}"/></w:drawing></w:r>' for i in ids) + "</w:p>" for t, ids in paragraphs)
    links = "".join(f'<Relationship Id="{i}" Target="media/{i}.png"/>' for i in (media if rels is None else rels))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, image in media.items():
            z.writestr(f"word/media/{i}.png", image)
    return raw.getvalue()


def test_pictures_are_read_once(spark, tmp_path):
    src, calls = tmp_path / "in", tmp_path / "calls"
    src.mkdir()
    calls.mkdir()

    def read(images):
        for image in images:
            (calls / uuid.uuid4().hex).write_bytes(image)
        return [None if b"blank" in x else f"it says {x.decode()}" for x in images]

    seen = lambda: sorted(p.read_bytes() for p in calls.iterdir())
    (src / "a.docx").write_bytes(picture_file([("before", ["one", "two"]), ("between", []), ("", ["blank"]), ("after", ["gone"])], {"one": b"fire exits", "two": b"stairs", "blank": b"blank"}, ["one", "two", "blank", "gone"]))
    (src / "b.docx").write_bytes(picture_file([("other", ["one"])], {"one": b"fire exits"}))
    (src / "c.docx").write_bytes(b"no archive")
    engine = Engine(spark, f"file://{tmp_path}/store", transcriber=read)
    report = engine.ingest(engine.collect([f"file://{src}"], "t0")[0], 100)
    assert {r.doc_key.rsplit("/", 1)[-1]: r.status for r in report.collect()} == {"a.docx": "done", "b.docx": "done", "c.docx": "failed"}
    texts = {r.doc_title: r.content for r in engine.table().collect()}
    assert texts["a"].split() == "before it says fire exits it says stairs between after".split() and "it says fire exits" in texts["b"]
    assert seen() == [b"blank", b"fire exits", b"stairs"]  # each different picture once
    (src / "a.docx").write_bytes(picture_file([("new version", ["one", "new"])], {"one": b"fire exits", "new": b"lifts"}))
    engine.ingest(engine.collect([f"file://{src}/a.docx"], "t0")[0], 200)
    assert seen() == [b"blank", b"fire exits", b"lifts", b"stairs"]
    assert any("it says lifts" in r.content and "it says fire exits" in r.content for r in engine.table().filter("is_valid").collect())
    bare = Engine(spark, f"file://{tmp_path}/bare")
    bare.ingest(bare.collect([f"file://{src}/b.docx"], "t0")[0], 100)
    assert "[图片]" in bare.table().first().content
