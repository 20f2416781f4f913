"""Operators 11 to 13 against brute force, nearest neighbours of any lengths, and their defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import LONG, ODD, brute_components, none, odd, recalls, rows_of

from tessera.llm import ann, jaccard_join, ranked_search, spelling_variants


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, every=199):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = sorted(w for w in n if len(w) >= 6 and n[w] >= 5)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in words)


def variant_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_spelling_variants(spark, sf_dir, monkeypatch):
    rng = random.Random(4)
    base = ["spelling", "variant", "größere", "aabbcc", "ÀÉîöÿ×x"]
    texts = [(i, " ".join(rng.choice(base) for _ in range(60))) for i in range(10)]
    for i in range(200):
        w = rng.choice(base)
        at = rng.randrange(len(w))
        w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "z" + w[at + 1 :], w.upper()])
        texts.append((1000 + i, "|".join([w] * rng.randint(1, 7))))
    texts += [(9000, "y" * 5000 + " "), (9001, ("y" * 5000 + "\n") * 4 + "y" * 4999), (9002, ("y" * 4999 + "-") * 4)] + ODD[:4]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("clash"), "id": F.lit(0)})
    assert variant_rows(spelling_variants.variants(df)) == brute_variants(texts)
    monkeypatch.setattr(spelling_variants, "SLICE_BYTES", 64)
    assert [b"".join(spelling_variants.pieces(x, 64)) for x in (b"ab cd " * 99, b"a" * 500, b"")] == [b"ab cd " * 99, b"a" * 500, b""]
    assert all(not re.search(rb"[a-z]$", p) or not re.match(rb"[a-z]", q) for p, q in zip(*(lambda x: (x, x[1:]))(list(spelling_variants.pieces(b"word " * 99, 64))), strict=False))
    docs = rows_of(spark, sf_dir)
    assert variant_rows(spelling_variants.op11_spelling_variants(spark, sf_dir)) == brute_variants(docs)
    assert variant_rows(spelling_variants.variants(odd(spark))) == brute_variants(ODD)
    assert spelling_variants.variants(none(spark)).count() == 0


def test_long_chains_have_one_root(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "id long, root long")
    assert {(r.id, r.root) for r in spelling_variants.roots(chain).collect()} == {(i, 40) for i in range(40)}


def crafted():
    random.seed(8)
    words = ["w%d" % i for i in range(4000)]
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(1, 90)))) for i in range(60)]
    shared = " ".join(random.choice(words) for _ in range(50))
    docs += [(200 + i, " ".join(random.choice(words) for _ in range(40)) + " " + shared) for i in range(20)]
    for g in range(6):
        hub = [random.choice(words) for _ in range(random.randint(20, 200))]
        for i in range(25):
            out = list(hub)
            for _ in range(random.randint(0, max(1, len(hub) // 16))):
                out[random.randrange(len(out))] = random.choice(words)
            docs.append((1000 + 100 * g + i, " ".join(out[: len(out) - random.randint(0, 4)])))
    return [*docs, (5000, None), (5001, ""), (5002, "solo"), (5003, "Solo"), (5004, "a b c d"), (5005, " \t"), (5006, "a b c"), (5007, LONG), (5008, LONG + "more words at the end")]


def component_rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, sf_dir, monkeypatch, small):
    if small:  # few centers, so that blocks do the work; many parts, blocks and ranges
        for name, value in (("CENTERS", 1), ("PART_MEMBERS", 4), ("BLOCK_MEMBERS", 4), ("RANGE_POSTINGS", 200)):
            monkeypatch.setattr(jaccard_join, name, value)
    docs = crafted()
    want = [x[:3] for x in brute_components(docs, 4, 85)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"label": F.lit(1), "keys": F.lit("x"), "meeting": F.lit(0)})
    assert component_rows(jaccard_join.components(df)) == want
    assert len({x[2] for x in want}) < len(want)
    if not small:
        assert component_rows(jaccard_join.op12_jaccard_join(spark, sf_dir)) == [x[:3] for x in brute_components(rows_of(spark, sf_dir), 4, 85)]
        rows = jaccard_join.components(odd(spark)).collect()
        assert len(rows) == len(ODD) and [r.component_id for r in rows if r.doc_id is None] == [None]
        assert jaccard_join.components(none(spark)).count() == 0


def test_jaccard_join_moves_sets_once_for_each_use(spark):
    rng = random.Random(5)
    docs = []
    for i in range(600):
        words = ["%07x" % rng.getrandbits(28) for _ in range(400)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:396], "end", str(i)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        before = shuffled()
        assert component_rows(jaccard_join.components(df)) == [(i, 397 if i % 2 == 0 else 395, i - i % 2) for i in range(1200)]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert shuffled() - before < 5 * sum(len(text) for _, text in docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    names = {t.name for t in spark.catalog.listTables()}
    assert not [n for n in names if n.startswith("tessera_")]


def test_occurrence_index_finds_what_counting_finds():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    hub = rng.permutation(400)[:120]
    sets = []
    for _ in range(60):
        some = np.where(rng.random(120) < rng.uniform(0, 0.15), rng.integers(0, 400, 120), hub)
        sets.append(np.unique(pool[np.unique(some)]))
    for q in range(60):
        index = jaccard_join.OccurrenceIndex(list(range(60)), list(range(60)), sets, (85, 100))
        found = set(index.link(-1, sets[q]))
        both = [len(np.intersect1d(sets[q], s)) for s in sets]
        assert found == {i for i, s in enumerate(sets) if 100 * both[i] >= 85 * (len(s) + len(sets[q]) - both[i])}


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            size = sum(c.values())
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // length))) for t in terms(text) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def hits(df):
    return sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect())


def test_ranked_search(spark, sf_dir, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert hits(ranked_search.op13_windowed_search(spark, sf_dir)) == brute_search(rows_of(spark, sf_dir), items)
    rng = random.Random(6)
    docs = [(d, " ".join(rng.choice(["aa", "bb", "cc", "Dd", "żółć", "x1", "same same"]) for _ in range(rng.randint(0, 30)))) for d in [*range(-40, 40), 7, 7, 10**15, -(10**15)]] + ODD
    asked = [(1, "aa aa bb"), (2, "ŻÓŁĆ żółć dd"), (3, None), (4, ""), (5, "nowhere"), (6, LONG), (7, "same"), (7, "same"), (8, "id but words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"window": F.lit(1), "item_id": F.lit("x"), "terms": F.lit(0)})
    table = spark.createDataFrame(asked, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_search(docs, sorted(set(asked), key=str))
    assert hits(ranked_search.search(df, table)) == want
    for name, value in (("WINDOW", 8), ("CHUNK_TERMS", 4)):  # several windows, tasks of a window, and chunks of items
        monkeypatch.setattr(ranked_search, name, value)
    assert hits(ranked_search.search(df, table)) == want
    assert hits(ranked_search.search(none(spark), table)) == [] == hits(ranked_search.search(df, table.limit(0)))


@pytest.mark.parametrize("name", ["x3", "x10", "x30", "x1000", "clusters", "mixed"])
def test_nearest_of_any_lengths(spark, name):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    if name[0] == "x":
        x[7] *= int(name[1:])
    elif name == "clusters":
        x = np.repeat(rng.standard_normal((20, 64)), 100, 0) + 0.02 * x
    else:
        x *= np.exp(3 * rng.standard_normal((2000, 1)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({"band": F.lit("clash"), "class": F.lit(1), "score": F.lit(2)})
    found = ann.nearest(table, table.filter("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score")
    assert set(r["count"] for r in found.groupBy("query_id").count().collect()) == {20}
    out = []
    got = defaultdict(list)
    for r in found.collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        out.append(len(set(got[q]) & set(np.lexsort((np.arange(2000), -s))[:20].tolist())) / 20)
    assert np.mean(out) >= 0.95 and min(out) >= 0.8


def test_nearest_beyond_the_doubles(spark):
    x = np.random.default_rng(2).standard_normal((60, 4))
    x[3], x[5] = [1e200, 0, 0, 0], [1e-200, 2e-200, 0, 0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert np.mean(recalls(table, ann.nearest(table, table.filter("vec_id % 2 = 0")), 2)) >= 0.99
    great = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [2e200, 0.0]), (4, [1e200, -1e200]), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = sorted(ann.nearest(great, great.filter("vec_id = 1")).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in rows] == [2, 3, 5, 4] and [r.score for r in rows[:3]] == [math.inf, math.inf, 2e200] and math.isnan(rows[3].score)
