"""Operators of the llm subpackage against brute force, round trips and held-out labels, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontamination, language_id, line_dedup, minmax_dedup, packing, suffix_dedup, token_counts, token_files, toxicity
from tessera.llm.common import keyed_rows, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n "), (4, "one two"), (5, "a b c d e f g\n" * 9), (5, "a b c d e f g\n" * 9), (6, LONG), (7, "x" * 3000), (8, "żółć ünïcode ☃ 123"), (9, "<|endoftext|> a|b  c"), (None, "no id here but words enough")]


def odd(spark):
    rows = [(i, t, None, None, None) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"n_tokens": F.lit("clash"), "_salt": F.lit(1), "span": F.lit(2), "rank": F.lit(3)})


def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def odd_texts():
    """Every letter before every stop and line feed, and random mixtures of characters that normalize, join or separate."""
    letters = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x30000, 37)] if chr(c).isalpha()]
    marks = [c + s for c in letters for s in (".", ",", ";", ":", "!", "?", "%%", "'s", "\nb")]
    texts = ["a " + " ".join(marks[i : i + 600]) for i in range(0, len(marks), 600)]
    pick = random.Random(7)
    some = ["a", "b", "é", "İ", "क़", "Σ", "e\u0301", "\u0301", "中", "½", "'", "'s", " ", " ", "  ", "\n", "\n", "\t", "\u00a0", "\x1c", ".", "!", "...", "|", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "%%", "😀", "K"]
    return texts + ["".join(pick.choice(some) for _ in range(pick.randint(0, 30))) for _ in range(4000)]


def test_encoder_equals_library(tok):
    from tessera.llm.tokenization import WordCacheEncoder, vocabulary_path

    texts = odd_texts()
    for name, separator in (("word_bpe_49k.json", " |"), ("byte_bpe_50k.json", "\n")):
        want = [e.ids for e in tok[name].encode_batch(texts, add_special_tokens=False)]
        for words in (200_000, 500):  # the second is emptied over and over
            got = WordCacheEncoder(vocabulary_path(name), separator, words).encode_all(texts)
            assert all(g.tolist() == w for g, w in zip(got, want, strict=True))


def rows_of(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_token_counts(spark, sf_dir, tok):
    t = tok["byte_bpe_50k.json"]
    want = sorted((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows_of(spark, sf_dir))
    assert sorted(tuple(r)[:3] for r in token_counts.op3_token_counts(spark, sf_dir).collect()) == want
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd(spark)).collect()}
    assert got == {(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ODD}
    assert token_counts.count_tokens(none(spark)).count() == 0


def test_token_files(spark, sf_dir, tok):
    t = tok["word_bpe_49k.json"]

    def want(docs):
        out, at = [], 0
        for i, x in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
            ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
            out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        return out

    got = token_files.op4_token_files(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == want(rows_of(spark, sf_dir))
    folder = shared_dir(spark)
    made = token_files.write_token_files(odd(spark), folder)
    assert sorted(map(tuple, token_files.read_token_files(made, folder).collect()), key=lambda r: r[1]) == want(ODD)
    empty = shared_dir(spark)
    assert token_files.read_token_files(token_files.write_token_files(none(spark), empty), empty).count() == 0
    path = made.first()["path"]
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="broken record"):
        token_files.read_token_files(made, folder).collect()


def check_packing(rows, cap):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= cap
    return bins


def test_packing(spark, sf_dir, tok):
    t = tok["byte_bpe_50k.json"]
    want = set()
    for i, x in rows_of(spark, sf_dir):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = packing.op7_best_fit_packing(spark, sf_dir).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    bins = check_packing(got, 2048)
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1
    few = packing.pack(odd(spark), max_tokens=512, max_docs=2, max_cost=300_000).collect()
    for v in check_packing(few, 512).values():
        assert len(v) <= 2 and sum(n * n for _, n in v) <= 300_000
    assert packing.pack(none(spark)).count() == 0


def test_plan_rules():
    random.seed(1)
    counts = {n: random.randint(1, 50) for n in random.sample(range(1, 90), 40)}
    for rule in ("norm", "dot"):
        plan = packing.plan_bins(counts, 100, 5, 8000, rule)
        bins = defaultdict(list)
        for length, a, b, first, offset in plan:
            for r in range(a, b):
                bins[first + r - a].append((offset, length))
        assert sum(map(len, bins.values())) == sum(counts.values())
        assert all(sum(n for _, n in v) <= 100 and len(v) <= 5 and sum(n * n for _, n in v) <= 8000 or len(v) == 1 for v in bins.values())


def test_suffix_dedup(spark, monkeypatch):
    def brute(docs, size=100):
        seen, out = set(), []
        for i, t in docs:
            b = (t or "").encode()
            cover = np.zeros(len(b) + 1, int)
            for s in range(len(b) - size + 1):
                if b[s : s + size] in seen:
                    cover[s] += 1
                    cover[s + size] -= 1
                seen.add(b[s : s + size])
            gone = np.cumsum(cover)[: len(b)] > 0
            out.append((i, len(b), int(gone.sum()), int((np.diff([0, *gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        return sorted(out)

    random.seed(3)
    base = ["".join(random.choice("ab cé") for _ in range(random.choice((50, 150, 400)))) for _ in range(20)]
    docs = [(i, "".join(random.choice(base) for _ in range(random.randint(0, 6)))) for i in range(40)] + [(100, "a" * 2000), (101, "ab" * 900), (102, ""), (103, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("span", F.lit(1))
    assert sorted(tuple(r)[:5] for r in suffix_dedup.remove_copies(df).collect()) == brute(docs)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert sorted(map(tuple, suffix_dedup.remove_copies(df, False).collect())) == brute(docs)
    rows = suffix_dedup.remove_copies(odd(spark), False).collect()
    assert len(rows) == len(ODD)
    assert suffix_dedup.remove_copies(none(spark)).count() == 0


def test_lpf():
    text = b"abracadabra" * 3
    grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 5)
    order = np.random.default_rng(0).permutation(len(grams))
    want = [max((next((k for k in range(5) if grams[i][k] != grams[j][k]), 5) for j in range(i)), default=0) for i in range(len(grams))]
    got = suffix_dedup.longest_previous_factors(grams[order], order)
    assert [int(got[list(order).index(i)]) for i in range(len(grams))] == want


def brute_components(docs, k, num=80, den=100):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def test_near_duplicates(spark, sf_dir):
    random.seed(5)
    words = ["w%d" % i for i in range(3000)]
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(5, 80)))) for i in range(60)]
    hub = [random.choice(words) for _ in range(120)]

    def edited(n):
        out = list(hub)
        for _ in range(n):
            out[random.randrange(len(out))] = random.choice(words)
        return " ".join(out)

    docs += [(100 + i, edited(random.randint(0, 4))) for i in range(60)] + [(500, " ".join(hub).upper()), (501, None), (502, ""), (503, "solo"), (504, "Solo"), (505, "a b c d"), (506, " \t")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(1))
    assert sorted(map(tuple, minmax_dedup.near_duplicates(df).collect())) == brute_components(docs, 4)
    assert sorted(map(tuple, minmax_dedup.op9_minmax_near_dedup(spark, sf_dir).collect())) == brute_components(rows_of(spark, sf_dir), 4)
    rows = minmax_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert minmax_dedup.near_duplicates(none(spark)).count() == 0


def test_residual_blocks(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(minmax_dedup, "SALT_MEMBERS", 4)
    test_near_duplicates(spark, "/root/testdata/sf0.001")


def test_line_dedup(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, line_dedup.op6_line_dedup(spark, sf_dir).collect())) == sorted(con.sql(line_dedup.OP6_SQL).fetchall())
    same = "This line is in many documents"
    docs = [(i, f"{same.upper()}  \nown {i}\n\t{same}") for i in range(7)] + [(7, None), (None, same), (9, "\n".join([same] * 3000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == ("own 0", 2) and got[9][1] == 0 and got[None] == (same, 0) and got[7] == ("", 0)
    assert line_dedup.dedup_lines(odd(spark)).count() == len(ODD) and line_dedup.dedup_lines(none(spark)).count() == 0


def test_decontamination(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.sql(decontamination.OP10_SQL).fetchall())
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == want
    assert sorted(map(tuple, decontamination.contamination(docs, bench, chunk_bytes=3000).collect())) == want
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "three"), (4, "Lorem")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.contamination(odd(spark), items).collect()}
    assert got[4] == (2, 1) and got[6] == (20_000, 1) and got[1] == (0, 0)
    assert decontamination.contamination(none(spark), items).count() == 0 and decontamination.contamination(odd(spark), items.limit(0)).count() == len(ODD)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.op5_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.98
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    model = language_id.fit(docs.filter(language_id.fold("doc_id", 3) != 1))
    out = language_id.predict(odd(spark), model).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.predict(odd(spark), language_id.fit(none(spark))).collect()} == {"und"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    y, p = np.array([truth[r.doc_id] for r in held]), np.array([r.predicted for r in held])
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.03
    counts = toxicity.count_trigrams(docs)
    scorer = toxicity.learn(docs, labels)
    hidden = ["1d10t", "l o s e r", "stuuuupid", "m.o.r.o.n", "d1sgu$t1ng", "tr@sh", "1d10t" + "!" * 100, "stu" + "u" * 300 + "p1d", "x" * 30 + "/" + "y3" * 30 + "/1d10t"]
    df = spark.createDataFrame([(i, f"Thation ouder the {w} and onrent") for i, w in enumerate(hidden)] + [(99, "the call at 3.14 in B2B covid19")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(df, scorer, counts).collect()}
    assert all(got[i] > 0.5 for i in range(len(hidden))) and got[99] < 0.5
    assert toxicity.score_texts(odd(spark), scorer, counts).count() == len(ODD)
    blank = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(odd(spark), blank, counts).collect()} == {0.0}
    assert not toxicity.count_trigrams(none(spark)).any()


def test_restoring_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    r = toxicity.Restorer(rng.integers(0, 60, (28, 28, 28)).astype(float))

    def cost(word, noise):
        path = [0, 0, *(toxicity.LETTERS.find(c) + 1 or toxicity.OTHER for c in word), 0]
        return noise + sum(r.cost[a, b, c] for a, b, c in zip(path, path[1:], path[2:], strict=False))

    for token in ("1d10t", "m.o.r0n", "aaab!", "l|5$", "ö0k", "7e57", "b-4-d", "x1!1x"):
        ways = [r._options(c, b) for b, c in zip(" " + token, token, strict=False)]
        all_paths: dict[str, float] = {}
        for path in itertools.product(*ways):
            word = "".join(x for x, _ in path)
            if word:
                all_paths[word] = min(all_paths.get(word, np.inf), cost(word, sum(n for _, n in path)))
        best = sorted(all_paths.items(), key=lambda x: (x[1], x[0]))
        got = r._restore(token)
        assert abs(all_paths[got[0]] - best[0][1]) < 1e-9
        assert abs(all_paths[got[-1]] - best[len(got) - 1][1]) < 1e-9


def test_readings_cover_long_tokens():
    token = "".join(random.Random(3).choice(("a1", "b2", "c3")) for _ in range(250))
    pieces = toxicity.readings(token)
    assert max(map(len, pieces)) <= toxicity.LONGEST
    assert all(any(token[i : i + 20] in p for p in pieces) for i in range(480))
    words = ["abcdefghij", "abcdefghik"]  # alike in their first eight bytes
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    row, _, word, at = toxicity.features(raw, np.array([0, len(raw)]))
    assert len(set(word.tolist())) == 2


def test_samples_survive_scale(spark):
    shares = language_id.sample_shares([("a", 25 * 10**12, 10**10), ("b", 10**15, 3), ("c", 1000, 10), ("d", None, 5)], language_id.TRAIN_BYTES)
    assert shares["b"] == shares["c"] == shares["d"] == 1.0 and 0 < shares["a"] < 1e-6
    from tessera.llm.common import below

    ids = spark.range(10**8)
    assert 3 <= ids.filter(below("id", toxicity.TRAIN_ROWS / 1e11)).count() <= 50
    assert 0 < ids.filter(below("id", 25 * shares["a"])).count() < 1000
    assert ids.filter(~below("id", 1.0)).isEmpty()


def test_code_lengths_against_plain_ppm():
    import math

    rng = random.Random(8)
    texts = {"x": "".join(rng.choice("abcd ") for _ in range(400)), "y": "".join(rng.choice("abé \n") for _ in range(300))}
    trained: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for name, t in texts.items():
        raw = b"\n" * 3 + t.encode()
        for i in range(len(raw) - 3):
            trained[int.from_bytes(raw[i : i + 4], "big")][name] += 1
    grams = sorted(trained)
    model = language_id.PPM(["x", "y"], np.array(grams), np.array([[trained[g][n] for n in "xy"] for g in grams], float))

    def plain(name, text):
        seen = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
        for g in grams:
            if n := trained[g][name]:
                b = g.to_bytes(4, "big")
                for k in range(4):
                    seen[k][b[3 - k : 3]][b[3]] += n
        raw, total = b"\n" * 3 + text.encode(), 0.0
        for i in range(3, len(raw)):
            for k in range(3, -1, -1):
                ctx = seen[k].get(raw[i - k : i])
                if ctx is None:
                    continue
                n, q = sum(ctx.values()), len(ctx)
                if raw[i] in ctx:
                    total -= math.log2(ctx[raw[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            else:
                total += 8
        return total

    asked = ["abcd", "", "é é", "zzz", "aé\n\nb dcba", "".join(rng.choice("abcdé xyz\n") for _ in range(500))]
    raw = [t.encode() for t in asked]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = model.code_lengths(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.allclose(got, [[plain(n, t) for n in "xy"] for t in asked], rtol=1e-4)


CLASHES = ["_doc", "_id", "_text", "_body", "_gone", "_n", "_hash", "_at", "_range", "_base", "_place", "_tie", "_salt", "_rank", "_row", "row", "a", "b", "k", "pos", "gone", "block", "n_dropped", "n_words", "component_id", "kept", "lang_pred", "contaminated", "label", "key", "h", "doc", "span", "length"]


def test_pipeline_keeps_clashing_columns(spark, sf_dir):
    import corpus_pipeline as P

    for repeat in (False, True):
        rows = [(i // (1 + repeat), f"this is the text of document {i} and " + " ".join(f"word{i}x{j}" for j in range(30)), "en", "s", 9) for i in range(12)]
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
        want = sorted(tuple(r[c] for c in ("doc_id", *CLASHES)) for r in docs.collect())
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert sorted(tuple(r[c] for c in ("doc_id", *CLASHES)) for r in out.collect()) == want, name
        assert P.STAGES[-1][1](spark, docs, sf_dir).count() == 12
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines"]
    for op in (minmax_dedup.near_duplicates, token_counts.count_tokens, lambda d: suffix_dedup.remove_copies(d, False)):
        assert op(docs).count() == 12


def recalls(table, found, asked, k=20):
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - (x[ids == r.vec_id] * x[ids == r.query_id][0]).sum(1).max()) < 1e-12
    out = []
    for q in ids[ids % asked == 0]:
        s = (x * x[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        out.append(len(set(got[q]) & set(ids[np.lexsort((ids, -s))[:k]].tolist())) / min(k, len(ids) - 1))
    return out


def test_nearest_in_rounds(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for name, value in (("SAMPLE", 128), ("GROWTH", 4), ("BLOCK", 200), ("QUERY_BLOCK", 40)):  # three rounds, several blocks in each
        monkeypatch.setattr(ann, name, value)
    out = recalls(table, ann.nearest(table, table.filter("vec_id % 20 = 0")), 20)
    assert np.mean(out) >= 0.95 and min(out) >= 0.8


def test_collisions():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16))
    index = ann.CollisionIndex(x)
    queries, radius = x[:30], rng.uniform(1, 6, 30)
    centers = queries * (index.length / np.sqrt((queries**2).sum(1)))[:, None]
    squares = (x**2).sum(1)
    at, half = centers @ index.bases, ann.WINDOW * radius + 1e-9 * index.length
    low = np.array([np.searchsorted(s, a - half, "left") // index.step for s, a in zip(index.sorted, at.T, strict=True)])
    high = np.array([-(-np.searchsorted(s, a + half, "right") // index.step) for s, a in zip(index.sorted, at.T, strict=True)])
    rank = np.argsort(np.argsort(np.hstack([x, np.sqrt(np.maximum(0, squares.max() - squares))[:, None]]) @ ann.directions(17), axis=0, kind="stable"), axis=0)
    planes, need = index.counts(centers, radius), rng.integers(1, index.need + 1, 30)
    for q, rows in enumerate(index.reaching(planes, need)):
        inside = (rank >= low[:, q] * index.step) & (rank < high[:, q] * index.step)
        assert rows.tolist() == np.flatnonzero(inside.sum(1) >= need[q]).tolist()
        assert index.collisions(planes, q, np.arange(700)).tolist() == inside.sum(1).tolist()
    verified = np.mean([len(r) for r in index.widen(centers, 40)])
    assert 40 <= verified <= 400


def test_nearest(spark, sf_dir):
    for sf in (sf_dir, "/root/testdata/sf0.1"):
        out = recalls(spark.read.parquet(f"{sf}/embeddings.parquet"), ann.op8_collision_counting(spark, sf), 20)
        assert np.mean(out) >= 0.95 and min(out) >= 0.8
    same = spark.range(3000).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(1D, 2D, 2D), array(sin(id), cos(id), -0D)) AS embedding")
    got = ann.nearest(same, same.filter("vec_id IN (0, 300)"))
    best = {q: [r.vec_id for r in sorted(got.collect(), key=lambda r: r.rank) if r.query_id == q] for q in (0, 300)}
    assert best == {0: list(range(3, 63, 3)), 300: list(range(0, 60, 3))}  # a third of all rows are equal: the least vec_ids
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 30 + [(2, [1.0, 0.0])] * 30 + [(3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(twice, twice.filter("vec_id = 2").limit(1)).collect()] == [1] * 20
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    assert [(r.rank, r.vec_id, r.score) for r in sorted(ann.nearest(bad, bad.filter("vec_id = 0")).collect(), key=lambda r: r.rank)] == [(1, 5, 5.0), (2, 6, 5.0)]
    assert ann.nearest(bad.limit(0), bad).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
        now = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            kept = {i for i, _, _, ok in brute_components([(r.doc_id, r.text) for r in before.values()], 5) if ok}
            assert set(now) == kept
        elif name == "language_id":
            assert set(before) - set(now) <= {i for i, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontamination.contamination(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.contaminated}
            assert set(now) == set(before) - bad
        before = now
        docs = spark.createDataFrame(list(now.values()), docs.schema)
    pieces = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(before)
    check_packing(pieces, 2048)
    assert sorted({r.doc_id for r in P.run(spark, sf_dir).collect()}) == sorted(before)


def test_keys_of_repeated_ids(spark):
    rows = [(i % 7 if i % 5 else None, f"text {i % 11}" if i % 13 else None, None, None, None) for i in range(300)] + [(1, "same", None, None, None)] * 100
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    got = sorted(keyed_rows(docs).select("_doc", "row.doc_id", "row.text").collect())
    assert [r._doc for r in got] == list(range(len(rows)))
    rank = lambda i, t: (i is not None, i or 0, t is not None, hashlib.sha256((t or "").encode()).hexdigest())
    assert [(r.doc_id, r.text) for r in got] == sorted(((i, t) for i, t, *_ in rows), key=lambda x: rank(*x))


def test_pipeline_odd_tables(spark, sf_dir):
    import corpus_pipeline as P

    for docs in (odd(spark), none(spark)):
        for _, stage in P.STAGES[:-1]:
            names, before = docs.columns, docs.count()
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
            assert docs.columns == names and docs.count() <= before
        kept = [r.text for r in docs.select("text").collect()]
        assert {"one two", "żółć ünïcode ☃ 123", "no id here but words enough"} <= set(kept) or not kept
        assert None not in kept and kept.count("a b c d e f g\n" * 9) <= 1
        pieces = P.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_trimmed_memory_goes_back_to_the_system():
    import re

    from tessera.llm.common import trim_memory

    held_mb = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    trim_memory()
    rows = [bytes(1000) for _ in range(200_000)]
    last = bytes(1000)  # above the rows, so that the heap's end stays in use
    most = held_mb()
    del rows
    trim_memory()
    assert most - held_mb() > 120 and len(last) == 1000
