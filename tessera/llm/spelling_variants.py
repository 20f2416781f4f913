"""Operator 11, spelling variants by a symmetric-delete join.

Words: tasks count the runs of letters of whole texts (a bounded table of counts, given out when full) and sums meet in one shuffle. In a share of places, told by the crc32 of document and run,
a run loses one code point first.

Join: every word emits itself and its single deletions, as 64-bit hashes from prefix sums, so that a word of any length costs rows in proportion to it, not to its square.
Words at distance one share a key in one of two ways, each an equi-join: the shorter word is a deletion of the longer one (distinct deletions, one for each run of equal code points; a key is
one word there), or both lose the code point at one place and leave the same (a key of deletion and place, shared by one word for each letter of the alphabet at most, so
no key is hot and every candidate is a link but for collisions of hashes). A pair shares one such key; candidates are verified by the exact edit distance of the words themselves.

Forms: each word's near words are counted and the most frequent found in one aggregation. Roots: forms are followed by pointer jumping; counts grow five times at each step, so
there are no cycles and rounds grow with the logarithm of the logarithm of the largest count. Every round is written to the shared folder.

Defined cases: null and empty texts have no runs; very long texts are read in pieces that end between runs, runs of any length are whole words; a null doc_id reads as an empty one;
repeated rows count again; ties for a form go to the smallest word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, SpanHasher, doc_text, materialize, mix64, release_caches, slices, string_buffers

LETTERS, OCCURRENCES, TIMES, EVERY, HELD_WORDS = 6, 5, 5, 199, 200_000
SELF, DELETION, PLACE = 0, 1, 2
#: UTF-8 of A-Z lower-cased, a-z and U+00C0 to U+00FF, whose first byte no other code point has.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xbf\xc3]")


def pieces(text: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `limit` bytes that end where no run goes on."""
    at = 0
    while len(text) - at > limit:
        border = NO_LETTER.search(text, at + limit)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def count_words(docs: DataFrame, letters: int = LETTERS, every: int = EVERY) -> DataFrame:
    """word, n for the words of at least `letters` code points."""
    run = re.compile(LETTER + rb"{%d,}" % letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for r, doc in enumerate(batch.column(0).to_pylist()):
                start = crc32(b":" if doc is None else b"%d:" % doc)
                for piece in pieces(data[off[r] : off[r + 1]].tobytes()):
                    for word, n in Counter(run.findall(piece.lower())).items():
                        h = crc32(word, start)
                        if h % every == 0:
                            s = word.decode()
                            at = h % len(s)
                            word = (s[:at] + s[at + 1 :]).encode()
                        held[word] += n
                    if len(held) > HELD_WORDS:
                        yield given()
        if held:
            yield given()

    counts = doc_text(docs).mapInArrow(count, "word string, n long")
    return counts.filter(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: DataFrame) -> DataFrame:
    """id, kind, key: each word itself (SELF), its distinct single deletions (DELETION), and its deletion at every place (PLACE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(13)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
                pre = hasher.prefix(part)
                begin = np.flatnonzero((part & 0xC0) != 0x80)
                end = np.append(begin[1:], len(part))
                row = np.searchsorted(own, begin, "right") - 1
                low, high = own[row], own[row + 1]
                gone = end - begin
                rest = ((pre[begin] - pre[low]) + (pre[high] - pre[end]) * hasher.inv[gone]) * hasher.inv[low]
                rest = mix64(rest + (high - low - gone).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                code = part[begin].astype(np.int64)
                for k in range(1, 4):
                    code = code << 8 | np.where(begin + k < end, part[np.minimum(begin + k, len(part) - 1)], 0)
                again = np.zeros(len(begin), bool)
                again[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
                first = np.searchsorted(begin, own[:-1])
                place = mix64(rest + (np.arange(len(begin)) - first[row] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                whole = hasher.spans(pre, own[:-1], own[1:])
                for kind, who, key in ((SELF, np.arange(j - i), whole), (DELETION, row[~again], rest[~again]), (PLACE, row, place)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][who]), pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64))], ["id", "kind", "key"])

    return words.select("id", "word").mapInArrow(run, "id long, kind tinyint, key long")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs a, b (ids, each pair once) of words (id, word, n) at distance one, with both words and counts."""
    keys = materialize(deletion_keys(words))
    one = keys.filter(F.col("kind") == SELF).select("key", F.col("id").alias("a"))
    longer = keys.filter(F.col("kind") == DELETION).select("key", F.col("id").alias("b"))
    left, right = (keys.filter(F.col("kind") == PLACE).select("key", F.col("id").alias(x)) for x in "ab")
    pairs = one.join(longer, "key").select("a", "b").unionByName(left.join(right, "key").filter("a < b").select("a", "b"))
    a, b = (words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").filter(F.levenshtein("a_word", "b_word", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """id, root for forms (id, root: the next form): the last form reached."""
    now = materialize(forms)
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("_far"))
        new = materialize(now.join(onward, "root", "left").select("id", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")))
        now = new.select("id", "root")
        if new.filter("_moved").isEmpty():
            return now


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents with at least so many letters and occurrences."""
    words = materialize(count_words(docs, letters, every).filter(F.col("n") >= occurrences).withColumn("id", F.monotonically_increasing_id()))
    pairs = materialize(near_words(words))
    both = [pairs.select(F.col(x).alias("id"), F.struct((-F.col(f"{y}_n")).alias("n"), F.col(f"{y}_word").alias("word"), F.col(y).alias("id")).alias("other")) for x, y in ("ab", "ba")]
    best = both[0].unionByName(both[1]).groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("_best"))
    found = words.join(best, "id", "left").withColumn("_form", F.when(-F.col("_best.n") >= times * F.col("n"), F.col("_best")))
    found = materialize(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_form.word").alias("form"), (-F.col("_form.n")).alias("form_n"), F.col("_form.id").alias("_next")))
    last = roots(found.filter("_next IS NOT NULL").select("id", F.col("_next").alias("root")))
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return found.join(named, "id", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch)::BIGINT >> 6), 128 + (unicode(ch)::BIGINT & 63)] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM places a JOIN places b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN places b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN places b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * words.n THEN other END AS form, CASE WHEN other_n >= 5 * words.n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON steps.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT steps.word, steps.at AS root FROM steps JOIN forms ON steps.at = forms.word WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
