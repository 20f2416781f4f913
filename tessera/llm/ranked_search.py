"""Operator 13, ranked lexical search by windowed bucket scoring.

Terms are maximal runs of bytes outside SEPARATORS, A-Z lower-cased, told apart by 64-bit hashes. One pass over the documents keeps the postings of asked terms
alone, as segments: whole documents of one window of WINDOW doc_ids with their slots, terms and counts. A task takes the segments of its windows in order,
joins them to at most WINDOW documents, and traverses each item's postings there: every term scatters its impacts into an array of one long a slot, which fits
a core's cache, and sets its bits in the occupancy bitset; only occupied slots are harvested, into a heap of k for each item. Tasks return k rows an item at most.

Statistics (documents, terms, documents of a term) are sums over all documents. Items are dealt to chunks of about CHUNK_TERMS terms by hash, each searched in a pass
of its own; a chunk's terms are broadcast and with them the weights, so what is held doesn't grow with the benchmark (an item's distinct terms stay together). Windows with more documents
than doc_ids (repeated ids) are dealt to several tasks.

Defined cases: null and empty texts, and those without a term, count nowhere and match nothing; very long texts are read whole; equal scores go by ascending doc_id; rows
with one doc_id are documents of their own; rows with a null doc_id count in the statistics but can't be named, so they aren't ranked; equal items are one, items of one id and different
texts are ranked each; null item_ids are ids; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import WordHasher, doc_text, materialize, release_caches, slices, string_buffers

SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
K, WINDOW, CHUNK_TERMS = 10, 1 << 15, 400_000
SEGMENT = "window long, docs array<long>, lengths array<long>, slots array<int>, terms array<int>, tf array<int>, counted long, total long"
HITS = "item long, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """item, term, times for items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher(SEPARATORS)
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for r, item in enumerate(batch.column(0).to_pylist()):
                h, times = np.unique(words.words(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(h.view(np.int64)), pa.array(times)], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times long")


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))


def segments(docs: DataFrame, vocabulary: object) -> DataFrame:
    """Postings of the vocabulary's terms (a broadcast sorted array of hashes) by windows; window is null for documents without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words, known = WordHasher(SEPARATORS), vocabulary.value
        for batch in batches:
            ids = batch.column(0)
            named, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                h, _, _, first = words.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(first)
                term = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[term] == h
                pair, tf = np.unique(np.repeat(np.arange(j - i), n)[hit] * len(known) + term[hit], return_counts=True)
                doc, term = pair // len(known), pair % len(known)
                # documents in order of window and id, postings with them
                place = np.where(named[i:j], number[i:j] // WINDOW, np.iinfo(np.int64).min)
                order = np.lexsort((number[i:j], place))
                rank = np.empty(j - i, np.int64)
                rank[order] = np.arange(j - i)
                by = np.argsort(rank[doc], kind="stable")
                doc, term, tf = rank[doc][by], term[by], tf[by]
                place, n, name = place[order], n[order], number[i:j][order]
                cut = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
                ends = np.append(cut[1:], len(place))
                rows, posts = np.append(cut, len(place)), np.searchsorted(doc, np.append(cut, len(place)))
                slot = doc - np.repeat(cut, np.diff(posts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place[cut], mask=place[cut] == np.iinfo(np.int64).min), _lists(name, rows), _lists(n, rows), _lists(slot.astype(np.int32), posts), _lists(term.astype(np.int32), posts), _lists(tf.astype(np.int32), posts),
                        pa.array([int((n[a:b] > 0).sum()) for a, b in zip(cut, ends, strict=True)], pa.int64()), pa.array([int(n[a:b].sum()) for a, b in zip(cut, ends, strict=True)], pa.int64()),
                    ],
                    ["window", "docs", "lengths", "slots", "terms", "tf", "counted", "total"],
                )

    return doc_text(docs).mapInArrow(run, SEGMENT)


def frequencies(parts: DataFrame) -> DataFrame:
    """term, df over all segments; a task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(batch.column(0).flatten().to_numpy())
            if len(c) > len(held):
                c, held = held, c
            held[: len(c)] += c
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "df"])

    return parts.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class WindowScorer:
    """Scores of one chunk's items over one window's postings after another, the k best of each item in a heap."""

    def __init__(self, items: list[int], first: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int) -> None:
        self.items, self.first, self.terms, self.times, self.weights = items, first, terms, times, weights
        self.documents, self.length, self.k = documents, length, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]

    def score(self, docs: np.ndarray, lengths: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        order = np.lexsort((slot, term))
        slot, term, tf = slot[order], term[order], tf[order].astype(np.int64)
        m = 25 + 75 * lengths * self.documents // self.length
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[slot]))
        begin = np.searchsorted(term, np.arange(len(self.weights) + 1))
        # the bits of each term's slots, word by word
        word = slot >> 6
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), start) if len(start) else np.empty(0, np.uint64)
        words, first_word = word[start], np.searchsorted(start, begin)
        bucket, occupied = np.zeros(len(docs), np.int64), np.zeros(-(-len(docs) // 64), np.uint64)
        for item, heap in enumerate(self.heaps):
            for at in range(self.first[item], self.first[item + 1]):
                t = self.terms[at]
                a, b = begin[t], begin[t + 1]
                if a < b:
                    bucket[slot[a:b]] += impact[a:b] * self.times[at]
                    c, d = first_word[t], first_word[t + 1]
                    occupied[words[c:d]] |= bits[c:d]
            self._harvest(heap, docs, bucket, occupied)

    def _harvest(self, heap: list[tuple[int, int]], docs: np.ndarray, bucket: np.ndarray, occupied: np.ndarray) -> None:
        full = np.flatnonzero(occupied)
        if not len(full):
            return
        row, bit = np.nonzero(np.unpackbits(occupied[full].view(np.uint8).reshape(len(full), 8), axis=1, bitorder="little"))
        slots = full[row] * 64 + bit
        got = bucket[slots]
        bucket[slots], occupied[full] = 0, 0
        some = np.flatnonzero(got >= (heap[0][0] if len(heap) == self.k else 1))
        if len(some) > self.k:
            some = some[got[some] >= np.partition(got[some], len(some) - self.k)[len(some) - self.k]]
        for score, name in sorted(zip(got[some].tolist(), docs[slots[some]].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[: self.k]:
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -name))
            elif (score, -name) > heap[0]:
                heapq.heapreplace(heap, (score, -name))


def _chunk(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame | None:
    """Hits of one chunk's items (item, term, times): at most k an item from each task."""
    spark = docs.sparkSession
    rows = rows.sort_by("item")
    item, hashes = rows["item"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
    known, term = np.unique(hashes, return_inverse=True)
    first = np.flatnonzero(np.diff(item, prepend=item[0] - 1))
    parts = materialize(segments(docs, spark.sparkContext.broadcast(known)).withColumn("segment", F.monotonically_increasing_id()))
    n, length = parts.agg(F.sum("counted"), F.sum("total")).first()
    if not length:
        return None
    df = frequencies(parts).toArrow()
    weights = np.zeros(len(known), np.int64)
    weights[df["term"].to_numpy()] = [math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df["df"].to_pylist()]
    asked = spark.sparkContext.broadcast((item[first].tolist(), np.append(first, len(item)), term, rows["times"].to_numpy(), weights, n, length, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        scorer, held, window, size = WindowScorer(*asked.value), [], None, 0

        def flush() -> None:
            if not held:
                return
            before = np.cumsum([0, *(len(x[0]) for x in held)])
            slot = np.concatenate([x[2].astype(np.int64) + b for x, b in zip(held, before, strict=False)])
            scorer.score(*(np.concatenate([x[i] for x in held]) for i in (0, 1)), slot, *(np.concatenate([x[i] for x in held]).astype(np.int64) for i in (3, 4)))
            held.clear()

        for batch in batches:
            lists = [batch.column(c) for c in range(1, 6)]
            for r, w in enumerate(batch.column(0).to_pylist()):
                parts = [x[r].values.to_numpy(zero_copy_only=False) for x in lists]
                if w != window or size + len(parts[0]) > WINDOW:
                    flush()
                    window, size = w, 0
                held.append(parts)
                size += len(parts[0])
        flush()
        found = [(i, -d, s) for i, heap in zip(scorer.items, scorer.heaps, strict=True) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    named = parts.filter(F.col("window").isNotNull()).select("window", "docs", "lengths", "slots", "terms", "tf", "segment")
    tasks = named.groupBy("window").agg(F.ceil(F.sum(F.size("docs")) / WINDOW).cast("int").alias("_tasks"))
    dealt = named.join(tasks, "window").withColumn("_salt", F.pmod(F.xxhash64("segment"), F.col("_tasks"))).repartition("window", "_salt").sortWithinPartitions("window", "_salt")
    return dealt.select("window", "docs", "lengths", "slots", "terms", "tf").mapInArrow(run, HITS)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    known = items.select(items["item_id"], F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    known = materialize(known.withColumn("item", F.monotonically_increasing_id()))
    terms = materialize(item_terms(known))
    chunks = -(-terms.count() // CHUNK_TERMS)
    hits = None
    for c in range(chunks):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).toArrow()
        if rows.num_rows and (found := _chunk(docs, rows, k)) is not None:
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    rank = F.row_number().over(W.Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_windowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
stats AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT q.*, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), stats),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM weighed JOIN tf USING (term), stats GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
