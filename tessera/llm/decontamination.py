"""Operator 10, benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the items (an item of fewer words is one window). Symbols are words; a block is
two of them. SHIFT, by hash of a block, says how far a search may skip; where it is 0, the block's hash leads to the
bucket of windows that end in it; those whose word hashes agree are compared byte by byte. Texts are searched in
segments that overlap by a window less one word, all segments of a batch in step, so the work is a few array
operations for every dozen words. Windows of each length below 13 have tables of their own.

The benchmark is broadcast in chunks of at most CHUNK_BYTES of text, each a pass over the documents, so what a task holds
is bounded however large the benchmark grows; one chunk, the usual case, needs no shuffle.

Defined cases: a very long text is searched whole, in a slice of its own; occurrences that overlap or tie count each word once; null or empty text has no words; null doc_ids and repeated rows keep a row each; items that repeat count by
item_id, a null item_id is left out; an empty benchmark or table works; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WordHasher, doc_text, materialize, mix64, release_caches, slices, string_buffers

WINDOW, CHUNK_BYTES, SEGMENT, TABLE_BITS = 13, 8 << 20, 256, 18
#: Bytes that no word has: 00-2F, 3A-60 (after lower-casing), 7B-7F.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def _blocks(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return h[at] if width == 1 else mix64(h[at - 1] * np.uint64(3) + h[at])


class Items:
    """Words of a chunk of items in flat arrays: ids, hashes, and places of their lower-cased bytes."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        words = WordHasher(SEPARATORS)
        data, off = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        self.names = [i for i, _ in items]
        self.hashes, start, end, self.first = words.words(data, off)
        self.bytes, self.start, self.end = words.lower[data].tobytes(), start.astype(np.int32), end.astype(np.int32)

    def said(self, at: int, n: int) -> bytes:
        return b"\0".join([self.bytes[s:e] for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)])


class WuManber:
    """SHIFT, bucket and comparison tables of the windows of one length, in words. begin: each different window's first word among the items' words; owner, owned: the items that hold it."""

    def __init__(self, items: Items, begin: np.ndarray, item: np.ndarray, length: int) -> None:
        self.items, self.length, self.width = items, length, min(2, length)
        one, two = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
        for i in range(length):
            h = items.hashes[begin + i]
            one, two = mix64(one * np.uint64(3) + h), two * np.uint64(0x9E3779B97F4A7C15) + h
        order = np.lexsort((item, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        del one, two
        self.begin = begin[order[new]].astype(np.int32)
        self.owned, self.owner = np.append(np.flatnonzero(new), len(order)).astype(np.int32), item[order].astype(np.int32)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.width + 1, np.int64)
        for end in range(self.width - 1, self.length):
            np.minimum.at(self.shift, self._slot(_blocks(items.hashes, self.begin + end, self.width)), self.length - 1 - end)
        last = _blocks(items.hashes, self.begin + (length - 1), self.width)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.suffix = last[self.order]

    def owners(self, window: int) -> list[str]:
        return [self.items.names[i] for i in self.owner[self.owned[window] : self.owned[window + 1]].tolist()]

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, window) of each agreement of word hashes in rows first[i]:first[i+1]."""
        spans = np.diff(first)
        per = np.maximum(0, -(-(spans - self.length + 1) // SEGMENT))  # segments by row
        row = np.repeat(np.arange(len(spans)), per)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        pos = first[row] + self.length - 1 + k * SEGMENT
        stop = np.minimum(pos + SEGMENT, first[row + 1])
        found_at, found = [], []
        while len(pos):
            block = _blocks(h, pos, self.width)
            step = self.shift[self._slot(block)]
            zero = step == 0
            if zero.any():
                p, b = pos[zero], block[zero]
                lo, hi = np.searchsorted(self.suffix, b, "left"), np.searchsorted(self.suffix, b, "right")
                many = hi - lo
                p = np.repeat(p, many)
                cand = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)]
                same = h[p - self.length + 1] == self.items.hashes[self.begin[cand]]  # the prefix first, as most differ there
                p, cand = p[same], cand[same]
                for i in range(1, self.length):
                    same = h[p - self.length + 1 + i] == self.items.hashes[self.begin[cand] + i]
                    p, cand = p[same], cand[same]
                found_at.append(p)
                found.append(cand)
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        return cat(found_at), cat(found)


def build_tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """items: (item_id, text). Some 50 bytes for each word of the items."""
    held = Items(items)
    size = np.diff(held.first)
    length = np.minimum(size, window)
    tables = []
    for n in np.unique(length[length > 0]).tolist():
        which = np.flatnonzero(length == n)
        many = size[which] - n + 1
        item = np.repeat(which, many)
        begin = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + held.first[item]
        tables.append(WuManber(held, begin, item, n))
    return tables


def find_items(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (from, to word of merged runs), items (ids) by row of docs, for one bounded chunk of items."""
    tables = docs.sparkSession.sparkContext.broadcast(build_tables(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words, mine = WordHasher(SEPARATORS), tables.value
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h, start, end, first = words.words(part, o)
                spans, ids = defaultdict(list), defaultdict(set)
                for t in mine:
                    for p, c in zip(*(x.tolist() for x in t.search(h, first)), strict=True):
                        a = p - t.length + 1
                        if b"\0".join([words.lower[part[s:e]].tobytes() for s, e in zip(start[a : p + 1].tolist(), end[a : p + 1].tolist(), strict=True)]) == t.items.said(int(t.begin[c]), t.length):
                            row = int(np.searchsorted(first, p, "right")) - 1
                            spans[row].append((a - int(first[row]), p + 1 - int(first[row])))
                            ids[row].update(t.owners(c))
                runs = []
                for r in range(j - i):
                    flat = []
                    for a, b in sorted(spans.get(r, ())):
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], b)
                        else:
                            flat += [a, b]
                    runs.append(flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(ids.get(r, ())) for r in range(j - i)], pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_words long, hits array<long>, items array<string>")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, items, digest = [], [], []
        for runs, ids in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            total, to = 0, 0
            for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
                total += max(0, b - max(a, to))
                to = max(to, b)
            names = sorted(set(ids))
            hit.append(total)
            items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    if chunks == 1:
        found = find_items(docs, [tuple(r) for r in items.collect()], window)
    else:  # a chunk's bytes are near the bound, as items are dealt by hash; each is read, broadcast and searched alone
        keyed = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")))  # written, as every chunk must see the same keys
        parts = []
        for c in range(chunks):
            chunk = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()]
            row = find_items(keyed.select(F.col("_row").alias("doc_id"), "text"), chunk, window).withColumnRenamed("doc_id", "_row")
            parts.append(row)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merged = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        found = keyed.select("doc_id", "_row").join(merged, "_row").select("doc_id", "n_words", "hits", "items")
    out = found.mapInArrow(_finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n.n, i, array_to_string(w[i:i + n.n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), n WHERE i + n.n - 1 <= len(w)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
