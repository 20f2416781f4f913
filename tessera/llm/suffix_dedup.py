"""Operator 1, suffix-array dedup: removal of later copies of 100-byte strings by longest-previous-factor arrays.

A byte goes if a LENGTH-byte string over it starts earlier too, that is, if the longest previous factor (LPF) of that string's
start is at least LENGTH. LPF comes from suffix order: of the suffixes before and after it with a smaller text position,
the nearest (previous and next smaller values) share the longest prefixes with it.

Suffixes of all bytes would be a hundred times the text, so only those that can matter are sorted. Every LENGTH-byte
window has an anchor, its K-byte gram with the least hash, which equal windows share; neighbouring windows
with one anchor form a run.
1. Runs are rows (anchor hash, hash of the run's bytes, document, place). A run whose bytes occur earlier is removed;
   equal runs are first combined in each task, so a passage in a third of all documents is a row for each task.
2. An anchor that occurs with one run only is unique. Else its first runs, which differ, may still share windows:
   mostly the ends of copied passages. Their bytes are fetched and dealt by anchor, and each block of them gets a suffix array, its
   LPF array and thereby the windows that start earlier in another run.
3. An anchor with more than HOT such runs isn't gathered: its windows become rows of their own under 128-bit hashes, and
   are resolved like runs in step 1.
Documents meet the spans that they lose in a join on doc_id, and are written without them.

Defined cases: null or empty text has no bytes and loses none; texts under LENGTH bytes lose none; where doc_ids repeat or are null, documents
are ordered by doc_id (null first), then by the text's hash, equal rows being one document with a result row each; longer texts than SEGMENT are read in
overlapping segments; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SpanHasher, doc_text, materialize, mix64, numbered, release_caches, slices, string_buffers

LENGTH, GRAM, HOT, BLOCK_SUFFIXES = 100, 32, 20_000, 200_000
SEGMENT = 1 << 20
_LOW = np.uint64(SEGMENT - 1)
RUNS = "h long, f long, doc long, lo int, n int, kind int"
SPAN = 4096  # a span is start * SPAN + length; runs are shorter


class Runs:
    """Runs of windows with one anchor, for bytes of at most SEGMENT."""

    def __init__(self) -> None:
        self.grams, self.bytes = SpanHasher(21), SpanHasher(22)
        self.steps = []
        power, g = self.grams.base, 1
        while g < GRAM:
            self.steps.append((g, np.uint64(power)))
            power, g = power * power & (1 << 64) - 1, 2 * g

    def find(self, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, run hash, first window, windows) of each run of x; valid: by window, whether it lies within a text."""
        h = self.grams.values[x]
        for g, p in self.steps:
            h = h[:-g] * p + h[g:]
        h = mix64(h)
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, g = LENGTH - GRAM + 1, 1
        while 2 * g <= width:
            m = np.minimum(m[:-g], m[g:])
            g *= 2
        if width > g:
            m = np.minimum(m[: len(m) - (width - g)], m[width - g :])
        at = (m & _LOW).astype(np.int64)
        change = np.ones(len(at) + 1, bool)
        change[1:-1] = at[1:] != at[:-1]
        edge = np.zeros(len(at) + 2, bool)
        edge[1:-1] = valid
        start = np.flatnonzero(valid & (change[:-1] | ~edge[:-2]))
        end = np.flatnonzero(valid & (change[1:] | ~edge[2:]))
        return h[at[start]], self.bytes.spans(self.bytes.prefix(x), start, end + LENGTH), start, end - start + 1


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row from, row to, byte from, byte to): whole rows, or a segment of a long one that shares LENGTH - 1 bytes with the next."""
    for i, j in slices(off, SEGMENT):
        a, b = int(off[i]), int(off[j])
        if b - a <= SEGMENT:
            yield i, j, a, b
        else:
            while a + LENGTH <= b:
                yield i, j, a, min(b, a + SEGMENT)
                a += SEGMENT - LENGTH + 1


def find_runs(docs: DataFrame) -> DataFrame:
    """Runs of docs (doc, text). Of equal runs in a batch the first is kept as kind 0, the others are kind 1: removed already, with a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        maker = Runs()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = string_buffers(batch.column(1))
            parts = []
            for i, j, a, b in _pieces(off):
                if b - a < LENGTH:
                    continue
                valid = np.zeros(b - a - LENGTH + 1, bool)
                for s, e in zip(np.maximum(off[i:j], a).tolist(), np.minimum(off[i + 1 : j + 1], b).tolist(), strict=True):
                    valid[s - a : max(s - a, e - a - LENGTH + 1)] = True
                h, f, lo, n = maker.find(data[a:b], valid)
                row = i + np.searchsorted(off[i : j + 1], lo + a, "right") - 1
                parts.append((h, f, doc[row], lo + a - off[row], n))
            if not parts:
                continue
            h, f, d, lo, n = (np.concatenate(p) for p in zip(*parts, strict=True))
            key = mix64(h * np.uint64(3) + f)
            order = np.lexsort((lo, d, key))
            h, f, d, lo, n, key = (v[order] for v in (h, f, d, lo, n, key))
            again = np.zeros(len(h), bool)
            again[1:] = (key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (f[1:] == f[:-1]) & ((d[1:] != d[:-1]) | (lo[1:] != lo[:-1]))
            h[again] = mix64(d[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo[again].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(d), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again.astype(np.int32))], ["h", "f", "doc", "lo", "n", "kind"])

    return docs.mapInArrow(run, RUNS)


def resolve(runs: DataFrame) -> DataFrame:
    """doc, lo, n, h, open: runs whose bytes start earlier (open false), and first runs of anchors that have several (open true). A task streams through sorted rows and holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = None, False  # the last first run, and whether its anchor had one before

        def out(rows: list[np.ndarray], open_: bool) -> pa.RecordBatch:
            h, _, d, lo, n = rows
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(lo), pa.array(n), pa.array(h), pa.array(np.full(len(d), open_))], ["doc", "lo", "n", "h", "open"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            done = cols[5] == 1
            if done.any():
                yield out([c[done] for c in cols[:5]], False)
            cols = [c[~done] for c in cols[:5]]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            h, f, d, lo, _ = cols
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
            at = np.flatnonzero(first)
            lead = at[np.cumsum(first) - 1]
            later = ~first & ((d != d[lead]) | (lo != lo[lead]))
            if later.any():
                yield out([c[later] for c in cols], False)
            same = h[at[1:]] == h[at[:-1]]
            many = np.concatenate([[several], same]) | np.concatenate([same, [False]])
            if many[:-1].any():
                yield out([c[at[:-1][many[:-1]]] for c in cols], True)
            held, several = [c[at[-1:]] for c in cols], bool(many[-1])
        if held is not None and several:
            yield out(held, True)

    return runs.repartition("h").sortWithinPartitions("h", "f", "doc", "lo").mapInArrow(run, "doc long, lo int, n int, h long, open boolean")


def longest_previous_factors(strings: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LPF, up to the strings' length, of suffixes given by their first bytes (rows of `strings`) and text positions."""
    n, width = strings.shape
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{width}").ravel(), kind="stable")
    q = position[order]

    def smaller(q: np.ndarray) -> np.ndarray:
        """Index of the nearest smaller value to the left, -1 for none; pointers jump over what is larger."""
        prev = np.arange(len(q)) - 1
        todo = np.arange(len(q))
        while len(todo):
            p = prev[todo]
            todo = todo[(p >= 0) & (q[np.maximum(p, 0)] >= q[todo])]
            prev[todo] = prev[prev[todo]]
        return prev

    def common(other: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        have = np.flatnonzero(other >= 0)
        for i in range(0, len(have), 1 << 15):
            k = have[i : i + (1 << 15)]
            differ = strings[order[k]] != strings[order[other[k]]]
            out[k] = np.where(differ.any(1), differ.argmax(1), width)
        return out

    left = smaller(q)
    right = smaller(q[::-1])[::-1]
    right = np.where(right >= 0, n - 1 - right, -1)
    lpf = np.empty(n, np.int64)
    lpf[order] = np.maximum(common(left), common(right))
    return lpf


def _lpf_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans removed by earlier windows of other runs of one anchor; rows come sorted by anchor and a block holds whole anchors."""
    wait: list[tuple] = []
    size = 0

    def solve() -> pa.RecordBatch:
        doc, lo, n = (np.array([r[k] for r in wait], np.int64) for k in (1, 2, 3))
        buf = np.frombuffer(b"".join(r[4] for r in wait), np.uint8)
        at = np.concatenate([[0], np.cumsum(n + LENGTH - 1)])[:-1]
        run = np.repeat(np.arange(len(wait)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        strings = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[at[run] + k]
        start = lo[run] + k
        position = np.empty(len(run), np.int64)
        ranks = np.lexsort((start, doc[run]))
        new = np.ones(len(run), bool)
        new[1:] = (start[ranks][1:] != start[ranks][:-1]) | (doc[run][ranks][1:] != doc[run][ranks][:-1])
        position[ranks] = np.cumsum(new)
        gone = longest_previous_factors(strings, position) >= LENGTH
        both = np.concatenate([[False], gone, [False]])
        turn = np.concatenate([[True], run[1:] != run[:-1], [True]])
        first = np.flatnonzero(gone & (~both[:-2] | turn[:-1]))
        last = np.flatnonzero(gone & (~both[2:] | turn[1:]))
        return pa.RecordBatch.from_arrays([pa.array(doc[run[first]]), pa.array(start[first] * SPAN + (last - first) + LENGTH)], ["doc", "span"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK_SUFFIXES and wait[-1][0] != r[0]:
                yield solve()
                wait, size = [], 0
            wait.append(r)
            size += r[3]
    if wait:
        yield solve()


def fetch(docs: DataFrame, runs: DataFrame, windows: bool) -> DataFrame:
    """The bytes of runs (doc, lo, n, h): a row each (h, doc, lo, n, bytes), or one row for each window, in the form of find_runs."""
    wanted = runs.groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "n")).alias("_runs"))
    joined = docs.join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = SpanHasher(23), SpanHasher(24)
        for batch in batches:
            for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                flat = items.values
                h, lo, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                raw = text.as_buffer().to_pybytes()
                if not windows:
                    for i in range(0, len(h), 4096):
                        a, m = lo[i : i + 4096], n[i : i + 4096]
                        ctx = [raw[s : s + c + LENGTH - 1] for s, c in zip(a.tolist(), m.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 4096]), pa.array(np.full(len(a), doc)), pa.array(a), pa.array(m), pa.array(ctx, pa.binary())], ["h", "doc", "lo", "n", "bytes"])
                    continue
                for s, c in zip(lo.tolist(), n.tolist(), strict=True):
                    x = np.frombuffer(raw[s : s + c + LENGTH - 1], np.uint8)
                    at = np.arange(c)
                    keys = [k.spans(k.prefix(x), at, at + LENGTH).view(np.int64) for k in (one, two)]
                    fixed = [np.full(c, doc), (s + at).astype(np.int32), np.ones(c, np.int32), np.zeros(c, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*keys, *fixed)], ["h", "f", "doc", "lo", "n", "kind"])

    return joined.mapInArrow(run, RUNS if windows else "h long, doc long, lo int, n int, bytes binary")


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans_, digest, texts = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, runs, sha = [], 0, 0, hashlib.sha256()
                if spans.is_valid:
                    s = np.sort(spans.values.to_numpy(zero_copy_only=False))
                    begin = s // SPAN
                    end = np.maximum.accumulate(begin + s % SPAN)
                    new = np.ones(len(s), bool)
                    new[1:] = begin[1:] > end[:-1]
                    firsts = np.flatnonzero(new)
                    for a, b in zip(begin[firsts].tolist(), np.maximum.reduceat(end, firsts).tolist(), strict=True):
                        kept.append(raw[at:a])
                        at, runs = b, runs + 1
                kept.append(raw[at:])
                left = b"".join(kept)
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans_.append(runs)
                digest.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    texts.append(left)
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_copies(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (the remaining bytes, which need not be UTF-8) for each row of docs."""
    texts = doc_text(docs)
    ids = texts.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        base = texts.select("doc_id", F.col("doc_id").alias("doc"), "text")
    else:  # no proper key: rows are numbered in order
        keyed = texts.withColumn("_hash", F.sha2("text", 256))
        numbers = keyed.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of")).distinct()
        numbers = numbered(numbers, "doc", F.col("_id").asc_nulls_first(), F.col("_of").asc())
        base = keyed.join(numbers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))).select("doc_id", "doc", "text")
        base = materialize(base)
    plain = base.select("doc", "text")
    one = plain if ids[0] == ids[1] else plain.dropDuplicates(["doc"])
    found = materialize(resolve(find_runs(one)))
    span = (F.col("lo").cast("long") * SPAN + F.col("n") + (LENGTH - 1)).alias("span")
    gone = found.filter("NOT open").select("doc", span)
    many = found.filter("open").groupBy("h").count().filter(F.col("count") > HOT).select("h")
    several = found.filter("open").select("doc", "lo", "n", "h")
    if not many.isEmpty():
        hot = several.join(many, "h", "left_semi")
        windows = fetch(one, hot, True)
        gone = gone.unionByName(resolve(windows).filter("NOT open").select("doc", span))
        several = several.join(many, "h", "left_anti")
    near = fetch(one, several, False).repartition("h").sortWithinPartitions("h").mapInArrow(_lpf_spans, "doc long, span long")
    spans = gone.unionByName(near).groupBy("doc").agg(F.collect_list("span").alias("_spans"))
    joined = base.select("doc", "text", "doc_id").join(spans.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "_spans")
    return joined.mapInArrow(_cut(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
