"""Operator 5, language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted from labelled texts and frozen. The code length of a
byte is that of the longest context that has seen it, plus an escape for each longer context that hasn't (method C: a
context of n counts and q distinct bytes escapes with q / (n + q)); below order 0 every byte costs 8 bits. A text's score for
a language is its exact code length over all its bytes; the shortest wins. As statistics are frozen, the code
length of every counted gram is one table entry, and a whole text is scored by array look-ups.

Fitted on a bounded sample: labelled documents outside the held-out fold, taken by hash of doc_id so that a language
has about train_bytes / languages bytes, or LEAST_ROWS documents where those are more. The model's size follows that bound, not the corpus; every text is scored whole.

Defined cases: a very long text is counted and scored whole, in parts that know the bytes before them; null text or one without a letter is `und` with score 0, as is every text where nothing can be learned; a null doc_id has
the remainder of an empty text and isn't learned from; languages that tie go by name; repeated rows keep a row each; an empty table gives no rows; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import below, doc_text, release_caches, slices, string_buffers

ORDER, TRAIN_BYTES, LEAST_ROWS, UNDETERMINED = 3, 12_000_000, 16, "und"
PAD = 10  # a text starts as after line feeds
PART = 1 << 19


def fold(doc_id: Column | str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string")) % folds


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after another, each after ORDER pads; index of each row's first own byte."""
    rows = len(off) - 1
    out = np.full(len(data) + ORDER * rows, PAD, np.uint8)
    first = off[:-1] + ORDER * np.arange(1, rows + 1)
    out[np.arange(len(data)) + np.repeat(first - off[:-1], np.diff(off))] = data
    return out, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_caches()
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        data, off = string_buffers(batch.column(1))
        for name in sorted(set(lang)):
            parts = []
            for r in np.flatnonzero(lang == name).tolist():
                for at in range(int(off[r]), int(off[r + 1]), PART):
                    to = min(int(off[r + 1]), at + PART)
                    before = data[max(int(off[r]), at - ORDER) : at]
                    x = np.concatenate([np.full(ORDER - len(before), PAD, np.uint8), before, data[at:to]]).astype(np.uint32)
                    parts.append(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
            if parts:
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def sample_by_bytes(docs: DataFrame, label: str, total: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rows of docs (doc_id, text, label) by hash of doc_id, with about total / labels bytes for each label, and about least_rows rows where that is more."""
    size = docs.groupBy(label).agg(F.sum(F.octet_length("text")).alias("_bytes"), F.count("*").alias("_rows"))
    sizes = [tuple(r) for r in size.collect()]  # a row for each label
    keep = F.lit(False)
    for name, share in sample_shares(sizes, total, least_rows).items():
        keep = keep | ((F.col(label) == name) & below("doc_id", share))
    return docs.filter(keep)


def sample_shares(sizes: list[tuple[str, int, int]], total: int, least_rows: int = LEAST_ROWS) -> dict[str, float]:
    """By label, the share of its rows to keep; sizes: (label, bytes, rows)."""
    return {name: min(1.0, max(total / len(sizes) / max(1, n or 0), least_rows / max(1, rows))) for name, n, rows in sizes}


class PPM:
    """Frozen trees of all languages: for each order the grams any language has seen, with their code lengths."""

    def __init__(self, names: list[str], grams: np.ndarray, counts: np.ndarray) -> None:
        """grams: sorted codes of ORDER + 1 bytes; counts: grams x languages."""
        self.names, self.order = names, ORDER
        self.grams, self.cost, self.escape = [np.zeros(1, np.int64)] * (ORDER + 2), [None] * (ORDER + 2), [None] * (ORDER + 1)
        level = {ORDER + 1: (grams, counts.astype(float))}
        for k in range(ORDER, 0, -1):  # grams of k bytes: the longer ones without their first byte, and as contexts those without their last
            g, c = level[k + 1]
            short = g & ((1 << 8 * k) - 1)
            u = np.union1d(short, g >> 8)
            s = np.zeros((len(u), len(names)))
            np.add.at(s, np.searchsorted(u, short), c)
            level[k] = (u, s)
        below = np.full((256, len(names)), 8.0)
        for k in range(1, ORDER + 2):
            g, c = level[k]
            ctx, at = np.unique(g >> 8, return_inverse=True)  # contexts of k - 1 bytes
            n, q = np.zeros((len(ctx), len(names))), np.zeros((len(ctx), len(names)))
            np.add.at(n, at, c)
            np.add.at(q, at, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
                seen = -np.log2(c / (n + q)[at])
            if k == 1:
                lower = below[g & 255]
            else:
                lower = self.cost[k - 1][np.searchsorted(self.grams[k - 1], g & ((1 << 8 * (k - 1)) - 1)) + 1]
            self.grams[k] = g
            self.cost[k] = np.vstack([np.zeros(len(names)), np.where(c > 0, seen, esc[at] + lower)]).astype(np.float32)
            # escapes by id of the context among grams of k - 1 bytes; 0 is "not seen by any"
            if k == 1:
                self.escape[0] = esc.astype(np.float32)
            else:
                table = np.zeros((len(self.grams[k - 1]) + 1, len(names)), np.float32)
                table[np.searchsorted(self.grams[k - 1], ctx) + 1] = esc
                self.escape[k - 1] = table
        self.tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _dense(self) -> list[np.ndarray]:
        """tables[k][id of k - 1 bytes * 256 + byte] = id of k bytes, 0 if unseen."""
        if self.tables is None:
            self.tables = [np.zeros(1, np.int32)]
            for k in range(1, self.order + 2):
                g = self.grams[k]
                head = np.searchsorted(self.grams[k - 1], g >> 8) + 1 if k > 1 else np.zeros(len(g), np.int64)
                t = np.zeros(((len(self.grams[k - 1]) + 1) if k > 1 else 1) * 256, np.int32)
                t[head * 256 + (g & 255)] = np.arange(len(g)) + 1
                self.tables.append(t)
        return self.tables

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Code lengths of bytes ORDER.. of x in each language: (len(x) - ORDER) x languages."""
        t = self._dense()
        ids = [np.zeros(len(x), np.int32), t[1][x]]
        for k in range(2, self.order + 2):
            nxt = np.zeros(len(x), np.int32)
            nxt[1:] = t[k][ids[-1][:-1].astype(np.int64) * 256 + x[1:]]
            ids.append(nxt)
        full = ids[self.order + 1][self.order :]
        out = self.cost[self.order + 1][full]
        todo = np.flatnonzero(full == 0) + self.order
        if len(todo):
            out[todo - self.order] += self._escaped(ids, todo, self.order)
        return out

    def _escaped(self, ids: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
        """Bytes that no language has seen after their last k bytes."""
        if k == 0:
            return np.broadcast_to(self.escape[0] + 8.0, (len(at), len(self.names))).copy()
        out = self.escape[k][ids[k][at - 1]]
        here = ids[k][at]
        out = out + self.cost[k][here]
        less = np.flatnonzero(here == 0)
        if len(less):
            out[less] += self._escaped(ids, at[less], k - 1)
        return out

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """rows x languages, in bits."""
        rows = len(off) - 1
        out = np.zeros((rows, len(self.names)))
        for i, j in slices(off, PART):
            if off[j] - off[i] <= PART:
                x, first = padded(data[off[i] : off[j]], off[i : j + 1] - off[i])
                b = self.bits(x)
                own = np.zeros(len(x) - ORDER + 1, bool)
                own[np.arange(off[j] - off[i]) + np.repeat(first - (off[i:j] - off[i]), np.diff(off[i : j + 1])) - ORDER] = True
                b[~own[:-1]] = 0
                live = np.flatnonzero(np.diff(off[i : j + 1]))
                if len(live):
                    out[i + live] = np.add.reduceat(b, first[live] - ORDER, axis=0, dtype=float)
            else:
                for at in range(int(off[i]), int(off[j]), PART):
                    to = min(int(off[j]), at + PART)
                    before = data[max(int(off[i]), at - ORDER) : at]
                    x = np.concatenate([np.full(ORDER - len(before), PAD, np.uint8), before, data[at:to]])
                    out[i] += self.bits(x).sum(0, dtype=float)
        return out


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Broadcast | None:
    """docs: doc_id, text, lang, without the held-out fold. The broadcast model, None where no text has a language."""
    sample = sample_by_bytes(docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL"), "lang", train_bytes).select("lang", "text")
    rows = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # no more rows than sampled bytes
    if not rows.num_rows:
        return None
    names = sorted(set(rows["lang"].to_pylist()))
    grams, at = np.unique(rows["gram"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(grams), len(names)))
    counts[at, np.searchsorted(np.array(names, object), np.array(rows["lang"].to_pylist(), object))] = rows["n"].to_numpy()
    return docs.sparkSession.sparkContext.broadcast(PPM(names, grams, counts))


def predict(docs: DataFrame, model: Broadcast | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each row of docs (doc_id, text)."""
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        ppm = model.value if model is not None else None
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            rows = len(off) - 1
            bits = ppm.code_lengths(data, off) if ppm else np.zeros((rows, 1))
            lettered = np.zeros(rows, bool)
            filled = np.flatnonzero(np.diff(off))
            if len(filled):
                lettered[filled] = np.logical_or.reduceat(letters[data], off[filled])
            for r in np.flatnonzero(~lettered & (np.diff(off) > 0)).tolist():
                lettered[r] = any(map(str.isalpha, data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")))
            best = bits.argmin(1)
            least = bits[np.arange(rows), best]
            with np.errstate(under="ignore"):
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            good = lettered & (ppm is not None)
            names = [ppm.names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), good.tolist(), strict=True)]
            per = least / np.maximum(1, np.diff(off))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(good, score, 0.0)), pa.array(per)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return doc_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
