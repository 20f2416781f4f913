"""Operator 2, toxicity of texts behind leetspeak, spacing and repetition, by a noisy channel.

Channel: a suspicious token (a letter beside a digit or sign, a letter three times in a row, or a run of lone
characters) is a lattice: a character stands for itself or for the letters it imitates, a separator or a repeated letter
for nothing. Source: a character trigram model over the words of all documents. A Viterbi search that keeps the
KEEP best paths restores the token. A run of one character counts as three of it. A token is decoded whole and in its parts between separators; what is
longer than LONGEST characters is decoded in pieces that overlap by half. Words of the text and restored words are then scored alike.

Score: word beginnings of 4 to 8 bytes and whole words, chosen and weighed by how purely they occur in labelled toxic
documents. Each different word gives the log-odds of its surest feature, and the sum is turned to a probability. Features are learned on a bounded sample
of labelled rows outside the held-out fold (TRAIN_ROWS, by hash of doc_id); the character model on every document.

Defined cases: a very long text is scored whole, in one slice of its own; null, empty and wordless texts get the score of a text without evidence; no labels: every score is 0; repeated labels of a doc_id
count as their maximum, null ones not at all; repeated rows keep a row each; equal training texts count once; an empty table gives no rows; other columns are ignored; scores may tie.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SpanHasher, below, doc_text, lower_table, mix64, slices, string_buffers
from tessera.llm.language_id import fold

TRAIN_ROWS, FOLDS, SUPPORT, PRIOR_WEIGHT, PURE, RECORD, KEEP, LONGEST = 20_000, 5, 0.004, 4.0, 0.5, 8, 4, 40
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What a character of a disguised word may stand for besides itself.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "&": "a"}
SEPARATORS = ".-_*~'`,:;/\\"
SIGNS = "".join(IMITATES) + SEPARATORS
_RUN = re.compile(r"(.)\1{3,}", re.S)
_PARTS = re.compile("[" + re.escape(SEPARATORS) + "]+")
OTHER = 27  # of the model's alphabet: 0 is a word's edge, 1..26 letters


@functools.lru_cache(1)
def _classes() -> dict[str, np.ndarray]:
    def table(chars: str) -> np.ndarray:
        t = np.zeros(256, bool)
        t[[ord(c) for c in chars]] = True
        return t

    letter = table(LETTERS)
    wordy = letter.copy()
    wordy[128:] = True
    sign = table(SIGNS)
    symbol = np.zeros(256, np.int64)
    symbol[128:] = OTHER
    symbol[[ord(c) for c in LETTERS]] = np.arange(1, 27)
    return {"letter": letter, "word": wordy, "sign": sign, "leet": table("".join(IMITATES)), "digit": table("0123456789"), "space": table(" \t\n\r\x0b\x0c"), "symbol": symbol}


def _runs(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of true, cut at borders."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = borders[borders < len(inside)]
    begins[at] |= inside[at]
    ends = np.zeros(len(inside) + 1, bool)
    ends[:-1] = begins | ~inside
    ends[-1] = True
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(ends)
    return start, stops[np.searchsorted(stops, start, "right")]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """28 x 28 x 28 counts of letters after two letters, over the words of all documents; combined in tasks, so no more rows than that leave one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, symbol = np.zeros(28**3, np.int64), lower_table(), _classes()["symbol"]
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                x = np.zeros(int(off[j] - off[i]) + 2 * (j - i) + 2, np.int64)
                pos = np.arange(off[j] - off[i]) + np.repeat(2 * np.arange(1, j - i + 1), np.diff(off[i : j + 1]))
                x[pos] = symbol[low[data[off[i] : off[j]]]]
                prev = np.where(x[1:-1] == 0, 0, x[:-2])  # nothing before an edge matters
                total += np.bincount((prev * 28 + x[1:-1]) * 28 + x[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = doc_text(docs).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(28**3)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(28, 28, 28)


class Restorer:
    """Viterbi decoding of disguised tokens under the character model."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.copy()
        c[:, 0, 0] = 0  # edges after edges are white space
        one = c.sum((0, 1)) + 1.0
        one = one / one.sum()
        two = c.sum(0)
        two = (two + 28 * one) / (two.sum(1, keepdims=True) + 28)
        three = (c + 28 * two[None]) / (c.sum(2, keepdims=True) + 28)
        self.cost = -np.log2(three)
        self.restore = functools.lru_cache(200_000)(self._restore)

    def _options(self, ch: str, last: str) -> list[tuple[str, float]]:
        out = []
        if ch in LETTERS:
            out.append((ch, 0.0))
        out += [(x, 1.0) for x in IMITATES.get(ch, "")]
        if ch in SEPARATORS or ch == "|" or ch == "!":
            out.append(("", 1.0))
        if ch not in LETTERS and ch not in SIGNS:
            out.append((ch, 0.0))
        if last == ch:
            out.append(("", 0.5))
        return out or [("", 2.0)]

    def _restore(self, token: str) -> tuple[str, ...]:
        """The KEEP likeliest words behind a token."""
        states = {(0, 0): [(0.0, "")]}
        last = ""
        for ch in token:
            nxt: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), paths in states.items():
                for letter, noise in self._options(ch, last):
                    if letter:
                        s = LETTERS.find(letter) + 1 or OTHER
                        key, step = (b, s), noise + self.cost[a, b, s]
                    else:
                        key, step = (a, b), noise
                    nxt.setdefault(key, []).extend((c + step, t + letter) for c, t in paths)
            states = {k: sorted(set(v))[:KEEP] for k, v in nxt.items()}
            last = ch
        ends = sorted({(c + self.cost[a, b, 0], t) for (a, b), paths in states.items() for c, t in paths if t})
        return tuple(dict.fromkeys(t for _, t in ends))[:KEEP]


def readings(token: str) -> list[str]:
    """What is decoded of a token: itself without outer signs, its parts between separators, and of what is over LONGEST characters the pieces."""
    token = _RUN.sub(r"\1\1\1", token)
    out = [token, token.strip(SEPARATORS + "!?\"()[]"), *(x for x in _PARTS.split(token) if len(x) >= 4)]
    step = LONGEST // 2
    return [x[i : i + LONGEST] for x in dict.fromkeys(out) if x for i in range(0, max(1, len(x) - step), step)]


def suspicious(data: np.ndarray, off: np.ndarray) -> list[tuple[int, str, bool]]:
    """(row, token, spaced) of disguised-looking tokens in lower-cased bytes; a run of lone characters is one token, spaced."""
    k = _classes()
    start, end = _runs(~k["space"][data], off[:-1])
    if not len(start):
        return []
    letter, wordy = k["letter"][data], k["word"][data]
    odd = np.zeros(len(data), bool)
    odd[:-1] = k["sign"][data[:-1]] & wordy[1:] | wordy[:-1] & k["digit"][data[1:]]
    borders = off[(off > 0) & (off < len(data))] - 1
    odd[borders] = False
    odd[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    sums = lambda x: (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(x)]))
    size = end - start
    flagged = (sums(odd) > 0) & (sums(letter) > 0)
    row = np.searchsorted(off, start, "right") - 1
    out = [(r, data[s:e].tobytes().decode("utf-8", "replace"), False) for r, s, e in zip(row[flagged].tolist(), start[flagged].tolist(), end[flagged].tolist(), strict=True)]
    lone = (size == 1) & (letter | k["leet"][data])[start]
    if lone.any():
        cuts = np.flatnonzero(np.diff(row)) + 1
        a, b = _runs(lone, cuts)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if y - x >= 3:
                for z in range(x, y, LONGEST):
                    out.append((int(row[x]), data[start[z : min(y, z + LONGEST)]].tobytes().decode(), True))
                    if z + LONGEST < y:  # a word may lie over the cut
                        w = z + LONGEST // 2
                        out.append((int(row[x]), data[start[w : min(y, w + LONGEST)]].tobytes().decode(), True))
    return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


@functools.lru_cache(1)
def _hasher() -> SpanHasher:
    return SpanHasher(41)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, word, index of the word) of each word of lower-cased bytes: its first 4 to 8 bytes, shortest first, and all of it with its end; word: a hash of all of it."""
    k = _classes()
    start, end = _runs(k["word"][data], off[:-1])
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    w8 = np.ndarray(len(data) + 1, "<u8", buf.tobytes(), 0, (1,))[start].astype(np.uint64)
    size = end - start
    w8 &= _MASKS[np.minimum(size, 8)]
    word = _hasher().spans(_hasher().prefix(data), start, end)
    row = np.searchsorted(off, start, "right") - 1
    at, keys = [], []
    for n in range(4, 9):
        some = np.flatnonzero(size >= n - 1)
        at.append(some)
        keys.append(mix64((w8[some] & _MASKS[n]) + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    long = np.flatnonzero(size >= 8)  # shorter words are whole with their end above
    at.append(long)
    keys.append(mix64(word[long] ^ np.uint64(0x2545F4914F6CDD1D)))
    at = np.concatenate(at)
    return row[at], np.concatenate(keys), word[at], at


class Features:
    """A set of feature hashes with a bit table that turns most others away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.table = np.zeros(1 << 20, bool)
        self.table[(keys >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into keys of those held, and their values."""
        some = np.flatnonzero(self.table[(keys >> np.uint64(44)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        ok = self.keys[at] == keys[some]
        return some[ok], self.values[at[ok]]


class Scorer:
    """Log-odds over the prior's of the features chosen; for the words that hold one, a longer feature with its own record overrules it."""

    def __init__(self, keys: np.ndarray, purity: np.ndarray, prior: float) -> None:
        logit = lambda p: np.log(p / (1 - p))
        pure = purity >= PURE
        self.chosen = Features(keys[pure], logit(purity[pure]) - logit(prior) if pure.any() else purity[pure])
        self.others = Features(keys[~pure], np.zeros(int((~pure).sum())))
        self.nothing = float(logit(prior / 2)) if prior > 0 else -np.inf

    def evidence(self, data: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], float]:
        """By row and word, the weight of the longest feature on record."""
        row, key, word, index = features(data, off)
        hit, value = self.chosen.look_up(key)
        if not len(hit):
            return {}
        held = np.zeros(int(index.max()) + 1, bool)
        held[index[hit]] = True
        rest = np.flatnonzero(held[index])
        over, _ = self.others.look_up(key[rest])
        at = np.concatenate([hit, rest[over]])
        value = np.concatenate([value, np.zeros(len(over))])
        order = np.argsort(at, kind="stable")  # shorter features first
        found = dict(zip(zip(row[at[order]].tolist(), word[at[order]].tolist(), strict=True), value[order].tolist(), strict=True))
        return {k: v for k, v in found.items() if v > 0}

    def words(self, words: list[str]) -> float:
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        return max(self.evidence(raw, np.array([0, len(raw)])).values(), default=0.0)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Features of the words as written in a bounded sample of labelled texts; restored words are scored by the same features."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(fold("doc_id", FOLDS) != 0)
    n = known.count()
    if not n:
        return Scorer(np.empty(0, np.uint64), np.empty(0), 0.0)
    sample = known.filter(below("doc_id", train_rows / n))  # about train_rows rows: 16 bytes each are broadcast
    rows = doc_text(docs).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = lower_table()
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist()) > 0
            data, off = string_buffers(batch.column(0))
            for i, j in slices(off):
                x, o = low[data[off[i] : off[j]]], off[i : j + 1] - off[i]
                row, key, _, _ = features(x, o)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                u, at = np.unique(key[new], return_inverse=True)
                both = np.bincount(at, minlength=len(u))
                bad = np.bincount(at, toxic[i:j][row[new]], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(both), pa.array(np.zeros(len(u), np.int64))], ["key", "bad", "n", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([int(toxic.sum())]), pa.array([len(toxic)]), pa.array([1])], ["key", "bad", "n", "docs"])

    stats = rows.mapInArrow(run, "key long, bad long, n long, docs long").groupBy("key", F.sign("docs").alias("total")).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = stats.filter("total > 0").first()
    if total is None:
        return Scorer(np.empty(0, np.uint64), np.empty(0), 0.0)
    prior = total["bad"] / total["n"]
    purity = (F.col("bad") + PRIOR_WEIGHT * prior) / (F.col("n") + PRIOR_WEIGHT)
    pure = (F.col("bad") >= max(3, math.ceil(SUPPORT * total["bad"]))) & (purity >= PURE)
    chosen = stats.filter((F.col("total") == 0) & (pure | (purity < PURE) & (F.col("n") >= RECORD))).select("key", purity.alias("p")).toArrow()  # bounded by the sample
    keys, p = chosen["key"].to_numpy().view(np.uint64), chosen["p"].to_numpy()
    return Scorer(np.array(keys), np.array(p), min(prior, 0.5))


def score_texts(docs: DataFrame, scorer: Scorer, restorer_counts: np.ndarray) -> DataFrame:
    """doc_id, score, restored (disguised tokens whose restored form is evidence, as token=word) for each row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((scorer, restorer_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, counts = model.value
        restorer, low = Restorer(counts), lower_table()

        @functools.lru_cache(200_000)
        def behind(token: str) -> tuple[tuple[str, float], ...]:
            """Restored words that are evidence, with their weights."""
            words = dict.fromkeys(w for t in readings(token) for w in restorer.restore(t))
            return tuple((w, v) for w in words if (v := mine.words([w])))

        @functools.lru_cache(50_000)
        def inside(token: str) -> tuple[tuple[str, float], ...]:
            """In a run of lone characters a word may start and end anywhere."""
            return tuple(dict.fromkeys(x for i in range(len(token) - 3) for n in range(4, min(14, len(token) - i) + 1) for x in behind(token[i : i + n])))

        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                x, o = low[data[off[i] : off[j]]], off[i : j + 1] - off[i]
                evidence: dict[tuple[int, int | str], float] = dict(mine.evidence(x, o))
                restored: dict[int, list[str]] = {}
                for r, token, spaced in suspicious(x, o):
                    for w, v in behind(token) or (inside(token) if spaced else ()):
                        evidence[r, token] = max(v, evidence.get((r, token), 0.0))
                        restored.setdefault(r, []).append(f"{token}={w}")
                logit = np.full(j - i, mine.nothing)
                if evidence:
                    np.add.at(logit, np.array([r for r, _ in evidence]), np.array(list(evidence.values())))
                score = np.where(np.isinf(logit), 0.0, 1 / (1 + np.exp(-np.maximum(logit, -700))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array([sorted(set(restored.get(r, ()))) for r in range(j - i)], pa.list_(pa.string()))], ["doc_id", "score", "restored"])

    return doc_text(docs).mapInArrow(run, "doc_id long, score double, restored array<string>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = count_trigrams(docs)
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_texts(docs, scorer, counts)
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
