"""Shared pieces of the training-data operators: durable intermediates, Arrow text buffers and byte hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: What a Python worker keeps between tasks (functions with an lru_cache); an operator that needs none of it calls release_caches().
WORKER_CACHES: list[Callable] = []


def release_caches() -> None:
    """Python workers outlive stages: what an earlier operator has cached in one gives way to the present one, and its memory to the system."""
    held = [f for f in WORKER_CACHES if f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        gc.collect()
        trim_memory()


def trim_memory() -> None:
    """Gives freed memory back to the system: glibc and Arrow's pool keep it otherwise, for each Python worker of an executor."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        else:
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialize(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write df to the shared folder in buckets of the key, and read back: joins on the key move the other side only. The second result drops it."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"spark_catalog.default.tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_shared(spark, path)

    return spark.table(name), drop


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty); other columns, whatever their names, stay out of the plan."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of an Arrow string column without copying; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of many spans of one buffer from prefix sums of a polynomial over random byte values."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1 & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.pow, self.inv = np.ones(n, np.uint64), np.ones(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumprod(np.full(n - 1, self.base, np.uint64), out=self.pow[1:])
            np.cumprod(np.full(n - 1, self.inverse, np.uint64), out=self.inv[1:])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.pow):
            self._grow(2 * len(data) + 2)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.pow[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: ASCII white space of the contracts: space and TAB to CR.
SPACE_BYTES = [0x20, *range(0x09, 0x0E)]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class WordHasher:
    """Word hashes of a text column: A-Z lower-cased, words are maximal runs of bytes outside `separators`."""

    def __init__(self, separators: list[int], seed: int = 7) -> None:
        self.lower = lower_table()
        self.is_word = np.ones(256, bool)
        self.is_word[separators] = False
        self.hasher = SpanHasher(seed)

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end, first): bytes of each word in `data`, and by row the index of its first word (one more at the end)."""
        hs, ss, es = [], [], []
        n, at = len(data), 0
        while at < n:
            to = min(n, at + SLICE_BYTES)
            while to < n and self.is_word[data[to]] and self.is_word[data[to - 1]]:  # a run is never cut
                step = data[to : to + 4096]
                gap = np.flatnonzero(~self.is_word[step])
                to += int(gap[0]) if len(gap) else len(step)
            part = self.lower[data[at:to]]
            inside = np.zeros(to - at + 2, np.int8)
            inside[1:-1] = self.is_word[part]
            flips = np.diff(inside)
            start, end = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
            cuts = off[(off > at) & (off < to)] - at
            if len(cuts):  # a run over a row's border is two words
                k = np.searchsorted(start, cuts, "right") - 1
                ok = (k >= 0) & (start[np.maximum(k, 0)] < cuts) & (end[np.maximum(k, 0)] > cuts)
                extra = np.unique(cuts[ok])
                start, end = np.sort(np.concatenate([start, extra])), np.sort(np.concatenate([end, extra]))
            pre = self.hasher.prefix(part)
            hs.append(self.hasher.spans(pre, start, end))
            ss.append(start + at)
            es.append(end + at)
            at = to
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        start = cat(ss, np.int64)
        return cat(hs, np.uint64), start, cat(es, np.int64), np.searchsorted(start, off, "left")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, each row's place (from 0) in that order, ties in any. Ranges are sorted apart and written; only their sizes, a row for each, are summed in one place."""
    tie = F.monotonically_increasing_id()
    dealt = df.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()))  # range << 33 | place in it
    split = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    before, offsets = 0, []
    for r in split.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["n"]
    base = df.sparkSession.createDataFrame(offsets, "_range long, _base long")
    return split.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_place")).select(*df.columns, name)


def below(key: Column | str, share: float) -> Column:
    """Whether a key's hash is in the lowest `share` of all 2^62 remainders; a share of one row in a trillion still keeps rows."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 62)) < F.lit(int(min(1.0, share) * (1 << 62)))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """_doc, row: a key for each row of docs in order of doc_id, and the row itself as a struct, whose names can't clash with others.

    The key is doc_id where that is one, else the number of the row, sorted by doc_id (null first) and the text's hash.
    """
    n = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    rows = docs.select(F.struct("*").alias("row"))
    if n[0] == n[1]:
        return rows.select(F.col("row.doc_id").cast("long").alias("_doc"), "row")
    hashed = rows.withColumn("_hash", F.sha2(F.col("row.text"), 256))
    return numbered(hashed, "_doc", F.col("row.doc_id").asc_nulls_first(), F.col("_hash").asc_nulls_first()).select("_doc", "row")
