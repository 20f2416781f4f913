"""Operator 9, near-duplicates by min-max hashing, with links confirmed on full sets.

Sketch: each of PERMUTATIONS hash functions gives its minimum and its maximum over a document's shingles, so 2 values
for one evaluation, of lower variance than as many minima. BANDS bands of 4 values (both ends of two functions) miss a
pair at the limit of 0.8 with probability (1 - 0.8^4)^32 < 5e-8. Documents with equal sets are one class, and its smallest doc_id takes part.

Candidates: first, each class against the smallest of its bucket, which is linear in a bucket's size. Links found so are
closed to components. Only buckets that still hold several components are searched further, in pairs of blocks of bounded
size: a task compares members of different components, those whose set sizes and whole sketches agree with the limit (a pair at the
limit falls below ESTIMATE with probability < 1e-4) on their full sets, and returns links alone. Pairs inside a component need no check, as they can't change it.

Confirmation: members of a center are dealt in groups of bounded size, each led by the center; a task streams through
sorted groups and holds one center's set at a time. Sets are built anew from the whole texts.

Defined cases: null, empty or wordless text has an empty set and is linked with nothing; fewer words than a shingle are one shingle; rows
with a null doc_id take no part (component_id null, kept true); very long texts are hashed whole; among ties of a component the smallest doc_id is kept; repeated rows get the same answer each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_BYTES, WordHasher, doc_text, materialize, mix64, release_caches, slices, string_buffers
from tessera.llm.components import connected_components

WORDS, PERMUTATIONS, BANDS, ESTIMATE, SALT_MEMBERS, BLOCK_MEMBERS, BLOCK_SHINGLES = 4, 64, 32, 0.65, 256, 256, 2_000_000
SIMILARITY = (80, 100)
SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, index of each row's first one and the end) from word hashes; a row of fewer than k words has one for the whole sequence."""
    n = np.diff(first)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    start = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], per)
    out = np.zeros(at[-1], np.uint64)
    whole = np.repeat(n >= k, per)
    s = start[whole]
    acc = np.zeros(len(s), np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[s + i]
    out[whole] = mix64(acc)
    for r in np.flatnonzero((n > 0) & (n < k)).tolist():
        acc = n[r : r + 1].astype(np.uint64)
        for x in range(int(first[r]), int(first[r + 1])):
            acc = acc * np.uint64(0xD1342543DE82EF95) + h[x : x + 1]
        out[at[r]] = mix64(acc)[0]
    return out, at


def distinct(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    rows = [np.unique(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(rows) if rows else s), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


class MinMaxSketcher:
    def __init__(self, permutations: int = PERMUTATIONS, bands: int = BANDS, seed: int = 11) -> None:
        self.factors = np.random.default_rng(seed).integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, 2 * permutations // bands

    def signatures(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rows x 2 * permutations uint32: minimum and maximum by turns; rows without shingles are 0."""
        out = np.zeros((len(at) - 1, 2 * len(self.factors)), np.uint32)
        live = np.flatnonzero(np.diff(at))
        if len(live):
            begin = at[:-1][live]
            for i, f in enumerate(self.factors):
                v = ((s * f) >> np.uint64(32)).astype(np.uint32)
                out[live, 2 * i] = np.minimum.reduceat(v, begin)
                out[live, 2 * i + 1] = np.maximum.reduceat(v, begin)
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        parts = sig.reshape(len(sig), self.bands, self.rows).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
        for i in range(self.rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
        return acc


def sketch(docs: DataFrame, k: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words, maker = WordHasher(SPACE_BYTES), MinMaxSketcher()
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                h, _, _, first = words.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, at = distinct(*shingles(h, first, k))
                sig = maker.signatures(s, at)
                sums = np.concatenate([[0], np.cumsum(mix64(s), dtype=np.uint64)]).astype(np.uint64)
                other = np.concatenate([[0], np.cumsum(mix64(s * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)]).astype(np.uint64)
                fp = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in (sums, other)]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * maker.bands), pa.array(maker.keys(sig).ravel().view(np.int64)))
                low = [x.tobytes() for x in sig.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(fp[0]), pa.array(fp[1]), keys, pa.array(low, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])

    return doc_text(docs).mapInArrow(run, SKETCH)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy den * |A and B| >= num * |A or B|. docs: one row for each doc_id used."""
    num, den = similarity
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("_salts"))
    dealt = pairs.join(groups, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    members = dealt.select("a", "_salt", F.lit(1).alias("_k"), F.col("b").alias("doc_id"))
    leaders = heads.select("a", "_salt", F.lit(0).alias("_k"), F.col("a").alias("doc_id"))
    led = docs.join(members.unionByName(leaders).hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words, head, lead = WordHasher(SPACE_BYTES), None, np.empty(0, np.uint64)
        for batch in batches:
            a, kind, doc = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "_k", "doc_id"))
            data, off = string_buffers(batch.column(batch.schema.get_field_index("text")))
            left, right = [], []
            for i, j in slices(off):
                h, _, _, first = words.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, at = distinct(*shingles(h, first, k))
                for r in range(i, j):
                    mine = s[at[r - i] : at[r - i + 1]]
                    if kind[r] == 0:
                        head, lead = a[r], mine
                    elif head == a[r]:
                        pos = np.searchsorted(lead, mine)
                        both = int((lead[np.minimum(pos, len(lead) - 1)] == mine).sum()) if len(lead) else 0
                        if den * both >= num * (len(lead) + len(mine) - both) and both:
                            left.append(a[r])
                            right.append(doc[r])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return led.select("a", "_salt", "_k", "doc_id", "text").repartition("a", "_salt").sortWithinPartitions("a", "_salt", "_k").mapInArrow(run, "a long, b long")


def linked_blocks(members: DataFrame, docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between members (key, doc_id, label, n_shingles, sketch) of one key and different labels, confirmed on full sets; each document is in one key.

    A key's members are dealt to blocks of about BLOCK_MEMBERS members and BLOCK_SHINGLES shingles at most (some 12 MB of text), and each pair of blocks is compared in one task, which skips pairs that it has joined already. Only links leave it.
    """
    num, den = similarity
    blocks = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    dealt = members.join(blocks, "key").withColumn("_mine", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    texts = docs.join(dealt.hint("shuffle_hash"), "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    spread = texts.select("*", other).select("key", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "doc_id", "label", "n_shingles", "sketch", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending")])
        ids, label, size, mine = (group.column(c).to_numpy() for c in ("doc_id", "label", "n_shingles", "_mine"))
        _, label = np.unique(label, return_inverse=True)
        low, high = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        sig = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        words, sets = WordHasher(SPACE_BYTES), {}
        data, off = string_buffers(group.column("text"))

        def full(r: int) -> np.ndarray:
            if r not in sets:
                h, _, _, first = words.words(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]))
                sets[r] = distinct(*shingles(h, first, k))[0]
            return sets[r]

        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        a, b = [], []
        for x in left.tolist():
            y = right[right > x] if low == high else right
            y = y[(label[y] != label[x]) & (den * np.minimum(size[y], size[x]) >= num * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            alike = (sig[y] == sig[x]).mean(1)
            order = np.argsort(-alike, kind="stable")
            for z in y[order[alike[order] >= ESTIMATE]].tolist():
                if label[z] == label[x]:
                    continue
                s, t = full(x), full(z)
                pos = np.minimum(np.searchsorted(s, t), len(s) - 1)
                both = int((s[pos] == t).sum())
                if den * both >= num * (len(s) + len(t) - both):
                    a.append(ids[x])
                    b.append(ids[z])
                    label[label == label[z]] = label[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("key", "_i", "_j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    texts = doc_text(docs)
    sketches = materialize(sketch(docs, k))
    some = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = materialize(some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "sketch"))
    buckets = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = materialize(buckets.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("_n")).filter("_n > 1").select("key", "center"))
    held = materialize(buckets.join(shared, "key").select("key", "doc_id", "center"))
    stars = materialize(held.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct())
    one = texts.dropDuplicates(["doc_id"]) if _repeats(texts) else texts
    links = materialize(confirm(stars, one, k, similarity))
    labels = connected_components(links)
    labelled = held.select("key", "doc_id").join(labels.select(F.col("v").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("key")
    rest = materialize(labelled.join(mixed, "key", "left_semi"))
    if not rest.isEmpty():
        # buckets that share a document are searched as one, so that no pair is met in each of its buckets
        whole = rest.groupBy("key").agg(F.min("doc_id").alias("a")).join(rest, "key").select("a", F.col("doc_id").alias("b"))
        joint = connected_components(whole).select(F.col("v").alias("doc_id"), F.col("label").alias("key"))
        members = joint.join(rest.select("doc_id", "label").distinct(), "doc_id").join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id")
        more = materialize(linked_blocks(members, one, k, similarity))
        labels = connected_components(links.unionByName(more))
    named = classes.select("fp1", "fp2", "n_shingles", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("fp1", "fp2", F.col("n_shingles").alias("_n"), F.coalesce("label", "rep").alias("_label"))
    same = (sketches["fp1"] == named["fp1"]) & (sketches["fp2"] == named["fp2"]) & (sketches["n_shingles"] == named["_n"]) & sketches["doc_id"].isNotNull()
    out = sketches.join(named, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_label", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(texts: DataFrame) -> bool:
    n = texts.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n[0] != n[1]


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
