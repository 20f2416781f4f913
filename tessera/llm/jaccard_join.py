"""Operator 12, n-gram Jaccard join by T-occurrence search, closed to components.

Sets are the distinct shingles of whole texts as 64-bit hashes; documents with equal sets are one class, led by its smallest doc_id. Linked sets of m and more shingles share
T(m) = ceil(similarity * m) at least, so among the T-prefix of each (its m - T(m) + l(m) smallest hashes, l(m) = 1 + m / 20) the first l common ones lie in both prefixes.
A class is searched only if l(T(m)) of its prefix keys are held by other documents too; that test is necessary for a link, so it loses none, and it
is repeated on whole sets, with keys of other components, as components grow: members of one group of copies, however large, soon share nothing with others.

Search: a query's inverted lists are divided by DivideSkip. The longest lists are set aside, as many as keep the threshold above zero; the short ones are merged by a heap,
documents met often enough there are probed in the long ones by binary search until the exact overlap that the two sizes require is reached or out of reach. Documents
that are joined to the query already are not probed.

Distribution: in ROUNDS rounds classes meet by a minimum of their shared keys (and size); the smallest CENTERS of a meeting are the index, to which its members, dealt to parts
of bounded size, are queries: linear in a meeting's size. What still passes the test after these is searched whole: classes connected by shared keys are dealt to blocks
of bounded size, and every pair of blocks is one index and one set of queries. Only links that join two components leave a task.
Prefixes are read where they were written, and dropped after the first test; whole sets are written once in buckets of doc_id, so that ids and labels come to them: a set moves to its meetings and blocks alone.

Defined cases: null, empty or wordless text has an empty set and is linked with nothing; fewer words than a shingle are one shingle; very long texts are read whole; equal sets are
linked; rows with a null doc_id take no part (component_id null); repeated rows get the same answer each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import SPACE_BYTES, WordHasher, doc_text, drop_shared, materialize, materialize_by, mix64, release_caches, shared_dir, slices, string_buffers
from tessera.llm.components import connected_components
from tessera.llm.minmax_dedup import _repeats, distinct, shingles

WORDS, SIMILARITY = 4, (85, 100)
ROUNDS, CENTERS, PART_MEMBERS, PART_SHINGLES, BLOCK_MEMBERS, BLOCK_SHINGLES, RANGE_POSTINGS = 2, 8, 1024, 2_000_000, 512, 2_000_000, 2_000_000
#: Weight of a binary probe against a merge step in DivideSkip's rule for the number of long lists.
PROBE = 0.0085
PARTS = "range int, part binary, form int"
SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, prefix binary"


def required(m: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """T: the least overlap of a set of m with any set that it is linked to."""
    return -(-similarity[0] * m // similarity[1])


def least_common(m: np.ndarray) -> np.ndarray:
    """l: common shingles that linked sets of m and more surely have in both prefixes."""
    return 1 + m // 20


def sketch(docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Size, fingerprints and prefix of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words = WordHasher(SPACE_BYTES)
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                h, _, _, first = words.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, at = distinct(*shingles(h, first, k))
                m = np.diff(at)
                sums = [np.concatenate([[0], np.cumsum(mix64(s * np.uint64(f)), dtype=np.uint64)]).astype(np.uint64) for f in (1, 0xD6E8FEB86659FD93)]
                fp = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
                size = np.where(m > 0, m - required(m, similarity) + least_common(m), 0)
                ends = np.concatenate([[0], np.cumsum(size)])
                taken = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], size)
                low = s[taken]
                prefix = pa.array([low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m), pa.array(fp[0]), pa.array(fp[1]), prefix], ["doc_id", "n_shingles", "fp1", "fp2", "prefix"])

    return doc_text(docs).mapInArrow(run, SKETCH)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes) for docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        words = WordHasher(SPACE_BYTES)
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in slices(off):
                h, _, _, first = words.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, at = distinct(*shingles(h, first, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


class OccurrenceIndex:
    """Inverted lists of some sets; `joined` tells the component of each, and grows as links are found."""

    def __init__(self, ids: list[int], labels: list[int], sets: list[np.ndarray], similarity: tuple[int, int]) -> None:
        self.ids, self.labels, self.sizes, self.similarity = ids, labels, [len(s) for s in sets], similarity
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first, self.lists = np.append(first, len(flat)), owner[order].tolist()
        self.parent: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def overlap(self, a: int, b: int) -> int:
        """Common shingles that sets of these sizes need."""
        num, den = self.similarity
        return -(-num * (a + b) // (num + den))

    def link(self, label: int, query: np.ndarray) -> list[int]:
        """Ids of indexed documents linked to the query, one for each component that isn't joined to its label; joins them."""
        m = len(query)
        num, den = self.similarity
        least = self.overlap(m, -(-num * m // den))
        at = np.minimum(np.searchsorted(self.keys, query), max(0, len(self.keys) - 1))
        at = at[self.keys[at] == query] if len(self.keys) else at[:0]
        if not m or len(at) < least:
            return []
        low, high = self.first[at], self.first[at + 1]
        order = np.argsort(high - low, kind="stable")
        low, high = low[order].tolist(), high[order].tolist()
        aside = min(least - 1, int(least / (PROBE * math.log2(high[-1] - low[-1]) + 1)))
        short = len(low) - aside
        found = []
        for doc, met in groupby(heapq.merge(*(self.lists[a:b] for a, b in zip(low[:short], high[:short], strict=True)))):
            n, need = sum(1 for _ in met), self.overlap(m, self.sizes[doc])
            if n + aside < need or n < least - aside or self.root(self.labels[doc]) == self.root(label):
                continue
            for i in range(short, len(low)):
                if n >= need or n + len(low) - i < need:
                    break
                place = bisect_left(self.lists, doc, low[i], high[i])
                n += place < high[i] and self.lists[place] == doc
            if n >= need:
                found.append(self.ids[doc])
                self.parent[self.root(self.labels[doc])] = self.root(label)
        return found


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def search_centers(meetings: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join components in meetings (meeting, doc_id, label, n_shingles): of the CENTERS smallest members of each with one another and with all others."""
    parts = meetings.groupBy("meeting").agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / PART_MEMBERS), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("_parts"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    parts = materialize(parts.filter("_n > 1 AND _lo <> _hi").select("meeting", "_parts"))
    held = meetings.join(parts, "meeting")
    place = F.row_number().over(W.Window.partitionBy("meeting").orderBy("doc_id"))
    centers = held.withColumn("_at", place).filter(F.col("_at") <= CENTERS).select("meeting", "_parts", "doc_id", "label")
    own = held.join(centers.select("meeting", "doc_id"), ["meeting", "doc_id"], "left_anti").select("meeting", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), "doc_id", "label")
    led = centers.select("meeting", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "doc_id", "label")
    dealt = led.unionByName(own).hint("shuffle_hash").join(sets, "doc_id").repartition("meeting", "_part").sortWithinPartitions("meeting", "_part", "_kind", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        now, centers, index = None, [], None
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for meeting, part, kind, doc, label, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (meeting, part):
                    now, centers, index = (meeting, part), [], None
                mine = _hashes(data)
                if kind == 0:
                    centers.append((doc, label, mine))
                    if len(centers) > 1:
                        index = _with(index, centers[:-1], similarity)
                elif index is None or len(index.ids) < len(centers):
                    index = _with(index, centers, similarity)
                if index is not None:
                    found = index.link(label, mine)
                    a += found
                    b += [doc] * len(found)
            yield _links(a, b)

    return dealt.select("meeting", "_part", "_kind", "doc_id", "label", "shingles").mapInArrow(run, "a long, b long")


def _with(index: OccurrenceIndex | None, members: list[tuple], similarity: tuple[int, int]) -> OccurrenceIndex:
    """An index of the members that knows what an earlier one has joined."""
    new = OccurrenceIndex([x[0] for x in members], [x[1] for x in members], [x[2] for x in members], similarity)
    if index is not None:
        new.parent = index.parent
    return new


def search_blocks(members: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join components among members (key, doc_id, label, n_shingles) of one key, by blocks of bounded size.

    Members are at home in the band of their size and guests in the next one, as linked sets differ by one band at most. A task has one block of a band's homes as index; its queries are the
    same block, another one of homes, or one of guests."""
    band = F.floor(F.log("n_shingles") / math.log(similarity[1] / similarity[0])).cast("int")
    homes = members.select("key", band.alias("_band"), F.lit(False).alias("_guest"), "doc_id", "label", "n_shingles")
    placed = homes.unionByName(homes.withColumns({"_band": F.col("_band") + 1, "_guest": F.lit(True)}))

    def blocks(guest: bool) -> Column:
        some = F.col("_guest") == F.lit(guest)
        return F.greatest(F.ceil(F.count_if(some) / BLOCK_MEMBERS), F.ceil(F.coalesce(F.sum(F.when(some, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    sizes = placed.groupBy("key", "_band").agg(F.count("*").alias("_n"), blocks(False).alias("_homes"), blocks(True).alias("_guests")).filter("_homes > 0 AND _n > 1").drop("_n")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("_guest"), F.col("_guests")).otherwise(F.col("_homes"))).cast("int")
    dealt = placed.join(sizes, ["key", "_band"]).withColumn("_own", own)
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("_guest"), F.col("_homes")).otherwise(F.col("_homes") + F.col("_guests")) - 1)))
    asked = F.col("_guest") | (F.col("_other") < F.col("_own"))  # of a pair of blocks the first is the index
    i = F.when(asked, F.col("_other")).otherwise(F.col("_own"))
    j = F.when(F.col("_guest"), F.col("_homes") + F.col("_own")).when(asked, F.col("_own")).otherwise(F.col("_other"))
    spread = met.select("key", "_band", i.alias("_i"), j.alias("_j"), asked.alias("_asked"), "doc_id", "label").hint("shuffle_hash").join(sets, "doc_id")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending")])
        rows = list(zip(*(group[c].to_pylist() for c in ("doc_id", "label", "_asked", "shingles")), strict=True))
        held = [(d, x, _hashes(s)) for d, x, asked, s in rows if not asked]
        a: list[int] = []
        b: list[int] = []
        if held:
            index, same = _with(None, held, similarity), group["_i"][0].as_py() == group["_j"][0].as_py()
            for doc, label, asked, data in rows:
                if asked or same:
                    found = index.link(label, _hashes(data))
                    a += found
                    b += [doc] * len(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("key", "_band", "_i", "_j").applyInArrow(run, "a long, b long")


def _deal(keys: np.ndarray, ranges: int, *values: np.ndarray) -> pa.RecordBatch:
    """range, part, form: keys (sorted) with their values by ranges of the hash. Of a key the range and its low half are kept: keys that agree in both count as one, which can only
    make more of them look shared. One value of 32 bits goes as such, others as 64 bits; form tells how many values, 0 for a short one."""
    r = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(r, prepend=r[0] - np.uint64(1))) if len(r) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(r))[: len(cut)]
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    short = len(values) == 1 and (not len(keys) or 0 <= int(values[0].min()) and int(values[0].max()) < 1 << 32)
    rows = np.column_stack([low, *values]).astype(np.uint32 if short else np.int64)
    form = np.full(len(cut), 0 if short else len(values), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(r[cut].astype(np.int32)), pa.array([rows[x:y].tobytes() for x, y in zip(cut, ends, strict=True)], pa.binary()), pa.array(form)], ["range", "part", "form"])


def _rows(part: bytes, form: int) -> np.ndarray:
    """Rows (key, values) of a part."""
    return np.frombuffer(part, np.int64).reshape(-1, form + 1) if form else np.frombuffer(part, np.uint32).reshape(-1, 2).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and labels of a batch (doc_id, label, keys as bytes), sorted by key."""
    sets = [_hashes(x) for x in batch.column(2).to_pylist()]
    size = [len(x) for x in sets]
    keys = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.repeat(batch.column(0).to_numpy(), size)[order], np.repeat(batch.column(1).to_numpy(), size)[order]


def _combined(keys: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the least and greatest label and the number of documents of each."""
    if not len(keys):
        return keys, low, high, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[0] - np.uint64(1)))
    return keys[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at)


def shared_keys(members: DataFrame, ranges: int) -> DataFrame:
    """range, part (key and its number of documents, sorted), postings: the keys of members (doc_id, label, keys) that several components hold.

    Tasks combine their own postings of a key first, so a key that very many documents hold is a row from each; what a range holds is its distinct keys.
    Most keys are held once in a task and go with a label alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _, label = _flat(batch)
            keys, low, high, n = _combined(keys, label, label, np.ones(len(keys), np.int64))
            one = n == 1
            yield _deal(keys[one], ranges, low[one])
            yield _deal(keys[~one], ranges, low[~one], high[~one], n[~one])

    def several(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, size = (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3), [], 0

        def merge() -> tuple[np.ndarray, ...]:
            rows = np.concatenate([np.column_stack([held[0].view(np.int64), *held[1:]]), *more])
            return _combined(rows[:, 0].copy().view(np.uint64), *(rows[:, i] for i in (1, 2, 3)))

        for batch in parts:
            for part, form in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "form")), strict=True):
                rows = _rows(part, form)
                more.append(rows if form == 3 else np.column_stack([rows, rows[:, 1], np.ones(len(rows), np.int64)]))
                size += len(rows)
            if size > max(1_000_000, len(held[0])):
                held, more, size = merge(), [], 0
        keys, low, high, n = merge()
        some = low < high
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.column_stack([keys[some].view(np.int64), n[some]]).tobytes()], pa.binary()), pa.array([int(n.sum())])], ["range", "part", "postings"])

    dealt = members.select("doc_id", "label", "keys").mapInArrow(count, PARTS)
    return dealt.groupBy("range").applyInArrow(several, "range int, part binary, postings long")


def shared_postings(members: DataFrame) -> DataFrame:
    """doc_id, key (range and low half of the hash), df: the keys of members (doc_id, label, keys) that several components hold, and how many documents do.

    Postings stream past the shared keys of their range; a range with more postings than others is dealt to several tasks, each with the range's keys."""
    spark = members.sparkSession
    total = members.agg(F.sum(F.length("keys"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * RANGE_POSTINGS)))
    known = materialize(shared_keys(members, ranges))
    salts = F.ceil(F.col("postings") / (2 * -(-total // (8 * ranges)) + 1)).cast("int")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, doc, _ = _flat(batch)
            yield _deal(keys, ranges, doc)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = n = np.empty(0, np.int64)
        for batch in batches:
            out = []
            for kind, span, part, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _rows(part, form)
                if kind == 0:
                    keys, n = rows[:, 0].copy(), rows[:, 1]
                elif len(keys):
                    at = np.minimum(np.searchsorted(keys, rows[:, 0]), len(keys) - 1)
                    hit = keys[at] == rows[:, 0]
                    out.append(np.column_stack([rows[hit, 1], span << 32 | rows[hit, 0], n[at[hit]]]))
            all_rows = np.concatenate([*out, np.empty((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(all_rows[:, i].copy()) for i in range(3)], ["doc_id", "key", "df"])

    some = known.filter(F.length("part") > 0).select("range", salts.alias("_salts"), "part")
    lists = some.select("range", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), "part", F.lit(1).alias("form"))
    posts = members.select("doc_id", "label", "keys").mapInArrow(post, PARTS).join(F.broadcast(some.select("range", "_salts")), "range")  # a row for each range
    posts = posts.select("range", F.pmod(F.xxhash64("part"), F.col("_salts")).cast("int").alias("_salt"), F.lit(1).alias("_kind"), "part", "form")
    dealt = lists.unionByName(posts).repartition("range", "_salt").sortWithinPartitions("range", "_salt", "_kind")
    return dealt.select("_kind", "range", "part", "form").mapInArrow(meet, "doc_id long, key long, df long")


def components(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    texts = doc_text(docs)
    prefixes = shared_dir(docs.sparkSession)
    sketches = materialize(sketch(docs, k, similarity), prefixes)
    some = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    repeated = _repeats(sketches)  # then a doc_id is searched by one of its rows' sets
    once = (lambda rows: rows.dropDuplicates(["doc_id"])) if repeated else (lambda rows: rows)
    rows = once(some)
    least = F.ceil(F.col("n_shingles") * similarity[0] / similarity[1])

    def searchable(keys: DataFrame, sizes: DataFrame, need: Column, *more: Column) -> DataFrame:
        """Rows (doc_id, n_shingles, label) of sizes whose keys (doc_id, label, keys) count as many shared ones as a link needs; `more` is found of these."""
        held = shared_postings(keys).groupBy("doc_id").agg(F.count("*").alias("_held"), *more)
        return materialize(sizes.join(held, "doc_id").filter(F.col("_held") >= need).drop("_held"))

    # every copy counts as a holder of its own here, so that prefixes needn't be moved to find the representatives: more keys look shared, none fewer
    meet = [F.min(F.struct(F.xxhash64("key", F.lit(r)).alias("h"), F.col("key").alias("k"))).alias(f"_meet{r}") for r in range(ROUNDS)]
    reps = rows.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", F.col("doc_id").alias("label"))
    members = searchable(rows.select("doc_id", F.col("doc_id").alias("label"), F.col("prefix").alias("keys")), reps, 1 + F.floor(least / 20), *meet)
    sketches = materialize(sketches.drop("prefix"))
    drop_shared(docs.sparkSession, prefixes)
    searched = texts.join(members.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    sets, drop_sets = materialize_by(once(whole_sets(searched, k)), "doc_id")
    links = None

    def relabelled(rows: DataFrame) -> DataFrame:
        new = connected_components(links).select(F.col("v").alias("doc_id"), F.col("label").alias("_label"))
        return rows.join(new, "doc_id", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")

    for r in range(ROUNDS):
        size = F.floor(F.log("n_shingles") / math.log(similarity[1] / similarity[0]))
        meetings = members.select(F.xxhash64(F.col(f"_meet{r}.k"), size).alias("meeting"), "doc_id", "label", "n_shingles")
        found = materialize(search_centers(meetings, sets, similarity))
        links = found if links is None else links.unionByName(found)
        members = materialize(relabelled(members))
    keys = members.select("doc_id", "label").hint("shuffle_hash").join(sets.withColumnRenamed("shingles", "keys"), "doc_id")
    left = searchable(keys, members.select("doc_id", "n_shingles", "label"), least)
    whole = materialize(left.hint("shuffle_hash").join(sets.withColumnRenamed("shingles", "keys"), "doc_id"))
    if not whole.isEmpty():
        # members that went took shared keys with them; of those left, rarest first, a member and whatever it is linked to have one in common among all but need - 1
        held = shared_postings(whole).join(whole.select("doc_id", least.alias("_need")), "doc_id")
        mine = W.Window.partitionBy("doc_id")
        ranked = held.withColumns({"_place": F.row_number().over(mine.orderBy("df", "key")), "_held": F.count("*").over(mine)})
        rare = materialize(ranked.filter((F.col("_held") >= F.col("_need")) & (F.col("_place") <= F.col("_held") - F.col("_need") + 1)).select("key", "doc_id"))
        joint = connected_components(rare.groupBy("key").agg(F.min("doc_id").alias("a")).join(rare, "key").select("a", F.col("doc_id").alias("b")))
        grouped = whole.select("doc_id", "label", "n_shingles").join(joint.select(F.col("v").alias("doc_id"), F.col("label").alias("key")), "doc_id")
        links = links.unionByName(materialize(search_blocks(grouped, sets, similarity)))
    drop_sets()
    labels = connected_components(links)
    named = classes.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("fp1", "fp2", F.col("n_shingles").alias("_n"), F.coalesce("label", "rep").alias("_label"))
    same = (sketches["fp1"] == named["fp1"]) & (sketches["fp2"] == named["fp2"]) & (sketches["n_shingles"] == named["_n"]) & sketches["doc_id"].isNotNull()
    out = sketches.join(named, same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_label", "doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_sql(percent: int) -> str:
    """DuckDB's doc_id, n_shingles, component_id at this similarity."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
sized AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
each AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
both_hold AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_hold JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n_shingles + y.n_shingles - common)),
reach AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, n_shingles, component_id FROM sized JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


OP12_SQL = near_sql(85)
