"""Operator 6, line dedup, in DataFrame operations alone: levelled sorted runs of line hashes, compacted periodically.

A run is a table sorted by key hash with, for each key, the number of documents and the largest doc_id that hold it.
Batches of documents, of BATCH_DOCS at most and BATCHES at least, come by falling ranges of doc_id. Each is summed to one row for a key, merge-anti-joined with the
keys that a run has settled already (held by enough documents, so that neither their verdict nor their largest doc_id
can change), and added as a run of level 0. FANOUT runs of a level are compacted to one of the next, so a key is
rewritten log(batches) times. The merged runs then say which keys lose their lines. Sums by key are combined before the
shuffle, so a line that a third of all documents hold is one row for each task; the join that takes verdicts back to lines
is one that adaptive execution splits where a key is hot.

Defined cases: columns of docs keep their values whatever their names; null or empty text is one empty line and never dropped; rows with a null doc_id keep all lines and
don't count; repeated rows of one doc_id count as one document and keep a row each; very long texts are handled in
blocks of lines; lines that tie go in order of doc_id, the largest keeps its own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_shared, shared_dir

MIN_CHARS, MIN_DOCS, BATCHES, BATCH_DOCS, FANOUT, BLOCK_LINES = 20, 3, 4, 1 << 30, 3, 1024
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """Keys of all lines: stripped of ASCII white space at both ends, A-Z lower-cased; other letters stay."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def key_hashes(text: Column) -> Column:
    """128 bits of each line's key as two longs; null where the key is too short."""
    return F.transform(line_keys(text), lambda x: F.when(F.char_length(x) >= MIN_CHARS, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))))


def summed(keys: DataFrame) -> DataFrame:
    return keys.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """The levels of sorted runs, Parquet tables in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout, self.levels, self.made = spark, folder, fanout, {}, 0

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        path = f"{self.folder}/run-{self.made}"
        df.sortWithinPartitions("a", "b").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        parts = [self.spark.read.schema("a long, b long, n_docs long, last_doc long").parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts)

    def add(self, keys: DataFrame, min_docs: int = MIN_DOCS) -> None:
        """One batch of (a, b, n_docs, last_doc), a row for each key, all of its documents below those of earlier batches."""
        known = [p for ps in self.levels.values() for p in ps]
        if known:
            settled = self._read(known).filter(F.col("n_docs") >= min_docs).select("a", "b")
            keys = keys.hint("merge").join(settled, ["a", "b"], "left_anti")
        level, path = 0, self._write(keys)
        while True:
            self.levels.setdefault(level, []).append(path)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels.pop(level)
            path = self._write(summed(self._read(merged)))
            for old in merged:
                drop_shared(self.spark, old)
            level += 1

    def merged(self) -> DataFrame:
        paths = [p for ps in self.levels.values() for p in ps]
        return summed(self._read(paths))


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the whole text), pos, k (hash of the key) for each line with a key."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(key_hashes(F.col("text"))).alias("pos", "k"))
    return lines.filter("k IS NOT NULL")


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, folder: str | None = None) -> DataFrame:
    """a, b, last_doc of the keys that at least min_docs documents hold, through the levelled runs."""
    spark = docs.sparkSession
    runs = LineRuns(spark, folder or shared_dir(spark))
    ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    once = ids[0] == ids[1]  # once: no doc_id has two rows, so keys need only be made distinct in each row
    batches = batches or max(BATCHES, -(-ids[0] // BATCH_DOCS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    for above, below in zip(edges[1:], edges, strict=False):
        part = docs.filter("doc_id IS NOT NULL")
        part = part if below is None else part.filter(F.col("doc_id") <= below)
        part = part if above is None else part.filter(F.col("doc_id") > above)
        if once:
            held = part.select("doc_id", F.explode(F.array_distinct(key_hashes(F.col("text")))).alias("k")).filter("k IS NOT NULL")
        else:
            held = line_hashes(part).select("k", "doc_id").distinct()
        held = held.select("k.a", "k.b", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_doc"))
        runs.add(summed(held), min_docs)
    return runs.merged().filter(F.col("n_docs") >= min_docs).select("a", "b", "last_doc")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, folder: str | None = None) -> DataFrame:
    """All columns of docs, text without the dropped lines, and n_lines, n_dropped where docs has no columns of that name."""
    base = docs.select(F.struct("*").alias("row"))  # names of the caller's columns can't clash with those used here
    base = base.select("row", F.col("row.doc_id").cast("long").alias("_id"), F.coalesce(F.col("row.text"), F.lit("")).alias("_body"))
    plain = base.select(F.col("_id").alias("doc_id"), F.col("_body").alias("text"))
    keys = repeated_keys(plain, min_docs, batches, folder)
    at = line_hashes(plain).select("doc_id", "_text", "pos", "k.a", "k.b").join(keys, ["a", "b"])
    at = at.filter(F.col("doc_id") != F.col("last_doc")).groupBy("doc_id", "_text", (F.col("pos") / BLOCK_LINES).cast("int").alias("block")).agg(F.collect_set("pos").alias("gone"))
    gone = at.groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.map_from_entries(F.collect_list(F.struct("block", "gone"))).alias("_gone"), F.sum(F.size("gone")).cast("long").alias("_n"))
    joined = base.withColumn("_text", F.xxhash64("_body")).join(gone, ["_id", "_text"], "left")
    lines = F.split("_body", "\n", -1)

    def kept(lines: Column) -> Column:
        def block(b: Column) -> Column:
            gone_here = F.coalesce(F.col("_gone")[b], F.array().cast("array<int>"))
            return F.filter(F.slice(lines, b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), lambda _, i: ~F.array_contains(gone_here, i + b * BLOCK_LINES))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), ((F.size(lines) - 1) / BLOCK_LINES).cast("int")), block)), "\n")

    made = {"text": F.when(F.col("_gone").isNull(), F.col("_body")).otherwise(kept(lines)), "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("_n", F.lit(0)).cast("long")}
    own = [(made["text"] if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return joined.select(*own, *[made[c].alias(c) for c in ("n_lines", "n_dropped") if c not in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND k.doc_id <> r.last_doc) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (r.key IS NOT NULL AND k.doc_id <> r.last_doc)), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""
