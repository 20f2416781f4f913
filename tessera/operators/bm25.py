"""The lexical road: Okapi BM25 for a whole table of questions at once, over corpora that each question's filters choose.

Statistics (document count, mean length, idf) belong to a filter signature, not to the corpus, so questions with the
same signature share them. Only postings of asked terms reach the scoring join; ranking keeps k rows for each question
in every task before it shuffles. PostingsIndex keeps the postings, so that a search reads no text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions.text import ngrams, tokenize
from tessera.operators.scratch import kept
from tessera.operators.sinks import read_file, write_file
from tessera.operators.store import Conflict, Store

K1, B, EPSILON = 1.5, 0.75, 0.25


def lengths(eligible: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """sig, chunk, ord, terms of eligible chunks (sig, chunk, ord, content)."""
    return eligible.select("sig", "chunk", "ord", tokens(F.col("content")).alias("terms"))


def _raw(df: DataFrame, n: DataFrame) -> DataFrame:
    return df.join(F.broadcast(n), "sig").withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # n: a row for each signature


def _idf(raw: DataFrame, mean: DataFrame) -> DataFrame:
    return raw.join(F.broadcast(mean), "sig", "left").select("sig", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _from_tokens(tokens: DataFrame) -> DataFrame:
    df = tokens.select("sig", F.explode(F.array_distinct("terms")).alias("term")).groupBy("sig", "term").agg(F.count("*").alias("df"))
    raw = _raw(df, tokens.groupBy("sig").agg(F.count("*").alias("n")))
    return _idf(raw, raw.groupBy("sig").agg(F.avg("raw").alias("mean")))


def idf_table(eligible: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """sig, term, df, idf: terms in more than half of a corpus get EPSILON times the mean idf of it."""
    return _from_tokens(lengths(eligible, tokenizer))


def asked_terms(questions: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """query_id, sig, term, times of questions (query_id, sig, question)."""
    return questions.select("query_id", "sig", F.explode(tokenizer(F.col("question"))).alias("term")).groupBy("query_id", "sig", "term").agg(F.count("*").alias("times"))


def scored(docs: DataFrame, postings: DataFrame, idf: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk, ord, score of chunks with an asked term. docs: sig, chunk, ord, dl; postings: sig, chunk, term, tf of asked terms; idf: sig, term, idf."""
    stats = docs.groupBy("sig").agg(F.avg("dl").alias("avgdl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = postings.join(idf, ["sig", "term"]).join(docs, ["sig", "chunk"]).join(F.broadcast(stats), "sig").withColumn("w", weight)  # stats: a row for each signature
    return met.join(asked, ["sig", "term"]).groupBy("query_id", "chunk", "ord").agg(F.sum(F.col("w") * F.col("times")).alias("score"))


def ranked(docs: DataFrame, postings: DataFrame, idf: DataFrame, asked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, chunk, ord, score, rank; see scored. Chunks without any asked term fill up to k in order of ord."""
    hits = scored(docs, postings, idf, asked)
    first = docs.withColumn("_n", F.row_number().over(W.Window.partitionBy("sig").orderBy("ord"))).filter(F.col("_n") <= k)
    fill = questions.select("query_id", "sig").join(first.select("sig", "chunk", "ord"), "sig").join(hits.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti")
    both = hits.unionByName(fill.select("query_id", "chunk", "ord", F.lit(0.0).alias("score")))
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def _parts(eligible: DataFrame, questions: DataFrame, tokenizer: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, postings, idf and asked terms as scored takes them; texts are tokenized once: the terms are written, and statistics, postings and fill read their columns."""
    tokens = kept(lengths(eligible, tokenizer).withColumn("dl", F.size("terms")))
    asked = kept(asked_terms(questions, tokenizer))
    terms = asked.select("sig", "term").distinct()
    postings = tokens.select("sig", "chunk", F.explode("terms").alias("term")).join(terms, ["sig", "term"], "left_semi").groupBy("sig", "chunk", "term").agg(F.count("*").alias("tf"))
    return tokens.select("sig", "chunk", "ord", "dl"), postings, _from_tokens(tokens).join(terms, ["sig", "term"], "left_semi"), asked


def first_ranks(eligible: DataFrame, questions: DataFrame, expected: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """query_id, rank in the whole corpus of the best expected chunk (query_id, chunk) of each question (query_id, sig, question): one more than the chunks before it, without ranking any.

    Only chunks with an asked term are counted one by one. All others score 0 and stand in order of ord, so what they add is a difference of counts by ord.
    """
    docs, postings, idf, asked = _parts(eligible, questions, tokenizer)
    hits = kept(scored(docs, postings, idf, asked).withColumn("score", F.round("score", 9)))
    wanted = expected.select("query_id", "chunk").distinct().join(questions.select("query_id", "sig"), "query_id").join(docs.select("sig", "chunk", "ord"), ["sig", "chunk"])
    wanted = wanted.join(hits.select("query_id", "chunk", "score"), ["query_id", "chunk"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = kept(wanted.groupBy("query_id", "sig").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord")).alias("b")).select("query_id", "sig", (-F.col("b.minus")).alias("best"), F.col("b.ord").alias("at")))
    before = (F.col("score") > F.col("best")) | ((F.col("score") == F.col("best")) & (F.col("ord") < F.col("at")))
    among = hits.join(best, "query_id").groupBy("query_id").agg(F.count_if(before).alias("hits_before"), F.count("*").alias("hits_all"), F.count_if(F.col("ord") < F.col("at")).alias("hits_below"))
    below = _counts_below(docs, best.filter("best = 0").select("sig", F.col("at").alias("ord")).distinct())
    sizes = docs.groupBy("sig").agg(F.count("*").alias("n"))
    out = best.join(among, "query_id", "left").join(sizes, "sig").join(below.withColumnRenamed("ord", "at"), ["sig", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    fill = F.when(F.col("best") > 0, 0).when(F.col("best") < 0, F.col("n") - zero("hits_all")).otherwise(zero("below") - zero("hits_below"))
    return out.select("query_id", (1 + zero("hits_before") + fill).alias("rank"))


def _counts_below(docs: DataFrame, places: DataFrame) -> DataFrame:
    """sig, ord, below: how many docs (sig, ord) stand before each place (sig, ord). Ranges of ord are counted whole; only a place's own range is counted row by row."""
    both = docs.select("sig", "ord", F.lit(0).alias("place")).unionByName(places.select("sig", "ord", F.lit(-1).alias("place")))
    ranges = kept(both.repartitionByRange("sig", "ord").withColumn("part", F.spark_partition_id()))
    whole = ranges.groupBy("sig", "part").agg(F.count_if(F.col("place") == 0).alias("n"))
    ahead = whole.withColumn("ahead", F.sum("n").over(W.Window.partitionBy("sig").orderBy("part")) - F.col("n")).select("sig", "part", "ahead")  # a row for each range
    here = W.Window.partitionBy("sig", "part").orderBy("ord", "place").rowsBetween(W.Window.unboundedPreceding, 0)
    own = ranges.join(places.select("sig").distinct(), "sig", "left_semi").withColumn("inside", F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).over(here)).filter("place = -1")
    return own.join(ahead, ["sig", "part"]).select("sig", "ord", (F.col("ahead") + F.col("inside")).alias("below"))


def search(eligible: DataFrame, questions: DataFrame, k: int = 20, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """query_id, chunk, ord, score, rank of the k best chunks for each question (query_id, sig, question).

    Chunks without any asked term score 0 and fill up to k in order of ord. tokenizer: of questions and contents alike.
    """
    docs, postings, idf, asked = _parts(eligible, questions, tokenizer)
    return ranked(docs, postings, idf, asked, questions, k)


class PostingsIndex:
    """A stored inverted index below `folder`: postings (term, chunk, tf) in files by bucket of the term, lengths (chunk, dl), both a delta for each commit; readers take what is newest of each chunk.

    A delta also has what the relevance gate asks of a corpus: pairs, the distinct pairs of neighbouring characters of each of its chunks, and changes (pair, n), by how many
    chunks a pair is held more or less since. Counts add up over deltas, so chunks that go are subtracted and no text is read again.

    A commit writes a delta and then a new manifest over the old one, so a reader sees a commit whole or not at all; its cost is that of its own chunks. A search reads the buckets
    of asked terms alone. Who may see a chunk is not kept here: eligible chunks come with the search.
    """

    BUCKETS, MERGE_AFTER = 64, 32

    def __init__(self, spark: SparkSession, folder: str, tokenizer: Callable[[Column], Column] = tokenize, store: Store | None = None) -> None:
        self.spark, self.folder, self.tokenizer, self.store = spark, folder.rstrip("/"), tokenizer, store
        self.name = self.folder.rsplit("/", 1)[-1]
        if store is not None:
            store.table(self.name, lambda deltas: [f"{self.folder}/{d}" for d, _ in deltas])

    def manifest(self) -> list[list]:
        """[delta, whether it has postings] of the current state."""
        if self.store is not None:
            return self.store.get(self.name) or []
        raw = read_file(self.spark, f"{self.folder}/MANIFEST")
        return json.loads(raw) if raw else []

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.BUCKETS)).cast("int")

    def rebuild(self, chunks: DataFrame) -> None:
        """The index as one delta of these chunks (chunk, content); readers see the old deltas until it is whole."""
        self.commit(chunks, anew=True)

    def commit(self, added: DataFrame, gone: DataFrame | None = None, anew: bool = False) -> None:
        """One delta: chunks (chunk, content) that come or change, and ids (chunk) that go. anew: it takes the place of all others."""
        deltas = self.manifest()
        path, seq = f"{self.folder}/delta-{uuid.uuid4().hex}", F.lit(len(deltas)).alias("seq")
        words = kept(added.select("chunk", self.tokenizer(F.col("content")).alias("terms")))
        sizes = words.select("chunk", F.size("terms").alias("dl"), seq)
        (sizes if gone is None else sizes.unionByName(gone.select("chunk", F.lit(None).cast("int").alias("dl"), seq))).write.parquet(f"{path}/lengths")
        posts = words.select("chunk", F.explode("terms").alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("tf")).select("term", "chunk", "tf", seq, self._bucket(F.col("term")).alias("bucket"))
        posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        pairs = kept(added.select("chunk", F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("(?s)(?=(..))"), F.lit(1))).alias("pairs"), seq))  # linear in the text, where substrings by place aren't
        pairs.write.parquet(f"{path}/pairs")
        counted = [pairs.select(F.explode("pairs").alias("pair"), F.lit(1).alias("n"))]
        if deltas and not anew:
            left = added.select("chunk") if gone is None else added.select("chunk").unionByName(gone.select("chunk"))
            before = self.lengths().select("chunk", "seq").join(left, "chunk", "left_semi").join(self._read("pairs"), ["chunk", "seq"])
            counted.append(before.select(F.explode("pairs").alias("pair"), F.lit(-1).alias("n")))
        reduce(DataFrame.unionByName, counted).groupBy("pair").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(f"{path}/changes")
        after = [*([] if anew else deltas), [path.rsplit("/", 1)[-1], not words.isEmpty()]]
        if self.manifest() != deltas:
            raise Conflict("another commit came between; nothing was changed")
        if self.store is not None:
            self.store.set(self.name, after)
        else:
            write_file(self.spark, f"{self.folder}/MANIFEST", json.dumps(after).encode())

    def sync(self, chunks: DataFrame) -> None:
        """One delta that makes the index hold just these chunks (chunk, content); chunks that it holds aren't read again."""
        held = self.lengths()
        if len(self.manifest()) >= self.MERGE_AFTER:
            self.rebuild(chunks)
            return
        added = chunks if held is None else chunks.join(held.select("chunk"), "chunk", "left_anti")
        self.commit(added, None if held is None else held.select("chunk").join(chunks.select("chunk"), "chunk", "left_anti"))

    def _read(self, kind: str) -> DataFrame | None:
        paths = [f"{self.folder}/{d}/{kind}" for d, _ in self.manifest()]
        return self.spark.read.parquet(*paths) if paths else None

    def document_frequency(self, terms: DataFrame) -> DataFrame:
        """term, df of terms (term): the chunks that hold it, else 1 where all its pairs of characters occur in some chunk; others have no row. As gate.document_frequency, without a text."""
        held = self.lengths()
        if held is None:
            return terms.select("term", F.lit(0).cast("long").alias("df")).limit(0)
        df = kept(self.postings(terms).join(held.select("chunk", "seq"), ["chunk", "seq"]).groupBy("term").agg(F.count("*").alias("df")))
        near = self._pairs_held(terms.join(df, "term", "left_anti").filter(F.length("term") >= 2))
        return df.unionByName(near.select("term", F.lit(1).cast("long").alias("df")))

    def _pairs_held(self, terms: DataFrame) -> DataFrame:
        each = terms.select("term", F.explode(F.array_distinct(ngrams(F.col("term"), 2))).alias("pair"))
        here = self._read("changes").join(each.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
        return each.join(here, "pair", "left").groupBy("term").agg(F.bool_and(F.col("n").isNotNull()).alias("ok")).filter("ok").select("term")

    def lengths(self) -> DataFrame | None:
        """chunk, dl, seq of the chunks that the index holds."""
        every = self._read("lengths")
        if every is None:
            return None
        newest = every.groupBy("chunk").agg(F.max_by(F.struct("dl", "seq"), F.struct("seq", F.col("dl").isNotNull())).alias("r"))
        return newest.select("chunk", "r.*").filter("dl IS NOT NULL")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, chunk, tf, seq: all, or of terms (term), from their buckets alone."""
        paths = [f"{self.folder}/{d}/postings" for d, held in self.manifest() if held]
        if not paths:
            kind = self.lengths().schema["chunk"].dataType.simpleString()
            return self.spark.createDataFrame([], f"term string, chunk {kind}, tf long, seq int")
        every = reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths])  # MERGE_AFTER deltas at most
        if terms is None:
            return every
        buckets = [r[0] for r in terms.select(self._bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
        return every.filter(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")

    def search(self, eligible: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
        """As search over eligible chunks (sig, chunk, ord); only where an asked term is in over half of a corpus are all terms counted, for its mean idf."""
        docs = kept(eligible.select("sig", "chunk", "ord").join(self.lengths(), "chunk"))
        asked = kept(asked_terms(questions, self.tokenizer))
        found = kept(self.postings(asked.select("term").distinct()).join(docs.select("sig", "chunk", "seq"), ["chunk", "seq"]).select("sig", "chunk", "term", "tf"))
        n = docs.groupBy("sig").agg(F.count("*").alias("n"))
        raw = kept(_raw(found.groupBy("sig", "term").agg(F.count("*").alias("df")), n).join(asked.select("sig", "term").distinct(), ["sig", "term"], "left_semi"))
        often = raw.filter("raw < 0").select("sig").distinct()
        mean = raw.sparkSession.createDataFrame([], raw.select("sig", F.col("raw").alias("mean")).schema)
        if not often.isEmpty():
            some = docs.join(often, "sig", "left_semi").select("sig", "chunk", "seq")
            df = self.postings().join(some, ["chunk", "seq"]).groupBy("sig", "term").agg(F.count("*").alias("df"))
            mean = _raw(df, n).groupBy("sig").agg(F.avg("raw").alias("mean"))
        return ranked(docs.drop("seq"), found, _idf(raw, mean), asked, questions, k)


def by_ids(eligible: DataFrame, ids: DataFrame) -> DataFrame:
    """Eligible chunks of a list of ids (chunk), with score 0."""
    return eligible.join(ids.select("chunk").distinct(), "chunk", "left_semi").withColumn("score", F.lit(0.0))
