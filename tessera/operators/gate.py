"""Relevance gate, vocabulary and topic anchors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_terms, ngrams, tokenize
from tessera.operators.bm25 import PostingsIndex

MIN_COVERAGE, MIN_COSINE = 0.20, 0.40
STOP = ["the", "and", "of", "to", "in", "is", "was", "for", "on", "with", "der", "die", "das", "und", "ist", "le", "la", "les", "de", "et", "el", "los", "que", "en"]


def vocabulary(chunks: DataFrame) -> DataFrame:
    """term, df over chunks (content)."""
    return chunks.select(F.explode(F.array_distinct(tokenize(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bigrams_held(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """term of terms whose character bigrams all occur somewhere in the chunks: words that a tokenizer cut otherwise there. terms: a short list of a few questions' terms."""
    each = terms.select("term", F.explode(F.array_distinct(ngrams(F.col("term"), 2))).alias("gram"))
    wanted = each.agg(F.collect_set("gram").alias("_wanted"))  # one row
    pairs = F.regexp_extract_all(F.lower("content"), F.lit("(?s)(?=(..))"), F.lit(1))  # linear in the text, where substrings by place aren't
    here = chunks.crossJoin(F.broadcast(wanted)).select(F.explode(F.array_intersect(pairs, "_wanted")).alias("gram")).distinct()
    return each.join(here.withColumn("_here", F.lit(True)), "gram", "left").groupBy("term").agg(F.bool_and(F.coalesce("_here", F.lit(False))).alias("ok")).filter("ok").select("term")


def document_frequency(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df of terms: the chunks that hold it, else 1 where all its bigrams occur, else null."""
    df = vocabulary(chunks).join(terms, "term", "left_semi")
    near = bigrams_held(chunks, terms.join(df, "term", "left_anti").filter(F.length("term") >= 2))
    return df.unionByName(near.select("term", F.lit(1).cast("long").alias("df")))


def coverage(questions: DataFrame, chunks: DataFrame, fallback: bool = False, index: PostingsIndex | None = None) -> DataFrame:
    """query_id, coverage, absent: idf-weighted share of a question's content terms that the chunks hold; 1 without content terms. fallback: terms count as held where their bigrams are.

    index: stored postings of just these chunks; counts come from it, with the fallback and by its tokenizer, and no text is read.
    """
    held = index.lengths() if index else None
    n = (chunks if held is None else held).agg(F.count("*").alias("n"))
    tokens = index.tokenizer if index else tokenize
    terms = questions.select("query_id", F.explode_outer(content_terms(tokens(F.col("question")), STOP)).alias("term"))
    asked = terms.filter("term IS NOT NULL").select("term").distinct()
    df = index.document_frequency(asked) if held is not None else document_frequency(chunks, asked) if fallback else vocabulary(chunks).join(asked, "term", "left_semi")
    known = terms.join(df, "term", "left").crossJoin(n)  # n is one row
    idf = F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = known.withColumn("idf", F.when(F.col("term").isNotNull(), idf))
    out = weighed.groupBy("query_id").agg(F.sum(F.when(F.col("df") > 0, F.col("idf"))).alias("present"), F.sum("idf").alias("all"), F.array_sort(F.collect_set(F.when(F.col("df").isNull(), F.col("term")))).alias("absent"))
    share = F.when(F.col("all").isNull(), 1.0).otherwise(F.coalesce("present", F.lit(0.0)) / F.col("all"))
    return out.select("query_id", F.round(share, 4).alias("coverage"), F.slice("absent", 1, 8).alias("absent"))


def assess(covered: DataFrame, top_cosine: DataFrame) -> DataFrame:
    """no_relevant: both signals low. top_cosine: query_id, cosine."""
    low = (F.col("coverage") < MIN_COVERAGE) & (F.coalesce("cosine", F.lit(0.0)) < MIN_COSINE)
    return covered.join(top_cosine, "query_id", "left").withColumn("no_relevant", low)


def _pairs(t: Column, between: str) -> Column:
    return F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(between, F.element_at(t, i), F.element_at(t, i + 1)))).otherwise(F.array().cast("array<string>"))


def anchor_vocabulary(chunks: DataFrame, max_df: int = 8) -> DataFrame:
    """Terms and pairs of neighbouring terms in 1 to max_df documents (doc, content): what a question can be about."""
    words = chunks.select("doc", tokenize(F.col("content")).alias("t"))
    both = words.select("doc", F.explode(F.array_distinct(F.concat(content_terms(F.col("t"), STOP), _pairs(F.col("t"), " ")))).alias("term")).distinct()
    return both.groupBy("term").agg(F.count("*").alias("docs")).filter(F.col("docs") <= max_df)


def whole_anchor_vocabulary(chunks: DataFrame, titles: DataFrame, blocked: list[str], max_df: int = 8, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """term, source (title, title_gram, body, pair), docs: terms and 2-grams of titles (doc, title) in any number of documents, body terms and their pairs in 1 to max_df.

    blocked terms, single characters and numbers go; keep says which body tokens count, by part of speech say; all by default.
    """
    title = titles.select("doc", tokenize(F.col("title")).alias("t"), F.lower("title").alias("title"))
    body = chunks.select("doc", tokenize(F.col("content")).alias("t"))
    words = F.filter("t", keep) if keep else F.col("t")
    parts = [
        title.select("doc", F.lit("title").alias("source"), F.explode("t").alias("term")),
        title.select("doc", F.lit("title_gram").alias("source"), F.explode(F.filter(ngrams(F.col("title"), 2), lambda g: g.rlike("^[\\p{L}\\p{N}]{2}$"))).alias("term")),
        body.select("doc", F.lit("body").alias("source"), F.explode(F.array_distinct(words)).alias("term")),
        body.select("doc", F.lit("pair").alias("source"), F.explode(F.array_distinct(_pairs(words, ""))).alias("term")),
    ]
    every = reduce(DataFrame.unionByName, parts).filter((F.length("term") >= 2) & ~F.col("term").rlike("^[0-9_]+$") & ~F.col("term").isin([*STOP, *blocked]))
    counted = every.distinct().groupBy("source", "term").agg(F.count("*").alias("docs"))
    return counted.filter(F.col("source").isin("title", "title_gram") | (F.col("docs") <= max_df))


def anchor_counts(vocabulary: DataFrame) -> DataFrame:
    """source, terms of a whole anchor vocabulary."""
    return vocabulary.groupBy("source").agg(F.count_distinct("term").alias("terms"))


def anchors(questions: DataFrame, terms: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """query_id, terms: the 2- to 4-grams of a question that the vocabulary holds, sorted."""
    grams = F.array_distinct(F.concat(*[ngrams(F.lower("question"), n) for n in sizes]))
    hits = questions.select("query_id", F.explode(grams).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return questions.select("query_id").join(hits, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def has_anchor(questions: DataFrame, terms: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """query_id, anchors: how many different 2- to 4-grams of a question the vocabulary (term) holds."""
    grams = F.array_distinct(F.concat(*[ngrams(F.col("question"), n) for n in sizes]))
    hits = questions.select("query_id", F.explode(grams).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("query_id").agg(F.count("*").alias("anchors"))
    return questions.select("query_id").join(hits, "query_id", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))


def sweep(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold, survive, detect: shares kept of in-scope scores and turned away of others. scores: score, in_scope; thresholds: a short list."""
    return scores.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(
        F.avg(F.when(F.col("in_scope"), (F.col("score") >= F.col("threshold")).cast("double"))).alias("survive"),
        F.avg(F.when(~F.col("in_scope"), (F.col("score") < F.col("threshold")).cast("double"))).alias("detect"),
    )
