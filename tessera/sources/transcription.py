"""Pictures of text: which pages and images are transcribed, and where the transcripts go among a document's blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

MAX_PAGES, MAX_IMAGES, MIN_PIXELS, ANCHOR_CHARS, ANCHOR_LEAST = 20, 20, 64, 16, 4


def no_transcriber(images: list[bytes]) -> list[str | None]:
    """The default where no model is at hand."""
    return [None] * len(images)


def transcribe(images: DataFrame, call: Callable[[list[bytes]], list[str | None]] = no_transcriber, batch: int = 10) -> DataFrame:
    """images (doc, page, ref, image) with their text; rows without any go. call gets batches and runs in the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t for i in range(0, len(frame), batch) for t in call([bytes(x) for x in frame["image"][i : i + batch]])]
            out = frame[["doc", "page", "ref"]].assign(text=texts)
            yield out[out["text"].notna()]

    return images.select("doc", "page", "ref", "image").mapInPandas(run, "doc string, page int, ref string, text string")


class TranscriptCache:
    """Transcripts by the hash of the image's bytes, in a folder that only grows: a picture that was read once, in whatever document, makes no call again.

    Files are added whole, so two writers don't meet; where both read the same picture, the smaller text counts. Pictures without a transcript are asked again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def texts(self) -> DataFrame:
        """hash, text."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "hash string, text string")
        return self.spark.read.schema("hash string, text string").parquet(self.folder).groupBy("hash").agg(F.min("text").alias("text"))

    def transcribe(self, images: DataFrame, call: Callable[[list[bytes]], list[str | None]] = no_transcriber, batch: int = 10) -> DataFrame:
        """As transcribe, where call sees each different image once, and only those that the cache doesn't hold."""
        hashed = images.filter("image IS NOT NULL").withColumn("hash", F.sha2("image", 256))
        new = hashed.join(self.texts(), "hash", "left_anti").groupBy("hash").agg(F.any_value("image").alias("image"))
        asked = new.select(F.col("hash").alias("doc"), F.lit(0).alias("page"), F.col("hash").alias("ref"), "image")
        transcribe(asked, call, batch).select(F.col("doc").alias("hash"), "text").write.mode("append").parquet(self.folder)
        return hashed.select("doc", "page", "ref", "hash").join(self.texts(), "hash").select("doc", "page", "ref", "text")


def red_pages(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """The first red pages of each document (doc, page, level)."""
    order = W.Window.partitionBy("doc").orderBy("page")
    return pages.filter("level = 'red'").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def inline_images(images: DataFrame, most: int = MAX_IMAGES, pixels: int = MIN_PIXELS) -> DataFrame:
    """Images (doc, page, ref, width, height, level) worth a transcript: not on red pages, not small, each once, the first of a document."""
    seen = W.Window.partitionBy("doc", "ref").orderBy("page")
    order = W.Window.partitionBy("doc").orderBy("page", "ref")
    large = images.filter((F.col("level") != "red") & (F.col("width") >= pixels) & (F.col("height") >= pixels))
    once = large.withColumn("_n", F.row_number().over(seen)).filter("_n = 1")
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", "")


def insert_positions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images (doc, page, ref, above: nearest text above, null at a page's top) with pos: blocks (doc, page, seq, text) of the page before it.

    It stands after the last block that holds the first characters of that text, and at the page's end if none does.
    """
    order = W.Window.partitionBy("doc", "page").orderBy("seq")
    numbered = blocks.withColumn("_i", F.row_number().over(order)).select("doc", "page", "_i", _bare(F.col("text")).alias("_text"))
    snippet = F.substring(_bare(F.col("above")), 1, ANCHOR_CHARS)
    hit = F.when((F.length("_snippet") >= ANCHOR_LEAST) & F.contains("_text", "_snippet"), F.col("_i"))
    found = images.withColumn("_snippet", snippet).join(numbered, ["doc", "page"], "left").groupBy("doc", "page", "ref").agg(F.max(hit).alias("_hit"), F.coalesce(F.max("_i"), F.lit(0)).alias("_all"))
    pos = F.when(F.col("above").isNull(), 0).otherwise(F.coalesce("_hit", "_all"))
    return images.join(found, ["doc", "page", "ref"]).withColumn("pos", pos).drop("_hit", "_all")


def merge_transcripts(blocks: DataFrame, pages: DataFrame, inline: DataFrame) -> DataFrame:
    """doc, seq, page, origin, text: blocks (doc, page, seq, text, level) without those of red pages, transcripts of red pages (doc, page, text) at
    their page's end, even where nothing else is left of it, and those of images (doc, page, pos, ref, text) at their places."""
    order = W.Window.partitionBy("doc", "page").orderBy("seq")
    plain = blocks.filter("level <> 'red'").withColumn("_i", F.row_number().over(order))
    sizes = plain.groupBy("doc", "page").agg(F.max("_i").alias("_all"))
    put = inline.join(sizes, ["doc", "page"]).withColumn("_slot", F.greatest(F.lit(0), F.least("pos", "_all")) * 2)
    parts = [
        plain.select("doc", "page", (F.col("_i") * 2 - 1).alias("_slot"), F.lit("").alias("_ref"), F.lit("block").alias("origin"), "text"),
        put.select("doc", "page", "_slot", F.col("ref").alias("_ref"), F.lit("image").alias("origin"), "text"),
        pages.select("doc", "page", F.lit((1 << 31) - 1).alias("_slot"), F.lit("").alias("_ref"), F.lit("page").alias("origin"), "text"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    place = F.row_number().over(W.Window.partitionBy("doc").orderBy("page", "_slot", "_ref")) - 1
    return both.select("doc", place.alias("seq"), "page", "origin", "text")


def replace_images(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """blocks (doc, seq, block_type, text, ref: null or a picture's) with pictures as paragraphs of their text (texts: doc, ref, text); pictures without one go."""
    said = texts.select("doc", "ref", F.col("text").alias("_said"))
    out = blocks.join(said, ["doc", "ref"], "left").filter("ref IS NULL OR _said IS NOT NULL")
    return out.withColumns({"block_type": F.when(F.col("ref").isNotNull(), "paragraph").otherwise(F.col("block_type")), "text": F.coalesce("_said", "text")}).select(blocks.columns)


def fill_images(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """blocks (doc, seq, block_type, text, ...) whose n-th image block of a document says the transcripts of its pictures (texts: doc, ref n:k, text), one to a line, as replace_images."""
    nth = F.when(F.col("block_type") == "image", F.row_number().over(W.Window.partitionBy("doc", F.col("block_type") == "image").orderBy("seq")) - 1)
    parts = texts.filter("trim(text) <> ''").select("doc", F.split("ref", ":").alias("p"), "text")
    lines = parts.groupBy("doc", F.col("p")[0].alias("ref")).agg(F.array_sort(F.collect_list(F.struct(F.col("p")[1].cast("int").alias("k"), "text"))).alias("l")).select("doc", "ref", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return replace_images(blocks.withColumn("ref", nth.cast("string")), lines).drop("ref")
