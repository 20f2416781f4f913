"""Files to rows: collection, format detection, text decoding, parsing to blocks, page quality."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.functions.text import clean, garble_count

SUFFIXES = {"pdf": "pdf", "docx": "docx", "md": "md", "markdown": "md", "txt": "txt"}
BLOCKS = "doc string, seq int, block_type string, text string, heading_level int, language string, warning string"
_TABLE_RULE = re.compile(r"^\|?[\s:\-|]+\|?\s*$")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]+\)")


def collect(spark: SparkSession, sources: list[str]) -> tuple[DataFrame, list[str]]:
    """(path, length, content of the files, sources that don't exist). Folders give their supported files at any depth, told by name before a byte is read; a file named itself is taken whatever its suffix."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders, plain, missing = [], [], []
    for source in sources:
        p = jvm.org.apache.hadoop.fs.Path(source)
        fs = p.getFileSystem(conf)
        (missing if not fs.exists(p) else folders if fs.getFileStatus(p).isDirectory() else plain).append(source)
    anycase = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in name) for name in SUFFIXES)
    reader = spark.read.format("binaryFile")
    parts = [reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{anycase}}}").load(folders)] if folders else []
    if plain:
        parts.append(spark.read.format("binaryFile").load(plain))
    if not parts:
        return spark.createDataFrame([], "path string, length long, content binary"), missing
    return reduce(DataFrame.unionByName, parts).select("path", "length", "content"), missing


def collect_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of all supported files below a folder. Order by path where it matters: contents aren't moved for it here."""
    return collect(spark, [folder])[0]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))


def detect_format(path: Column, content: Column) -> Column:
    """pdf, docx, md, txt or unsupported: the suffix is trusted, else the first 1024 bytes decide, and of a zip its table of contents.

    Text is UTF-8, where a character cut by the 1024th byte doesn't count, or else GBK. Only archives and heads that aren't UTF-8 go through Python.
    """
    by_suffix = F.lit(None).cast("string")
    for name, kind in SUFFIXES.items():
        by_suffix = F.when(suffix(path) == name, kind).otherwise(by_suffix)
    head = F.substring(content, 1, 1024)
    magic = F.hex(F.substring(head, 1, 4))
    zipped = magic.isin("504B0304", "504B0506")
    whole = _without_cut(head).cast("string")
    utf8 = F.is_valid_utf8(whole)
    other = by_suffix.isNull() & ~zipped & ~magic.isin("25504446", "D0CF11E0")
    text = F.when(utf8, whole).otherwise(gbk_text(F.when(other & ~utf8, head)))
    sniffed = (
        F.when(magic == "25504446", "pdf")
        .when(zipped, sniff_zip(F.when(by_suffix.isNull() & zipped, content)))
        .when(magic == "D0CF11E0", "unsupported")
        .when(text.isNotNull() & looks_like_text(text), F.when(text.rlike("(?m)^\\s*# "), "md").otherwise("txt"))
        .otherwise("unsupported")
    )
    return F.coalesce(by_suffix, sniffed)


def _without_cut(head: Column) -> Column:
    """A full head of 1024 bytes without the bytes of a UTF-8 character that its end cuts."""
    n = F.octet_length(head)
    byte = lambda back: F.conv(F.hex(F.substring(head, n - back, F.lit(1))), 16, 10).cast("int")
    drop = F.when(byte(0) >= 0xC0, 1).when((byte(1) >= 0xE0) & (byte(0) >= 0x80), 2).when((byte(2) >= 0xF0) & (byte(1) >= 0x80) & (byte(0) >= 0x80), 3).otherwise(0)
    return F.when(n < 1024, head).otherwise(F.substring(head, F.lit(1), n - drop))


def looks_like_text(head: Column) -> Column:
    """No NUL, and control characters under a tenth."""
    control = F.regexp_count(head, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    return ~F.contains(head, F.lit("\x00")) & (control < 0.1 * F.greatest(F.lit(1), F.length(head)))


@F.pandas_udf(T.StringType())
def gbk_text(head: pd.Series) -> pd.Series:
    """The head as GBK, without a character that its end cuts; null where it isn't that."""

    def one(raw: bytes | None) -> str | None:
        for some in (raw, raw[:-1] if raw and len(raw) == 1024 else None):
            try:
                return some.decode("gbk") if some is not None else None
            except UnicodeDecodeError:
                continue
        return None

    return head.map(one).astype(object)


@F.pandas_udf(T.StringType())
def sniff_zip(content: pd.Series) -> pd.Series:
    """docx for an office package (word, and by the same rule xl and ppt), unsupported for any other archive."""

    def one(raw: bytes) -> str:
        try:
            names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
        except (zipfile.BadZipFile, TypeError):
            return "unsupported"
        return "docx" if "[Content_Types].xml" in names and any(n.startswith(("word/", "xl/", "ppt/")) for n in names) else "unsupported"

    return content.map(one)


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8, else GBK, else UTF-8 with replacements; line ends become LF."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for code, errors in (("utf-8", "strict"), ("gbk", "strict"), ("utf-8", "replace")):
            try:
                return raw.decode(code, errors).replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeDecodeError:
                continue
        return ""

    return content.map(one)


def txt_paragraphs(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """key, seq, text: blank-line paragraphs, stripped, empty ones out."""
    parts = F.transform(F.split(F.col(text), "\n\n", -1), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    return docs.select(key, F.posexplode(F.filter(parts, lambda p: p != "")).alias("seq", "text"))


def cjk_heading(line: str) -> int | None:
    """Level of a Chinese section heading of at most 40 characters: chapter 1, section 2, numbers by their dots up to 3, other numbered ones 3; null for other lines."""
    if not line or len(line) > 40:
        return None
    number = "[一二三四五六七八九十百千零〇0-9]+"
    if re.match(f"第{number}章", line):
        return 1
    if re.match(f"第{number}[节条]", line):
        return 2
    if dotted := re.match(r"([0-9]+(?:\.[0-9]+)+)\s*[\u4e00-\u9fff]", line):
        return min(3, dotted[1].count(".") + 1)
    if ended := re.match(r"([0-9]+(?:\.[0-9]+)*[.、])\s*[\u4e00-\u9fff]", line):
        return min(3, ended[1].count(".") + 1)
    return 3 if re.match("[一二三四五六七八九十]+、", line) else None


def markdown_blocks(text: str, cjk: bool = False) -> list[tuple[str, str, int | None, str | None, str | None]]:
    """(type, text, heading level, code language, warning) by a scan of lines; a paragraph ends before any other block. cjk: Chinese section headings without signs count, as page text has lost its signs."""
    blocks: list[tuple] = []
    paragraph: list[str] = []

    def flush() -> None:
        if joined := "\n".join(paragraph).strip():
            blocks.append(("paragraph", joined, None, None, None))
        paragraph.clear()

    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        if bare.startswith("```"):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith("```")), None)
            blocks.append(("code", "\n".join(lines[i + 1 : end]), None, bare[3:].strip() or None, None if end is not None else "fence not closed"))
            i = len(lines) if end is None else end + 1
            continue
        heading = re.match(r"^(#{1,6})\s+(\S.*)$", bare)
        if heading:
            flush()
            blocks.append(("heading", heading[2].strip(), len(heading[1]), None, None))
        elif bare.startswith("|"):
            j = i
            while j < len(lines) and lines[j].strip().startswith("|"):
                j += 1
            if j - i >= 2 and _TABLE_RULE.match(lines[i + 1].strip()):
                flush()
                blocks.append(("table", "\n".join(x.strip() for x in lines[i:j]), None, None, None))
            else:
                paragraph.extend(lines[i:j])
            i = j
            continue
        elif _IMAGE.fullmatch(bare):
            flush()
            blocks.append(("image", bare, None, None, None))
        elif not bare:
            flush()
        elif cjk and (level := cjk_heading(bare)):
            flush()
            blocks.append(("heading", bare, level, None, None))
        else:
            paragraph.append(line)
        i += 1
    flush()
    return blocks


def docx_blocks(raw: bytes) -> list[tuple[str, str, int | None, str | None, str | None]]:
    """Paragraphs, headings, tables and image places of a word-processing file in body order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    out: list[tuple] = []
    for node in body if body is not None else []:
        if node.tag == f"{w}p":
            style = node.find(f"{w}pPr/{w}pStyle")
            level = re.match(r"(?:Heading|标题)\s*([1-3])$", style.get(f"{w}val", "")) if style is not None else None
            if text := said(node).strip():
                out.append(("heading" if level else "paragraph", text, int(level[1]) if level else None, None, None))
            if next(node.iter(f"{w}drawing"), None) is not None:
                out.append(("image", "[图片]", None, None, None))
        elif node.tag == f"{w}tbl":
            rows = [[said(c).replace("\n", " ") for c in r.findall(f"{w}tc")] for r in node.findall(f"{w}tr")]
            if rows:
                rows.insert(1, ["---"] * len(rows[0]))
                out.append(("table", "\n".join("| " + " | ".join(r) + " |" for r in rows), None, None, None))
    return out


def docx_pictures(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(number of the image block among docx_blocks, number in it, bytes) of the pictures that a word-processing file embeds; a picture whose part is missing is left out."""
    w, a, r = ("{http://schemas.openxmlformats.org/" + x for x in ("wordprocessingml/2006/main}", "drawingml/2006/main}", "officeDocument/2006/relationships}"))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        held = set(z.namelist())
        if "word/_rels/document.xml.rels" not in held:
            return []
        targets = {e.get("Id"): posixpath.normpath(posixpath.join("/word", e.get("Target", "")))[1:] for e in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if e.get("TargetMode") != "External"}
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        drawn = [d for d in ([b for b in p.iter(f"{w}drawing")] for p in (body.findall(f"{w}p") if body is not None else [])) if d]
        out = []
        for i, drawings in enumerate(drawn):
            parts = [targets.get(blip.get(f"{r}embed")) for d in drawings for blip in d.iter(f"{a}blip")]
            out += [(i, k, z.read(part)) for k, part in enumerate(parts) if part in held]
        return out


def pictures(docs: DataFrame) -> DataFrame:
    """doc, page (0), ref (image block's number : number in it), image of docs (doc, format, content) in docx; a file that can't be read has none, as parse_blocks reports it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["doc"], frame["content"], strict=True):
                try:
                    found = docx_pictures(content)
                except (ValueError, TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    found = []
                yield pd.DataFrame([(doc, 0, f"{i}:{k}", image) for i, k, image in found], columns=["doc", "page", "ref", "image"])

    return docs.filter("format = 'docx'").select("doc", "content").mapInPandas(run, "doc string, page int, ref string, image binary")


def garbled(text: str) -> bool:
    """As has_garble: a replacement character, or control characters over 1 %."""
    return "\ufffd" in text or len(_CONTROL.findall(text)) > 0.01 * len(text)


def parse_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc, format, text, content): text formats from text, docx from content; a document that can't be read is one block of type error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, kind, text, content in zip(frame["doc"], frame["format"], frame["text"], frame["content"], strict=True):
                try:
                    if kind == "docx":
                        found = docx_blocks(content)
                    elif kind == "md":
                        found = markdown_blocks(text or "")
                    elif kind == "txt":
                        found = [("paragraph", p.strip(), None, None, "garbled" if garbled(p) else None) for p in (text or "").split("\n\n") if p.strip()]
                    else:
                        raise ValueError(f"no parser for {kind}")
                except Exception as e:  # one broken file is a row, not a failed job
                    found = [("error", "", None, None, f"{type(e).__name__}: {e}")]
                rows += [(doc, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc", "seq", "block_type", "text", "heading_level", "language", "warning"]).astype({"heading_level": "Int32"})

    return docs.select("doc", "format", "text", "content").mapInPandas(run, BLOCKS)


def grade_page(text: Column, images: Column) -> dict[str, Column]:
    """level, text_chars, garble_ratio of a page: red if garbled or nearly empty, yellow if thin or full of images."""
    chars = F.length(F.trim(clean(text)))
    ratio = F.when(chars > 0, garble_count(text) / chars).otherwise(0.0)
    level = F.when((ratio > 0.01) | (chars < 20), "red").when((chars < 100) | (images >= 3), "yellow").otherwise("green")
    return {"level": level, "text_chars": chars, "garble_ratio": F.round(ratio, 4)}


def grade_signals(text: Column, images: Column) -> Column:
    """What made a page red or yellow, in words; empty for a green one."""
    g = grade_page(text, images)
    said = [F.when(g["garble_ratio"] > 0.01, "garbled"), F.when(g["text_chars"] < 20, "nearly empty"), F.when((g["text_chars"] >= 20) & (g["text_chars"] < 100), "thin"), F.when(images >= 3, "many images")]
    return F.array_compact(F.array(*said))


def summarize_pages(pages: DataFrame, by: str = "doc") -> DataFrame:
    """by, pages, green, yellow, red and share of green pages of graded pages (by, level)."""
    n = lambda level: F.count_if(F.col("level") == level)
    return pages.groupBy(by).agg(F.count("*").alias("pages"), n("green").alias("green"), n("yellow").alias("yellow"), n("red").alias("red")).withColumn("green_share", F.round(F.col("green") / F.col("pages"), 4))


PAGE_BLOCKS = "doc string, page int, seq int, block_type string, text string, heading_level int, language string, warning string"


def pdf_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of a PDF's pages (doc, page, text, image_count, encrypted): red pages stay raw and flagged, others are read as markdown with Chinese headings, a page without blocks is its raw text; then texts that pages repeat at their edges go.

    A document with an encrypted page is one block of type error.
    """
    locked = pages.filter("encrypted").select("doc").distinct()
    graded = pages.join(locked, "doc", "left_anti").withColumn("level", grade_page(F.col("text"), F.col("image_count"))["level"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, page, text, level in frame[["doc", "page", "text", "level"]].itertuples(index=False):
                text = text or ""
                raw = [("paragraph", text.strip(), None, None, "red page" if level == "red" else None)]
                found = raw if level == "red" else markdown_blocks(text, cjk=True) or raw
                rows += [(doc, page, i, *b) for i, b in enumerate(found) if b[1]]
            yield pd.DataFrame(rows, columns=["doc", "page", "seq", "block_type", "text", "heading_level", "language", "warning"]).astype({"heading_level": "Int32"})

    read = graded.select("doc", F.col("page").cast("int").alias("page"), "text", "level").mapInPandas(run, PAGE_BLOCKS)
    errors = locked.select("doc", F.lit(0).alias("page"), F.lit(0).alias("seq"), F.lit("error").alias("block_type"), F.lit("").alias("text"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("string").alias("language"), F.lit("encrypted").alias("warning"))
    return strip_repeated_edges(read).unionByName(errors)


def strip_repeated_edges(blocks: DataFrame) -> DataFrame:
    """Drops first and last blocks of pages (doc, page, seq, text) whose text is at the edge of 3 pages or, in documents of 2 pages or more, of all."""
    w = W.Window.partitionBy("doc", "page")
    edge = blocks.withColumn("_edge", (F.col("seq") == F.min("seq").over(w)) | (F.col("seq") == F.max("seq").over(w)))
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("_pages"))
    seen = edge.filter("_edge").groupBy("doc", "text").agg(F.count_distinct("page").alias("_n"))
    again = seen.join(pages, "doc").filter((F.col("_n") >= 3) | (F.col("_pages") >= 2) & (F.col("_n") == F.col("_pages"))).select("doc", "text", F.lit(True).alias("_again"))
    return edge.join(again, ["doc", "text"], "left").filter(~(F.col("_edge") & F.coalesce("_again", F.lit(False)))).select(blocks.columns)
