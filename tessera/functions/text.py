"""Text measures and keys as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs, CJK punctuation and full-width forms, each counted as one token.
WIDE = "[\\u4e00-\\u9fff\\u3000-\\u303f\\uff00-\\uffef]"
WORD = "[\\p{L}\\p{N}_]+"
#: Full-width forms and their ASCII twins.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokenize_mixed(text: Column) -> Column:
    """As tokenize, but runs of CJK ideographs, which have no spaces, become their overlapping pairs; a lone one is a token."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[\\u4e00-\\u9fff]+|[\\p{L}\\p{N}_&&[^\\u4e00-\\u9fff]]+"), F.lit(0))
    pairs = lambda t: F.regexp_extract_all(t, F.lit("(?=(..))"), F.lit(1))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike("^[\\u4e00-\\u9fff]{2,}$"), pairs(t)).otherwise(F.array(t))))


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams of a string; none if it is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def est_tokens(text: Column) -> Column:
    """Wide characters plus a third of the ASCII word characters, that third at least 1."""
    ascii_chars = F.length(F.regexp_replace(text, "[^A-Za-z0-9_]", ""))
    return F.regexp_count(text, F.lit(WIDE)) + F.greatest(F.lit(1), F.floor(ascii_chars / 3)).cast("int")


def normalize(text: Column) -> Column:
    """Full-width to half-width, all white space out, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, FULL_WIDTH, HALF_WIDTH), "(?U)[\\s\\u3000]+", ""))


def doc_id(tenant: Column, doc_key: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", tenant, doc_key), 256), 1, 12))


def chunk_id(doc: Column, version: Column, index: Column) -> Column:
    return F.format_string("%s_%04d_%05d", doc, version, index)


def parse_chunk_id(value: Column) -> dict[str, Column]:
    """Document, version and index of a chunk id; null where it isn't one."""
    pattern = "^(.+)_(\\d{4})_(\\d{5})$"
    part = lambda i: F.when(value.rlike(pattern), F.regexp_extract(value, pattern, i))
    return {"doc": part(1), "version": part(2).cast("int"), "chunk_index": part(3).cast("int")}


def filename_date(name: Column) -> tuple[Column, Column]:
    """(date as YYYY or YYYY-MM-DD, year) of the first year in a file name; null without one."""
    pattern = "(20\\d{2})[-_]?(\\d{2})?[-_]?(\\d{2})?"
    year, month, day = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    full = (month != "") & (day != "")
    return F.when(year != "", F.when(full, F.concat_ws("-", year, month, day)).otherwise(year)), F.when(year != "", year.cast("int"))


def years(question: Column) -> Column:
    """Sorted different years 20xx that stand alone in a question."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit("(?<!\\d)(20\\d{2})(?!\\d)"), F.lit(1)), lambda y: y.cast("int"))))


def content_terms(tokens: Column, stop: list[str]) -> Column:
    """Tokens that say something: not stop words, at least two characters, not digits alone; repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(stop) & (F.length(t) >= 2) & ~t.rlike("^[0-9_]+$"))


def clean(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "")


def garble_count(text: Column) -> Column:
    """Replacement and control characters other than TAB, LF and CR."""
    return F.regexp_count(text, F.lit("[\\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))


def has_garble(text: Column) -> Column:
    """A replacement character, or control characters over 1 %."""
    return F.contains(text, F.lit("�")) | (garble_count(text) > 0.01 * F.length(text))


def split_pages(text: Column, pages: Column) -> Column:
    """Texts of `pages` pages parted by form feeds, line feeds at their ends out; missing pages are empty, the last takes what is over."""
    parts = F.transform(F.split(text, "\f", -1), lambda p: F.btrim(p, F.lit("\n")))
    n = F.size(parts)
    over = F.concat(F.slice(parts, F.lit(1), pages - 1), F.array(F.array_join(F.slice(parts, pages, n), "\f")))
    return F.when(n < pages, F.concat(parts, F.array_repeat(F.lit(""), (pages - n).cast("int")))).when(n > pages, over).otherwise(parts)


def join_lines(text: Column) -> Column:
    """Lines as one paragraph: stripped, empty ones out, a space between two only where both sides are ASCII."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    spaced = F.regexp_replace(F.array_join(lines, "\n"), "(?<=[\\x00-\\x7f])\\n(?=[\\x00-\\x7f])", " ")
    return F.replace(spaced, F.lit("\n"), F.lit(""))
