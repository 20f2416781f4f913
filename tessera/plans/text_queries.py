"""Text measures, keys, format sniffing, page quality, parsing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, gate
from tessera.plans.fixtures import CHUNKS_SQL, QUESTIONS_SQL, chunks, questions, table
from tessera.sources import files

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.vocabulary(chunks(spark, sf_dir))


def est_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.est_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("est_tokens"))


EST = r"(len(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]')) + greatest(1, length(regexp_replace({0}, '[^A-Za-z0-9_]', '', 'g')) // 3))::BIGINT"


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.est_tokens(F.col("content")).cast("long")
    return chunks(spark, sf_dir).groupBy("source").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("chunks"), F.sum(t).alias("tokens"), F.round(5 / F.count("*"), 6).alias("top5_coverage"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("ＡＢｃ１２！　"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(odd)).alias("digest"), F.length(T.normalize(odd)).cast("long").alias("n"))


def doc_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("chunk", T.doc_id(F.col("tenant_id"), F.concat(F.lit("file_"), F.col("doc").cast("string"), F.lit(".md"))).alias("doc_key_id"))


def chunk_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks(spark, sf_dir).select("chunk", T.chunk_id(F.concat(F.lit("doc_a_0001_"), F.col("doc").cast("string")), F.col("version"), F.col("chunk_index")).alias("chunk_id"))
    return made.select("chunk", "chunk_id", *[c.alias(k) for k, c in T.parse_chunk_id(F.col("chunk_id")).items()])


def filename_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("policy_"), (2020 + d % 7).cast("string"), F.lit("-"), F.lpad((1 + d % 12).cast("string"), 2, "0"), F.lit("-05.md"))).when(d % 3 == 1, F.concat(F.lit("plan"), (2020 + d % 7).cast("string"), F.lit(".txt"))).otherwise(F.lit("notes.txt"))
    date, year = T.filename_date(F.col("name"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", date.alias("doc_date"), year.alias("doc_year"))


def years_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that turns of conversations name, every third with two more of its own."""
    asked = F.concat_ws(" ", "text", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("in "), (2015 + F.col("turn")).cast("string"), F.lit(", 2021 and 20231"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(T.years(asked).cast("array<string>"), ",").alias("years"))


def page_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, F.lit(200)).substr(F.lit(1), (F.col("doc_id") % 200).cast("int")).alias("text"), (F.col("doc_id") % 5).alias("images"))
    return pages.select("doc_id", *[c.alias(k) for k, c in files.grade_page(F.col("text"), F.col("images")).items()]).withColumn("text_chars", F.col("text_chars").cast("long"))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = page_grade(spark, sf_dir).withColumn("doc", F.floor(F.col("doc_id") / 10))
    return graded.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == "red", F.col("doc_id")))).cast("array<string>"), ",").alias("red"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == "yellow", F.col("doc_id")))).cast("array<string>"), ",").alias("yellow"), F.count_if(F.col("level") == "green").alias("green"))


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("doc"), (F.col("doc_id") % 3).alias("page"), F.posexplode(F.split(F.concat(F.lit("HEAD\n"), F.coalesce("text", F.lit(""))), "\n", -1)).alias("seq", "text"))


def header_footer_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.strip_repeated_edges(_page_blocks(spark, sf_dir)).groupBy("doc", "page").agg(F.count("*").alias("blocks"))


def txt_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return files.txt_paragraphs(docs).select("doc", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("digest"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    name = F.concat(F.lit("f"), p.cast("string"), F.element_at(F.array(F.lit(".PDF"), F.lit(".markdown"), F.lit(".bin"), F.lit(".html")), (p % 4 + 1).cast("int")))
    head = F.element_at(F.array(F.lit("%PDF-1.7"), F.lit("# title\n"), F.lit("")), (p % 3 + 1).cast("int"))
    body = F.encode(F.concat(head, F.substring("html", 1, 500)), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", files.detect_format(name, body).alias("format"))


def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", files.looks_like_text(F.substring(html, 1, 1024)).alias("is_text"), T.has_garble(html).alias("garbled"), html.rlike("(?m)^\\s*# ").alias("has_heading"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\nx = 1\n```\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit("md").alias("format"), text.alias("text"), F.lit(None).cast("binary").alias("content"))


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_blocks(_markdown(spark, sf_dir))


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(md_blocks(spark, sf_dir).withColumn("page", F.lit(1)))


def anchor_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.anchor_vocabulary(chunks(spark, sf_dir))


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = gate.vocabulary(chunks(spark, sf_dir)).filter(F.length("term").between(2, 4))
    return gate.has_anchor(questions(spark), short)


_GRADE = r"""pages AS (SELECT doc_id, substr(substr(coalesce(text, ''), 1, 200), 1, doc_id % 200) AS text, doc_id % 5 AS images FROM documents),
m AS (SELECT doc_id, images, length(trim(translate(text, chr(9) || chr(10) || chr(13), ''), ' ')) AS text_chars, len(regexp_extract_all(text, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]')) AS g FROM pages),
graded AS (SELECT doc_id, CASE WHEN (CASE WHEN text_chars > 0 THEN g / text_chars ELSE 0 END) > 0.01 OR text_chars < 20 THEN 'red' WHEN text_chars < 100 OR images >= 3 THEN 'yellow' ELSE 'green' END AS level,
  text_chars, round(CASE WHEN text_chars > 0 THEN g / text_chars ELSE 0.0 END, 4) AS garble_ratio FROM m)"""

QUERIES = {
    "tokens_df": (tokens_df, f"WITH {CHUNKS_SQL} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('content')})) AS term FROM chunks) GROUP BY term"),
    "est_tokens": (est_tokens, f"SELECT doc_id, {EST.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS est_tokens FROM documents"),
    "corpus_stats": (corpus_stats, f"WITH {CHUNKS_SQL} SELECT source, count(DISTINCT doc) AS docs, count(*) AS chunks, sum({EST.format('content')})::BIGINT AS tokens, round(5 / count(*), 6) AS top5_coverage FROM chunks GROUP BY source"),
    "normalize_text": (normalize_text, r"WITH n AS (SELECT doc_id, 'abc12!' || lower(regexp_replace(coalesce(text, ''), '[\s\x{3000}\x{00a0}\x{2028}\x{2029}\x{0085}\x0b\x{2000}-\x{200a}\x{202f}\x{205f}\x{1680}]+', '', 'g')) AS s FROM documents) SELECT doc_id, md5(s) AS digest, length(s)::BIGINT AS n FROM n"),
    "doc_id_hash": (doc_id_hash, f"WITH {CHUNKS_SQL} SELECT chunk, 'doc_' || substr(sha256(tenant_id || ':file_' || doc || '.md'), 1, 12) AS doc_key_id FROM chunks"),
    "chunk_id_parse": (chunk_id_parse, f"WITH {CHUNKS_SQL}, c AS (SELECT chunk, printf('doc_a_0001_%d_%04d_%05d', doc, 1, chunk_index) AS chunk_id FROM chunks) SELECT chunk, chunk_id, regexp_extract(chunk_id, '^(.+)_(\\d{{4}})_(\\d{{5}})$', 1) AS doc, regexp_extract(chunk_id, '^(.+)_(\\d{{4}})_(\\d{{5}})$', 2)::INT AS version, regexp_extract(chunk_id, '^(.+)_(\\d{{4}})_(\\d{{5}})$', 3)::INT AS chunk_index FROM c"),
    "filename_date": (filename_date, "WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'policy_' || (2020 + doc_id % 7) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-05.md' WHEN 1 THEN 'plan' || (2020 + doc_id % 7) || '.txt' ELSE 'notes.txt' END AS name FROM documents) SELECT doc_id, name, CASE doc_id % 3 WHEN 0 THEN substr(name, 8, 10) WHEN 1 THEN substr(name, 5, 4) END AS doc_date, CASE doc_id % 3 WHEN 0 THEN substr(name, 8, 4)::INT WHEN 1 THEN substr(name, 5, 4)::INT END AS doc_year FROM n"),
    "years_in_query": (years_in_query, r"WITH q AS (SELECT *, concat_ws(' ', text, CASE WHEN conv_id % 3 = 0 THEN 'in ' || (2015 + turn) || ', 2021 and 20231' END) AS question FROM conversations) SELECT conv_id, turn, role, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(question, '[0-9]+'), lambda y: length(y) = 4 AND y LIKE '20%'))), ',') AS years FROM q"),
    "page_grade": (page_grade, f"WITH {_GRADE} SELECT * FROM graded"),
    "page_summary": (page_summary, f"WITH {_GRADE} SELECT doc_id // 10 AS doc, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (level = 'red'), '') AS red, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (level = 'yellow'), '') AS yellow, count(*) FILTER (level = 'green') AS green FROM graded GROUP BY 1"),
    "header_footer_strip": (header_footer_strip, """WITH l AS (SELECT doc_id // 3 AS doc, doc_id % 3 AS page, unnest(string_split('HEAD' || chr(10) || coalesce(text, ''), chr(10))) AS text, unnest(range(1 + len(string_split(coalesce(text, ''), chr(10))))) AS seq FROM documents),
e AS (SELECT *, seq = min(seq) OVER p OR seq = max(seq) OVER p AS edge FROM l WINDOW p AS (PARTITION BY doc, page)),
n AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc),
s AS (SELECT doc, text, count(DISTINCT page) AS c FROM e WHERE edge GROUP BY doc, text),
r AS (SELECT s.doc, s.text FROM s JOIN n ON s.doc = n.doc WHERE c >= 3 OR pages >= 2 AND c = pages)
SELECT e.doc, page, count(*) AS blocks FROM e LEFT JOIN r ON e.doc = r.doc AND e.text = r.text WHERE NOT (edge AND r.doc IS NOT NULL) GROUP BY e.doc, page"""),
    "txt_paragraphs": (txt_paragraphs, r"WITH p AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents) SELECT doc, unnest(range(len(ps))) AS seq, md5(unnest(ps)) AS digest FROM p"),
    "detect_format": (detect_format, "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' ELSE CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN regexp_matches(['', '# title' || chr(10), ''][page_id % 3 + 1] || substr(html, 1, 500), '(?m)^\\s*# ') THEN 'md' ELSE 'txt' END END AS format FROM pages"),
    "html_sniff": (html_sniff, r"SELECT page_id, NOT contains(substr(coalesce(html, ''), 1, 1024), chr(0)) AND len(regexp_extract_all(substr(coalesce(html, ''), 1, 1024), '[\x00-\x08\x0b\x0c\x0e-\x1f]')) < 0.1 * greatest(1, length(substr(coalesce(html, ''), 1, 1024))) AS is_text, contains(coalesce(html, ''), chr(65533)) OR len(regexp_extract_all(coalesce(html, ''), '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]')) > 0.01 * length(coalesce(html, '')) AS garbled, regexp_matches(coalesce(html, ''), '(?m)^\s*# ') AS has_heading FROM pages"),
    "md_blocks": (md_blocks, None),
    "chunk_docs": (chunk_docs, None),
    "anchor_vocab": (anchor_vocab, f"""WITH {CHUNKS_SQL}, t AS (SELECT doc, {TOKENS.format('content')} AS t FROM chunks),
w AS (SELECT doc, unnest(t) AS term FROM t), s AS (SELECT DISTINCT doc, term FROM w WHERE term NOT IN ({', '.join(f"'{x}'" for x in gate.STOP)}) AND length(term) >= 2 AND NOT regexp_full_match(term, '[0-9_]+')
  UNION SELECT DISTINCT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM t)
SELECT term, count(*) AS docs FROM s GROUP BY term HAVING count(*) <= 8"""),
    "anchor_match": (anchor_match, f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, v AS (SELECT DISTINCT unnest({TOKENS.format('content')}) AS term FROM chunks),
g AS (SELECT DISTINCT query_id, substr(question, i, n) AS term FROM (SELECT query_id, question, n, unnest(range(1, length(question) - n + 2)) AS i FROM questions, (VALUES (2), (3), (4)) s(n)))
SELECT q.query_id, count(v.term) AS anchors FROM questions q LEFT JOIN g ON q.query_id = g.query_id LEFT JOIN v ON g.term = v.term AND length(v.term) BETWEEN 2 AND 4 GROUP BY q.query_id"""),
}
