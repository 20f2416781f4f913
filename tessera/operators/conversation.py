"""The deterministic part of question answering, for a table of turns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions.text import tokenize

HISTORY_MESSAGES, MESSAGE_CHARS, HISTORY_CHARS, EVIDENCE_CHARS = 20, 150, 1200, 500
CONFIDENCE, MAX_RETRY = 0.6, 2
CONTACT_WORDS = ["phone", "email", "contact", "hotline"]
CHAT_WORDS = ["hello", "hi", "thanks", "bye", "hallo", "merci", "hola"]
PRONOUNS = ["it", "this", "that", "these", "those", "they", "he", "she"]
REFERRING = ["the above", "as before", "the former", "the latter"]
#: Words that link to a head, and heads that say nothing alone.
LINKS = ["of the", "for the", "of"]
HEADS = ["rule", "rules", "process", "standard", "policy", "company", "manager", "employees"]
SELF_CONTAINED_CHARS, INTENT_CHARS = 6, 256
CITATION = "\\[source:\\s*([^\\]]+)\\]"


def last_messages(messages: DataFrame, keep: int = HISTORY_MESSAGES) -> DataFrame:
    """The last `keep` messages of each thread (thread, seq, role, content); n: 1 for the newest."""
    w = W.Window.partitionBy("thread").orderBy(F.desc("seq"))
    return messages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)


def history_budget(messages: DataFrame, keep: int = HISTORY_MESSAGES, per_message: int = MESSAGE_CHARS, budget: int = HISTORY_CHARS) -> DataFrame:
    """User and assistant messages that fit: newest first, each cut, until one doesn't; the newest always stays."""
    said = last_messages(messages.filter(F.col("role").isin("user", "assistant")), keep)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, per_message))
    w = W.Window.partitionBy("thread").orderBy("n")
    upto = F.sum(F.length("line") + 1).over(w) - 1
    fits = said.withColumn("line", line).withColumn("_fits", (F.col("n") == 1) | (upto <= budget))
    return fits.withColumn("_all", F.min(F.col("_fits").cast("int")).over(w)).filter("_all = 1").select("thread", "n", "line")


def rule_intent(question: Column) -> Column:
    """chitchat, contact_guidance or null by keywords."""
    low = F.lower(question)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", "chitchat").when(any_of(CONTACT_WORDS), "contact_guidance").when((F.length(question) <= 12) & any_of(CHAT_WORDS), "chitchat")


def is_anaphoric(question: Column) -> Column:
    low = F.lower(question)
    phrase = F.exists(F.array(*map(F.lit, REFERRING)), lambda x: F.contains(low, x))
    return phrase | F.arrays_overlap(tokenize(question), F.array(*map(F.lit, PRONOUNS)))


def generic_head(question: Column, links: list[str] = LINKS, heads: list[str] = HEADS) -> Column:
    """A linking word before a head that says nothing alone ("the amount of the rule")."""
    return F.lower(question).rlike(f"\\b({'|'.join(links)})\\s+({'|'.join(heads)})\\b")


def self_contained(question: Column, has_anchor: Column, over: Column | int = SELF_CONTAINED_CHARS) -> Column:
    """A question that needs no history: nothing referred to, long enough, no generic head, a topic of the corpus."""
    return ~is_anaphoric(question) & (F.length(question) > over) & ~generic_head(question) & has_anchor


def skip_rewrite(question: Column, has_anchor: Column, has_history: Column, retry: Column) -> Column:
    """Whether a question goes to retrieval as it is: never on a retry, always if self-contained, else only without history."""
    alone = self_contained(question, has_anchor)
    return F.when(retry > 0, False).when(F.coalesce(question, F.lit("")) == "", False).when(alone, True).otherwise(~has_history)


def confirms_expired(last_answer: Column, question: Column) -> Column:
    """The assistant offered expired documents and the user agrees."""
    low = F.lower(last_answer)
    return F.contains(low, F.lit("expired")) & F.contains(low, F.lit("?")) & F.lower(question).rlike("^(y|yes|ok)\\b|show")


def evidence_line(cid: Column, title: Column, page: Column, date: Column, expired: Column, content: Column) -> Column:
    place = F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))).otherwise("-")
    return F.concat(F.lit("["), cid, F.lit("] "), title, F.lit(" | "), place, F.lit(" | "), date, F.when(expired, " | expired").otherwise(""), F.lit(" | "), F.translate(F.substring(content, 1, EVIDENCE_CHARS), "\n", " "))


def enrich_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, pos, chunk, ...: cited chunks (query_id, cites array) that were retrieved (query_id, chunk, ...), each once, in order of first mention."""
    each = cited.select("query_id", F.posexplode("cites").alias("pos", "chunk")).groupBy("query_id", "chunk").agg(F.min("pos").alias("pos"))
    return each.join(retrieved, ["query_id", "chunk"])


def cited_titles(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))


def reverse_citations(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """query_id, cited, chunk: for each citation of an answer the retrieved title it contains, the longest one. titles: query_id, title, chunk."""
    cited = answers.select("query_id", F.explode(cited_titles(F.col("answer"))).alias("cited")).distinct()
    found = cited.join(titles, "query_id").filter(F.contains(F.col("cited"), F.col("title")))
    return found.groupBy("query_id", "cited").agg(F.max_by("chunk", F.struct(F.length("title"), "title", "chunk")).alias("chunk"))


def verify(n_cites: Column, n_expired: Column, confidence: Column) -> dict[str, Column]:
    """grounded, confidence, degraded after the verdict: no citation is never grounded, some expired ones hold confidence to 0.5, all expired degrade."""
    conf = F.when(n_cites == 0, 0.0).when((n_expired > 0) & (n_expired < n_cites), F.least(confidence, F.lit(0.5))).otherwise(confidence)
    return {"grounded": (n_cites > 0) & (confidence >= CONFIDENCE), "confidence": conf, "degraded": (n_cites > 0) & (n_expired == n_cites)}


def route(grounded: Column, confidence: Column, retry: Column) -> Column:
    return F.when(grounded & (confidence >= CONFIDENCE), "ok").when(retry < MAX_RETRY, "retry").otherwise("disclose")


def disclose(answer: Column, n_cites: Column) -> Column:
    return F.concat(answer, F.when(n_cites > 0, " (Sources may not cover every point.)").otherwise(" (No source was found for this.)"))


def stub_answers(evidence: DataFrame, max_cites: int = 2) -> DataFrame:
    """query_id, answer, cites, confidence: cites the first evidence rows (query_id, rank, chunk, title); sure if it cites and says enough."""
    first = evidence.filter(F.col("rank") <= max_cites).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", "title"))).alias("e"))
    text = F.concat(F.lit("See "), F.array_join(F.transform("e", lambda x: F.concat(F.lit("[source: "), x["title"], F.lit("]"))), "; "))
    out = first.select("query_id", text.alias("answer"), F.transform("e", lambda x: x["chunk"]).alias("cites"))
    return out.withColumn("confidence", F.when(F.contains("answer", F.lit("[source:")) & (F.length("answer") > 20), 0.9).otherwise(0.3))


def strict_json(raw: Column, schema: str) -> Column:
    """The first JSON object of a model's output, fenced or among other words, by a schema; null where it isn't one."""
    text = F.trim(F.regexp_replace(F.trim(raw), "(?s)^```(?:json)?(.*?)```.*$", "$1"))
    return F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), schema, {"mode": "PERMISSIVE"})


def extract_tag(text: Column, tag: str) -> Column:
    """What stands in <tag>..</tag>, the whole text without it."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def split_intent(text: Column, within: int = INTENT_CHARS) -> dict[str, Column]:
    """intent and answer of an output that starts with an intent tag closed within some characters; else a null intent and the whole text."""
    pattern = "(?s)^\\s*<intent>([^<]*)</intent>(.*)$"
    tagged = text.rlike(pattern) & (F.instr(text, "</intent>") <= within)
    return {"intent": F.when(tagged, F.trim(F.regexp_extract(text, pattern, 1))), "answer": F.regexp_replace(F.when(tagged, F.regexp_extract(text, pattern, 2)).otherwise(text), "^\\s+", "")}


def prompt(kind: str, question: Column, evidence: Column, history: Column) -> Column:
    """Prompt of a step (rewrite, answer or verify) with its parts in tags; empty parts stay out."""
    task = {"rewrite": "Restate the last question so that it stands alone.", "answer": "Answer from the evidence alone and cite it.", "verify": "Say whether the evidence supports the answer."}[kind]
    part = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n<{tag}>"), c, F.lit(f"</{tag}>"))).otherwise("")
    return F.concat(F.lit(task), part("history", history), part("evidence", evidence), part("question", question))
