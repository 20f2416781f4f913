"""Answers for a table of questions: routes, answer and verification by a model, retries over the questions that still fail.

The graph of one conversation turn is unrolled: entry rules, retrieval, no data or confirmation, then at most three passes of answer and
verification, each over the rows that the pass before left open. A model is an adapter (prompts to texts); stub answers need none.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators import conversation as C
from tessera.operators.retrieval import Retrieved
from tessera.operators.scratch import kept

GREETING, CONTACT = "Hello! Ask me about the documents.", "Please contact the team named in the handbook."
NO_DATA = "The documents hold nothing on this question."
CONFIRM = "Only an expired document was found: {0}. Show expired content anyway?"
ANSWER_SCHEMA, VERDICT_SCHEMA = "answer string, chunk_ids array<string>, intent string", "grounded boolean, confidence double"
CALLS = "query_id {0}, raw string, tries int, prompt_chars int, completion_chars int, truncated boolean, ms double"
FIELDS = ["query_id", "route", "answer", "intent", "citations", "grounded", "confidence", "degraded", "retries"]


def rewritten(questions: DataFrame, history: DataFrame, has_anchor: DataFrame, call: Callable[[list[str]], list[tuple[str, str]]] | None = None) -> DataFrame:
    """query_id, rewritten, include_expired, mode of questions (query_id, question). history: query_id, text, last_answer; has_anchor: query_id, anchors. A model rewrites what no rule passes on; without one, or where it says nothing, the question stays."""
    q = questions.join(history, "query_id", "left").join(has_anchor, "query_id", "left")
    expired = F.coalesce(C.confirms_expired(F.col("last_answer"), F.col("question")), F.lit(False))
    skip = C.skip_rewrite(F.col("question"), F.coalesce("anchors", F.lit(0)) > 0, F.coalesce("text", F.lit("")) != "", F.lit(0))
    told = q.withColumn("include_expired", expired).withColumn("mode", F.when(skip & ~expired, "skip").otherwise("llm"))
    if call is None:
        return told.select("query_id", F.col("question").alias("rewritten"), "include_expired", F.when(F.col("mode") == "skip", "skip").otherwise("none").alias("mode"))
    asked = told.filter(F.col("mode") == "llm").select("query_id", C.prompt("rewrite", F.col("question"), F.lit(""), F.col("text")).alias("prompt"))
    made = complete_json(asked, call, "rewritten_query string").select("query_id", F.trim("parsed.rewritten_query").alias("_new"))
    return told.join(made, "query_id", "left").select("query_id", F.coalesce(F.when(F.col("_new") != "", F.col("_new")), F.col("question")).alias("rewritten"), "include_expired", "mode")


def complete_json(prompts: DataFrame, call: Callable[[list[str]], list[tuple[str, str]]], schema: str, tries: int = 2, batch: int = 16) -> DataFrame:
    """query_id, parsed and the usage of a model's JSON answers to prompts (query_id, prompt). call: prompts to (text, finish reason); an answer without a JSON object is asked for again."""

    def holds_json(text: str) -> bool:
        at, to = text.find("{"), text.rfind("}")
        try:
            return at >= 0 and isinstance(json.loads(text[at : to + 1]), dict)
        except json.JSONDecodeError:
            return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                asked = part["prompt"].tolist()
                began = time.perf_counter()
                said, tried, open_ = [("", "")] * len(asked), [0] * len(asked), list(range(len(asked)))
                for _ in range(tries):
                    if not open_:
                        break
                    for k, answer in zip(open_, call([asked[k] for k in open_]), strict=True):
                        said[k], tried[k] = answer, tried[k] + 1
                    open_ = [k for k in open_ if not holds_json(said[k][0])]
                ms = (time.perf_counter() - began) * 1000 / len(asked)
                yield pd.DataFrame({"query_id": part["query_id"], "raw": [t for t, _ in said], "tries": tried, "prompt_chars": [len(p) for p in asked], "completion_chars": [len(t) for t, _ in said], "truncated": [f == "length" for _, f in said], "ms": ms})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, CALLS.format(kind)).withColumn("parsed", C.strict_json(F.col("raw"), schema))


def evidence(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, kind, chunk, title, validity, line of retrieved rows; chunks: chunk, doc_title, page_num, doc_date, content."""
    order = W.Window.partitionBy("query_id").orderBy(F.when(F.col("kind") == "item", 0).when(F.col("kind") == "expired", 1).otherwise(2), "rank")
    told = found.join(chunks.select("chunk", "doc_title", "page_num", "doc_date", "content"), "chunk").withColumn("rank", F.row_number().over(order))
    line = C.evidence_line(F.col("chunk").cast("string"), F.col("doc_title"), F.col("page_num"), F.col("doc_date"), F.col("validity") == "expired", F.col("content"))
    return told.select("query_id", "rank", "kind", F.col("chunk").cast("string").alias("chunk"), F.col("doc_title").alias("title"), "validity", line.alias("line"))


def answer(questions: DataFrame, retrieved: Retrieved, lines: DataFrame, history: DataFrame, ask: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """A row of FIELDS for each question (query_id, question, include_expired).

    lines: evidence(); history: query_id, text. ask: (query_id, prompt, evidence array) to (query_id, answer, chunk_ids, intent); judge: (query_id, prompt,
    answer) to (query_id, grounded, confidence). keep writes and rereads each pass, so a pass isn't computed again for the next.
    """
    lines = keep(lines)
    q = questions.withColumn("_rule", C.rule_intent(F.col("question")))
    direct = q.filter(F.col("_rule").isin("chitchat", "contact_guidance")).select("query_id", F.lit("direct").alias("route"), F.when(F.col("_rule") == "chitchat", GREETING).otherwise(CONTACT).alias("answer"), F.col("_rule").alias("intent"), _none(), F.lit(True).alias("grounded"), F.lit(1.0).alias("confidence"), F.lit(False).alias("degraded"), F.lit(0).alias("retries"))
    rest = q.join(direct.select("query_id"), "query_id", "left_anti").join(retrieved.verdicts.select("query_id", "no_relevant"), "query_id", "left")
    kinds = lines.groupBy("query_id").agg(F.count_if(F.col("kind") == "item").alias("_items"), F.count_if(F.col("kind") == "expired").alias("_expired"), F.min_by("title", F.when(F.col("kind") == "expired", F.col("rank"))).alias("_title"))
    rest = rest.join(kinds, "query_id", "left").withColumns({"_items": F.coalesce("_items", F.lit(0)), "_expired": F.coalesce("_expired", F.lit(0)), "no_relevant": F.coalesce("no_relevant", F.lit(False))})
    wanted = F.coalesce("include_expired", F.lit(False))
    confirm = ~F.col("no_relevant") & (F.col("_items") == 0) & (F.col("_expired") > 0) & ~wanted
    nothing = ~confirm & (F.col("no_relevant") | (F.col("_items") + F.when(wanted, F.col("_expired")).otherwise(0) == 0))
    to_confirm = rest.filter(confirm).select("query_id", F.lit("confirm").alias("route"), F.replace(F.lit(CONFIRM), F.lit("{0}"), F.coalesce("_title", F.lit("unknown"))).alias("answer"), F.lit("kb_qa").alias("intent"), _none(), F.lit(True).alias("grounded"), F.lit(1.0).alias("confidence"), F.lit(False).alias("degraded"), F.lit(0).alias("retries"))
    no_data = rest.filter(nothing).select("query_id", F.lit("no_data").alias("route"), F.lit(NO_DATA).alias("answer"), F.lit("kb_qa").alias("intent"), _none(), F.lit(False).alias("grounded"), F.lit(0.0).alias("confidence"), F.lit(True).alias("degraded"), F.lit(0).alias("retries"))
    open_ = rest.filter(~confirm & ~nothing).select("query_id", "question").withColumn("citations", F.array().cast("array<string>"))
    told = history.select("query_id", F.col("text").alias("history"))
    done = [direct, to_confirm, no_data]
    for n in range(C.MAX_RETRY + 1):
        asked = _prompts(open_, lines, told, n)
        made = keep(ask(asked))
        state = open_.select("query_id", "question").join(made, "query_id").join(asked.select("query_id", "evidence"), "query_id")
        cites = lines.select("query_id", "chunk", "validity")
        cited = C.enrich_citations(state.select("query_id", F.col("chunk_ids").alias("cites")), cites).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]).alias("citations"), F.count_if(F.col("validity") == "expired").alias("_expired"))
        state = state.join(cited, "query_id", "left").withColumns({"citations": F.coalesce("citations", F.array().cast("array<string>")), "_expired": F.coalesce("_expired", F.lit(0))})
        checked = state.filter(F.size("citations") > 0).join(lines.select("query_id", "chunk", "line", "rank"), "query_id").filter(F.array_contains("citations", F.col("chunk"))).groupBy("query_id", "question", "answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("_cited"))
        said = judge(checked.select("query_id", C.prompt("verify", F.col("question"), F.concat(F.col("_cited"), F.lit("\n"), F.col("answer")), F.lit("")).alias("prompt"), "answer"))
        judged = state.join(said.select("query_id", F.col("grounded").alias("_grounded"), F.col("confidence").alias("_conf")), "query_id", "left")
        rule = C.verify(F.size("citations"), F.col("_expired"), F.coalesce("_conf", F.lit(0.0)))
        intent = F.when(F.col("intent") == "chitchat", "chitchat").otherwise("kb_qa")
        judged = judged.withColumns({"intent": intent, "grounded": F.coalesce("_grounded", F.lit(False)) & (F.size("citations") > 0), "confidence": rule["confidence"], "degraded": rule["degraded"]})
        judged = keep(judged.withColumn("_to", F.when(F.col("intent") == "chitchat", "ok").otherwise(C.route(F.col("grounded"), F.col("confidence"), F.lit(n)))))
        ended = judged.filter(F.col("_to") != "retry")
        text = F.when(F.col("_to") == "disclose", C.disclose(F.col("answer"), F.size("citations"))).otherwise(F.col("answer"))
        done.append(ended.select("query_id", F.when(F.col("_to") == "disclose", "disclose").otherwise("answer").alias("route"), text.alias("answer"), "intent", "citations", "grounded", "confidence", (F.col("degraded") | (F.col("_to") == "disclose")).alias("degraded"), F.lit(n).alias("retries")))
        open_ = judged.filter(F.col("_to") == "retry").select("query_id", "question", "citations")
    return reduce(DataFrame.unionByName, [d.select(*FIELDS) for d in done])


def _none():
    return F.array().cast("array<string>").alias("citations")


def _prompts(open_: DataFrame, lines: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """query_id, prompt, evidence (chunks in order) of a pass: all evidence first, on a retry the rows cited before where there are any."""
    each = open_.join(lines, "query_id").filter((F.size("citations") == 0) | F.array_contains("citations", F.col("chunk")) if n else F.lit(True))
    packed = each.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", "title", "line"))).alias("_e")).join(history, "query_id", "left")
    text = F.array_join(F.transform("_e", lambda x: x["line"]), "\n")
    hint = F.lit("\nSay plainly what the sources lack; invent nothing." if n else "")
    return packed.select("query_id", F.concat(C.prompt("answer", F.col("question"), text, F.col("history")), hint).alias("prompt"), F.transform("_e", lambda x: F.struct(x["rank"].alias("rank"), x["chunk"].alias("chunk"), x["title"].alias("title"))).alias("evidence"))


def stub_ask(prompts: DataFrame) -> DataFrame:
    """Answers without a model: the first evidence rows cited."""
    each = prompts.select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.*")
    return C.stub_answers(each).select("query_id", "answer", F.col("cites").alias("chunk_ids"), F.lit("kb_qa").alias("intent"))


def stub_judge(answers: DataFrame) -> DataFrame:
    """A verdict without a model: sure of an answer that cites and says enough."""
    sure = F.contains("answer", F.lit("[source:")) & (F.length("answer") > 20)
    return answers.select("query_id", sure.alias("grounded"), F.when(sure, 0.9).otherwise(0.3).alias("confidence"))


def finalized(messages: DataFrame, answers: DataFrame, keep: int = C.HISTORY_MESSAGES) -> DataFrame:
    """messages (conv_id, turn, role, text) with the answers (conv_id, answer) after them, the last `keep` of each conversation: the table that a next turn reads."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    said = answers.join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    both = messages.select("conv_id", "turn", "role", "text").unionByName(said)
    return both.withColumn("_n", F.row_number().over(W.Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_n") <= keep).drop("_n")


def event_frames(answers: DataFrame, piece: int = 40) -> DataFrame:
    """query_id, seq, frame: the server-sent events of each answer (ready, token by pieces, citation, done), as event and data lines."""
    count = F.greatest(F.ceil(F.length("answer") / piece), F.lit(1)).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(F.substring("answer", i * piece + 1, F.lit(piece)).alias("text"))).alias("data")))
    cites = F.transform("citations", lambda c: F.struct(F.lit("citation").alias("event"), F.to_json(F.struct(c.alias("chunk_id"))).alias("data")))
    one = lambda name, data: F.array(F.struct(F.lit(name).alias("event"), data.alias("data")))
    ends = one("done", F.to_json(F.struct("route", "intent", "grounded", "confidence", "degraded", "retries")))
    every = F.concat(one("ready", F.lit("{}")), tokens, cites, ends)
    rows = answers.select("query_id", F.posexplode(every).alias("seq", "e"))
    return rows.select("query_id", "seq", F.concat(F.lit("event: "), F.col("e.event"), F.lit("\ndata: "), F.col("e.data"), F.lit("\n\n")).alias("frame"))
