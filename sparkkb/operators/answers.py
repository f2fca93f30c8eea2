"""The parts around generated answers that are plain data work: parsing, citing, filtering and merging of answer rows and events."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.session import table

MOST_SUB_QUERIES = 5


def parsed_steps(reply: Column, fallback: Column) -> Column:
    """Sub-queries of a decomposition reply, an array of (query_text, query_type, hops): at most five, with defaults; the question itself where nothing can be read.

    JSON is looked for in whatever surrounds it, and mended: commas before a closing bracket, single quotes, names without quotes, comments; plain texts in the list are sub-queries.
    """
    kind = "array<struct<query_text:string,query_type:string,hops:int>>"
    lax = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowComments": "true", "allowBackslashEscapingAnyCharacter": "true"}
    text = F.regexp_replace(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), r",\s*([\]}])", "$1")
    texts = F.transform(F.from_json(F.when(text.rlike(r"^\[\s*[\"']"), text), "array<string>", lax), lambda x: F.struct(x.alias("query_text"), F.lit(None).cast("string").alias("query_type"), F.lit(None).cast("int").alias("hops")))
    found = F.filter(F.coalesce(texts, F.from_json(F.when(text != "", text), kind, lax)), lambda x: F.coalesce(F.trim(x["query_text"]), F.lit("")) != "")
    filled = F.transform(F.slice(found, 1, MOST_SUB_QUERIES), lambda x: F.struct(F.trim(x["query_text"]).alias("query_text"), F.coalesce(x["query_type"], F.lit("single_hop")).alias("query_type"), F.coalesce(x["hops"], F.lit(1)).alias("hops")))
    alone = F.array(F.struct(fallback.alias("query_text"), F.lit("single_hop").alias("query_type"), F.lit(1).alias("hops")))
    return F.when(F.size(filled) > 0, filled).otherwise(alone)


def route(steps: Column) -> Column:
    """Where a question goes: one worker by its type, or one worker for each of its sub-queries."""
    return F.when(F.size(steps) == 1, F.when(steps[0]["query_type"] == "multi_hop", "multi_hop").otherwise("single_hop")).otherwise("parallel")


def step_stats(rows: DataFrame, steps: str) -> DataFrame:
    """Sub-queries by type, and their mean hops to two places."""
    one = rows.select(F.explode(steps).alias("s"))
    return one.groupBy(F.col("s.query_type").alias("query_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s.hops"), 2).alias("mean_hops"))


def reduced(log: DataFrame, key: str, order: list[str], mode: str, data: str) -> DataFrame:
    """(key, items): an append log with resets folded to its list: what was added since the last RESET, which itself counts."""
    last = F.max(F.when(F.col(mode) == "RESET", F.struct(*order))).over(Window.partitionBy(key))
    kept = log.withColumn("__last", last).where(F.col("__last").isNull() | (F.struct(*order) >= F.col("__last")))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.col(data).alias("__data")))), lambda x: x["__data"]).alias("items"))


def reduced_sizes(log: DataFrame, key: str, order: list[str], mode: str, data: str) -> DataFrame:
    """(key, n, last_item): how many items reduced() gives, and the greatest, without a list: both are combined before the shuffle."""
    last = log.where(F.col(mode) == "RESET").groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*order)).alias("__last"))
    kept = log.join(last, F.col(key).eqNullSafe(F.col("__key")), "left").where(F.col("__last").isNull() | (F.struct(*order) >= F.col("__last")))
    return kept.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(data).alias("last_item"))


def cited(hops: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run, hop, place, index_id, text): evidence that a hop cites by index; an unknown index keeps its place without text."""
    each = hops.select("run", "hop", F.posexplode("source_indices").alias("place", "index_id"))
    return each.join(evidence.select("run", "index_id", "text").dropDuplicates(["run", "index_id"]), ["run", "index_id"], "left").select("run", "hop", "place", "index_id", "text")


def shown_events(events: DataFrame, roles: list[str]) -> DataFrame:
    """Events of the given roles; a parent is kept only if it was shown before its child, or at the same time."""
    shown = events.where(F.col("role").isin(roles))
    parents = shown.select(F.col("id").alias("parent_id"), F.col("seq").alias("parent_seq"))
    known = shown.select("id", "seq", F.explode("parent_ids").alias("parent_id")).join(parents, "parent_id").where("parent_seq <= seq").groupBy("id").agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
    return shown.join(known, "id", "left").select("id", "seq", "role", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parent_ids"))


def sub_answers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the sub-answers (query_text, query_type, answer, reasoning, confidence) of each key as one text, with confidence to two places and reasoning as bullets."""
    word = lambda c, default: F.coalesce(F.col(c), default)
    fields = F.struct(F.col(order).alias("place"), F.col("query_text"), word("query_type", F.lit("single-hop")).alias("query_type"), word("answer", F.lit("")).alias("answer"), word("reasoning", F.array().cast("array<string>")).alias("reasoning"), word("confidence", F.lit(0.0)).alias("confidence"))

    def part(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        head = F.concat(F.lit("## Sub-query "), n, F.lit(": "), F.coalesce(x["query_text"], F.concat(F.lit("Sub-query "), n)), F.lit("\nType: "), x["query_type"], F.lit("\nConfidence: "), F.format_string("%.2f", x["confidence"]), F.lit("\n\n### Answer\n"), x["answer"], F.lit("\n"))
        steps = F.array_join(F.transform(x["reasoning"], lambda s: F.concat(F.lit("- "), F.coalesce(s, F.lit("")), F.lit("\n"))), "")
        return F.concat(head, F.when(F.size(x["reasoning"]) > 0, F.concat(F.lit("\n### Reasoning Process\n"), steps)).otherwise(""))

    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(fields)), part), "\n\n---\n\n").alias("text"))


def last_said(messages: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """The last message of each conversation that is not blank."""
    said = messages.where(F.trim(text) != "")
    return said.groupBy(key).agg(F.max_by(text, F.struct(*order)).alias("final_answer"))


def is_plain_summary(text: Column, most: int = 500) -> Column:
    """A summary without markup, ASCII letters or JSON, of at most 500 characters."""
    bad = r"[#*`_~<>{}\[\]|]|[A-Za-z]|^\s*$"
    return text.isNotNull() & (F.length(text) <= most) & ~text.rlike(bad)


def change_summary(before: str | None, after: str | None) -> str:
    """Lines and characters added and removed, and the headings touched."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    changed = [x for x in difflib.unified_diff(a, b, lineterm="", n=0) if x[:1] in "+-" and x[:3] not in ("+++", "---")]
    plus, minus = [x[1:] for x in changed if x[0] == "+"], [x[1:] for x in changed if x[0] == "-"]
    heads = list(dict.fromkeys(x.strip("# ") for x in plus + minus if re.match(r"#{1,6}\s", x)))
    return f"+{len(plus)} -{len(minus)} lines, {len(after or '') - len(before or ''):+d} characters" + (f"; headings: {', '.join(heads)}" if heads else "")


def change_summaries(versions: DataFrame) -> DataFrame:
    """(id, summary) of (id, before, after)."""

    @F.pandas_udf("string")
    def summary(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([change_summary(a, b) for a, b in zip(before, after, strict=True)], dtype=object)

    return versions.select("id", summary("before", "after").alias("summary"))


def normalized_hits(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Rows of services that spell their fields in several ways as one fixed set of columns: the first spelling that is there and filled."""
    have = set(rows.columns)
    return rows.select(*[F.coalesce(*[F.col(c) for c in spelled if c in have], F.lit(None)).alias(name) for name, spelled in names.items()])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inference_result")


def _steps(spark, sf_dir):
    """A decomposition for each result: its question alone, or with its query_id as a second step for every row that has a score."""
    said = F.to_json(F.array(F.struct(F.col("question").alias("query_text"), F.lit("multi_hop").alias("query_type"), F.col("score").alias("hops")), F.struct(F.col("query_id").alias("query_text"), F.lit(None).cast("string").alias("query_type"), F.lit(None).cast("int").alias("hops"))))
    return _results(spark, sf_dir).select("line_no", parsed_steps(F.when(F.col("score").isNotNull(), F.concat(F.lit("steps: "), said)), F.col("question")).alias("steps"))


def decomposition(spark, sf_dir):
    s = _steps(spark, sf_dir)
    return s.select("line_no", route(F.col("steps")).alias("route"), F.explode("steps").alias("s")).select("line_no", "route", "s.query_text", "s.query_type", "s.hops")


def decomposition_stats(spark, sf_dir):
    return step_stats(_steps(spark, sf_dir), "steps")


def decomposition_mended(spark, sf_dir):
    """Replies in a fence, with commas too many, as plain texts, or cut off, by the score of the result."""
    step = F.concat(F.lit('{query_text: '), F.to_json(F.struct(F.col("question").alias("q"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("question").alias("q")))) - 6), F.lit(", 'query_type': 'multi_hop', /* */ hops: 2,}"))
    texts = F.concat(F.lit('["first", '), F.to_json(F.array("query_id")).substr(F.lit(2), F.length(F.to_json(F.array("query_id"))) - 2), F.lit(", ]"))
    said = F.when(F.col("score") == 1, F.concat(F.lit('Sure:\n```json\n{"sub_queries": ['), step, F.lit(",\n]}\n```"))).when(F.col("score") == 0, texts).otherwise(F.concat(F.lit("["), step))
    rows = _results(spark, sf_dir).select("line_no", F.explode(parsed_steps(said, F.col("question"))).alias("s"))
    return rows.select("line_no", "s.query_text", "s.query_type", "s.hops")


def sub_answer_texts(spark, sf_dir):
    """The results of each query as sub-answers of one text."""
    r = _results(spark, sf_dir)
    rows = r.select("query_id", "line_no", F.col("question").alias("query_text"), F.col("judge_model").alias("query_type"), "answer", F.when(F.col("reasoning").isNotNull(), F.array("reasoning", F.lit("done"))).alias("reasoning"), (F.col("score") / 3).alias("confidence"))
    return sub_answers(rows, "query_id", "line_no")


def state_reducer(spark, sf_dir):
    """Events of a user since the last purchase, which resets."""
    e = table(spark, sf_dir, "events").withColumn("mode", F.when(F.col("event_type") == "purchase", "RESET").otherwise("ADD"))
    return reduced_sizes(e, "user_id", ["ts", "event_id"], "mode", "event_id")


def evidence_citations(spark, sf_dir):
    """Each result cites the results of its own query by line."""
    r = _results(spark, sf_dir)
    hops = r.select(F.col("query_id").alias("run"), F.col("line_no").alias("hop"), F.array(F.col("line_no"), F.col("line_no") + 1).alias("source_indices"))
    return cited(hops, r.select(F.col("query_id").alias("run"), F.col("line_no").alias("index_id"), F.col("question").alias("text")))


def event_role_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("role"), F.array(F.col("event_id") - 1, F.col("event_id") - 7, F.col("event_id") + 1).alias("parent_ids"))
    return shown_events(e, ["click", "purchase"]).select("id", "role", F.array_join("parent_ids", ",").alias("parents"))


def final_answers(spark, sf_dir):
    return last_said(_results(spark, sf_dir), "query_id", ["line_no"], "answer")


def plain_summaries(spark, sf_dir):
    return _results(spark, sf_dir).select("line_no", is_plain_summary(F.col("answer")).alias("plain"))


def answer_changes(spark, sf_dir):
    """How the answers of a query changed from one run to the next."""
    before = F.lag("answer").over(Window.partitionBy("query_id").orderBy("line_no"))
    return change_summaries(_results(spark, sf_dir).select(F.col("line_no").alias("id"), before.alias("before"), F.col("answer").alias("after")))


def hit_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "knowledge_chunk").select(F.col("chunk_text").alias("chunkText"), F.col("chunk_no"), F.col("knowledge_base_id").cast("string").alias("knCode"))
    return normalized_hits(rows, {"text": ["chunkText", "chunk_text"], "chunk_no": ["chunkNo", "chunk_no"], "kb_code": ["knCode", "kn_code"]}).groupBy("kb_code").agg(F.count("text").alias("texts"), F.sum("chunk_no").alias("numbers"))


def queries() -> dict:
    return {f.__name__: f for f in (decomposition, decomposition_stats, decomposition_mended, sub_answer_texts, state_reducer, evidence_citations, event_role_filter, final_answers, plain_summaries, answer_changes, hit_fields)}


def oracle_sql() -> dict[str, str]:
    steps = """SELECT line_no, question AS query_text, CASE WHEN score IS NOT NULL THEN 'multi_hop' ELSE 'single_hop' END AS query_type, coalesce(score, 1)::int AS hops, CASE WHEN score IS NOT NULL THEN 'parallel' ELSE 'single_hop' END AS route FROM inference_result
        UNION ALL SELECT line_no, query_id, 'single_hop', 1, 'parallel' FROM inference_result WHERE score IS NOT NULL"""
    return {
        "decomposition": steps.replace("question AS query_text", "trim(question, ' ') AS query_text"),
        "decomposition_stats": f"SELECT query_type, count(*) AS n, round(avg(hops), 2) AS mean_hops FROM ({steps}) GROUP BY ALL",
        "decomposition_mended": """SELECT line_no, question AS query_text, 'multi_hop' AS query_type, 2 AS hops FROM inference_result WHERE score = 1 UNION ALL SELECT line_no, trim(question, ' '), 'single_hop', 1 FROM inference_result WHERE score IS NULL OR score NOT IN (0, 1)
            UNION ALL SELECT line_no, 'first', 'single_hop', 1 FROM inference_result WHERE score = 0 UNION ALL SELECT line_no, query_id, 'single_hop', 1 FROM inference_result WHERE score = 0""",
        "sub_answer_texts": r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line_no) AS i FROM inference_result)
            SELECT query_id, string_agg('## Sub-query ' || i || ': ' || question || chr(10) || 'Type: ' || coalesce(judge_model, 'single-hop') || chr(10) || 'Confidence: ' || printf('%.2f', coalesce(score / 3, 0)::double) || chr(10) || chr(10) || '### Answer' || chr(10) || coalesce(answer, '') || chr(10)
              || CASE WHEN reasoning IS NOT NULL THEN chr(10) || '### Reasoning Process' || chr(10) || '- ' || reasoning || chr(10) || '- done' || chr(10) ELSE '' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS text FROM n GROUP BY ALL""",
        "state_reducer": "WITH l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS r FROM events) SELECT user_id, count(*)::int AS n, max(event_id) AS last_item FROM l WHERE r IS NULL OR (ts, event_id) >= r GROUP BY ALL",
        "evidence_citations": "SELECT h.query_id AS run, h.line_no AS hop, p::int AS place, h.line_no + p AS index_id, e.question AS text FROM inference_result h CROSS JOIN (VALUES (0), (1)) v(p) LEFT JOIN inference_result e ON e.query_id = h.query_id AND e.line_no = h.line_no + p",
        "event_role_filter": "WITH s AS (SELECT event_id AS id, event_type AS role FROM events WHERE event_type IN ('click', 'purchase')), p AS (SELECT s.id, string_agg(q.id::varchar, ',' ORDER BY q.id) AS parents FROM s JOIN s q ON q.id IN (s.id - 1, s.id - 7) GROUP BY s.id) SELECT s.id, s.role, coalesce(p.parents, '') AS parents FROM s LEFT JOIN p USING (id)",
        "final_answers": "SELECT query_id, arg_max(answer, line_no) AS final_answer FROM inference_result WHERE trim(answer, ' ') <> '' GROUP BY ALL",
        "plain_summaries": r"SELECT line_no, answer IS NOT NULL AND length(answer) <= 500 AND NOT regexp_matches(answer, '[#*`_~<>{}\[\]|]|[A-Za-z]|^\s*$') AS plain FROM inference_result",
        "hit_fields": "SELECT knowledge_base_id::varchar AS kb_code, count(chunk_text) AS texts, sum(chunk_no)::bigint AS numbers FROM knowledge_chunk GROUP BY ALL",
    }
