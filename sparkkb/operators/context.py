"""Dataflow around answers: history, indexing and grouping of results, context under a token budget, and evaluation reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.session import materialize, table

#: Characters that end a sentence.
ENDERS = ".!?。！？\n;；"
TOKENS_PER_CHARACTER = 1.3
LEAST_CUT, MOST_ROUNDS = 50, 101


def history(turns: DataFrame, who: str, order: list[str], said: str, n: int = 5) -> DataFrame:
    """Each turn with the n turns of the same user before it, oldest first."""
    before = Window.partitionBy(who).orderBy(*order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(said).over(before))


def indexed(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Result ids ``key-key-n``, numbered within the keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("index_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys], n.cast("string")))


def ranked(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))))


def ranked_by_slots(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """As ranked(), for groups of any size: rows are stored in ranges of the order, a rank is the rows of the group in the ranges before and the place in its own."""
    slots = rows.repartitionByRange(F.desc(score), F.asc(tie)).withColumn("__slot", F.spark_partition_id())
    slots = materialize(slots, "slots")  # ranges are sampled, so that they may differ from run to run
    upto = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.groupBy(*group, "__slot").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("__slot").alias("__at"), "__before")
    placed = slots.withColumn("__within", F.row_number().over(Window.partitionBy(*group, "__slot").orderBy(F.desc(score), F.asc(tie))))
    same = F.col("__slot") == F.col("__at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(before, same).withColumn("rank", (F.col("__within") + F.col("__before")).cast("int")).select(*rows.columns, "rank")


def tokens_of(text: str) -> int:
    return int(len(text) * TOKENS_PER_CHARACTER)


def cut_at_sentence(text: str, budget: int) -> str:
    """The longest prefix within a token budget that ends a sentence; empty if there is none."""
    head = text[: int(budget / TOKENS_PER_CHARACTER) + 1]
    while head and tokens_of(head) > budget:
        head = head[:-1]
    return head[: max((head.rfind(c) for c in ENDERS), default=-1) + 1]


def taken(items: Iterable[tuple[int, object, str]], budget: int) -> Iterator[tuple[object, str, bool]]:
    """(item, text, whole) of (round, item, text) in order until the budget is used or a round gives nothing: an item that does not fit is cut at a sentence if LEAST_CUT tokens are left, else skipped."""
    left, at, took = budget, 1, False
    for n, item, text in items:
        if n != at:
            if n != at + 1 or not took:
                return
            at, took = n, False
        if left <= 0 or n > MOST_ROUNDS:
            return
        if (size := tokens_of(text)) <= left:
            yield item, text, True
            left, took = left - size, True
        elif left >= LEAST_CUT and (part := cut_at_sentence(text, left)) and len(part) < len(text):
            yield item, part, False
            left, took = left - tokens_of(part), True


def round_robin(groups: list[list[tuple[int, str]]], budget: int) -> list[tuple[int, str, bool]]:
    """(item, text, whole) taken in turns from groups, as taken() does."""
    longest = max(map(len, groups), default=0)
    return list(taken(((n + 1, *g[n]) for n in range(longest) for g in groups if n < len(g)), budget))


def reachable(hits: DataFrame, query: str, order: list[Column], budget: int) -> DataFrame:
    """Hits that taken() may take, whatever else there is.

    A hit is surely taken while `need` tokens are left, and then uses at least `least`. Those before it in order with the same two numbers were taken as well
    if that much is left at the hit. So after k of them with k * least > budget - need it cannot be, and a query keeps some budget * log(budget) hits, and
    the empty ones, which use nothing and are all returned while tokens are left.
    """
    tokens = lambda n: F.floor(n * F.lit(TOKENS_PER_CHARACTER))
    whole, cut = tokens(F.length("text")), tokens(F.length(F.split("text", f"[{ENDERS}]", 2)[0]) + 1)
    need = F.least(whole, F.greatest(cut, F.lit(LEAST_CUT)))
    sized = hits.withColumn("__need", need).withColumn("__least", F.when(F.col("__need") == whole, whole).otherwise(cut)).where(F.col("__need") <= budget)
    placed = sized.withColumn("__before", F.row_number().over(Window.partitionBy(query, "__need", "__least").orderBy(*order)) - 1)
    return placed.where(F.col("__before") * F.col("__least") <= budget - F.col("__need")).drop("__need", "__least", "__before")


def context(hits: DataFrame, query: str, group: str, budget: int, most: int = MOST_ROUNDS) -> DataFrame:
    """(query, position, item, text, whole): hits (query, group, item, text, score) under a token budget for each query, in turns over its groups.

    There are at most MOST_ROUNDS turns, so that many hits of a group can be reached. The hits of a query that its budget can reach go through one
    task in order, a batch at a time. A null group is a group.
    """
    best = ranked(hits.where("text is not null"), [query, group], "score", "item").where(F.col("rank") <= most)
    top = best.withColumn("of", F.max("score").over(Window.partitionBy(query, group)))
    order = [F.col("rank").asc(), F.col("of").desc_nulls_last(), F.col(group).asc_nulls_last()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        rows = (r for b in chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        kind = pa.schema([first.schema.field(0), ("position", pa.int32()), first.schema.field(2), first.schema.field(3), ("whole", pa.bool_())])
        found = ((q, n, *x) for q, mine in groupby(rows, lambda r: r[0]) for n, x in enumerate(taken((r[1:] for r in mine), budget), 1))
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)

    kind = dict(hits.dtypes)
    ordered = reachable(top, query, order, budget).repartition(query).sortWithinPartitions(F.col(query), *order)
    return ordered.select(query, "rank", "item", "text").mapInArrow(run, f"`{query}` {kind[query]}, position int, item {kind['item']}, text string, whole boolean")


def rendered(rows: DataFrame, query: str) -> DataFrame:
    """One text by query: numbered passages in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "item", "text"))), lambda x: F.concat(F.lit("["), x["position"].cast("string"), F.lit("] "), x["text"]))
    return rows.groupBy(query).agg(F.array_join(lines, "\n\n").alias("context"))


def token_budget(most: int, reserved: int = 2000, share: float = 0.8) -> int:
    return max(0, int(most * share) - reserved)


def confidence(rows: DataFrame, group: str, score: str, tie: str, cited: str | None = None) -> DataFrame:
    """The mean of the three best scores of each group, of those cited if any is; 0 without any."""
    scored = cited_only(rows, group, cited) if cited else rows
    top = ranked(scored.where(F.col(score).isNotNull()), [group], score, tie).where("rank <= 3").groupBy(group).agg(F.avg(score).alias("confidence"))
    return rows.select(group).distinct().join(top, group, "left").select(group, F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"))


def cited_only(rows: DataFrame, group: str, cited: str) -> DataFrame:
    """The cited rows of the groups that have any, all rows of the others."""
    some = rows.where(cited).groupBy(F.col(group).alias("__group")).agg(F.lit(True).alias("__some"))
    marked = rows.join(some, F.col(group).eqNullSafe(F.col("__group")), "left")
    return marked.where(F.col("__some").isNull() | F.coalesce(F.col(cited), F.lit(False))).select(*rows.columns)


def collected_sources(rows: DataFrame, group: str, source: str, text: str, order: str, cited: str) -> DataFrame:
    """(group, source, head, first, n): the sources of each group, the cited ones if any is, once each by source and first 50 characters of the text."""
    return cited_only(rows, group, cited).groupBy(group, source, F.substring(text, 1, 50).alias("head")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


#: Headings of the kinds of sources in a context.
SECTIONS = {"knowledge_base": "[Knowledge Base]", "web": "[Web Search]"}


def rendered_sections(rows: DataFrame, query: str) -> DataFrame:
    """(query, context): rows (query, question, kind, position, title, url, text, truncated) as one text by query, with a section for each kind of source, its passages numbered. Other kinds are left out."""
    mark = F.when(F.coalesce("truncated", F.lit(False)), " (truncated)").otherwise("")
    said = F.concat(F.coalesce("text", F.lit("")), mark)
    first = F.when(F.col("kind") == "web", F.concat(F.coalesce("title", F.lit("")), F.lit("("), F.coalesce("url", F.lit("")), F.lit(")\n"), said)).otherwise(said)
    items = rows.where(F.col("kind").isin(*SECTIONS)).groupBy(query, "kind").agg(F.array_sort(F.collect_list(F.struct("position", first.alias("said")))).alias("items"))
    heading = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[F.col("kind")]
    numbered = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["said"]))
    parts = items.select(query, "kind", F.concat(heading, F.lit("\n"), F.array_join(numbered, "\n"), F.lit("\n")).alias("part"))
    asked = rows.groupBy(query).agg(F.min_by("question", "position").alias("question"))
    whole = parts.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "part"))), lambda x: x["part"]), "\n").alias("parts"))
    return asked.join(whole, query, "left").select(query, F.concat(F.lit("## Sub-query: "), F.coalesce("question", F.lit("")), F.lit("\n\n"), F.coalesce("parts", F.lit(""))).alias("context"))


def sub_questions(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, query_id, question): a text's lines that are not blank as sub-questions; without any the text itself."""
    lines = F.filter(F.transform(F.split(text_col, r"\r?\n"), F.trim), lambda x: x != "")
    chosen = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.col(text_col)))
    return rows.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(chosen).alias("n", "question")).select(id_col, F.concat(F.lit("sq_"), F.col("n") + 1).alias("query_id"), "question")


def parsed_score(reply: Column) -> Column:
    """The score of a judge's reply: JSON, a fenced block of JSON, or the first object with a score."""
    as_json = lambda c: F.get_json_object(c, "$.score")
    fenced = F.regexp_extract(reply, r"```(?:json)?\s*(\{[^`]*\})\s*```", 1)
    first = F.regexp_extract(reply, r'(\{[^{}]*"score"[^{}]*\})', 1)
    return F.coalesce(F.when(F.trim(reply).startswith("{"), as_json(F.trim(reply))), F.when(fenced != "", as_json(fenced)), F.when(first != "", as_json(first))).try_cast("int")


def pending(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a result that has an answer and no error."""
    done = results.where("error is null and answer is not null and trim(answer) != ''").select("query_id").distinct()
    return questions.join(done, "query_id", "left_anti")


def selected(questions: DataFrame, results: DataFrame, retry_failed: bool = False, ids: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """Questions to run: those named by ids; a sample of a size (by hash, the same each time); those whose last result failed; else those without a last result that is good. A result failed if it has an error or no answer."""
    if ids is not None:
        return questions.where(F.col("query_id").isin(ids))
    if sample is not None:
        return questions.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    last = results.groupBy("query_id").agg(F.max_by(F.struct("error", "answer"), "line_no").alias("r"))
    good = (F.coalesce("r.error", F.lit("")) == "") & (F.coalesce("r.answer", F.lit("")) != "")
    return questions.join(last.where(~good).select("query_id"), "query_id", "left_semi") if retry_failed else questions.join(last.where(good).select("query_id"), "query_id", "left_anti")


def report(results: DataFrame, *by: str) -> DataFrame:
    """Correct answers and accuracy over all results (unscored ones count), tokens, mean latency, unscored and errors."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if(F.col("score") == 1), F.lit(0)).alias("correct"), F.round(F.count_if(F.col("score") == 1) / F.count(F.lit(1)), 6).alias("accuracy"),
        F.sum("tokens_used").alias("tokens"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.count_if(F.col("score").isNull()).alias("unscored"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def percentiles(results: DataFrame, by: str, value: str) -> DataFrame:
    """Median, the value at 99 % of the rows, and the greatest, of each group; counted over distinct values, so no group is collected."""
    counts = results.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return upto.groupBy(by).agg(
        ((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("p50"), at(F.least(F.floor(F.col("all") * 0.99), F.col("all") - 1)).alias("p99"), F.max(value).alias("most"))


def user_history5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return history(turns, "user_id", ["ts", "event_id"], "event_type").select("event_id", F.array_join("history", ",").alias("history"))


def result_index_ids(spark, sf_dir):
    return indexed(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "index_id")


def group_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "inference_result").where("latency_ms is not null").select("line_no", F.coalesce("judge_model", F.lit("none")).alias("judge"), "latency_ms")
    return ranked_by_slots(rows, ["judge"], "latency_ms", "line_no").select("line_no", "judge", "rank")


def round_robin_context(spark, sf_dir):
    """For each base, its chunks of the most lines as a context, in turns over its files."""
    hits = table(spark, sf_dir, "knowledge_chunk").select("knowledge_base_id", "fs_entry_id", F.col("kid").alias("item"), F.col("chunk_text").alias("text"), (F.col("end_line") - F.col("start_line")).cast("double").alias("score"))
    return context(hits, "knowledge_base_id", "fs_entry_id", token_budget(8192))


def rendered_context(spark, sf_dir):
    return rendered(round_robin_context(spark, sf_dir), "knowledge_base_id")


def answer_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "inference_result").select(F.coalesce("judge_model", F.lit("none")).alias("judge"), F.col("latency_ms"), "line_no")
    return confidence(rows, "judge", "latency_ms", "line_no")


def question_lines(spark, sf_dir):
    return sub_questions(table(spark, sf_dir, "inference_result"), "line_no", "question")


def judge_parse(spark, sf_dir):
    said = F.concat(F.lit('I think ```json\n{"score": '), F.col("score").cast("string"), F.lit(', "reasoning": "'), F.regexp_replace(F.coalesce("reasoning", F.lit("")), r'["`{}\\\x00-\x1f]', ""), F.lit('"}\n``` is right'))
    return table(spark, sf_dir, "inference_result").select("line_no", parsed_score(said).alias("parsed"))


def resume_pending(spark, sf_dir):
    results = table(spark, sf_dir, "inference_result")
    return pending(results.select("query_id").distinct(), results)


def eval_report(spark, sf_dir):
    results = table(spark, sf_dir, "inference_result").withColumn("judge", F.coalesce("judge_model", F.lit("none")))
    return report(results, "judge")


def latency_percentiles(spark, sf_dir):
    return percentiles(table(spark, sf_dir, "inference_result").withColumn("judge", F.coalesce("judge_model", F.lit("none"))), "judge", "latency_ms")


def source_collection(spark, sf_dir):
    """Sources once each by source and first 50 characters, the first document of each."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("source", F.substring("text", 1, 50).alias("head"), "doc_id")
    return d.groupBy("source", "head").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def _cited(spark, sf_dir):
    return table(spark, sf_dir, "inference_result").select(F.coalesce("judge_model", F.lit("none")).alias("judge"), "query_id", "latency_ms", "line_no", "answer", (F.col("score") == 1).alias("cited"))


def cited_confidence(spark, sf_dir):
    """By query: the mean of its three slowest results, of those that are right if any is."""
    return confidence(_cited(spark, sf_dir), "query_id", "latency_ms", "line_no", "cited")


def cited_sources(spark, sf_dir):
    return collected_sources(_cited(spark, sf_dir), "query_id", "judge", "answer", "line_no", "cited")


def sub_query_context(spark, sf_dir):
    """Each query's results as passages, those with an error as pages."""
    r = table(spark, sf_dir, "inference_result")
    rows = r.select("query_id", "question", F.when(F.col("error").isNull(), "knowledge_base").otherwise("web").alias("kind"), F.col("line_no").alias("position"), F.col("judge_model").alias("title"), F.col("error").alias("url"), F.col("answer").alias("text"), (F.col("score") == 0).alias("truncated"))
    return rendered_sections(rows, "query_id")


def resume_failed(spark, sf_dir):
    results = table(spark, sf_dir, "inference_result")
    return selected(results.select("query_id").distinct(), results, retry_failed=True)


def resume_rest(spark, sf_dir):
    """Queries without a last good result, among all ids of documents' bases and of results."""
    results = table(spark, sf_dir, "inference_result")
    more = table(spark, sf_dir, "knowledge_base").select(F.concat(F.lit("new-"), "kid").alias("query_id"))
    return selected(results.select("query_id").unionAll(more).distinct(), results)


def question_stats(spark, sf_dir):
    """Questions by number of words, and mean length."""
    q = table(spark, sf_dir, "inference_result").withColumn("words", F.size(F.split(F.trim("question"), r"\s+")))
    return q.groupBy("words").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("question")), 2).alias("mean_length"))


def queries() -> dict:
    return {f.__name__: f for f in (user_history5, result_index_ids, group_rank, round_robin_context, rendered_context, answer_confidence, question_lines, judge_parse, resume_pending, eval_report, latency_percentiles, source_collection, cited_confidence, cited_sources, sub_query_context, resume_failed, resume_rest, question_stats)}


def oracle_sql() -> dict[str, str]:
    judge = "coalesce(judge_model, 'none') AS judge"
    return {
        "user_history5": "SELECT event_id, coalesce(string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM events",
        "result_index_ids": "SELECT event_id, concat_ws('-', user_id::varchar, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::varchar) AS index_id FROM events",
        "group_rank": f"SELECT line_no, {judge}, row_number() OVER (PARTITION BY coalesce(judge_model, 'none') ORDER BY latency_ms DESC, line_no)::int AS rank FROM inference_result WHERE latency_ms IS NOT NULL",
        "answer_confidence": f"SELECT judge, round(coalesce(avg(latency_ms) FILTER (r <= 3 AND latency_ms IS NOT NULL), 0), 6) AS confidence FROM (SELECT {judge}, latency_ms, row_number() OVER (PARTITION BY coalesce(judge_model, 'none') ORDER BY latency_ms DESC NULLS LAST, line_no) AS r FROM inference_result) GROUP BY ALL",
        "question_lines": "SELECT line_no, 'sq_' || n AS query_id, q AS question FROM (SELECT line_no, unnest(l) AS q, unnest(range(1, len(l) + 1)) AS n FROM (SELECT line_no, list_filter(list_transform(regexp_split_to_array(question, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM inference_result))",
        "judge_parse": "SELECT line_no, score AS parsed FROM inference_result",
        "resume_pending": "SELECT DISTINCT query_id FROM inference_result WHERE query_id NOT IN (SELECT query_id FROM inference_result WHERE error IS NULL AND answer IS NOT NULL AND trim(answer, ' ') <> '')",
        "eval_report": f"SELECT {judge}, count(*) AS total, count(*) FILTER (score = 1) AS correct, round(count(*) FILTER (score = 1) / count(*), 6) AS accuracy, sum(tokens_used)::bigint AS tokens, round(sum(latency_ms), 3) AS latency_ms, count(*) FILTER (score IS NULL) AS unscored, count(*) FILTER (error IS NOT NULL) AS errors FROM inference_result GROUP BY 1",
        "latency_percentiles": f"SELECT judge, median(latency_ms) AS p50, list_sort(list(latency_ms))[least((count(*) * 0.99)::bigint + CASE WHEN (count(*) * 0.99)::bigint > count(*) * 0.99 THEN -1 ELSE 0 END, count(*) - 1) + 1] AS p99, max(latency_ms) AS most FROM (SELECT {judge}, latency_ms FROM inference_result WHERE latency_ms IS NOT NULL) GROUP BY judge",
        "source_collection": "SELECT source, substr(text, 1, 50) AS head, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL",
        "cited_confidence": """WITH r AS (SELECT query_id, latency_ms, line_no, coalesce(score = 1, false) AS c, bool_or(coalesce(score = 1, false)) OVER (PARTITION BY query_id) AS has_c FROM inference_result),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY latency_ms DESC, line_no) AS n FROM r WHERE (c OR NOT has_c) AND latency_ms IS NOT NULL)
            SELECT q.query_id, round(coalesce(avg(k.latency_ms), 0), 6) AS confidence FROM (SELECT DISTINCT query_id FROM inference_result) q LEFT JOIN k ON k.query_id = q.query_id AND k.n <= 3 GROUP BY ALL""",
        "cited_sources": f"""WITH r AS (SELECT query_id, {judge}, answer, line_no, coalesce(score = 1, false) AS c, bool_or(coalesce(score = 1, false)) OVER (PARTITION BY query_id) AS has_c FROM inference_result)
            SELECT query_id, judge, substr(answer, 1, 50) AS head, min(line_no) AS first, count(*) AS n FROM r WHERE c OR NOT has_c GROUP BY ALL""",
        "sub_query_context": """WITH r AS (SELECT query_id, question, line_no, CASE WHEN error IS NULL THEN 'knowledge_base' ELSE 'web' END AS kind, CASE WHEN error IS NULL THEN '' ELSE coalesce(judge_model, '') || '(' || error || ')' || chr(10) END || coalesce(answer, '') || CASE WHEN score = 0 THEN ' (truncated)' ELSE '' END AS said FROM inference_result),
            n AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY line_no) AS i FROM r),
            p AS (SELECT query_id, kind, CASE kind WHEN 'web' THEN '[Web Search]' ELSE '[Knowledge Base]' END || chr(10) || string_agg(i || '. ' || said, chr(10) ORDER BY i) || chr(10) AS part FROM n GROUP BY query_id, kind)
            SELECT query_id, '## Sub-query: ' || q.question || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY kind) AS context FROM p JOIN (SELECT query_id, arg_min(question, line_no) AS question FROM r GROUP BY ALL) q USING (query_id) GROUP BY query_id, q.question""",
        "resume_failed": "SELECT query_id FROM (SELECT query_id, arg_max((error, answer), line_no) AS r FROM inference_result GROUP BY ALL) WHERE NOT (coalesce(r[1], '') = '' AND coalesce(r[2], '') <> '')",
        "resume_rest": "SELECT query_id FROM (SELECT query_id, arg_max((error, answer), line_no) AS r FROM inference_result GROUP BY ALL) WHERE NOT (coalesce(r[1], '') = '' AND coalesce(r[2], '') <> '') UNION ALL SELECT 'new-' || kid FROM knowledge_base",
        "question_stats": "SELECT len(regexp_split_to_array(trim(question, ' '), '\\s+'))::int AS words, count(*) AS n, round(avg(length(question)), 2) AS mean_length FROM inference_result GROUP BY ALL",
    }
