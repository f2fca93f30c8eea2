"""Build state and coverage, latest rows by key, duplicates, and table changes as latest-wins transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.session import table


def rate(covered: Column, total: Column) -> Column:
    """Percent, two places; 0 without any."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.round(covered / total * 100, 2))


def coverage(chunks: DataFrame, vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """By file: chunks, how many have a vector, how many are retrievable (their file is live), and the rates."""
    embedded = vectors.where("embedding is not null").select(F.col("vec_id").alias("kid"), F.lit(1).alias("has_vector"))
    live = entries.where("is_deleted = false and entry_type = 'FILE'").select(F.col("kid").alias("fs_entry_id"), F.lit(1).alias("is_live"))
    counts = chunks.select("kid", "fs_entry_id").join(embedded, "kid", "left").groupBy("fs_entry_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("has_vector").alias("embedded"))
    return counts.join(live, "fs_entry_id", "left").select(
        "fs_entry_id", "chunks", "embedded", F.when(F.col("is_live") == 1, F.col("chunks")).otherwise(0).alias("indexed"), rate(F.col("embedded"), F.col("chunks")).alias("embedded_rate"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; aggregated, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("best"))
    return best.select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in rest]).select(rows.columns)


def first_duplicates(entries: DataFrame) -> DataFrame:
    """(checksum, first_kid, copies): live files of the same content, the lowest kid first."""
    return entries.where("is_deleted = false and entry_type = 'FILE' and checksum is not null").groupBy("checksum").agg(F.min("kid").alias("first_kid"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows overwritten by new ones of the same key, and the other new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def task_state(events: DataFrame) -> DataFrame:
    """State of each task (user) from its append-only log: the last type, the last value that is not null, when it began and last changed, and how many steps it took."""
    step = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(
        F.max_by("event_type", step).alias("state"), F.max_by("value", F.when(F.col("value").isNotNull(), step)).alias("last_value"), F.min("ts").alias("started_at"), F.max("ts").alias("changed_at"), F.count(F.lit(1)).alias("steps"))


def base_by_code(bases: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, kid): live bases by business code; a code that is no integer finds nothing."""
    live = bases.where("is_deleted = false").select("kid")
    return codes.select("code", F.col("code").try_cast("bigint").alias("kid")).join(live, "kid").select("code", "kid")


def batch_summary(rows: DataFrame, failed: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def expired(rows: DataFrame, ts: str, ttl_seconds: int, now: str, size: int | None = None) -> DataFrame:
    """Rows whose time to live ended by now, soonest first; size of them at most, if given."""
    over = rows.withColumn("expires_at", F.col(ts) + F.expr(f"make_dt_interval(0, 0, 0, {ttl_seconds})")).where(F.col("expires_at") <= F.lit(now).cast("timestamp"))
    ordered = over.orderBy("expires_at", *[c for c in rows.columns if c != ts])
    return ordered if size is None else ordered.limit(size)


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "knowledge_chunk"), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "knowledge_fs_entry"))


def latest_task(spark, sf_dir):
    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def latest_chunks(spark, sf_dir):
    """Of several ingests of a chunk number of a file, the last."""
    return latest(table(spark, sf_dir, "knowledge_chunk").select("fs_entry_id", "chunk_no", "kid", "created_at"), ["fs_entry_id", "chunk_no"], ["created_at", "kid"])


def chunk_pages(spark, sf_dir):
    """Page 2 of 20 chunks of the whole table by file, number and id."""
    return table(spark, sf_dir, "knowledge_chunk").select("fs_entry_id", "chunk_no", "kid").orderBy("fs_entry_id", "chunk_no", "kid").offset(20).limit(20)


def duplicate_checksum(spark, sf_dir):
    return first_duplicates(table(spark, sf_dir, "knowledge_fs_entry"))


def metadata_upsert(spark, sf_dir):
    """Active attribute rows by file, name and type: the last written."""
    rows = table(spark, sf_dir, "knowledge_file_metadata_value").where("is_deleted = false").select("fs_entry_id", "property_name", "value_type", "kid", "updated_at")
    return latest(rows, ["fs_entry_id", "property_name", "value_type"], ["updated_at", "kid"])


def replace_by_file(spark, sf_dir):
    """Chunks after the files of base 7 were chunked again as one chunk each."""
    chunks = table(spark, sf_dir, "knowledge_chunk").select("fs_entry_id", "chunk_no", "knowledge_base_id")
    return replaced(chunks, chunks.where("knowledge_base_id = 7").select("fs_entry_id", F.lit(1).alias("chunk_no"), "knowledge_base_id").distinct(), "fs_entry_id").groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("chunks"))


def task_states(spark, sf_dir):
    return task_state(table(spark, sf_dir, "events"))


def kb_lookup(spark, sf_dir):
    codes = table(spark, sf_dir, "inference_result").select(F.regexp_extract("query_id", r"\d+", 0).alias("code")).distinct()
    return base_by_code(table(spark, sf_dir, "knowledge_base"), codes)


def update_summary(spark, sf_dir):
    return batch_summary(table(spark, sf_dir, "inference_result"), F.col("error").isNotNull())


def ttl_expired(spark, sf_dir):
    return expired(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 86_400, "2024-01-15T00:00:00Z")


def ttl_batch(spark, sf_dir):
    """The 100 events to expire next."""
    return expired(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 86_400, "2024-01-15T00:00:00Z", 100)


def task_results(spark, sf_dir):
    """State of each build (user): the last step and its error, also where that is none, and when it first finished (a purchase), which later steps leave."""
    step = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.concat(F.lit("value "), F.col("event_id").cast("string"))))
    return e.groupBy("user_id").agg(F.max_by("event_type", step).alias("state"), F.max_by(F.struct("error"), step)["error"].alias("error"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished_at"))


def build_pages(spark, sf_dir):
    """The result of a build by live file: its state, coverage, and the ids of the first 20 of its chunks."""
    report = file_report(spark, sf_dir)
    chunks = table(spark, sf_dir, "knowledge_chunk")
    first = F.row_number().over(Window.partitionBy("fs_entry_id").orderBy("chunk_no", "kid"))
    page = chunks.select("fs_entry_id", "chunk_no", "kid", first.alias("n")).where("n <= 20").groupBy("fs_entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "kid"))), lambda x: x["kid"]), ",").alias("page"))
    covered = coverage_report(spark, sf_dir).select("fs_entry_id", "embedded", "embedded_rate")
    joined = report.join(covered.withColumnRenamed("fs_entry_id", "kid"), "kid", "left").join(page.withColumnRenamed("fs_entry_id", "kid"), "kid", "left")
    return joined.select("kid", "status", "chunks", F.coalesce("embedded", F.lit(0)).alias("embedded"), F.coalesce("embedded_rate", F.lit(0.0)).alias("embedded_rate"), "page")


def file_report(spark, sf_dir):
    """By live file: characters, lines and chunks of what is stored of it."""
    chunks = table(spark, sf_dir, "knowledge_chunk").groupBy("fs_entry_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk_text")).alias("characters"), F.max("end_line").alias("last_line"), F.max("updated_at").alias("built_at"))
    files = table(spark, sf_dir, "knowledge_fs_entry").where("is_deleted = false and entry_type = 'FILE'")
    status = F.when(F.col("chunks").isNull(), "pending").when(F.col("built_at") < F.col("updated_at"), "stale").otherwise("complete")
    return files.join(chunks, files["kid"] == chunks["fs_entry_id"], "left").select("kid", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "characters", "last_line")


def queries() -> dict:
    return {f.__name__: f for f in (coverage_report, latest_task, latest_chunks, chunk_pages, duplicate_checksum, metadata_upsert, replace_by_file, task_states, kb_lookup, update_summary, ttl_expired, ttl_batch, task_results, build_pages, file_report)}


def oracle_sql() -> dict[str, str]:
    return {
        "coverage_report": """SELECT c.fs_entry_id, count(*) AS chunks, count(e.vec_id) AS embedded, CASE WHEN any_value(f.kid) IS NOT NULL THEN count(*) ELSE 0 END AS indexed, round(count(e.vec_id) / count(*) * 100, 2) AS embedded_rate
            FROM knowledge_chunk c LEFT JOIN embeddings e ON e.vec_id = c.kid LEFT JOIN knowledge_fs_entry f ON f.kid = c.fs_entry_id AND NOT f.is_deleted AND f.entry_type = 'FILE' GROUP BY c.fs_entry_id""",
        "latest_task": "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "latest_chunks": "SELECT fs_entry_id, chunk_no, kid, created_at FROM knowledge_chunk QUALIFY row_number() OVER (PARTITION BY fs_entry_id, chunk_no ORDER BY created_at DESC, kid DESC) = 1",
        "chunk_pages": "SELECT fs_entry_id, chunk_no, kid FROM knowledge_chunk ORDER BY ALL LIMIT 20 OFFSET 20",
        "duplicate_checksum": "SELECT checksum, min(kid) AS first_kid, count(*) AS copies FROM knowledge_fs_entry WHERE NOT is_deleted AND entry_type = 'FILE' AND checksum IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
        "metadata_upsert": "SELECT fs_entry_id, property_name, value_type, kid, updated_at FROM knowledge_file_metadata_value WHERE NOT is_deleted QUALIFY row_number() OVER (PARTITION BY fs_entry_id, property_name, value_type ORDER BY updated_at DESC, kid DESC) = 1",
        "replace_by_file": "WITH n AS (SELECT DISTINCT fs_entry_id, 1 AS chunk_no, knowledge_base_id FROM knowledge_chunk WHERE knowledge_base_id = 7) SELECT knowledge_base_id, count(*) AS chunks FROM (SELECT fs_entry_id, chunk_no, knowledge_base_id FROM knowledge_chunk ANTI JOIN n USING (fs_entry_id) UNION ALL FROM n) GROUP BY ALL",
        "task_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value, min(ts) AS started_at, max(ts) AS changed_at, count(*) AS steps FROM events GROUP BY ALL",
        "kb_lookup": "SELECT DISTINCT regexp_extract(query_id, '\\d+') AS code, b.kid FROM inference_result r JOIN knowledge_base b ON b.kid = TRY_CAST(regexp_extract(query_id, '\\d+') AS bigint) AND NOT b.is_deleted",
        "update_summary": "SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed FROM inference_result",
        "ttl_expired": "SELECT event_id, ts, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15 00:00:00'",
        "ttl_batch": "SELECT event_id, ts, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY expires_at, event_id LIMIT 100",
        "task_results": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'value ' || arg_max(event_id, (ts, event_id)) END AS error, min(ts) FILTER (event_type = 'purchase') AS finished_at FROM events GROUP BY ALL",
        "build_pages": """WITH c AS (SELECT fs_entry_id, count(*) AS chunks, max(updated_at) AS built_at FROM knowledge_chunk GROUP BY ALL), v AS (SELECT c.fs_entry_id, count(e.vec_id) AS embedded, round(count(e.vec_id) / count(*) * 100, 2) AS rate FROM knowledge_chunk c LEFT JOIN embeddings e ON e.vec_id = c.kid GROUP BY ALL),
            p AS (SELECT fs_entry_id, string_agg(kid::varchar, ',' ORDER BY n) AS page FROM (SELECT fs_entry_id, kid, row_number() OVER (PARTITION BY fs_entry_id ORDER BY chunk_no, kid) AS n FROM knowledge_chunk) WHERE n <= 20 GROUP BY ALL)
            SELECT f.kid, CASE WHEN c.chunks IS NULL THEN 'pending' WHEN c.built_at < f.updated_at THEN 'stale' ELSE 'complete' END AS status, coalesce(c.chunks, 0) AS chunks, coalesce(v.embedded, 0) AS embedded, coalesce(v.rate, 0) AS embedded_rate, p.page
            FROM knowledge_fs_entry f LEFT JOIN c ON c.fs_entry_id = f.kid LEFT JOIN v ON v.fs_entry_id = f.kid LEFT JOIN p ON p.fs_entry_id = f.kid WHERE NOT f.is_deleted AND f.entry_type = 'FILE'""",
        "file_report": """WITH c AS (SELECT fs_entry_id, count(*) AS chunks, sum(length(chunk_text))::bigint AS characters, max(end_line) AS last_line, max(updated_at) AS built_at FROM knowledge_chunk GROUP BY ALL)
            SELECT f.kid, CASE WHEN c.chunks IS NULL THEN 'pending' WHEN c.built_at < f.updated_at THEN 'stale' ELSE 'complete' END AS status, coalesce(c.chunks, 0) AS chunks, characters, last_line
            FROM knowledge_fs_entry f LEFT JOIN c ON c.fs_entry_id = f.kid WHERE NOT f.is_deleted AND f.entry_type = 'FILE'""",
    }
