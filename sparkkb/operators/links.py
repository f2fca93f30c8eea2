"""The graph of references between files: spans and tokens in texts, current state of edges, inbound and outbound queries.

An edge keeps the id it was resolved to and the path it names. Its state is a view: a live target id,
else a live file at the path, makes it resolved. Events that change files therefore change no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.operators.orphans import named_paths, path_keys
from sparkkb.session import table

SPAN = r"!?\[[^\]\n]*\]\(\s*(?:<(?=[^<>\s]+>))?([^()\s<>]+)>?(?:\s+[^()\n]*)?\)"
SCHEME = "kbref://"
TOKEN = rf"(?<![\w/]){SCHEME}(\d+)(?!\w)"


def spans(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, target, path, suffix): link and image targets of a text in order."""
    found = texts.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(SPAN), F.lit(1))).alias("place", "target"))
    return found.withColumn("path", F.regexp_extract("target", r"^[^#?]*", 0)).withColumn("suffix", F.regexp_extract("target", r"[#?].*$", 0))


def is_local(target: Column) -> Column:
    """Targets that name a file: not empty, no fragment, no host, no URL scheme."""
    return (target != "") & ~target.startswith("#") & ~target.startswith("//") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def states(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(kid, state, current_target_id, current_path, suffix) of each edge: resolved to a live file, broken if its target is gone, else unresolved."""
    live = entries.where("is_deleted = false").select(F.col("kid").alias("live_id"), F.col("virtual_path").alias("live_path"))
    named = path_keys(links.where("original_target is not null"), entries, entries.where("is_deleted = false")).select("kid", F.col("key").alias("named_id")).distinct()
    edge = links.select("kid", "target_fs_entry_id", F.regexp_extract("original_target", r"[#?].*$", 0).alias("suffix")).distinct()
    by_id = edge.join(live, edge["target_fs_entry_id"] == live["live_id"], "left").join(named, "kid", "left")
    target = F.coalesce("live_id", "named_id")
    state = F.when(target.isNotNull(), "resolved").when(F.col("target_fs_entry_id").isNotNull(), "broken").otherwise("unresolved")
    out = by_id.select("kid", state.alias("state"), target.alias("current_target_id"), "suffix")
    return out.join(live.select(F.col("live_id").alias("current_target_id"), F.col("live_path").alias("current_path")), "current_target_id", "left").select("kid", "state", "current_target_id", "current_path", "suffix")


def neighbours(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(target_id, source_id, edges): resolved edges between live files. Deleted sources are hidden."""
    live = entries.where("is_deleted = false").select(F.col("kid").alias("source_id"))
    resolved = states(links, entries).where("state = 'resolved'").join(links.select("kid", F.col("source_fs_entry_id").alias("source_id")), "kid")
    return resolved.join(live, "source_id", "left_semi").groupBy(F.col("current_target_id").alias("target_id"), "source_id").agg(F.count(F.lit(1)).alias("edges"))


def pending(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(knowledge_base_id, path, sources, edges): what unresolved edges of live files wait for: inbound edges of a path that has no live file."""
    live = entries.where("is_deleted = false").select(F.col("kid").alias("source_fs_entry_id")).distinct()
    open_ = states(links, entries).where("state != 'resolved'").select("kid")
    named = named_paths(links.where("original_target is not null"), entries, entries.where("is_deleted = false")).where("path is not null").select("kid", "knowledge_base_id", "path").distinct()
    edges = links.select("kid", "source_fs_entry_id").distinct().join(open_, "kid", "left_semi").join(live, "source_fs_entry_id", "left_semi").join(named, "kid")
    return edges.groupBy("knowledge_base_id", "path").agg(F.countDistinct("source_fs_entry_id").alias("sources"), F.count(F.lit(1)).alias("edges"))


def resolve_tokens(texts: DataFrame, id_col: str, base_col: str, text_col: str, links: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, text): reference tokens replaced by the current path and suffix of their edge, by the original target where it is not resolved, by nothing where the edge is unknown or of another base."""
    parts = texts.select(id_col, F.col(base_col).alias("base"), F.posexplode(F.split(F.regexp_replace(text_col, TOKEN, "\x01$1\x02"), "\x01")).alias("place", "part"))
    parts = parts.withColumn("edge", F.when(F.col("part").contains("\x02"), F.substring_index("part", "\x02", 1).cast("long"))).withColumn("rest", F.when(F.col("edge").isNotNull(), F.substring_index("part", "\x02", -1)).otherwise(F.col("part")))
    edge = states(links, entries).join(links.select("kid", "knowledge_base_id", "original_target").distinct(), "kid")
    shown = edge.select(F.col("kid").alias("edge"), F.col("knowledge_base_id").alias("base"), F.when(F.col("state") == "resolved", F.concat("current_path", "suffix")).otherwise(F.col("original_target")).alias("shown"))
    filled = parts.join(shown, ["edge", "base"], "left").withColumn("said", F.concat(F.coalesce("shown", F.lit("")), "rest"))
    return filled.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "").alias("text"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "knowledge_file_reference"), table(spark, sf_dir, "knowledge_fs_entry")


def link_extract(spark, sf_dir):
    marked = table(spark, sf_dir, "knowledge_file_reference").select("kid", F.concat(F.lit("see [it]("), "original_target", F.lit(") and ![x](<"), "original_target", F.lit("> 'y')")).alias("text"))
    return spans(marked, "kid", "text").where(is_local(F.col("target")))


def ref_state(spark, sf_dir):
    return states(*_both(spark, sf_dir))


def ref_inbound(spark, sf_dir):
    return neighbours(*_both(spark, sf_dir)).groupBy("target_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("edges").alias("edges"))


def ref_outbound(spark, sf_dir):
    return neighbours(*_both(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("targets"), F.sum("edges").alias("edges"))


def ref_pending(spark, sf_dir):
    return pending(*_both(spark, sf_dir))


def ref_resolve(spark, sf_dir):
    links, entries = _both(spark, sf_dir)
    texts = links.select("kid", "knowledge_base_id", F.concat(F.lit("a kbref://"), "kid", F.lit(" b kbref://"), F.col("kid") + 1, F.lit(".")).alias("text"))
    return resolve_tokens(texts, "kid", "knowledge_base_id", "text", links, entries)


def _state_sql() -> str:
    from sparkkb.operators.problems import _BROKEN_SQL

    ctes = _BROKEN_SQL.replace("WHERE r.target_fs_entry_id IS NULL AND r.original_target IS NOT NULL", "WHERE r.original_target IS NOT NULL").replace(
        "FROM entry WHERE entry_type = 'FILE' GROUP BY ALL", "FROM entry WHERE entry_type = 'FILE' AND NOT is_deleted GROUP BY ALL")
    return ctes + r""", named AS (SELECT DISTINCT r.kid, d.key AS named_id FROM resolved r LEFT JOIN dictionary d ON d.knowledge_base_id = r.knowledge_base_id AND d.virtual_path = r.path),
      state AS (SELECT DISTINCT k.kid, coalesce(l.kid, n.named_id) AS current_target_id, regexp_extract(k.original_target, '[#?].*$') AS suffix,
        CASE WHEN coalesce(l.kid, n.named_id) IS NOT NULL THEN 'resolved' WHEN k.target_fs_entry_id IS NOT NULL THEN 'broken' ELSE 'unresolved' END AS state
        FROM knowledge_file_reference k LEFT JOIN entry l ON l.kid = k.target_fs_entry_id AND NOT l.is_deleted LEFT JOIN named n ON n.kid = k.kid),
      pairs AS (SELECT s.current_target_id AS target_id, k.source_fs_entry_id AS source_id, count(*) AS edges FROM state s JOIN knowledge_file_reference k USING (kid)
        JOIN entry e ON e.kid = k.source_fs_entry_id AND NOT e.is_deleted WHERE s.state = 'resolved' GROUP BY ALL),
      shown AS (SELECT s.kid, k.knowledge_base_id AS base, CASE WHEN s.state = 'resolved' THEN e.virtual_path || s.suffix ELSE k.original_target END AS shown FROM state s JOIN knowledge_file_reference k USING (kid) LEFT JOIN entry e ON e.kid = s.current_target_id)
    """


def queries() -> dict:
    return {f.__name__: f for f in (link_extract, ref_state, ref_inbound, ref_outbound, ref_pending, ref_resolve)}


def oracle_sql() -> dict[str, str]:
    sql = _state_sql()
    local = "original_target <> '' AND NOT starts_with(original_target, '#') AND NOT starts_with(original_target, '//')"
    return {
        "link_extract": f"SELECT kid, p.place::int AS place, original_target AS target, regexp_extract(original_target, '^[^#?]*') AS path, regexp_extract(original_target, '[#?].*$') AS suffix FROM knowledge_file_reference, (VALUES (0), (1)) p(place) WHERE {local}",
        "ref_state": sql + "SELECT s.kid, s.state, s.current_target_id, e.virtual_path AS current_path, s.suffix FROM state s LEFT JOIN entry e ON e.kid = s.current_target_id",
        "ref_inbound": sql + "SELECT target_id, count(*) AS sources, sum(edges)::bigint AS edges FROM pairs GROUP BY ALL",
        "ref_outbound": sql + "SELECT source_id, count(*) AS targets, sum(edges)::bigint AS edges FROM pairs GROUP BY ALL",
        "ref_pending": sql + """SELECT r.knowledge_base_id, r.path, count(DISTINCT k.source_fs_entry_id) AS sources, count(*) AS edges FROM (SELECT DISTINCT kid, knowledge_base_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM resolved WHERE path <> '!') r
            JOIN state s ON s.kid = r.kid AND s.state <> 'resolved' JOIN (SELECT DISTINCT kid, source_fs_entry_id FROM knowledge_file_reference) k ON k.kid = r.kid JOIN (SELECT DISTINCT kid FROM entry WHERE NOT is_deleted) e ON e.kid = k.source_fs_entry_id GROUP BY ALL""",
        "ref_resolve": sql + "SELECT k.kid, 'a ' || coalesce(a.shown, '') || ' b ' || coalesce(b.shown, '') || '.' AS text FROM knowledge_file_reference k LEFT JOIN shown a ON a.kid = k.kid AND a.base = k.knowledge_base_id LEFT JOIN shown b ON b.kid = k.kid + 1 AND b.base = k.knowledge_base_id",
    }
