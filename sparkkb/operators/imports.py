"""Importing files: paths checked, links rewritten to tokens, front matter as attributes, and what an import or update changes.

Tables are never changed in place. Each step gives the rows to append, and a report with a status for each item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.functions.text import mime_type
from sparkkb.operators import build, chunking, links, orphans, tree
from sparkkb.session import table

#: A text with more links than this stays as it is.
MOST_LINKS = 1024
#: A link in three parts: what is before its target, the target, what is after it.
PARTS = r"(!?\[[^\]\n]*\]\(\s*(?:<(?=[^<>\s]+>))?)([^()\s<>]+)(>?(?:\s+[^()\n]*)?\))"
#: Marks around targets while a text is in parts: characters that Unicode reserves for such use.
OPEN, CLOSE = "﷐", "﷑"
#: Places of links of one text fit between the edge ids of two texts.
EDGES = 2048


def clean_path(path: str, root: bool = False) -> str:
    """An absolute path without empty segments; ValueError if it is relative, climbs, or is the root where that is not allowed."""
    parts = [p for p in path.strip().split("/") if p]
    if not path.strip().startswith("/") or ".." in parts or not (parts or root):
        raise ValueError(f"no usable path: {path!r}")
    return "/" + "/".join(parts)


def cleaned_path(path: Column | str, root: bool = False) -> Column:
    """clean_path() of a column; null where it raises."""
    path = F.trim(F.col(path) if isinstance(path, str) else path)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    good = path.startswith("/") & ~F.array_contains(parts, "..") & (F.lit(root) | (F.size(parts) > 0))
    return F.when(good, F.concat(F.lit("/"), F.array_join(parts, "/")))


def existing(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """(knowledge_base_id, virtual_path), once each: the paths that have a live entry."""
    return paths.select("knowledge_base_id", "virtual_path").distinct().join(tree.live(entries).select("knowledge_base_id", "virtual_path"), ["knowledge_base_id", "virtual_path"], "left_semi")


def rewritten(texts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (id, knowledge_base_id, source_fs_entry_id, text, created_at) with local link targets replaced by tokens of edges, and the edges.

    A target that names a live file gives a resolved edge, one that names nothing an unresolved edge with the path. Targets that are empty, fragments,
    hosts, URLs, above or at the root, or directories stay, and so do texts with more than MOST_LINKS links. Edge ids follow from the id and the
    link's place in its text. Repeated rows count once; null texts stay null.
    """
    rows = texts.select("id", "knowledge_base_id", "source_fs_entry_id", "text", "created_at").distinct()
    marked = F.regexp_replace("text", PARTS, f"$1{OPEN}$2{CLOSE}$3")
    parts = F.split(marked, OPEN)
    usable = ~F.col("text").rlike(f"[{OPEN}{CLOSE}]") & F.size(parts).between(2, MOST_LINKS + 1)
    cut = rows.where(F.coalesce(usable, F.lit(False))).select("id", "knowledge_base_id", "source_fs_entry_id", "created_at", F.posexplode(parts).alias("place", "part"))
    cut = cut.withColumns({"original_target": F.when(F.col("place") > 0, F.substring_index("part", CLOSE, 1)), "rest": F.substring_index("part", CLOSE, -1), "kid": F.col("id") * EDGES + F.col("place")})
    named = orphans.named_paths(cut.where(links.is_local(F.col("original_target"))), entries, tree.live(entries)).select("kid", "path", "key")
    folders = tree.live(entries).where("entry_type = 'DIRECTORY'").select("knowledge_base_id", F.col("virtual_path").alias("path"), F.lit(True).alias("is_folder")).distinct()
    edges = cut.join(named.where("path != '/'"), "kid").join(folders, ["knowledge_base_id", "path"], "left").where("key is not null or is_folder is null")
    edges = edges.select(
        "kid", "knowledge_base_id", "source_fs_entry_id", F.col("key").alias("target_fs_entry_id"), "original_target", F.when(F.col("key").isNull(), F.col("path")).alias("target_path"),
        F.regexp_extract("original_target", r"[#?].*$", 0).alias("target_suffix"), F.when(F.col("key").isNull(), "unresolved").otherwise("resolved").alias("status"), "created_at")
    token = F.when(F.col("edge").isNotNull(), F.concat(F.lit("kbref://"), F.col("edge").cast("string"))).otherwise(F.col("original_target"))
    filled = cut.join(edges.select("kid", F.col("kid").alias("edge")), "kid", "left").withColumn("said", F.concat(F.coalesce(token, F.lit("")), "rest"))
    whole = filled.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "").alias("text"))
    return whole.unionByName(rows.where(~F.coalesce(usable, F.lit(False))).select("id", "text")), edges


def attribute_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, property_name, value_type, value_string, value_number, value_boolean, value_datetime, value_string_list): front matter as rows of the attribute table."""
    rows = chunking.front_matters(texts, id_col, text_col)
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    of = lambda kind, c: F.when(F.col("value_type") == kind, c)
    return rows.select(
        id_col, "property_name", "value_type", of("string", plain).alias("value_string"), of("number", plain.try_cast("decimal(20,6)")).alias("value_number"), of("boolean", plain.try_cast("boolean")).alias("value_boolean"),
        of("datetime", plain.try_cast("timestamp")).alias("value_datetime"), of("stringList", F.from_json("value", "array<string>")).alias("value_string_list"))


def with_front_matter(values: DataFrame, found: DataFrame) -> DataFrame:
    """Attribute rows after an import: those of the front matter replace rows of the same file, name and type; keys that front matter no longer has stay."""
    return build.upserted(values.select(found.columns), found, ["fs_entry_id", "property_name", "value_type"])


def import_report(files: DataFrame, entries: DataFrame, reject_copies: bool = False) -> DataFrame:
    """(place, knowledge_base_id, virtual_path, phase, status) of files (place, knowledge_base_id, path, checksum) to be imported.

    Status: ``refused`` for an unusable path, ``repeated`` if an earlier file has the path, ``exists`` if a live entry has it, ``copy`` if copies are rejected and a live
    file of the base has the content, else ``created``. Markdown is phase 2, so that its links find their targets.
    """
    named = files.select("place", "knowledge_base_id", "path", "checksum", cleaned_path("path").alias("virtual_path"))
    first = named.where("virtual_path is not null").groupBy("knowledge_base_id", "virtual_path").agg(F.min("place").alias("first"))
    live = tree.live(entries)
    taken = live.select("knowledge_base_id", "virtual_path", F.lit(True).alias("taken")).distinct()
    copies = live.where("entry_type = 'FILE' and checksum is not null").select("knowledge_base_id", "checksum", F.lit(True).alias("copied")).distinct()
    rows = named.join(first, ["knowledge_base_id", "virtual_path"], "left").join(taken, ["knowledge_base_id", "virtual_path"], "left").join(copies, ["knowledge_base_id", "checksum"], "left")
    status = F.when(F.col("virtual_path").isNull(), "refused").when(F.col("place") != F.col("first"), "repeated").when(F.col("taken"), "exists").when(F.col("copied") & F.lit(reject_copies), "copy").otherwise("created")
    phase = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), 2).otherwise(1)
    return rows.select("place", "knowledge_base_id", "virtual_path", phase.alias("phase"), status.alias("status"))


def new_entries(files: DataFrame, entries: DataFrame, first_kid: int, reject_copies: bool = False) -> DataFrame:
    """Entries (kid, knowledge_base_id, entry_type, name, virtual_path, depth, checksum, mime_type) that an import appends: the files it creates, and the directories they need. Ids follow from the place; directories count back from first_kid."""
    made = import_report(files, entries, reject_copies).where("status = 'created'").join(files.select("place", "checksum"), "place")
    name = F.substring_index("virtual_path", "/", -1)
    own = made.select((F.col("place") + first_kid).alias("kid"), "knowledge_base_id", F.lit("FILE").alias("entry_type"), name.alias("name"), "virtual_path", (F.size(F.split("virtual_path", "/")) - 1).alias("depth"), "checksum", mime_type(name).alias("mime_type"))
    folders = tree.missing_directories(entries, made)
    number = F.xxhash64("knowledge_base_id", "virtual_path")
    return own.unionByName(
        folders.select((-F.abs(number) - 1).alias("kid"), "knowledge_base_id", F.lit("DIRECTORY").alias("entry_type"), name.alias("name"), "virtual_path", "depth", F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("string").alias("mime_type")))


def update_report(updates: DataFrame, entries: DataFrame, running: DataFrame) -> DataFrame:
    """(kid, status) of updates (kid, signature): ``unknown`` without a live file, ``busy`` while a build of it runs, ``conflict`` if the content is no longer what the update refers to, else ``updated``."""
    files = tree.live(entries).where("entry_type = 'FILE'").groupBy("kid").agg(F.max("checksum").alias("checksum"))
    rows = updates.join(files.withColumn("known", F.lit(True)), "kid", "left").join(running.select("kid").distinct().withColumn("runs", F.lit(True)), "kid", "left")
    return rows.select("kid", F.when(F.col("known").isNull(), "unknown").when(F.col("runs"), "busy").when(~F.col("signature").eqNullSafe(F.col("checksum")), "conflict").otherwise("updated").alias("status"))


def timeline(report: DataFrame, at: str) -> DataFrame:
    """Rows (fs_entry_id, event, created_at) that an update appends to its timeline."""
    return report.where("status = 'updated'").select(F.col("kid").alias("fs_entry_id"), F.lit("update").alias("event"), F.lit(at).cast("timestamp").alias("created_at"))


def created_bases(names: DataFrame, bases: DataFrame) -> DataFrame:
    """(kb_name, status) of names to create: a live base of that name ``exists``; a name asked for more than once is created once; blank ones are ``refused``."""
    live = bases.where("is_deleted = false").select("kb_name", F.lit(True).alias("known")).distinct()
    asked = names.select(F.trim("kb_name").alias("kb_name")).distinct().join(live, "kb_name", "left")
    return asked.select("kb_name", F.when(F.coalesce("kb_name", F.lit("")) == "", "refused").when(F.col("known"), "exists").otherwise("created").alias("status"))


def renamed_bases(changes: DataFrame, bases: DataFrame) -> DataFrame:
    """(code, kb_name, status) of new names (code, kb_name) for bases by business code: ``not found`` without a live base of that code, ``refused`` for a blank name, ``exists`` if another live base has it, else ``renamed``."""
    live = bases.where("is_deleted = false").select("kid", F.col("kb_name").alias("old"))
    named = live.groupBy(F.col("old").alias("kb_name")).agg(F.min("kid").alias("first"), F.max("kid").alias("last"))
    rows = changes.select("code", F.trim("kb_name").alias("kb_name"), F.col("code").try_cast("bigint").alias("kid")).join(live, "kid", "left").join(named, "kb_name", "left")
    other = (F.col("first") != F.col("kid")) | (F.col("last") != F.col("kid"))
    status = F.when(F.col("old").isNull(), "not found").when(F.coalesce("kb_name", F.lit("")) == "", "refused").when(other, "exists").otherwise("renamed")
    return rows.select("code", "kb_name", status.alias("status"))


def supplied(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that changes has, where a change supplies a value: an update from a list of values. Of several changes of a key the greatest counts."""
    fields = [c for c in changes.columns if c != key]
    one = changes.groupBy(key).agg(F.max(F.struct(*fields)).alias("__new"))
    joined = rows.join(one, key, "left")
    return joined.select(*[F.coalesce(F.col("__new")[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def stored(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries after their content was stored anew: size, checksum and type from objects (kid, file_size, checksum), what was derived from the old content (line_count) cleared."""
    one = objects.groupBy("kid").agg(F.max(F.struct("file_size", "checksum")).alias("__new"))
    joined = entries.join(one, "kid", "left")
    new = F.col("__new").isNotNull()
    changed = {"file_size": F.col("__new.file_size"), "checksum": F.col("__new.checksum"), "mime_type": mime_type("name"), "line_count": F.lit(None)}
    return joined.select(*[F.when(new, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in entries.columns])


def cache_state(log: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """(key, created_at, expires_at) of a cache from its log (key, ts, hit): an insert replaces the row, a hit after it extends its time to live."""
    last = log.where("not hit").groupBy(key).agg(F.max("ts").alias("created_at"))
    used = log.join(last, key).where(F.col("ts") >= F.col("created_at")).groupBy(key, "created_at").agg(F.max("ts").alias("used_at"))
    return used.select(key, "created_at", (F.col("used_at") + F.expr(f"make_dt_interval(0, 0, 0, {ttl_seconds})")).alias("expires_at"))


def accepted(tasks: DataFrame) -> DataFrame:
    """(task_id, status) of queued tasks (task_id, file_id): the first of each file runs, the others wait for it."""
    first = F.min("task_id").over(Window.partitionBy("file_id"))
    return tasks.select("task_id", F.when(F.col("task_id") == first, "running").otherwise("waiting").alias("status"))


def build_report(texts: DataFrame, id_col: str, text_col: str, kind_col: str) -> DataFrame:
    """(id, status, step) of a build: ``unsupported`` kinds and ``failed`` texts (null or blank) end at their step, all others are chunked and complete."""
    done = chunking.converted(texts, id_col, text_col, kind_col)
    blank = F.coalesce(F.trim(F.col("text")), F.lit("")) == ""
    return done.select(id_col, F.when(F.col("status") != "converted", F.col("status")).when(blank, "failed").otherwise("complete").alias("status"), F.when(F.col("status") != "converted", "markdown").when(blank, "chunking").otherwise("complete").alias("step"))


def cleanup(cache: DataFrame, now: str, size: int) -> DataFrame:
    """(key, expires_at, state): the next entries to evict, soonest first: READY ones whose time is over, and ERROR ones again; they are EVICTING then."""
    due = cache.where((F.col("state") == "ERROR") | ((F.col("state") == "READY") & (F.col("expires_at") <= F.lit(now).cast("timestamp"))))
    return due.orderBy("expires_at", "key").limit(size).select("key", "expires_at", F.lit("EVICTING").alias("state"))


def evicted(cache: DataFrame, done: DataFrame) -> DataFrame:
    """The cache without the entries whose eviction succeeded."""
    return cache.join(done.select("key").distinct(), "key", "left_anti")


# --- queries


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files to be imported; a document without source, base or name has an unusable path."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("place"), "knowledge_base_id", F.concat_ws("/", F.when(F.col("source").isNotNull(), ""), F.col("source"), F.col("file_name")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "knowledge_fs_entry")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A text for each link of the reference table, as a link, as an image, and in a form that is none."""
    r = table(spark, sf_dir, "knowledge_file_reference").where("original_target is not null")
    text = F.concat(F.lit("# [a]("), "original_target", F.lit(") b\n\n![c](<"), "original_target", F.lit("> \"d\") [e](https://x.y/z) [f](#g) ["), "original_target", F.lit("]"))
    return rewritten(r.select(F.col("kid").alias("id"), "knowledge_base_id", "source_fs_entry_id", text.alias("text"), "created_at"), _entries(spark, sf_dir))


def links_rewritten(spark, sf_dir):
    return _linked(spark, sf_dir)[0]


def links_created(spark, sf_dir):
    return _linked(spark, sf_dir)[1].select("kid", "target_fs_entry_id", "target_path", "status")


def path_check(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_file_reference").select(cleaned_path("original_target").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def existing_paths(spark, sf_dir):
    return existing(table(spark, sf_dir, "knowledge_file_reference").select("knowledge_base_id", F.col("target_path").alias("virtual_path")), _entries(spark, sf_dir))


def entry_lookup(spark, sf_dir):
    """The entry at the path that each link was resolved to."""
    paths = table(spark, sf_dir, "knowledge_file_reference").where("target_path is not null").select("kid", "knowledge_base_id", F.col("target_path").alias("virtual_path"))
    return paths.join(tree.live(_entries(spark, sf_dir)).select("knowledge_base_id", "virtual_path", F.col("kid").alias("entry_id"), "entry_type"), ["knowledge_base_id", "virtual_path"]).select("kid", "entry_id", "entry_type")


def front_matter_values(spark, sf_dir):
    return attribute_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "property_name", "value_type", "value_string")


def front_matter_upsert(spark, sf_dir):
    """Owners of documents as attributes of the files whose id they have, over what is stored."""
    found = attribute_rows(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "fs_entry_id").where("property_name = 'owner'").select("fs_entry_id", "property_name", "value_type", "value_string")
    values = table(spark, sf_dir, "knowledge_file_metadata_value").where("is_deleted = false and property_name = 'owner'")
    return with_front_matter(values, found).groupBy("fs_entry_id").agg(F.count(F.lit(1)).alias("n"), F.max("value_string").alias("owner"))


def import_status(spark, sf_dir):
    return import_report(_files(spark, sf_dir), _entries(spark, sf_dir)).select(F.col("place").alias("doc_id"), "virtual_path", "phase", "status")


def imported_entries(spark, sf_dir):
    return new_entries(_files(spark, sf_dir), _entries(spark, sf_dir), 10**9).select("knowledge_base_id", "entry_type", "name", "virtual_path", "depth", "checksum")


def update_status(spark, sf_dir):
    """Each reference asks to update its target, with the content that the target's source has; files without a line count are being built."""
    e = _entries(spark, sf_dir)
    asked = table(spark, sf_dir, "knowledge_file_reference").where("target_fs_entry_id is not null").select(F.col("target_fs_entry_id").alias("kid"), "source_fs_entry_id").distinct()
    asked = asked.join(e.select(F.col("kid").alias("source_fs_entry_id"), F.col("checksum").alias("signature")), "source_fs_entry_id", "left")
    return update_report(asked.select("kid", "signature"), e, e.where("entry_type = 'FILE' and line_count is null")).groupBy("kid", "status").agg(F.count(F.lit(1)).alias("n"))


def base_creation(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_name")).unionAll(table(spark, sf_dir, "knowledge_base").select("kb_name"))
    return created_bases(names, table(spark, sf_dir, "knowledge_base"))


def update_from_values(spark, sf_dir):
    """Sizes and line counts of entries from what their chunks hold."""
    changes = table(spark, sf_dir, "knowledge_chunk").groupBy(F.col("fs_entry_id").alias("kid")).agg(F.sum(F.length("chunk_text")).alias("file_size"), F.max("end_line").alias("line_count"))
    return supplied(_entries(spark, sf_dir).select("kid", "name", "file_size", "line_count"), changes, "kid")


def storage_update(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("kid"), F.col("n_chars").alias("file_size"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    return stored(_entries(spark, sf_dir).select("kid", "name", "file_size", "checksum", "mime_type", "line_count"), objects)


def _cache(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "purchase").alias("hit"))


def cache_touch(spark, sf_dir):
    return cache_state(_cache(spark, sf_dir), "user_id", 600)


def _states(spark, sf_dir):
    """A cache entry for each user: over ten minutes after its last event, failed if that is an error, gone if it is a view."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg((F.max("ts").cast("timestamp") + F.expr("interval 10 minutes")).alias("expires_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return e.select("key", "expires_at", F.when(F.col("last") == "error", "ERROR").when(F.col("last") == "view", "EVICTED").otherwise("READY").alias("state"))


def cache_cleanup(spark, sf_dir):
    """The first 50 users whose cache is over, or failed."""
    return cleanup(_states(spark, sf_dir), "2024-01-20T00:00:00Z", 50)


def cache_rest(spark, sf_dir):
    """The cache after these were evicted."""
    return evicted(_states(spark, sf_dir), cache_cleanup(spark, sf_dir)).select("key", "state")


def base_rename(spark, sf_dir):
    """Each query's number asks for the name of a document source, or of a base."""
    r = table(spark, sf_dir, "inference_result").select(F.regexp_extract("query_id", r"\d+", 0).cast("int").cast("string").alias("code")).distinct()
    names = table(spark, sf_dir, "knowledge_base").select((F.col("kid") + 1).cast("string").alias("code"), "kb_name").unionAll(table(spark, sf_dir, "documents").where("knowledge_base_id is not null").select(F.col("knowledge_base_id").cast("string"), "source").distinct())
    return renamed_bases(r.join(names, "code", "left").select("code", "kb_name"), table(spark, sf_dir, "knowledge_base"))


def task_queue(spark, sf_dir):
    return accepted(table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("file_id"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def build_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return build_report(d.select("doc_id", "text", F.substring_index("file_name", ".", -1).alias("kind")), "doc_id", "text", "kind")


def queries() -> dict:
    return {f.__name__: f for f in (
        links_rewritten, links_created, path_check, existing_paths, entry_lookup, front_matter_values, front_matter_upsert, import_status, imported_entries, update_status, base_creation, update_from_values, storage_update,
        cache_touch, cache_cleanup, cache_rest, base_rename, task_queue, build_status)}


def oracle_sql() -> dict[str, str]:
    from sparkkb.operators.problems import _BROKEN_SQL

    ctes = _BROKEN_SQL.replace("WHERE r.target_fs_entry_id IS NULL AND r.original_target IS NOT NULL", "WHERE r.original_target IS NOT NULL").replace(
        "FROM entry WHERE entry_type = 'FILE' GROUP BY ALL", "FROM entry WHERE entry_type = 'FILE' AND NOT is_deleted GROUP BY ALL")
    local = "original_target <> '' AND NOT starts_with(original_target, '#') AND NOT starts_with(original_target, '//') AND NOT regexp_matches(original_target, '^[A-Za-z][A-Za-z0-9+.-]*:')"
    spelled = "regexp_full_match(original_target, '[^()\\s<>]+')"
    edge = ctes + f""", named AS (SELECT DISTINCT r.kid, r.path, d.key FROM resolved r LEFT JOIN dictionary d ON d.knowledge_base_id = r.knowledge_base_id AND d.virtual_path = r.path),
      edge AS (SELECT DISTINCT k.kid, k.original_target, n.path, n.key FROM knowledge_file_reference k JOIN named n USING (kid) WHERE {local} AND {spelled} AND n.path NOT IN ('!', '')
        AND (n.key IS NOT NULL OR NOT EXISTS (SELECT 1 FROM entry f WHERE f.knowledge_base_id = k.knowledge_base_id AND f.virtual_path = n.path AND f.entry_type = 'DIRECTORY' AND NOT f.is_deleted))) """
    path = "CASE WHEN starts_with(trim({0}, ' '), '/') AND NOT list_contains(string_split({0}, '/'), '..') AND len(list_filter(string_split(trim({0}, ' '), '/'), lambda x: x <> '')) > 0 THEN '/' || array_to_string(list_filter(string_split(trim({0}, ' '), '/'), lambda x: x <> ''), '/') END"
    files = "files AS (SELECT doc_id, knowledge_base_id, concat_ws('/', CASE WHEN source IS NOT NULL THEN '' END, source, file_name) AS p, sha256(text) AS checksum FROM documents)"
    imported = f"""WITH {files}, named AS (SELECT *, {path.format("p")} AS virtual_path FROM files),
      status AS (SELECT n.doc_id, n.knowledge_base_id, n.virtual_path, n.checksum, CASE WHEN regexp_matches(lower(p), '\\.(md|markdown)$') THEN 2 ELSE 1 END AS phase,
        CASE WHEN virtual_path IS NULL THEN 'refused' WHEN n.knowledge_base_id IS NOT NULL AND row_number() OVER (PARTITION BY n.knowledge_base_id, n.virtual_path ORDER BY doc_id) > 1 THEN 'repeated'
          WHEN EXISTS (SELECT 1 FROM knowledge_fs_entry e WHERE NOT e.is_deleted AND e.knowledge_base_id = n.knowledge_base_id AND e.virtual_path = n.virtual_path) THEN 'exists' ELSE 'created' END AS status FROM named n) """
    title = "regexp_extract(text, '^---\\n(?:[^\\n]*\\n)*?{0}:[ ]*([^\\n]*?)[ ]*\\n', 1)"
    kind = "lower(CASE WHEN contains(file_name, '.') THEN regexp_extract(file_name, '[^.]*$') ELSE file_name END)"
    return {
        "links_rewritten": edge + """SELECT DISTINCT k.kid AS id, '# [a](' || coalesce('kbref://' || (e.kid * 2048 + 1), k.original_target) || ') b' || chr(10) || chr(10) || '![c](<' || coalesce('kbref://' || (e.kid * 2048 + 2), k.original_target)
            || '> "d") [e](https://x.y/z) [f](#g) [' || k.original_target || ']' AS text FROM knowledge_file_reference k LEFT JOIN edge e USING (kid) WHERE k.original_target IS NOT NULL""",
        "links_created": edge + "SELECT e.kid * 2048 + p AS kid, key AS target_fs_entry_id, CASE WHEN key IS NULL THEN path END AS target_path, CASE WHEN key IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM edge e, (VALUES (1), (2)) v(p)",
        "path_check": f"SELECT {path.format('original_target')} AS path, count(*) AS n FROM knowledge_file_reference GROUP BY ALL",
        "existing_paths": "SELECT DISTINCT r.knowledge_base_id, r.target_path AS virtual_path FROM knowledge_file_reference r SEMI JOIN (FROM knowledge_fs_entry WHERE NOT is_deleted) e ON e.knowledge_base_id = r.knowledge_base_id AND e.virtual_path = r.target_path",
        "entry_lookup": "SELECT r.kid, e.kid AS entry_id, e.entry_type FROM knowledge_file_reference r JOIN knowledge_fs_entry e ON e.knowledge_base_id = r.knowledge_base_id AND e.virtual_path = r.target_path AND NOT e.is_deleted",
        "front_matter_values": f"SELECT doc_id, 'title' AS property_name, 'string' AS value_type, {title.format('title')} AS value_string FROM documents WHERE starts_with(text, '---') UNION ALL SELECT doc_id, 'owner', 'string', {title.format('owner')} FROM documents WHERE starts_with(text, '---')",
        "front_matter_upsert": f"""WITH n AS (SELECT doc_id AS fs_entry_id, 'string' AS value_type, {title.format('owner')} AS value_string FROM documents WHERE starts_with(text, '---'))
            SELECT fs_entry_id, count(*) AS n, max(value_string) AS owner FROM (SELECT fs_entry_id, value_string FROM n UNION ALL
              SELECT v.fs_entry_id, v.value_string FROM knowledge_file_metadata_value v WHERE NOT v.is_deleted AND v.property_name = 'owner' AND NOT EXISTS (SELECT 1 FROM n WHERE n.fs_entry_id = v.fs_entry_id AND n.value_type = v.value_type)) GROUP BY ALL""",
        "import_status": imported + "SELECT doc_id, virtual_path, phase, status FROM status",
        "imported_entries": imported + """, made AS (SELECT * FROM status WHERE status = 'created')
            SELECT knowledge_base_id, 'FILE' AS entry_type, regexp_extract(virtual_path, '[^/]*$') AS name, virtual_path, (len(string_split(virtual_path, '/')) - 1)::int AS depth, checksum FROM made
            UNION ALL SELECT DISTINCT m.knowledge_base_id, 'DIRECTORY', string_split(m.virtual_path, '/')[2], '/' || string_split(m.virtual_path, '/')[2], 1, NULL FROM made m WHERE len(string_split(m.virtual_path, '/')) > 2
              AND NOT EXISTS (SELECT 1 FROM knowledge_fs_entry e WHERE NOT e.is_deleted AND e.knowledge_base_id = m.knowledge_base_id AND e.virtual_path = '/' || string_split(m.virtual_path, '/')[2])""",
        "update_status": """WITH a AS (SELECT DISTINCT target_fs_entry_id AS kid, source_fs_entry_id FROM knowledge_file_reference WHERE target_fs_entry_id IS NOT NULL), f AS (SELECT kid, checksum, line_count FROM knowledge_fs_entry WHERE NOT is_deleted AND entry_type = 'FILE')
            SELECT a.kid, CASE WHEN f.kid IS NULL THEN 'unknown' WHEN f.line_count IS NULL THEN 'busy' WHEN s.checksum IS DISTINCT FROM f.checksum THEN 'conflict' ELSE 'updated' END AS status, count(*) AS n
            FROM a LEFT JOIN f USING (kid) LEFT JOIN knowledge_fs_entry s ON s.kid = a.source_fs_entry_id GROUP BY ALL""",
        "base_creation": """SELECT DISTINCT n.kb_name, CASE WHEN coalesce(n.kb_name, '') = '' THEN 'refused' WHEN EXISTS (SELECT 1 FROM knowledge_base b WHERE NOT b.is_deleted AND b.kb_name = n.kb_name) THEN 'exists' ELSE 'created' END AS status
            FROM (SELECT trim(source, ' ') AS kb_name FROM documents UNION ALL SELECT trim(kb_name, ' ') FROM knowledge_base) n""",
        "update_from_values": "WITH c AS (SELECT fs_entry_id AS kid, sum(length(chunk_text))::bigint AS s, max(end_line) AS l FROM knowledge_chunk GROUP BY ALL) SELECT e.kid, e.name, coalesce(c.s, e.file_size) AS file_size, coalesce(c.l, e.line_count) AS line_count FROM knowledge_fs_entry e LEFT JOIN c USING (kid)",
        "storage_update": """SELECT e.kid, e.name, CASE WHEN d.doc_id IS NULL THEN e.file_size ELSE d.n_chars END AS file_size, CASE WHEN d.doc_id IS NULL THEN e.checksum ELSE sha256(d.text) END AS checksum,
            CASE WHEN d.doc_id IS NULL THEN e.mime_type ELSE m.mime END AS mime_type, CASE WHEN d.doc_id IS NULL THEN e.line_count END AS line_count FROM knowledge_fs_entry e LEFT JOIN documents d ON d.doc_id = e.kid, LATERAL (SELECT """
            + chunking.MIME_SQL.replace("name", "e.name") + " AS mime) m",
        "cache_touch": "WITH l AS (SELECT user_id, max(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.user_id, l.created_at, max(e.ts) + INTERVAL 10 MINUTE AS expires_at FROM events e JOIN l USING (user_id) WHERE e.ts >= l.created_at GROUP BY ALL",
        "cache_cleanup": """WITH e AS (SELECT user_id AS key, max(ts) + INTERVAL 10 MINUTE AS expires_at, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY ALL)
            SELECT key, expires_at, 'EVICTING' AS state FROM e WHERE last = 'error' OR (last <> 'view' AND expires_at <= TIMESTAMP '2024-01-20 00:00:00') ORDER BY expires_at, key LIMIT 50""",
        "cache_rest": """WITH e AS (SELECT user_id AS key, max(ts) + INTERVAL 10 MINUTE AS expires_at, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY ALL),
            d AS (SELECT key FROM e WHERE last = 'error' OR (last <> 'view' AND expires_at <= TIMESTAMP '2024-01-20 00:00:00') ORDER BY expires_at, key LIMIT 50)
            SELECT key, CASE last WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'EVICTED' ELSE 'READY' END AS state FROM e ANTI JOIN d USING (key)""",
        "base_rename": """WITH r AS (SELECT DISTINCT TRY_CAST(regexp_extract(query_id, '\\d+') AS int)::varchar AS code FROM inference_result),
            n AS (SELECT (kid + 1)::varchar AS code, kb_name FROM knowledge_base UNION ALL (SELECT DISTINCT knowledge_base_id::varchar, source FROM documents WHERE knowledge_base_id IS NOT NULL)),
            c AS (SELECT r.code, trim(n.kb_name, ' ') AS kb_name, TRY_CAST(r.code AS bigint) AS kid FROM r LEFT JOIN n ON n.code = r.code)
            SELECT c.code, c.kb_name, CASE WHEN NOT EXISTS (SELECT 1 FROM knowledge_base b WHERE NOT b.is_deleted AND b.kid = c.kid) THEN 'not found' WHEN coalesce(c.kb_name, '') = '' THEN 'refused'
              WHEN EXISTS (SELECT 1 FROM knowledge_base b WHERE NOT b.is_deleted AND b.kb_name = c.kb_name AND b.kid <> c.kid) THEN 'exists' ELSE 'renamed' END AS status FROM c""",
        "task_queue": "SELECT CASE WHEN r = 1 THEN 'running' ELSE 'waiting' END AS status, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY ALL",
        "build_status": f"""SELECT doc_id, CASE WHEN NOT k THEN 'unsupported' WHEN blank THEN 'failed' ELSE 'complete' END AS status, CASE WHEN NOT k THEN 'markdown' WHEN blank THEN 'chunking' ELSE 'complete' END AS step
            FROM (SELECT doc_id, coalesce({kind} IN ('md', 'markdown', 'txt', 'html', 'htm', 'csv'), false) AS k, text IS NULL OR regexp_full_match(text, '[\\s\\x00\\x{{feff}}]*') AS blank FROM documents)""",
    }
