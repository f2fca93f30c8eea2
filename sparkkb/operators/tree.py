"""The file tree: listing, globbing, subtrees, paths, and changes as transforms of the entry table.

Containment is answered by equality: an entry's path gives the paths of all its ancestors, which are
joined to the wanted roots. No pair of unrelated entries is ever compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.functions.paths import normalize_path, parent_path
from sparkkb.session import table


def live(entries: DataFrame) -> DataFrame:
    return entries.where("is_deleted = false")


def lookup(entries: DataFrame, base: int, path: str) -> DataFrame:
    """The live entry at a path of a base, if any."""
    return live(entries).where((F.col("knowledge_base_id") == base) & (F.col("virtual_path") == path))


def list_dir(entries: DataFrame, base: int, path: str = "/") -> DataFrame:
    """Live children of a directory, directories first, then by lower-case name: (kid, name, kind, size)."""
    children = live(entries).where((F.col("knowledge_base_id") == base) & (parent_path("virtual_path") == path.rstrip("/")))
    kind = F.when(F.col("entry_type") == "DIRECTORY", "directory").otherwise("file")
    return children.select("kid", "name", kind.alias("kind"), F.when(kind == "directory", 0).otherwise(F.coalesce("file_size", F.lit(0))).alias("size")).orderBy(F.col("kind"), F.lower("name"), "kid")


def segment_pattern(segment: str) -> str:
    """A shell pattern of one segment as a regular expression: ``*``, ``?``, ``[...]`` and ``[!...]``."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        i += 1
        close = segment.find("]", i + 1 + segment[i : i + 1].count("!")) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close >= 0:
            body = segment[i:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", "\\^", 1) if body.startswith("^") else body) + "]"
            i = close + 1
        else:
            out += re.escape(c)
    return out


def glob(entries: DataFrame, pattern: str) -> DataFrame:
    """Live entries whose path matches a pattern segment by segment, case-sensitively. ``**`` and relative or root patterns are refused."""
    segments = [s for s in pattern.split("/") if s]
    if not pattern.startswith("/") or not segments or "**" in segments:
        raise ValueError("an absolute pattern below the root without ** is needed")
    depth = F.length("virtual_path") - F.length(F.replace(F.col("virtual_path"), F.lit("/"), F.lit("")))
    return live(entries).where((depth == len(segments)) & F.col("virtual_path").rlike("^/" + "/".join(map(segment_pattern, segments)) + "$"))


def _ancestors(path: Column) -> Column:
    """The paths of an entry and of all its ancestors, from the top."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def subtree(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_kid, kid): the live entries at and below each root; roots has kid, knowledge_base_id, virtual_path."""
    above = live(entries).where("virtual_path != '/'").select("kid", "knowledge_base_id", F.explode(_ancestors(F.col("virtual_path"))).alias("virtual_path"))
    return above.join(roots.select(F.col("kid").alias("root_kid"), "knowledge_base_id", "virtual_path"), ["knowledge_base_id", "virtual_path"]).select("root_kid", "kid")


def rebuilt_paths(entries: DataFrame) -> DataFrame:
    """(kid, path): paths from names and parents alone, level by level from the top."""
    node = entries.select("kid", "parent_entry_id", "name")
    level = node.where("parent_entry_id is null").select("kid", F.concat(F.lit("/"), "name").alias("path"))
    out = level
    for _ in range((entries.agg(F.max("depth")).first()[0] or 1) - 1):
        level = node.join(level.select(F.col("kid").alias("parent_entry_id"), "path"), "parent_entry_id").select("kid", F.concat("path", F.lit("/"), "name").alias("path"))
        out = out.unionAll(level)
    return out


def ancestor_names(entries: DataFrame) -> DataFrame:
    """(kid, names): names of the live entry and its live ancestors from the top, joined by a slash."""
    above = live(entries).select("kid", "knowledge_base_id", F.posexplode(_ancestors(F.col("virtual_path"))).alias("level", "virtual_path"))
    named = above.join(live(entries).select("knowledge_base_id", "virtual_path", "name"), ["knowledge_base_id", "virtual_path"])
    return named.groupBy("kid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), "/").alias("names"))


def _inside(path: str, base: int) -> Column:
    return (F.col("knowledge_base_id") == base) & ((F.col("virtual_path") == path) | F.col("virtual_path").startswith(path + "/"))


def moved(entries: DataFrame, base: int, path: str, to: str) -> DataFrame:
    """The entry table after a file or directory moved (or was renamed): parent, paths, names and depths of its subtree. Not into itself. The parent is null at the top, and where the new place has no directory yet."""
    if to == path or to.startswith(path + "/"):
        raise ValueError("an entry can't be moved into itself")
    inside = _inside(path, base) & ~F.col("is_deleted")
    at_top = inside & (F.col("virtual_path") == path)
    above = to.rsplit("/", 1)[0]
    parent = lookup(entries, base, above).agg(F.max("kid")).first()[0] if above else None
    changes = {
        "name": F.when(at_top, to.rsplit("/", 1)[1]).otherwise(F.col("name")),
        "depth": F.when(inside, F.col("depth") + (to.count("/") - path.count("/"))).otherwise(F.col("depth")),
        "virtual_path": F.when(inside, F.concat(F.lit(to), F.expr(f"substring(virtual_path, {len(path) + 1})"))).otherwise(F.col("virtual_path")),
        "parent_entry_id": F.when(at_top, F.lit(parent).cast("long")).otherwise(F.col("parent_entry_id")) if "parent_entry_id" in entries.columns else None,
    }
    return entries.withColumns({k: c for k, c in changes.items() if c is not None})


def moved_batch(entries: DataFrame, base: int, moves: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The entry table after several moves, one after another, and (path, to, status) of each: ``moved``, ``not found``, ``into itself`` or ``taken``. ValueError if an entry is to be moved twice."""
    if len({path for path, _ in moves}) < len(moves):
        raise ValueError("an entry can be moved once only")
    said = []
    for path, to in moves:
        there = {r["virtual_path"] for r in live(entries).where((F.col("knowledge_base_id") == base) & F.col("virtual_path").isin(path, to)).select("virtual_path").distinct().collect()}
        status = "into itself" if to == path or to.startswith(path + "/") else "not found" if path not in there else "taken" if to in there else "moved"
        entries = moved(entries, base, path, to) if status == "moved" else entries
        said.append((path, to, status))
    return entries, said


def deleted(entries: DataFrame, base: int, path: str) -> DataFrame:
    """The entry table after a subtree was deleted; its rows stay as tombstones."""
    return entries.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(_inside(path, base), F.lit(False)))


def missing_directories(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(knowledge_base_id, virtual_path, depth): the directories that new files need and that don't exist yet; files has knowledge_base_id, virtual_path."""
    needed = files.select("knowledge_base_id", F.posexplode(_ancestors(normalize_path(parent_path("virtual_path")))).alias("level", "virtual_path")).where("virtual_path != '/'").distinct()
    return needed.join(live(entries), ["knowledge_base_id", "virtual_path"], "left_anti").select("knowledge_base_id", "virtual_path", (F.col("level") + 1).alias("depth"))


def label(prefix: str = "d") -> Column:
    """A label of a tree path: depth, and eight characters of the name's md5."""
    return F.concat(F.lit(prefix), F.col("depth").cast("string"), F.lit("_"), F.substring(F.md5(F.col("name").cast("binary")), 1, 8))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "knowledge_fs_entry")


def _top(entries: DataFrame, base: int = 7) -> str:
    """The first top-level directory of a base."""
    return live(entries).where((F.col("knowledge_base_id") == base) & (F.col("entry_type") == "DIRECTORY") & F.col("parent_entry_id").isNull()).orderBy("kid").first()["virtual_path"]


def list_dir_top(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return list_dir(e, 7, _top(e))


def glob_segments(spark, sf_dir):
    return glob(_entries(spark, sf_dir), "/*[0-9]/[a-p]*-??*.md").select("kid", "virtual_path")


def subtree_files(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return subtree(e, live(e).where("entry_type = 'DIRECTORY'"))


def path_recursive(spark, sf_dir):
    return rebuilt_paths(_entries(spark, sf_dir))


def ancestor_path(spark, sf_dir):
    return ancestor_names(_entries(spark, sf_dir))


def rename_subtree(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return moved(e, 7, _top(e), "/renamed").select("kid", "name", "virtual_path", "depth")


def move_subtree(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return moved(e, 7, _top(e), "/new/place/for_it").select("kid", "name", "virtual_path", "depth")


def _first_file(entries: DataFrame, top: str) -> str:
    """The first file in a directory of base 7."""
    return live(entries).where((F.col("knowledge_base_id") == 7) & (F.col("entry_type") == "FILE") & (parent_path("virtual_path") == top)).orderBy("kid").first()["virtual_path"]


def move_to_top(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return moved(e, 7, _first_file(e, _top(e)), "/out.md").select("kid", "parent_entry_id", "name", "virtual_path", "depth")


def move_batch(spark, sf_dir):
    """Two moves that follow each other, and three that are refused."""
    e = _entries(spark, sf_dir)
    top = _top(e)
    after, said = moved_batch(e, 7, [(_first_file(e, top), "/out.md"), ("/out.md", top + "/back.md"), ("/nowhere", "/x"), (top, top + "/y"), (top + "/back.md", top)])
    assert [x for *_, x in said] == ["moved", "moved", "not found", "into itself", "taken"]
    return after.select("kid", "parent_entry_id", "name", "virtual_path", "depth")


def soft_delete_visibility(spark, sf_dir):
    e = _entries(spark, sf_dir)
    after = live(deleted(e, 7, _top(e)))
    return after.groupBy("knowledge_base_id", "entry_type").agg(F.count(F.lit(1)).alias("visible"))


def directories_to_create(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("knowledge_base_id is not null and file_name is not null and source is not null").select("knowledge_base_id", F.concat(F.lit("/imported/"), "source", F.lit("/"), "file_name").alias("virtual_path"))
    return missing_directories(_entries(spark, sf_dir), files)


def tree_labels(spark, sf_dir):
    return _entries(spark, sf_dir).select("kid", label().alias("label"))


_TOP_SQL = "(SELECT virtual_path FROM knowledge_fs_entry WHERE knowledge_base_id = 7 AND NOT is_deleted AND entry_type = 'DIRECTORY' AND parent_entry_id IS NULL ORDER BY kid LIMIT 1)"


def _moved_sql(to: str) -> str:
    inside = "(knowledge_base_id = 7 AND NOT is_deleted AND (virtual_path = top OR starts_with(virtual_path, top || '/')))"
    return f"""SELECT kid, CASE WHEN {inside} AND virtual_path = top THEN '{to.rsplit("/", 1)[1]}' ELSE name END AS name,
        CASE WHEN {inside} THEN '{to}' || substr(virtual_path, length(top) + 1) ELSE virtual_path END AS virtual_path, (depth + CASE WHEN {inside} THEN {to.count("/") - 1} ELSE 0 END)::int AS depth
        FROM knowledge_fs_entry, (SELECT {_TOP_SQL} AS top)"""


_FILE_SQL = f"""SELECT e.kid, CASE WHEN e.kid = f.kid THEN {{parent}} ELSE e.parent_entry_id END AS parent_entry_id, CASE WHEN e.kid = f.kid THEN '{{name}}' ELSE e.name END AS name,
    CASE WHEN e.kid = f.kid THEN {{path}} ELSE e.virtual_path END AS virtual_path, CASE WHEN e.kid = f.kid THEN {{depth}} ELSE e.depth END AS depth FROM knowledge_fs_entry e, (SELECT kid, parent_entry_id AS parent, depth AS d, regexp_replace(virtual_path, '/[^/]*$', '') AS top
      FROM knowledge_fs_entry WHERE knowledge_base_id = 7 AND NOT is_deleted AND entry_type = 'FILE' AND regexp_replace(virtual_path, '/[^/]*$', '') = {_TOP_SQL} ORDER BY kid LIMIT 1) f"""


def queries() -> dict:
    return {"list_dir": list_dir_top} | {f.__name__: f for f in (glob_segments, subtree_files, path_recursive, ancestor_path, rename_subtree, move_subtree, move_to_top, move_batch, soft_delete_visibility, directories_to_create, tree_labels)}


def oracle_sql() -> dict[str, str]:
    return {
        "list_dir": f"""SELECT kid, name, CASE entry_type WHEN 'DIRECTORY' THEN 'directory' ELSE 'file' END AS kind, CASE entry_type WHEN 'DIRECTORY' THEN 0 ELSE coalesce(file_size, 0) END AS size
            FROM knowledge_fs_entry WHERE NOT is_deleted AND knowledge_base_id = 7 AND regexp_replace(virtual_path, '/[^/]*$', '') = {_TOP_SQL}""",
        "glob_segments": "SELECT kid, virtual_path FROM knowledge_fs_entry WHERE NOT is_deleted AND regexp_full_match(virtual_path, '/[^/]*[0-9]/[a-p][^/]*-[^/][^/][^/]*\\.md')",
        "subtree_files": "SELECT r.kid AS root_kid, f.kid FROM knowledge_fs_entry r JOIN knowledge_fs_entry f ON f.knowledge_base_id = r.knowledge_base_id AND NOT f.is_deleted AND (f.virtual_path = r.virtual_path OR starts_with(f.virtual_path, r.virtual_path || '/')) WHERE NOT r.is_deleted AND r.entry_type = 'DIRECTORY'",
        "path_recursive": "WITH RECURSIVE p AS (SELECT kid, '/' || name AS path FROM knowledge_fs_entry WHERE parent_entry_id IS NULL UNION ALL SELECT e.kid, p.path || '/' || e.name FROM knowledge_fs_entry e JOIN p ON e.parent_entry_id = p.kid) SELECT kid, path FROM p",
        "ancestor_path": "SELECT f.kid, string_agg(a.name, '/' ORDER BY length(a.virtual_path)) AS names FROM knowledge_fs_entry f JOIN knowledge_fs_entry a ON a.knowledge_base_id = f.knowledge_base_id AND NOT a.is_deleted AND (a.virtual_path = f.virtual_path OR starts_with(f.virtual_path, a.virtual_path || '/')) WHERE NOT f.is_deleted GROUP BY f.kid",
        "rename_subtree": _moved_sql("/renamed"),
        "move_subtree": _moved_sql("/new/place/for_it"),
        "move_to_top": _FILE_SQL.format(parent="NULL", name="out.md", path="'/out.md'", depth="1"),
        "move_batch": _FILE_SQL.format(parent="f.parent", name="back.md", path="f.top || '/back.md'", depth="f.d"),
        "soft_delete_visibility": f"SELECT knowledge_base_id, entry_type, count(*) AS visible FROM knowledge_fs_entry, (SELECT {_TOP_SQL} AS top) WHERE NOT is_deleted AND NOT (knowledge_base_id = 7 AND (virtual_path = top OR starts_with(virtual_path, top || '/'))) GROUP BY ALL",
        "directories_to_create": """SELECT knowledge_base_id, '/imported' AS virtual_path, 1 AS depth FROM documents WHERE knowledge_base_id IS NOT NULL AND file_name IS NOT NULL AND source IS NOT NULL GROUP BY ALL
            UNION ALL SELECT knowledge_base_id, '/imported/' || source, 2 FROM documents WHERE knowledge_base_id IS NOT NULL AND file_name IS NOT NULL AND source IS NOT NULL GROUP BY ALL""",
        "tree_labels": "SELECT kid, 'd' || depth || '_' || substr(md5(name), 1, 8) AS label FROM knowledge_fs_entry",
    }
