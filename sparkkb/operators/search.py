"""Metadata search, and its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.plans import filters
from sparkkb.session import table


def metadata_search(entries: DataFrame, values: DataFrame, bases: DataFrame, where: dict | None) -> DataFrame:
    """Files of live bases that satisfy a filter: (kid, kb_code, full_path, updated_at)."""
    live = bases.where("is_deleted = false").select(F.col("kid").alias("knowledge_base_id"))
    return filters.apply(entries, values, where).join(live, "knowledge_base_id", "left_semi").select(
        "kid", F.col("knowledge_base_id").cast("string").alias("kb_code"), F.ltrim(F.col("virtual_path"), F.lit("/")).alias("full_path"), "updated_at")


def page(found: DataFrame, size: int = 500, number: int = 1) -> DataFrame:
    """A page by updated_at, then kid. Only the rows up to the page are kept while sorting."""
    return found.orderBy("updated_at", "kid").offset((number - 1) * size).limit(size)


def typed_value() -> Column:
    """The value of a row as text: its column by declared type, else the first that is filled."""
    as_text = {
        "string": F.col("value_string"), "number": F.regexp_replace(F.regexp_replace(F.col("value_number").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), "boolean": F.col("value_boolean").cast("string"),
        "datetime": F.date_format("value_datetime", "yyyy-MM-dd'T'HH:mm:ss"), "stringList": F.concat(F.lit("["), F.array_join("value_string_list", ","), F.lit("]")),
    }
    chosen = F.lit(None).cast("string")
    for kind, column in as_text.items():
        chosen = F.when(F.col("value_type") == kind, column).otherwise(chosen)
    return F.coalesce(chosen, *as_text.values())


def backfill(files: DataFrame, values: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(kid, property_name, value): the attributes of files, the row with the greatest kid by name; names None gives all."""
    rows = values.where("is_deleted = false and property_name is not null")
    rows = rows.where(F.col("property_name").isin(names)) if names is not None else rows
    latest = rows.groupBy("fs_entry_id", "property_name").agg(F.max_by(typed_value(), "kid").alias("value"))
    return latest.join(files.select(F.col("kid").alias("fs_entry_id")), "fs_entry_id", "left_semi").select(F.col("fs_entry_id").alias("kid"), "property_name", "value")


def file_metadata(files: DataFrame, values: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(kid, metadata): system fields and attributes of each file as one map of strings; a file without attributes has its system fields only."""
    wanted = [f for f in filters.SYSTEM_FIELDS if names is None or f in names]
    system = F.map_filter(F.create_map(*[x for f in wanted for x in (F.lit(f), filters.system_column(f).cast("string"))]), lambda k, v: v.isNotNull()) if wanted else F.create_map().cast("map<string,string>")
    own = backfill(files, values, names).groupBy(F.col("kid").alias("__kid")).agg(F.map_from_entries(F.collect_list(F.struct("property_name", "value"))).alias("own"))
    return files.join(own, files["kid"] == own["__kid"], "left").select("kid", F.map_concat(F.coalesce("own", F.create_map().cast("map<string,string>")), system).alias("metadata") if not wanted else
        F.map_concat(system, F.map_filter(F.coalesce("own", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(wanted))).alias("metadata"))


def _leaf(op: str, field: str, value=None) -> dict:
    return {op: {"fieldName": field} | ({} if value is None else {"value": value})}


_AND, _OR = (lambda *x: {"and": list(x)}), (lambda *x: {"or": list(x)})
_EXISTS = "EXISTS (SELECT 1 FROM knowledge_file_metadata_value m WHERE m.fs_entry_id = f.kid AND NOT m.is_deleted AND m.property_name = '{0}' AND {1})"

#: Filter and the same condition in SQL, by query name.
FILTERS: dict[str, tuple[dict, str]] = {
    "dsl_eq_sys": (_leaf("eq", "fileType", "md"), "lower(regexp_extract(f.name, '\\.([^.]*)$', 1)) = 'md'"),
    "dsl_range_sys": (_AND(_leaf("gte", "fileSize", 2000), _leaf("lt", "createdAt", "2024-06-01T00:00:00+00:00")), "f.file_size >= 2000 AND f.created_at < TIMESTAMPTZ '2024-06-01 00:00:00+00'"),
    "dsl_not_null_sys": ({"not": _leaf("eq", "mimeType", "text/markdown")}, "NOT (f.mime_type = 'text/markdown')"),
    "dsl_exists_sys": (_leaf("exists", "fileSignature"), "f.checksum IS NOT NULL"),
    "dsl_prefix": (_leaf("prefix", "filePath", "/guides-"), "starts_with(f.virtual_path, '/guides-')"),
    "dsl_wildcard_escape": (_leaf("wildcard", "fileName", "price%*.??"), "f.name LIKE 'price!%%.__' ESCAPE '!'"),
    "dsl_eq_custom": (_leaf("eq", "review_state", "final"), _EXISTS.format("review_state", "m.value_string = 'final'")),
    "dsl_ne_custom": (_leaf("ne", "review_state", "final"), _EXISTS.format("review_state", "m.value_string <> 'final'")),
    "dsl_not_eq_custom": ({"not": _leaf("eq", "review_state", "final")}, "NOT " + _EXISTS.format("review_state", "m.value_string = 'final'")),
    "dsl_in": (_leaf("in", "review_state", ["final", "draft", "in review"]), _EXISTS.format("review_state", "m.value_string IN ('final', 'draft', 'in review')")),
    "dsl_in_sys": (_leaf("in", "fileType", ["csv", "pdf"]), "lower(regexp_extract(f.name, '\\.([^.]*)$', 1)) IN ('csv', 'pdf')"),
    "dsl_contains": (_leaf("contains", "keywords", "import job"), _EXISTS.format("keywords", "list_contains(m.value_string_list, 'import job')")),
    "dsl_exists": (_leaf("exists", "scanned_at"), _EXISTS.format("scanned_at", "(m.value_string IS NOT NULL OR m.value_number IS NOT NULL OR m.value_boolean IS NOT NULL OR m.value_datetime IS NOT NULL OR m.value_string_list IS NOT NULL)")),
    "dsl_boolean": (_leaf("eq", "is_public", True), _EXISTS.format("is_public", "m.value_boolean")),
    "dsl_range_number": (_AND(_leaf("gt", "word_total", 1000), _leaf("lte", "word_total", 9000)), _EXISTS.format("word_total", "m.value_number > 1000") + " AND " + _EXISTS.format("word_total", "m.value_number <= 9000")),
    "dsl_range_datetime_or_string": (_leaf("gte", "reviewed_at", "2024-06-01"), _EXISTS.format("reviewed_at", "(m.value_datetime >= TIMESTAMPTZ '2024-06-01 00:00:00+00' OR m.value_string >= '2024-06-01')")),
    "dsl_prefix_custom": (_leaf("prefix", "revision", "rev 1"), _EXISTS.format("revision", "starts_with(m.value_string, 'rev 1')")),
    "dsl_and_or_not": (
        _AND(_OR(_leaf("eq", "pinned", True), _leaf("eq", "legal_hold", True)), {"not": _leaf("exists", "expires_at")}, _leaf("in", "fileType", ["md", "txt", "csv"])),
        "(" + _EXISTS.format("pinned", "m.value_boolean") + " OR " + _EXISTS.format("legal_hold", "m.value_boolean") + ") AND NOT "
        + _EXISTS.format("expires_at", "(m.value_string IS NOT NULL OR m.value_number IS NOT NULL OR m.value_boolean IS NOT NULL OR m.value_datetime IS NOT NULL OR m.value_string_list IS NOT NULL)")
        + " AND lower(regexp_extract(f.name, '\\.([^.]*)$', 1)) IN ('md', 'txt', 'csv')"),
}
_FILES = "SELECT f.kid, f.knowledge_base_id::varchar AS kb_code, ltrim(f.virtual_path, '/') AS full_path, f.updated_at FROM knowledge_fs_entry f JOIN knowledge_base b ON b.kid = f.knowledge_base_id AND NOT b.is_deleted WHERE f.entry_type = 'FILE' AND NOT f.is_deleted AND "


def _search(where: dict | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries, values, bases = (table(spark, sf_dir, t) for t in ("knowledge_fs_entry", "knowledge_file_metadata_value", "knowledge_base"))
        return metadata_search(entries, values, bases, where)

    return run


def _folded(spark, sf_dir):
    return _search(filters.fold_file_types(FILTERS["dsl_eq_custom"][0], [".MD", "txt"]))(spark, sf_dir)


def _page(spark, sf_dir):
    return page(_search(FILTERS["dsl_exists_sys"][0])(spark, sf_dir), 50, 2)


def _count(spark, sf_dir):
    return _search(FILTERS["dsl_exists_sys"][0])(spark, sf_dir).groupBy("kb_code").agg(F.count(F.lit(1)).alias("total"))


def _live_files(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_fs_entry").where("entry_type = 'FILE' and is_deleted = false")


def _backfill(spark, sf_dir):
    return backfill(_live_files(spark, sf_dir), table(spark, sf_dir, "knowledge_file_metadata_value"))


def _metadata_get(spark, sf_dir):
    files = file_metadata(_live_files(spark, sf_dir), table(spark, sf_dir, "knowledge_file_metadata_value"), ["fileName", "fileSize", "review_state", "page_total"])
    return files.select("kid", F.col("metadata")["fileName"].alias("file_name"), F.col("metadata")["fileSize"].alias("file_size"), F.col("metadata")["review_state"].alias("review_state"), F.col("metadata")["page_total"].alias("page_total"))


def _distinct_properties(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_file_metadata_value").where("is_deleted = false and property_name is not null").select("property_name", "value_type").distinct()


_TYPED = r"""coalesce(CASE value_type WHEN 'string' THEN value_string WHEN 'number' THEN {n} WHEN 'boolean' THEN value_boolean::varchar WHEN 'datetime' THEN {d} WHEN 'stringList' THEN {l} END,
 value_string, {n}, value_boolean::varchar, {d}, {l})""".format(
    n=r"regexp_replace(regexp_replace(value_number::varchar, '(\.\d*?)0+$', '\1'), '\.$', '')", d="strftime(value_datetime AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')", l="'[' || array_to_string(value_string_list, ',') || ']'")
_LATEST = f"SELECT fs_entry_id AS kid, property_name, arg_max(v, kid) AS value FROM (SELECT *, struct_pack(x := {_TYPED}) AS v FROM knowledge_file_metadata_value WHERE NOT is_deleted AND property_name IS NOT NULL) GROUP BY ALL"


def queries() -> dict:
    return {name: _search(where) for name, (where, _) in FILTERS.items()} | {
        "file_type_folded": _folded, "metadata_search_page": _page, "metadata_search_count": _count, "metadata_backfill_long": _backfill, "metadata_get": _metadata_get, "distinct_properties": _distinct_properties}


def oracle_sql() -> dict[str, str]:
    live = "kid IN (SELECT kid FROM knowledge_fs_entry WHERE entry_type = 'FILE' AND NOT is_deleted)"
    return {name: _FILES + sql for name, (_, sql) in FILTERS.items()} | {
        "file_type_folded": _FILES + FILTERS["dsl_eq_custom"][1] + " AND lower(regexp_extract(f.name, '\\.([^.]*)$', 1)) IN ('md', 'txt')",
        "metadata_search_page": _FILES + "f.checksum IS NOT NULL ORDER BY updated_at, kid LIMIT 50 OFFSET 50",
        "metadata_search_count": f"SELECT kb_code, count(*) AS total FROM ({_FILES} f.checksum IS NOT NULL) GROUP BY ALL",
        "metadata_backfill_long": f"SELECT kid, property_name, value.x AS value FROM ({_LATEST}) WHERE {live}",
        "metadata_get": f"""WITH l AS ({_LATEST}) SELECT f.kid, f.name AS file_name, f.file_size::varchar AS file_size, a.value.x AS review_state, p.value.x AS page_total FROM knowledge_fs_entry f
            LEFT JOIN l a ON a.kid = f.kid AND a.property_name = 'review_state' LEFT JOIN l p ON p.kid = f.kid AND p.property_name = 'page_total' WHERE f.entry_type = 'FILE' AND NOT f.is_deleted""",
        "distinct_properties": "SELECT DISTINCT property_name, value_type FROM knowledge_file_metadata_value WHERE NOT is_deleted AND property_name IS NOT NULL",
    }
