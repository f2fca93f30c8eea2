"""Registered queries on broken references and attribute-value rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkkb.operators import orphans, wide
from sparkkb.session import materialize, table


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, values, links, entries, definitions = (
        table(spark, sf_dir, t) for t in ("knowledge_chunk", "knowledge_file_metadata_value", "knowledge_file_reference", "knowledge_fs_entry", "knowledge_metadata_property_def"))
    return orphans.broken_references(orphans.references(chunks, values, links, entries), orphans.parents(entries, definitions))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, field_name, kid, cause): every reference to a record that is absent, deleted or younger."""
    return _broken(spark, sf_dir).select("table_name", "field_name", "kid", "cause")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references by table, field, month and cause."""
    return orphans.report(_broken(spark, sf_dir))


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    return wide.wide(table(spark, sf_dir, "knowledge_file_metadata_value"), table(spark, sf_dir, "knowledge_metadata_property_def"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fs_entry_id, property_def_id, kid): the row that fills each cell of the wide table, which is stored whole first."""
    whole, columns = _wide(spark, sf_dir)
    return wide.filled_by(materialize(whole, "wide"), columns)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the wide table with their typed values, one below the other."""
    whole, columns = _wide(spark, sf_dir)
    return wide.cells_of(materialize(whole, "wide"), columns).drop("kid")


def p2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file, one typed column per live property definition."""
    whole, columns = _wide(spark, sf_dir)
    return whole.select("fs_entry_id", *[f"`{name}`" for _, name, _ in columns])


#: Percent escapes are decoded byte by byte here; paths climb with a fold over their segments.
_BROKEN_SQL = r"""
WITH entry AS (SELECT kid, knowledge_base_id, entry_type, virtual_path, is_deleted, created_at FROM knowledge_fs_entry),
link AS (
  SELECT r.kid, r.knowledge_base_id, r.created_at, s.virtual_path AS source_path,
         url_decode(replace(regexp_replace(regexp_extract(r.original_target, '^[^#?]*'), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\1', 'g'), '+', '%2B')) AS target
  FROM knowledge_file_reference r LEFT JOIN entry s ON s.kid = r.source_fs_entry_id
  WHERE r.target_fs_entry_id IS NULL AND r.original_target IS NOT NULL
), segments AS (
  SELECT kid, knowledge_base_id, created_at,
         list_filter(string_split(CASE WHEN starts_with(target, '/') THEN target ELSE regexp_replace(source_path, '/[^/]*$', '') || '/' || target END, '/'), lambda x: x <> '' AND x <> '.') AS parts
  FROM link
), resolved AS (
  SELECT kid, knowledge_base_id, created_at,
         list_reduce(parts, lambda acc, x: CASE WHEN acc = '!' OR (x = '..' AND acc = '') THEN '!' WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '') AS path
  FROM segments
), dictionary AS (
  SELECT knowledge_base_id, virtual_path, arg_min(kid, (is_deleted::int, kid)) AS key FROM entry WHERE entry_type = 'FILE' GROUP BY ALL
), refs AS (
  SELECT 'knowledge_chunk' AS table_name, 'fs_entry_id' AS field_name, kid, fs_entry_id AS key, created_at, 'entry' AS parent FROM knowledge_chunk WHERE fs_entry_id IS NOT NULL
  UNION ALL SELECT 'knowledge_file_metadata_value', 'fs_entry_id', kid, fs_entry_id, created_at, 'entry' FROM knowledge_file_metadata_value WHERE NOT is_deleted AND fs_entry_id IS NOT NULL
  UNION ALL SELECT 'knowledge_file_metadata_value', 'property_def_id', kid, property_def_id, created_at, 'definition' FROM knowledge_file_metadata_value WHERE NOT is_deleted AND property_def_id IS NOT NULL
  UNION ALL SELECT 'knowledge_file_reference', 'target_fs_entry_id', kid, target_fs_entry_id, created_at, 'entry' FROM knowledge_file_reference WHERE target_fs_entry_id IS NOT NULL
  UNION ALL SELECT 'knowledge_file_reference', 'target_fs_entry_id', r.kid, d.key, r.created_at, 'entry' FROM resolved r LEFT JOIN dictionary d ON d.knowledge_base_id = r.knowledge_base_id AND d.virtual_path = r.path
), parent AS (
  SELECT 'entry' AS parent, kid, is_deleted, created_at FROM entry UNION ALL SELECT 'definition', kid, is_deleted, created_at FROM knowledge_metadata_property_def
), broken AS (
  SELECT table_name, field_name, r.kid, r.created_at,
         CASE WHEN p.kid IS NULL THEN 'missing' WHEN p.is_deleted THEN 'deleted' WHEN p.created_at > r.created_at THEN 'late' END AS cause
  FROM refs r LEFT JOIN parent p ON p.parent = r.parent AND p.kid = r.key
)
"""

_FOUND_SQL = r"""
WITH v AS (
  SELECT v.*, d.value_type AS as_type,
         regexp_replace(v.value_string, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS text
  FROM knowledge_file_metadata_value v JOIN knowledge_metadata_property_def d ON d.kid = v.property_def_id AND NOT d.is_deleted
  WHERE NOT v.is_deleted
), usable AS (
  SELECT * FROM v WHERE CASE as_type
    WHEN 'string' THEN text <> '' OR value_number IS NOT NULL OR value_boolean IS NOT NULL OR value_datetime IS NOT NULL OR value_string_list IS NOT NULL
    WHEN 'number' THEN value_number IS NOT NULL OR regexp_full_match(text, '[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?')
    WHEN 'boolean' THEN value_boolean IS NOT NULL OR lower(text) IN ('true', 'yes', 'y', 'on', '1', 'false', 'no', 'n', 'off', '0')
    WHEN 'datetime' THEN value_datetime IS NOT NULL OR (regexp_full_match(text, '(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})([T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}(:?\d{2})?)?)?')
         AND TRY_CAST(replace(text[1:10], '/', '-') AS date) IS NOT NULL)
    WHEN 'stringList' THEN value_string_list IS NOT NULL OR (json_valid(text) AND text[1:1] = '[' AND coalesce(list_bool_and(list_transform(TRY_CAST(text AS json[]), lambda x: json_type(x) = 'VARCHAR')), true)) END
)
, best AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY fs_entry_id, property_def_id ORDER BY updated_at DESC, kid DESC) = 1)
"""

#: A time without zone is UTC, a zone of hours only gets its minutes.
_VALUES_SQL = r"""
SELECT fs_entry_id, property_def_id,
  CASE WHEN as_type = 'string' THEN coalesce(CASE WHEN text <> '' THEN value_string END, value_number::varchar, value_boolean::varchar,
    strftime(value_datetime AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ'), to_json(value_string_list)::varchar) END AS as_string,
  CASE WHEN as_type = 'number' THEN coalesce(value_number::double, TRY_CAST(replace(text, ',', '') AS double)) END AS as_number,
  CASE WHEN as_type = 'boolean' THEN coalesce(value_boolean, lower(text) IN ('true', 'yes', 'y', 'on', '1')) END AS as_boolean,
  CASE WHEN as_type = 'datetime' THEN coalesce(value_datetime AT TIME ZONE 'UTC',
    TRY_CAST(replace(text[1:10], '/', '-') || ' ' || coalesce(nullif(regexp_extract(text, '^.{10}[T ](\d{2}:\d{2}(:\d{2})?)', 1), ''), '00:00') AS timestamp)
    - coalesce(TRY_CAST(regexp_extract(text, '([+-]\d{2})(:?\d{2})?$', 1) AS int) * (length(text) > 16)::int, 0) * INTERVAL 1 HOUR
    - coalesce(TRY_CAST(regexp_extract(text, '([+-])\d{2}:?(\d{2})$', 1) || regexp_extract(text, '([+-])\d{2}:?(\d{2})$', 2) AS int) * (length(text) > 16)::int, 0) * INTERVAL 1 MINUTE) END AS as_datetime,
  CASE WHEN as_type = 'stringList' THEN coalesce(value_string_list, TRY_CAST(text AS json)::varchar[]) END AS "as_stringList"
FROM best
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_values, p2_wide)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _BROKEN_SQL + "SELECT table_name, field_name, kid, cause FROM broken WHERE cause IS NOT NULL",
        "p1_report": _BROKEN_SQL + "SELECT table_name, field_name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, cause, count(*) AS n FROM broken WHERE cause IS NOT NULL GROUP BY ALL",
        "p2_found": _FOUND_SQL + "SELECT fs_entry_id, property_def_id, kid FROM best",
        "p2_values": _FOUND_SQL + _VALUES_SQL,
    }
