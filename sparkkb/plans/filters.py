"""The JSON filter language over file entries: validation, and compilation to columns.

A node is a dict of one key: ``and`` / ``or`` with a list of nodes, ``not`` with one, or a leaf
``{operator: {"fieldName": ..., "value": ...}}``. System fields are columns of the entry; all other
fields are attribute-value rows. All leaves on attributes are answered by one pass over these rows
and one join, whatever their number; the boolean tree is then evaluated on the flags.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators, as well as the codes of problems below.
LEAVES = ("eq", "ne", "in", "contains", "exists", "gt", "gte", "lt", "lte", "prefix", "wildcard")
ORDER = ("gt", "gte", "lt", "lte")
#: System fields, and their types.
SYSTEM_FIELDS = {"fileName": "string", "fileType": "string", "fileSize": "number", "mimeType": "string", "createdAt": "datetime", "updatedAt": "datetime", "fileSignature": "string", "filePath": "string"}
VALUE_COLUMNS = {"string": "value_string", "number": "value_number", "boolean": "value_boolean", "datetime": "value_datetime", "stringList": "value_string_list"}


def file_type(name: Column) -> Column:
    """Lower-case text after the last dot, empty without one."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def system_column(field: str) -> Column:
    return {
        "fileName": F.col("name"), "fileType": file_type(F.col("name")), "fileSize": F.col("file_size"), "mimeType": F.col("mime_type"),
        "createdAt": F.col("created_at"), "updatedAt": F.col("updated_at"), "fileSignature": F.col("checksum"), "filePath": F.col("virtual_path"),
    }[field]


def is_iso(value: Any) -> bool:
    try:
        datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return False
    return True


def literal_type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "stringList" if isinstance(value, list) else "string"


@dataclass(frozen=True)
class Problem:
    path: str
    code: str
    message: str


def validate(where: Any, fields: dict[str, str] | None = None, max_depth: int = 3, max_leaves: int = 12) -> list[Problem]:
    """All problems of a filter. fields gives types of known attributes; without it any name is allowed, typed by the literal."""
    found: list[Problem] = []
    leaves = 0

    def say(path: str, code: str, message: str) -> None:
        found.append(Problem(path, code, message))

    def node(x: Any, path: str, depth: int) -> None:
        nonlocal leaves
        if not isinstance(x, dict) or len(x) != 1:
            return say(path, "INVALID_BOOLEAN_NODE", "a node is a dict of exactly one key")
        (op, body), = x.items()
        if op in ("and", "or", "not"):
            if depth >= max_depth:
                return say(path, "TOO_DEEP_BOOLEAN_NESTING", f"more than {max_depth} levels")
            if op == "not":
                return node(body, f"{path}.not", depth + 1)
            if not isinstance(body, list) or not body:
                return say(f"{path}.{op}", "INVALID_BOOLEAN_NODE", "needs a list that is not empty")
            for i, y in enumerate(body):
                node(y, f"{path}.{op}[{i}]", depth + 1)
        elif op in LEAVES:
            leaves += 1
            if leaves == max_leaves + 1:
                say(path, "TOO_MANY_CONDITIONS", f"more than {max_leaves} conditions")
            leaf(op, body, f"{path}.{op}")
        else:
            say(path, "UNSUPPORTED_OPERATOR", f"unknown operator {op!r}")

    def leaf(op: str, body: Any, path: str) -> None:
        if not isinstance(body, dict):
            return say(path, "INVALID_BOOLEAN_NODE", "needs fieldName")
        field = body.get("fieldName")
        if not field or (fields is not None and field not in SYSTEM_FIELDS and field not in fields):
            return say(path, "UNKNOWN_FIELD", f"unknown field {field!r}")
        wrong = lambda why: say(path, "INVALID_FIELD_VALUE_TYPE", why)
        if op == "exists":
            return wrong("exists takes no value") if "value" in body else None
        if body.get("value") is None:
            return wrong(f"no value for {op}")
        value = body["value"]
        kind = SYSTEM_FIELDS.get(field) or (fields or {}).get(field) or "any"
        if op == "in":
            if not isinstance(value, list) or not value:
                return wrong("in takes a list that is not empty")
            kinds = {literal_type(v) for v in value}
            if len(kinds) > 1 or kind == "stringList" or not _fits(kind, value[0]):
                return wrong("values of other types")
            return None
        if isinstance(value, list):
            return wrong(f"{op} takes one value")
        if op in ("prefix", "wildcard"):
            return None if kind in ("string", "any") and isinstance(value, str) else wrong(f"{op} is for strings")
        if op == "contains":
            return None if kind in ("stringList", "any") and field not in SYSTEM_FIELDS and isinstance(value, str) else wrong("contains is for string lists")
        if kind == "stringList":
            return wrong(f"{op} does not apply to string lists")
        if op in ORDER and (kind not in ("number", "datetime", "any") or isinstance(value, bool) or (isinstance(value, str) and not is_iso(value))):
            return wrong(f"{op} takes a number or a time")
        return None if _fits(kind, value) else wrong(f"not a {kind}")

    node(where, "$", 0)
    return found


def _fits(kind: str, value: Any) -> bool:
    return kind == "any" or kind == literal_type(value) or (kind == "datetime" and isinstance(value, str) and is_iso(value))


def fold_file_types(where: dict | None, file_types: list[str] | None) -> dict | None:
    """A list of file types as one more condition; an empty list is none."""
    if not file_types:
        return where
    extra = {"in": {"fieldName": "fileType", "value": [t.lower().lstrip(".") for t in file_types]}}
    return {"and": [where, extra]} if where else extra


def like_pattern(op: str, value: str) -> str:
    """A LIKE pattern with ``!`` as escape."""
    plain = "".join("!" + c if c in "!%_" else c for c in value)
    return plain + "%" if op == "prefix" else plain.replace("*", "%").replace("?", "_")


def _compare(op: str, column: Column, value: Any) -> Column:
    if op == "in":
        return column.isin(value)
    if op == "prefix":
        return column.startswith(value)
    if op == "wildcard":
        return F.like(column, F.lit(like_pattern(op, value)), F.lit("!"))
    return {"eq": column == value, "ne": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def _system(op: str, field: str, value: Any) -> Column:
    column = system_column(field)
    if op == "exists":
        return column.isNotNull()
    if SYSTEM_FIELDS[field] == "datetime":
        value = [F.lit(v).cast("timestamp") for v in value] if op == "in" else F.lit(value).cast("timestamp")
    return _compare(op, column, value)


def _attribute(op: str, field: str, value: Any) -> Column:
    """Whether one attribute-value row satisfies a leaf."""
    named = F.col("property_name") == field
    if op == "exists":
        return named & F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in VALUE_COLUMNS.values()], F.lit(False))
    if op == "contains":
        return named & F.array_contains("value_string_list", value)
    if op in ORDER and isinstance(value, str):  # an ISO literal may be meant as a time or as text
        as_time = _compare(op, F.col("value_datetime"), F.lit(value).cast("timestamp"))
        return named & (F.coalesce(as_time, F.lit(False)) | F.coalesce(_compare(op, F.col("value_string"), value), F.lit(False)))
    kind = literal_type(value[0] if op == "in" else value)
    return named & _compare(op, F.col(VALUE_COLUMNS[kind]), value)


def apply(entries: DataFrame, values: DataFrame, where: dict | None) -> DataFrame:
    """The live files that satisfy a filter. Null system fields give neither true nor false; attributes exist or not. No or an empty filter keeps all."""
    files = entries.where("entry_type = 'FILE' and is_deleted = false")
    if not where:
        return files
    if problems := validate(where):
        raise ValueError("; ".join(f"{p.path}: {p.code} {p.message}" for p in problems))
    tests: list[Column] = []

    def build(node: dict) -> Column:
        (op, body), = node.items()
        if op in ("and", "or"):
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [build(x) for x in body])
        if op == "not":
            return ~build(body)
        field, value = body["fieldName"], body.get("value")
        if field in SYSTEM_FIELDS:
            return _system(op, field, value)
        tests.append(_attribute(op, field, value))
        return F.coalesce(F.col(f"__flag{len(tests) - 1}"), F.lit(False))

    condition = build(where)
    if tests:
        some = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
        flags = values.where("is_deleted = false").where(some).groupBy(F.col("fs_entry_id").alias("__file")).agg(
            *[F.bool_or(F.coalesce(t, F.lit(False))).alias(f"__flag{i}") for i, t in enumerate(tests)])
        files = files.join(flags, files["kid"] == flags["__file"], "left")
    return files.where(condition).select(*entries.columns)
