"""Attribute-value rows into wide tables.

1. ``narrow``  the usable rows of one type: of the rows of an entity and an attribute the latest stays
   (aggregated map-side first). The attribute's definition gives the type; a row gives the value in it.
2. Each type is stored as one narrow table, partitioned by attribute and bucketed by entity, all with the
   same buckets: an attribute is read alone, and attributes are co-partitioned.
3. ``wide``    narrow tables are outer-joined onto the entities that any of them has, FAN_IN at a time, and the
   results likewise, in a balanced tree; what was joined is one structure, so that rows have few columns. Every table of the tree is bucketed by entity, so a join reads buckets
   and shuffles no cell (above the first level only the entities' ids, to bring them together). Each level is
   stored: a plan of all joins at once would sort all attributes in each task.

No join is left to a broadcast, whatever the size.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkkb.session import materialize_bucketed

FAN_IN = 8
#: More attributes than this do not make a table.
MOST_ATTRIBUTES = 10_000
#: Rows of a bucket, as long as there are no more buckets than shuffle partitions: each attribute is a file a bucket.
BUCKET_ROWS = 100_000
#: Tables of one level that are written at the same time.
AT_ONCE = 8
#: White space of any kind.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NUMBER = r"^[+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
DATETIME = r"^(\d{4})[-/](\d{2})[-/](\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:(Z)|([+-]\d{2}):?(\d{2})?)?)?$"
#: A number is a double, so that 1e50 and 1e-9 have a value as well; one too large for a double has none and fills no cell.
TYPES = {"string": "string", "number": "double", "boolean": "boolean", "datetime": "timestamp", "stringList": "array<string>"}


def _number(text: Column) -> Column:
    number = F.when(text.rlike(NUMBER), F.regexp_replace(text, ",", "").cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def _boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "y", "on", "1"), True).when(low.isin("false", "no", "n", "off", "0"), False)


def _datetime(text: Column) -> Column:
    part = [F.regexp_extract(text, DATETIME, i) for i in range(9)]
    clock = F.when(part[4] == "", "00:00").otherwise(part[4])
    second = F.when(part[5] == "", ":00").otherwise(part[5])
    zone = F.when(part[7] == "", "+00:00").otherwise(F.concat(part[7], F.lit(":"), F.when(part[8] == "", "00").otherwise(part[8])))
    same = F.substring(text, 5, 1) == F.substring(text, 8, 1)
    return F.when((part[0] != "") & same, F.concat(part[1], F.lit("-"), part[2], F.lit("-"), part[3], F.lit("T"), clock, second, zone).try_cast("timestamp"))


def _string_list(text: Column) -> Column:
    json = F.try_parse_json(F.when(text.startswith("["), text))  # a pattern would recurse in long lists
    of_strings = F.schema_of_variant(json).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(of_strings, json.cast("array<string>"))


def _no_nulls(items: Column) -> Column:
    return F.when(F.forall(items, lambda x: x.isNotNull()), items)


def _value(kind: str) -> Column:
    """The value of a row in a type; null if it has no usable one."""
    text = F.btrim("value_string", F.lit(BLANKS))
    if kind == "string":
        return F.coalesce(
            F.when(text != "", F.col("value_string")), F.col("value_number").cast("string"), F.col("value_boolean").cast("string"),
            F.date_format("value_datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.to_json("value_string_list"))
    if kind == "number":
        return F.coalesce(F.col("value_number").cast("double"), _number(text))
    if kind == "boolean":
        return F.coalesce("value_boolean", _boolean(text))
    if kind == "datetime":
        return F.coalesce("value_datetime", _datetime(text))
    return F.coalesce("value_string_list", _no_nulls(_string_list(text)))


def narrow(values: DataFrame, kind: str, ids: list[int]) -> DataFrame:
    """(property_def_id, fs_entry_id, kid, value): the row that fills each cell of the attributes ids, which are of one type.

    Only rows with is_deleted false and a usable value, whatever type the row says. Of several the greatest updated_at wins, then
    the greatest kid; a null updated_at comes last. Rows without entity have no cell.
    """
    rows = values.where(F.col("property_def_id").isin(ids) & (F.col("is_deleted") == F.lit(False)) & F.col("fs_entry_id").isNotNull())
    rows = rows.select("property_def_id", "fs_entry_id", "kid", "updated_at", _value(kind).cast(TYPES[kind]).alias("value")).where("value is not null")
    latest = rows.groupBy("property_def_id", "fs_entry_id").agg(F.max_by(F.struct("kid", "value"), F.struct("updated_at", "kid")).alias("best"))
    return latest.select("property_def_id", "fs_entry_id", "best.kid", "best.value")


def _by_type(columns: list[tuple[int, str, str]]) -> dict[str, list[tuple[int, str]]]:
    found: dict[str, list[tuple[int, str]]] = {}
    for k, name, kind in columns:
        found.setdefault(kind, []).append((k, name))
    return found


def cells(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(property_def_id, fs_entry_id, kid, as_string, as_number, as_boolean, as_datetime, as_stringList): the narrow tables of all live definitions, one below the other."""
    of = _by_type(attributes(definitions))
    parts = [
        narrow(values, t, [k for k, _ in of.get(t, [])]).select(
            "property_def_id", "fs_entry_id", "kid", *[(F.col("value") if x == t else F.lit(None)).cast(TYPES[x]).alias(f"as_{x}") for x in TYPES])
        for t in TYPES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def attributes(definitions: DataFrame) -> list[tuple[int, str, str]]:
    """(id, column name, type) of each live definition, by id. A name that several have gets its id behind it; a definition written twice counts once, by its least type and name."""
    live = definitions.where("is_deleted = false and kid is not null").where(F.col("value_type").isin(*TYPES))
    rows = live.groupBy("kid").agg(F.min(F.struct("value_type", "property_name")).alias("d")).select("kid", "d.*").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    names = [r["property_name"] for r in rows]
    return sorted((r["kid"], r["property_name"] if r["property_name"] and names.count(r["property_name"]) == 1 else f"{r['property_name'] or 'property'}_{r['kid']}", r["value_type"]) for r in rows)


def _joined(parts: list[tuple[DataFrame, dict[int, str]]], buckets: int) -> tuple[DataFrame, dict[int, str]]:
    """Bucketed tables (fs_entry_id, cells) outer-joined onto the entities that any of them has, and where each attribute is in the new cells."""
    # An expression in place of the column: a union of bucketed scans claims their buckets, but reads them without.
    ids = [part.select(F.coalesce("fs_entry_id", F.lit(0)).alias("fs_entry_id")) for part, _ in parts]
    whole = ids[0]
    for more in ids[1:]:
        whole = whole.unionAll(more)
    whole = whole.repartition(buckets, "fs_entry_id").distinct()
    for i, (part, _) in enumerate(parts):
        whole = whole.join(part.withColumnRenamed("cells", f"g{i}").hint("merge"), "fs_entry_id", "left")
    return whole.select("fs_entry_id", F.struct(*[f"g{i}" for i in range(len(parts))]).alias("cells")), {k: f"g{i}.{at}" for i, (_, of) in enumerate(parts) for k, at in of.items()}


def wide(values: DataFrame, definitions: DataFrame) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """One row per fs_entry_id that has a cell: a typed column per live definition, and ``<name>__kid``, the row that fills it. Empty tables give an empty result."""
    columns = attributes(definitions)
    if not columns:
        return values.select("fs_entry_id").limit(0), columns
    of = _by_type(columns)
    buckets = max(1, min(values.count() // BUCKET_ROWS, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def each(f, items: list) -> list:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(inheritable_thread_target(values.sparkSession)(f), items))

    def store(kind: str) -> DataFrame:
        found = narrow(values, kind, [k for k, _ in of[kind]])
        # One file for each bucket and attribute; cells are unique by now, so no entity is hot.
        return materialize_bucketed(found.repartition(buckets, "fs_entry_id"), f"narrow_{kind.lower()}", "fs_entry_id", "property_def_id", buckets=buckets)

    stored = dict(zip(of, each(store, list(of)), strict=True))
    groups = [(t, some[i : i + FAN_IN]) for t, some in of.items() for i in range(0, len(some), FAN_IN)]

    def first(group: tuple[str, list[tuple[int, str]]]) -> DataFrame:
        """(fs_entry_id, cells): the attributes of a group, by id."""
        kind, some = group
        table = stored[kind].where(F.col("property_def_id").isin([k for k, _ in some]))
        whole = table.select("fs_entry_id").distinct()
        for k, _ in some:
            part = stored[kind].where(F.col("property_def_id") == k).select("fs_entry_id", F.struct("value", "kid").alias(f"c{k}"))
            whole = whole.join(part.hint("merge"), "fs_entry_id", "left")
        return whole.select("fs_entry_id", F.struct(*[f"c{k}" for k, _ in some]).alias("cells"))

    def keep(df: DataFrame) -> DataFrame:
        return materialize_bucketed(df, "joined", "fs_entry_id", buckets=buckets)

    level = [(df, {k: f"c{k}" for k, _ in some}) for df, (_, some) in zip(each(first, groups), groups, strict=True)]  # and where each attribute is in cells
    while len(level) > 1:
        tables = each(keep, [t for t, _ in level])
        level = [_joined(list(zip(tables[i : i + FAN_IN], [at for _, at in level[i : i + FAN_IN]], strict=True)), buckets) for i in range(0, len(level), FAN_IN)]
    whole, at = level[0]
    cells_ = [c for k, name, _ in columns for c in (F.col(f"cells.{at[k]}.value").alias(name), F.col(f"cells.{at[k]}.kid").alias(f"{name}__kid"))]
    return whole.select("fs_entry_id", *cells_), columns


def filled_by(table: DataFrame, columns: list[tuple[int, str, str]]) -> DataFrame:
    """(fs_entry_id, property_def_id, kid): the non-null cells of a wide table."""
    return cells_of(table, columns, False)


def cells_of(table: DataFrame, columns: list[tuple[int, str, str]], with_values: bool = True) -> DataFrame:
    """(fs_entry_id, property_def_id, kid) and as_string, as_number, as_boolean, as_datetime, as_stringList: the non-null cells of a wide table."""
    def cell(k: int, name: str, kind: str) -> Column:
        typed = [(F.col(f"`{name}`") if x == kind else F.lit(None).cast(TYPES[x])).alias(f"as_{x}") for x in TYPES if with_values]
        return F.struct(F.lit(k).cast("long").alias("property_def_id"), F.col(f"`{name}__kid`").alias("kid"), *typed)

    none = [F.struct(F.lit(None).cast("long").alias("property_def_id"), F.lit(None).cast("long").alias("kid"), *[F.lit(None).cast(TYPES[x]).alias(f"as_{x}") for x in TYPES if with_values])]
    each = F.array(*([cell(*c) for c in columns] or none))
    return table.select("fs_entry_id", F.explode(F.filter(each, lambda x: x["kid"].isNotNull())).alias("cell")).select("fs_entry_id", "cell.*")
