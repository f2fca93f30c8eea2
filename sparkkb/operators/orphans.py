"""References to records that do not exist, by bitmaps of dictionary-encoded keys.

Keys are integers: ids as they are; paths by a dictionary, which gives the path of a record the record's id and
every other path that is referred to a number that no record has. For each range of keys and each period, the
referred keys form one bitmap, built map-side first, so that a key that a third of all rows refer to is still one
bit; it is compressed to positions, runs or a page of bits, whichever is least. Parent keys form a bitmap of
the records that are live, by range and period of creation. Reference AND-NOT the parents of
earlier periods leaves few bits: keys that are absent, deleted, or created in the same period
or later. Only these are decoded and compared exactly, and only their rows are read out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkkb.functions.paths import decode_percent, normalize_path, parent_path
from sparkkb.session import materialize

#: Keys of a range, as Spark's bitmap functions number them.
RANGE = 32_768


def period_of(ts: Column | str) -> Column:
    """Months since year 0, the period of a timestamp; null timestamps count as the first period."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(0))


def references(chunks: DataFrame, values: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """(table_name, field_name, parent, kid, key, created_at): every reference as an integer key.

    Null references are none. A link without target id refers by path; one without either is none. The keys of paths are stored, once.
    """

    def plain(df: DataFrame, name: str, field: str, parent: str) -> DataFrame:
        return df.where(F.col(field).isNotNull()).select(
            F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.lit(parent).alias("parent"), "kid", F.col(field).alias("key"), "created_at")

    active = values.where("is_deleted = false")
    by_path = encoded_paths(links.where("target_fs_entry_id is null and original_target is not null"), entries)
    return (
        plain(chunks, "knowledge_chunk", "fs_entry_id", "entry")
        .unionAll(plain(active, "knowledge_file_metadata_value", "fs_entry_id", "entry"))
        .unionAll(plain(active, "knowledge_file_metadata_value", "property_def_id", "definition"))
        .unionAll(plain(links, "knowledge_file_reference", "target_fs_entry_id", "entry"))
        .unionAll(by_path)
    )


def named_paths(links: DataFrame, entries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(kid, created_at, knowledge_base_id, path, key): the path that each link names, null above the root, and the id of the record at it, null without one.

    A live file comes before deleted ones. Records are those of targets (or entries); entries tell where relative paths begin.
    """
    sources = entries.select(F.col("kid").alias("source_fs_entry_id"), F.col("virtual_path").alias("source_path"))
    target = decode_percent(F.regexp_extract("original_target", r"^[^#?]*", 0))
    absolute = F.when(target.startswith("/"), target).otherwise(F.concat(parent_path("source_path"), F.lit("/"), target))
    referred = links.select("kid", "created_at", "knowledge_base_id", "source_fs_entry_id", "original_target").join(sources, "source_fs_entry_id", "left").select("kid", "created_at", "knowledge_base_id", normalize_path(absolute).alias("path"))
    dictionary = (
        (entries if targets is None else targets).where("entry_type = 'FILE' and virtual_path is not null")
        .groupBy("knowledge_base_id", F.col("virtual_path").alias("path"))
        .agg(F.min(F.struct(F.coalesce("is_deleted", F.lit(False)).alias("gone"), F.col("kid"))).alias("best"))
        .select("knowledge_base_id", "path", F.col("best.kid").alias("key"))
    )
    return referred.join(dictionary, ["knowledge_base_id", "path"], "left").select("kid", "created_at", "knowledge_base_id", "path", "key")


def path_keys(links: DataFrame, entries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(kid, key): the record that each link names by its path, null without one."""
    return named_paths(links, entries, targets).select("kid", "key")


def encoded_paths(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Links by path as references: paths without a record are numbered behind the ids of the records, each path of a base once, those that lead nowhere as one."""
    named = materialize(named_paths(links, entries), "paths")
    absent = named.where("key is null").select("knowledge_base_id", "path").distinct()
    absent = materialize(absent.withColumn("number", F.monotonically_increasing_id()), "absent")
    behind = (entries.agg(F.max("kid")).first()[0] or 0) + 1
    n, a = named.where("key is null").alias("n"), absent.alias("a")
    numbered = n.join(a, F.col("n.path").eqNullSafe(F.col("a.path")) & F.col("n.knowledge_base_id").eqNullSafe(F.col("a.knowledge_base_id")))
    keys = named.where("key is not null").select("kid", "key", "created_at").unionAll(numbered.select("n.kid", (F.col("a.number") + behind).alias("key"), "n.created_at"))
    return keys.select(F.lit("knowledge_file_reference").alias("table_name"), F.lit("target_fs_entry_id").alias("field_name"), F.lit("entry").alias("parent"), "kid", "key", "created_at")


def parents(entries: DataFrame, definitions: DataFrame) -> DataFrame:
    """(parent, key, is_deleted, created_at), one row per key: a key written twice is live if any row is, and as old as its oldest row."""
    both = entries.select(F.lit("entry").alias("parent"), "kid", "is_deleted", "created_at").unionAll(
        definitions.select(F.lit("definition").alias("parent"), "kid", "is_deleted", "created_at"))
    return both.where("kid is not null").groupBy("parent", F.col("kid").alias("key")).agg(
        F.min(F.coalesce("is_deleted", F.lit(False))).alias("is_deleted"), F.min("created_at").alias("created_at"))


POSITIONS, RUNS, PAGE = 0, 1, 2


def _container(positions: np.ndarray) -> bytes:
    """A sorted set of positions of a range: two bytes each, or four a run, or a page of a bit for each, after a byte that tells which."""
    breaks = np.flatnonzero(np.diff(positions) != 1)
    if min(2 * len(positions), 4 * (len(breaks) + 1)) >= RANGE // 8:
        page = np.zeros(RANGE, bool)
        page[positions] = True
        return bytes([PAGE]) + np.packbits(page).tobytes()
    if 4 * (len(breaks) + 1) < 2 * len(positions):
        edges = np.stack([positions[np.append(0, breaks + 1)], positions[np.append(breaks, len(positions) - 1)]])
        return bytes([RUNS]) + edges.astype("<u2").tobytes()
    return bytes([POSITIONS]) + positions.astype("<u2").tobytes()


def _page(container: bytes) -> np.ndarray:
    """The bits of a container."""
    if container[0] == PAGE:
        return np.unpackbits(np.frombuffer(container, np.uint8, offset=1)).view(bool)
    values = np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    page = np.zeros(RANGE, bool)
    if container[0] == POSITIONS:
        page[values] = True
    else:
        first, last = values.reshape(2, -1)
        marks = np.zeros(RANGE + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, last + 1, -1)
        page = np.cumsum(marks[:-1]) > 0
    return page


def _compress(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        held = pa.array([_container(np.sort(x.values.to_numpy(zero_copy_only=False))) for x in lists], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], held], batch.schema.names)


def bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    """One compressed bitmap of keys by range of 32,768 keys, period and the given columns.

    Positions are merged before the shuffle, so a hot key is sent once by each task.
    """
    positions = rows.groupBy(*by, period_of("created_at").alias("period"), F.bitmap_bucket_number("key").alias("range")).agg(
        F.collect_set(F.bitmap_bit_position("key").cast("smallint")).alias("bits"))
    return positions.mapInArrow(_compress, ", ".join([*(f"{c} string" for c in by), "period int", "range long", "bits binary"]))


def _and_not(table: pa.Table, live: pa.Table) -> pa.Table:
    """Keys of references that no parent of an earlier period has, of one range of keys."""
    born = np.argsort(live["period"].to_numpy(), kind="stable")
    seen, at, covered = live["bits"], 0, np.zeros(RANGE, bool)
    periods = live["period"].to_numpy()
    out = {"table_name": [], "field_name": [], "period": [], "key": []}
    for i in np.argsort(table["period"].to_numpy(), kind="stable").tolist():
        period, number = table["period"][i].as_py(), table["range"][i].as_py()
        while at < len(born) and periods[born[at]] < period:
            covered |= _page(seen[int(born[at])].as_py())
            at += 1
        left = np.flatnonzero(_page(table["bits"][i].as_py()) & ~covered)
        out["key"].append((number - 1) * RANGE + left + 1 if number > 0 else number * RANGE - left)  # ranges of keys below 1 count downwards
        for c in ("table_name", "field_name", "period"):
            out[c] += [table[c][i].as_py()] * len(left)
    keys = np.concatenate(out["key"]) if out["key"] else np.empty(0, np.int64)
    return pa.table({"parent": pa.array(table["parent"].to_pylist()[:1] * len(keys), pa.string()), "table_name": pa.array(out["table_name"], pa.string()), "field_name": pa.array(out["field_name"], pa.string()), "period": pa.array(out["period"], pa.int32()), "key": pa.array(keys, pa.int64())})


def suspects(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """(parent, table_name, field_name, period, key) whose bit survives reference AND-NOT parent."""
    referred = bitmaps(refs, "parent", "table_name", "field_name")
    live = bitmaps(parent.where("not is_deleted"), "parent")
    return referred.groupBy("parent", "range").cogroup(live.groupBy("parent", "range")).applyInArrow(
        _and_not, "parent string, table_name string, field_name string, period int, key long")


def broken_references(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """(table_name, field_name, kid, cause, created_at), one row per reference row without a record to refer to.

    cause: ``missing`` no record has the key, ``deleted`` the record is, ``late`` it was created after the reference.
    Null creation times are never late. Rows written twice come out twice; empty tables give an empty result.
    """
    facts = suspects(refs, parent).join(parent, ["parent", "key"], "left").select(
        "table_name", "field_name", "period", "key", F.col("is_deleted").alias("gone"), F.col("created_at").alias("born"))
    # A hot key may have a third of all rows: the rows' side is split by adaptive skew handling, the facts have one row per key.
    rows = refs.withColumn("period", period_of("created_at")).join(facts, ["table_name", "field_name", "period", "key"])
    cause = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("born") > F.col("created_at"), "late")
    return rows.select("table_name", "field_name", "kid", cause.alias("cause"), "created_at").where("cause is not null")


def report(broken: DataFrame) -> DataFrame:
    """Broken references by table, field, month of created_at and cause."""
    return broken.groupBy("table_name", "field_name", F.date_format("created_at", "yyyy-MM").alias("month"), "cause").agg(F.count(F.lit(1)).alias("n"))
