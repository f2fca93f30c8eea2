"""Orphan references and wide tables on hand-made rows."""

from datetime import datetime, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkkb.operators import orphans, problems, wide

from .conftest import DATA


def day(n):
    return datetime(2024, 1 + n // 28, 1 + n % 28, tzinfo=timezone.utc)


ENTRY = "kid long, knowledge_base_id long, entry_type string, virtual_path string, is_deleted boolean, created_at timestamp, extra string"
REF = "kid long, knowledge_base_id long, source_fs_entry_id long, target_fs_entry_id long, original_target string, created_at timestamp, period string, path string, source_path string"
VALUE = "kid long, fs_entry_id long, property_def_id long, value_string string, value_number decimal(20,6), value_boolean boolean, value_datetime timestamp, value_string_list array<string>, is_deleted boolean, created_at timestamp, updated_at timestamp, value_type string, as_type string, best string"
DEFINITION = "kid long, property_name string, value_type string, is_deleted boolean, created_at timestamp"
CHUNK = "kid long, fs_entry_id long, created_at timestamp, table_name string, bits binary"


def entries(spark):
    rows = [
        (1, 1, "DIRECTORY", "/a", False, day(0), None), (2, 1, "FILE", "/a/x.md", False, day(1), "x"), (3, 1, "FILE", "/a/gone.md", True, day(1), None),
        (4, 1, "FILE", "/a/late %.md", False, day(40), None), (5, 1, "FILE", "/a/two.md", True, day(1), None), (6, 1, "FILE", "/a/two.md", False, day(2), None), (40_000, 2, "FILE", "/a/x.md", False, None, None),
    ]
    return spark.createDataFrame(rows, ENTRY)


def found(spark, chunks=(), values=(), links=()):
    refs = orphans.references(
        spark.createDataFrame(list(chunks), CHUNK), spark.createDataFrame(list(values), VALUE), spark.createDataFrame(list(links), REF), entries(spark))
    parents = orphans.parents(entries(spark), spark.createDataFrame([(9, "p", "string", False, day(0))], DEFINITION))
    return sorted((r["field_name"], r["kid"], r["cause"]) for r in orphans.broken_references(refs, parents).collect())


def test_causes_and_late_within_a_month(spark):
    chunks = [(1, 2, day(5), None, None), (2, 3, day(5), "t", b"x"), (3, 4, day(5), None, None), (4, 4, day(39), None, None), (5, 4, day(41), None, None), (6, 99, None, None, None), (7, None, day(1), None, None), (8, 40_000, day(1), None, None), (9, -5, day(1), None, None), (9, -5, day(1), None, None)]
    assert found(spark, chunks) == [("fs_entry_id", 2, "deleted"), ("fs_entry_id", 3, "late"), ("fs_entry_id", 4, "late"), ("fs_entry_id", 6, "missing"), ("fs_entry_id", 9, "missing"), ("fs_entry_id", 9, "missing")]


@pytest.mark.parametrize(
    "target, cause",
    [("x.md", None), ("./x.md#top", None), ("/a/x.md?raw=1", None), ("../a/x.md", None), ("X.md", "missing"), ("/a", "missing"), ("gone.md", "deleted"), ("late%20%25.md", "late"), ("late%20%.md", "late"), ("two.md", None), ("../../x.md", "missing"), ("#here", "missing"), ("a+b.md", "missing")],
)
def test_paths(spark, target, cause):
    links = [(1, 1, 2, None, target, day(10), None, "p", None), (2, 1, 2, None, None, day(10), "p", None, "/a")]
    assert [x[2] for x in found(spark, links=links)] == ([cause] if cause else [])


def test_hot_key_is_one_bit_and_all_rows_come_out(spark):
    chunks = [(k, 77, day(3), None, None) for k in range(3000)] + [(k, 2, day(3), None, None) for k in range(3000, 6000)]
    assert len(found(spark, chunks)) == 3000


@pytest.mark.parametrize("positions, kind", [([5], orphans.POSITIONS), (list(range(100, 900)), orphans.RUNS), (list(range(0, 32_768, 3)), orphans.PAGE), (list(range(32_768)), orphans.RUNS), ([0, 32_767], orphans.POSITIONS), (list(range(0, 30_000, 2)) + [32_767], orphans.PAGE)])
def test_containers_hold_their_bits(positions, kind):
    held = orphans._container(np.array(positions))
    assert held[0] == kind and len(held) <= 4097 and np.flatnonzero(orphans._page(held)).tolist() == positions


def test_keys_of_any_sign_are_decoded(spark):
    keys = [-70_000, -32_769, -32_768, -32_767, -1, 0, 1, 32_768, 32_769, 65_536, 65_537]
    refs = spark.createDataFrame([("t", "f", "entry", i, k, day(1)) for i, k in enumerate(keys)], "table_name string, field_name string, parent string, kid long, key long, created_at timestamp")
    none = spark.createDataFrame([], "parent string, key long, is_deleted boolean, created_at timestamp")
    assert sorted(r["key"] for r in orphans.suspects(refs, none).collect()) == keys
    own = refs.select("parent", "key", F.lit(False).alias("is_deleted"), F.lit(day(0)).alias("created_at"))
    assert orphans.suspects(refs, own.withColumn("created_at", F.lit(None).cast("timestamp"))).count() == 0


def test_paths_without_a_record_go_through_the_bitmaps(spark):
    links = [(k, 1 + k % 2, 2, None, "nowhere.md" if k < 6 else "../../out.md", day(10), None, "p", None) for k in range(9)]
    refs = orphans.references(*(spark.createDataFrame([], x) for x in (CHUNK, VALUE)), spark.createDataFrame(links, REF), entries(spark))
    rows = refs.collect()
    assert len(rows) == 9 and all(r["key"] > 40_000 for r in rows) and len({r["key"] for r in rows}) == 4
    assert [x[2] for x in found(spark, links=links)] == ["missing"] * 9


def test_empty_tables(spark):
    assert found(spark) == []
    values, definitions = spark.createDataFrame([], VALUE), spark.createDataFrame([], DEFINITION)
    assert wide.filled_by(*wide.wide(values, spark.createDataFrame([(1, "p", "string", False, day(0))], DEFINITION))).collect() == []
    assert wide.wide(values, definitions)[0].collect() == []


def cell(kind, **given):
    base = dict(kid=1, fs_entry_id=5, property_def_id=1, value_string=None, value_number=None, value_boolean=None, value_datetime=None, value_string_list=None, is_deleted=False, created_at=day(0), updated_at=day(0), value_type=kind, as_type="clash", best=None)
    row = base | given
    return tuple({**row, "value_number": row["value_number"] and Decimal(row["value_number"])}.values())


@pytest.mark.parametrize(
    "kind, text, usable",
    [
        ("number", " 1,234.50\n", True), ("number", "1,2,3", False), ("number", "12..5", False), ("number", "+1.5e+3", True), ("number", "", False), ("number", "about 3", False),
        ("boolean", " YES　", True), ("boolean", "2", False), ("boolean", "off", True), ("datetime", "2024/02/29 10:00", True), ("datetime", "2023-02-29", False), ("datetime", "2024-01-01T10:00:05+02:00", True),
        ("datetime", "2024-01/01", False), ("datetime", "Q3 2024", False), ("stringList", '["a", "b"]', True), ("stringList", "[]", True), ("stringList", "['a']", False), ("stringList", "[1]", False), ("stringList", '["a", null]', False), ("stringList", "[null]", False), ("stringList", '["' + "\\\\n" * 20000 + '"]', True), ("number", "1," + "234," * 5000 + "567", False), ("stringList", "[", False),
        ("string", "  \t", False), ("string", "N/A", True),
    ],
)
def test_usable_values(spark, kind, text, usable):
    definitions = spark.createDataFrame([(1, "p", kind, False, day(0))], DEFINITION)
    got = wide.cells(spark.createDataFrame([cell("odd", value_string=text)], VALUE), definitions).collect()
    assert bool(got) == usable


def test_latest_usable_row_wins_and_columns_are_typed(spark):
    definitions = spark.createDataFrame([(1, "n", "number", False, day(0)), (2, "n", "string", False, day(0)), (3, "gone", "string", True, day(0))], DEFINITION)
    rows = [
        cell("x", kid=1, value_number=1, updated_at=day(3)), cell("x", kid=2, value_string="2", updated_at=day(4)), cell("x", kid=3, value_string="2", updated_at=day(4)), cell("x", kid=4, value_string="no", updated_at=day(9)),
        cell("x", kid=5, value_number=9, updated_at=day(9), is_deleted=True), cell("x", kid=6, property_def_id=2, value_boolean=True), cell("x", kid=7, property_def_id=3, value_string="z"), cell("x", kid=8, fs_entry_id=6, property_def_id=2, value_string="q"),
        cell("x", kid=9, fs_entry_id=None, value_number=1), cell("x", kid=10, updated_at=None, value_number=4),
    ]
    table, columns = wide.wide(spark.createDataFrame(rows, VALUE), definitions)
    assert [c[1] for c in columns] == ["n_1", "n_2"]
    assert sorted((r["fs_entry_id"], r["n_1"] and float(r["n_1"]), r["n_2"]) for r in table.collect()) == [(5, 2.0, "true"), (6, None, "q")]
    assert sorted(map(tuple, wide.filled_by(table, columns).collect())) == [(5, 1, 3), (5, 2, 6), (6, 2, 8)]


def test_large_and_small_numbers_keep_their_value(spark):
    definitions = spark.createDataFrame([(1, "n", "number", False, day(0))], DEFINITION)
    texts = {5: "1e50", 6: "1e-9", 7: "1" + "0" * 32, 8: "-1,234.5"}
    rows = [cell("x", kid=f, fs_entry_id=f, value_string=t) for f, t in texts.items()] + [cell("x", kid=99, fs_entry_id=5, value_string="7", updated_at=None)]
    table, columns = wide.wide(spark.createDataFrame(rows, VALUE), definitions)
    assert {r["fs_entry_id"]: r["n"] for r in table.collect()} == {f: float(t.replace(",", "")) for f, t in texts.items()}
    assert {r["fs_entry_id"]: r["kid"] for r in wide.filled_by(table, columns).collect()} == {f: f for f in texts}


def test_joins_of_wide_tables_shuffle_no_cell(spark):
    definitions = spark.createDataFrame([(k, f"c{k}", "number" if k % 2 else "string", False, day(0)) for k in range(1, 7)], DEFINITION)
    rows = [cell("x", kid=100 * f + k, fs_entry_id=f, property_def_id=k, value_number=k) for f in range(1, 8) for k in range(1, 7)]
    table, _ = wide.wide(spark.createDataFrame(rows, VALUE), definitions)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") and plan.count("Exchange ") <= 1 and "Broadcast" not in plan


def test_many_attributes_take_two_levels(spark):
    definitions = spark.createDataFrame([(k, f"c{k}", "number", False, day(0)) for k in range(1, 30)], DEFINITION)
    rows = [cell("number", kid=100 * f + k, fs_entry_id=f, property_def_id=k, value_number=k) for f in range(1, 8) for k in range(1, 30) if (f + k) % 3]
    table, columns = wide.wide(spark.createDataFrame(rows, VALUE), definitions)
    assert table.count() == 7
    assert wide.filled_by(table, columns).count() == len(rows)


def test_report_counts_by_month(spark):
    broken = spark.createDataFrame([("t", "f", 1, "missing", day(0)), ("t", "f", 2, "missing", day(1)), ("t", "f", 3, "late", None)], "table_name string, field_name string, kid long, cause string, created_at timestamp")
    assert sorted((r["month"] or "", r["n"]) for r in orphans.report(broken).collect()) == [("", 1), ("2024-01", 2)]
    assert broken.where(F.col("cause") == "late").count() == 1


def test_p2_found_reads_the_whole_wide_table(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(problems, "materialize", lambda df, what: stored.append(df) or df)
    found = problems.p2_found(spark, DATA)
    _, columns = wide.wide(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("knowledge_file_metadata_value", "knowledge_metadata_property_def")))
    assert set(stored[0].columns) == {"fs_entry_id", *(n for _, n, _ in columns), *(f"{n}__kid" for _, n, _ in columns)} and found.count() > 0
