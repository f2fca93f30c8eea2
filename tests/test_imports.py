"""Imports, moves and recall on hand-made rows: nulls, repeated rows, empty tables, clashing columns."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sparkkb.functions import markup
from sparkkb.operators import build, context, imports, links, reading, retrieval, tree

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
ENTRY = "kid long, knowledge_base_id long, parent_entry_id long, entry_type string, name string, virtual_path string, depth int, file_size long, checksum string, mime_type string, line_count int, is_deleted boolean, created_at timestamp, path string, place long, n long"
TEXT = "id long, knowledge_base_id long, source_fs_entry_id long, text string, created_at timestamp, place int, edge string, path string"
FILE = "place long, knowledge_base_id long, path string, checksum string, virtual_path string, first long, status string"


def entry(kid, kind, path, base=1, parent=None, deleted=False, checksum=None):
    return (kid, base, parent, kind, path.rsplit("/", 1)[1], path, path.count("/"), 5, checksum, None, 3, deleted, NOW, None, None, None)


def entries(spark):
    rows = [entry(1, "DIRECTORY", "/a"), entry(2, "FILE", "/a/x.md", parent=1, checksum="c1"), entry(3, "FILE", "/a/gone.md", parent=1, deleted=True), entry(4, "FILE", "/top.md"), entry(5, "DIRECTORY", "/b"), entry(6, "FILE", "/a/x.md", base=2)]
    return spark.createDataFrame(rows, ENTRY)


def test_links_are_rewritten(spark):
    many = "[l](x.md) " * 1025
    texts = {
        1: ("[a](x.md#s) ![b](<../top.md> 'T') [c](gone.md)", "[a](kbref://2049) ![b](<kbref://2050> 'T') [c](kbref://2051)"),
        2: ("[a](#f) [b](//h/x) [c](https://h/x.md) [d](/a) [e](../..) [f](/)", None), 3: ("", None), 4: (None, None), 5: (many, None), 6: ("plain [x] (y)", None), 7: (f"[a](x.md) {imports.OPEN}", None),
    }
    rows = [(k, 1, 2, t, NOW, 0, "clash", "/p") for k, (t, _) in texts.items()]
    new, edges = imports.rewritten(spark.createDataFrame(rows + rows[:1], TEXT), entries(spark))
    assert {r["id"]: r["text"] for r in new.collect()} == {k: t if want is None else want for k, (t, want) in texts.items()}
    found = {r["kid"]: (r["target_fs_entry_id"], r["target_path"], r["target_suffix"], r["status"]) for r in edges.collect()}
    assert found == {2049: (2, None, "#s", "resolved"), 2050: (4, None, "", "resolved"), 2051: (None, "/a/gone.md", "", "unresolved")}
    empty, none = imports.rewritten(spark.createDataFrame([], TEXT), entries(spark))
    assert empty.count() == 0 and none.count() == 0


def test_rewritten_tokens_resolve_again(spark):
    new, edges = imports.rewritten(spark.createDataFrame([(1, 1, 2, "see [a](./x.md#s)", NOW, 0, None, None)], TEXT), entries(spark))
    back = links.resolve_tokens(new.withColumn("knowledge_base_id", F.lit(1).cast("long")), "id", "knowledge_base_id", "text", edges, entries(spark))
    assert [r["text"] for r in back.collect()] == ["see [a](/a/x.md#s)"]


@pytest.mark.parametrize("path, want", [("/a//b/", "/a/b"), (" /a ", "/a"), ("a", None), ("/a/../b", None), ("/", None), ("", None), ("/..a", "/..a"), (None, None)])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(imports.cleaned_path("p").alias("c")).first()["c"] == want
    if path is not None and want is None:
        with pytest.raises(ValueError):
            imports.clean_path(path)
    elif path is not None:
        assert imports.clean_path(path) == want


def test_import_report_and_entries(spark):
    files = [(1, 1, "/n/x.md", "c9", "clash", None, None), (2, 1, "/n//x.md", "c9", None, None, None), (3, 1, "/a/x.md", "c2", None, None, None), (4, 1, "rel", None, None, None, None), (5, 1, "/c.txt", "c1", None, None, None), (6, None, None, None, None, None, None)]
    df = spark.createDataFrame(files, FILE)
    assert {r["place"]: (r["phase"], r["status"]) for r in imports.import_report(df, entries(spark), True).collect()} == {1: (2, "created"), 2: (2, "repeated"), 3: (2, "exists"), 4: (1, "refused"), 5: (1, "copy"), 6: (1, "refused")}
    made = imports.new_entries(df, entries(spark), 100).collect()
    assert {(r["entry_type"], r["virtual_path"]) for r in made} == {("FILE", "/n/x.md"), ("FILE", "/c.txt"), ("DIRECTORY", "/n")} and len({r["kid"] for r in made}) == 3
    assert imports.import_report(df.limit(0), entries(spark)).count() == 0


def test_update_report(spark):
    updates = spark.createDataFrame([(2, "c1"), (2, "old"), (4, None), (3, "x"), (99, None), (6, "c")], "kid long, signature string")
    got = sorted(tuple(r) for r in imports.update_report(updates, entries(spark), spark.createDataFrame([(6,), (6,)], "kid long")).collect())
    assert got == [(2, "conflict"), (2, "updated"), (3, "unknown"), (4, "updated"), (6, "busy"), (99, "unknown")]
    assert imports.timeline(imports.update_report(updates, entries(spark), updates.limit(0)), "2024-01-02").count() == 2


def test_supplied_and_stored(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", None)], "kid long, name string, size int")
    changes = spark.createDataFrame([(1, 7), (1, 8), (3, None), (9, 1)], "kid long, size int")
    assert sorted(map(tuple, imports.supplied(rows, changes, "kid").collect())) == [(1, "a", 8), (2, None, 6), (3, "c", None)]
    after = imports.stored(entries(spark), spark.createDataFrame([(2, 77, "new")], "kid long, file_size long, checksum string")).where("kid in (2, 4)").orderBy("kid").collect()
    assert [(r["file_size"], r["checksum"], r["mime_type"], r["line_count"]) for r in after] == [(77, "new", "text/markdown", None), (5, None, None, 3)]


def test_cache_and_cleanup(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m, tzinfo=timezone.utc)
    log = spark.createDataFrame([(1, at(0), False), (1, at(5), True), (1, at(9), False), (2, at(1), True), (3, at(1), False), (3, at(2), True)], "k long, ts timestamp, hit boolean")
    assert {r["k"]: (r["created_at"].minute, r["expires_at"].minute) for r in imports.cache_state(log, "k", 60).collect()} == {1: (9, 10), 3: (1, 3)}
    cache = spark.createDataFrame([(1, at(3), "READY"), (2, at(1), "READY"), (3, at(50), "READY"), (4, at(2), "ERROR"), (5, at(0), "EVICTING")], "key long, expires_at timestamp, state string")
    assert [r["key"] for r in imports.cleanup(cache, "2024-01-01T00:10:00Z", 2).collect()] == [2, 4]


def test_moves(spark):
    e = entries(spark)
    after, said = tree.moved_batch(e, 1, [("/a", "/b/a"), ("/b/a/x.md", "/y.md"), ("/none", "/z"), ("/b", "/b/c"), ("/top.md", "/y.md")])
    assert [x for *_, x in said] == ["moved", "moved", "not found", "into itself", "taken"]
    assert {r["kid"]: (r["virtual_path"], r["parent_entry_id"], r["depth"]) for r in after.collect()} == {1: ("/b/a", 5, 2), 2: ("/y.md", None, 1), 3: ("/a/gone.md", 1, 2), 4: ("/top.md", None, 1), 5: ("/b", None, 1), 6: ("/a/x.md", None, 2)}
    with pytest.raises(ValueError):
        tree.moved_batch(e, 1, [("/a", "/c"), ("/a", "/d")])


def test_recall_of_many_queries_is_that_of_each(spark):
    texts = [(1, "pump rack pump"), (2, "rack and pump index rack"), (3, None), (4, ""), (5, "index 泵 rack"), (6, "PUMP")]
    chunks = spark.createDataFrame([(i, t, "x") for i, t in texts], "chunk_id long, chunk_text string, places string")
    asked = {1: "pump", 2: "rack pump", 3: "nosuch pump", 4: "", 5: None, 6: "泵", 7: "Pump"}
    rows = [(i, t) for i, t in asked.items()]
    got = {}
    for r in retrieval.text_recall_batch(chunks, spark.createDataFrame(rows + rows[:1], "query_id long, text string")).collect():
        assert r["chunk_id"] not in got.setdefault(r["query_id"], {})
        got[r["query_id"]][r["chunk_id"]] = r["text_score"]
    want = {i: {r["chunk_id"]: round(r["text_score"], 6) for r in retrieval.text_recall(chunks, t).collect()} for i, t in asked.items() if t}
    assert got == {i: w for i, w in want.items() if w}
    assert retrieval.text_recall_batch(chunks, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_vectors_of_odd_shape(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [3.0, 4.0]), (6, [])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["s"] for r in vectors.select("vec_id", retrieval.cosine(F.col("embedding"), [1.0, 0.0]).alias("s")).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None, 5: pytest.approx(0.6), 6: None}
    assert vectors.select(retrieval.cosine(F.col("embedding"), []).alias("s")).where("s is not null").count() == 0
    near = retrieval.nearest(vectors.where("vec_id in (1, 5)"), vectors.where("vec_id not in (4, 6)"), 2).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in near) == [(1, 1, 1.0, 1), (1, 5, 0.6, 2), (5, 1, 0.6, 2), (5, 5, 1.0, 1)]


def test_merged_order(spark):
    hits = spark.createDataFrame([("1", 5, 0.5), ("1", 6, 0.9), ("2", 7, 1.0), ("3", 8, None)], "kb_code string, chunk_id long, score double")
    assert [(r["kb_code"], r["chunk_id"]) for r in retrieval.federated_merge(hits, spark.createDataFrame([("1",), ("3",)], "kb_code string")).collect()] == [("2", None), ("1", 6), ("1", 5), ("3", 8)]


@pytest.mark.parametrize("reader", ["yaml", "own"])
def test_front_matter_of_both_readers(monkeypatch, reader):
    if reader == "own":
        monkeypatch.setattr(markup, "yaml", None)
    elif markup.yaml is None:
        pytest.skip("no YAML here")
    found, rest = markup.front_matter("---\ntitle: 'A'\nn: 3\nok: true\ntags: [a, b]\nday: 2024-01-02\ntext: one\n  two\n---\nbody")
    assert found == {"title": "A", "n": 3, "ok": True, "tags": ["a", "b"], "day": "2024-01-02", "text": "one two"} and rest == "body"


@pytest.mark.parametrize("line, level", [("第一千章 x", 1), ("第〇节", 1), ("万、x", 1), ("（十）x", 1), ("1.2 Title", 1), ("1.2标题", 0), ("1、概述", 0), ("1、 概述", 1), ("# x", 1), ("##### x", 0), ("一、x。", 0)])
def test_shapes_of_headings(line, level):
    assert markup.headings([line]) == [level]


def test_lines_at_any_break(spark):
    text = "a\r\nb\x0bc \n d\x85"
    got = [(r["line_no"], r["start"], r["line"]) for r in reading.line_offsets(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").orderBy("line_no").collect()]
    assert [x for *_, x in got] == text.splitlines() and [text[s : s + len(x)] for _, s, x in got] == text.splitlines()


def test_cited_only_and_selected(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, None), ("b", 4, False), (None, 5, True), (None, 6, None)], "g string, n long, cited boolean")
    assert sorted(r["n"] for r in context.cited_only(rows, "g", "cited").collect()) == [1, 3, 4, 5]
    results = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "bad", "x"), ("b", 1, None, ""), ("c", 1, "bad", None), ("c", 2, "", "y")], "query_id string, line_no long, error string, answer string")
    asked = spark.createDataFrame([(x,) for x in "abcd"], "query_id string")
    ids = lambda **how: sorted(r["query_id"] for r in context.selected(asked, results, **how).collect())
    assert ids() == ["a", "b", "d"] and ids(retry_failed=True) == ["a", "b"] and ids(ids=["c", "z"]) == ["c"] and len(ids(sample=3)) == 3


def test_expired_in_order(spark):
    rows = spark.createDataFrame([(k, datetime(2024, 1, k, tzinfo=timezone.utc)) for k in (5, 2, 9, 1)], "k long, ts timestamp")
    assert [r["k"] for r in build.expired(rows, "ts", 60, "2024-01-08", 2).collect()] == [1, 2]
