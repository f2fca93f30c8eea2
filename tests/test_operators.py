"""Behaviour that SQL does not show: validation, paths, text parsing, budgets, archives, streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkkb.functions import markup
from sparkkb.functions.paths import decode_percent, normalize_path
from sparkkb.operators import answers, chunking, context, links, retrieval, tree
from sparkkb.plans import filters
from sparkkb.session import scratch_path
from sparkkb.sources import files
from sparkkb.streaming import jobs


def leaf(op, field="x", **more):
    return {op: {"fieldName": field, **more}}


@pytest.mark.parametrize(
    "where, code",
    [
        ({}, "INVALID_BOOLEAN_NODE"), ({"and": []}, "INVALID_BOOLEAN_NODE"), ({"like": {}}, "UNSUPPORTED_OPERATOR"), (leaf("eq", value=1, field=None), "UNKNOWN_FIELD"), (leaf("exists", value=1), "INVALID_FIELD_VALUE_TYPE"),
        (leaf("gt", value="abc"), "INVALID_FIELD_VALUE_TYPE"), (leaf("eq", "fileSize", value="1"), "INVALID_FIELD_VALUE_TYPE"), (leaf("contains", "fileName", value="a"), "INVALID_FIELD_VALUE_TYPE"), (leaf("in", value=[1, "a"]), "INVALID_FIELD_VALUE_TYPE"),
        (leaf("prefix", value=3), "INVALID_FIELD_VALUE_TYPE"), ({"not": {"not": {"not": {"not": leaf("exists")}}}}, "TOO_DEEP_BOOLEAN_NESTING"), ({"and": [leaf("exists")] * 13}, "TOO_MANY_CONDITIONS"), (leaf("gt", value=True), "INVALID_FIELD_VALUE_TYPE"),
    ],
)
def test_filter_problems(where, code):
    assert code in [p.code for p in filters.validate(where)]


def test_good_filters_and_typed_fields():
    good = {"and": [leaf("eq", value=1), {"or": [leaf("gte", value="20260515"), leaf("wildcard", "fileName", value="*.md")]}, {"not": leaf("exists")}]}
    assert filters.validate(good) == []
    assert [p.code for p in filters.validate(leaf("eq", "tags", value="a"), {"tags": "stringList"})] == ["INVALID_FIELD_VALUE_TYPE"]
    assert [p.code for p in filters.validate(leaf("eq", "nope", value="a"), {"tags": "stringList"})] == ["UNKNOWN_FIELD"]
    assert filters.like_pattern("wildcard", "a_*%?!") == "a!_%!%_!!"
    assert filters.fold_file_types(None, []) is None


def test_paths(spark):
    cases = {"/a/./b/../c": "/a/c", "/..": None, "/a//b/": "/a/b", "/": "/", None: None, "/a/../..": None}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", normalize_path("p").alias("n"), decode_percent(F.lit("100%25 a+b %E4%B8%AD %zz")).alias("d")).collect()
    assert {r["p"]: r["n"] for r in got} == cases
    assert got[0]["d"] == "100% a+b 中 %zz"


def test_glob_and_moves(spark):
    rows = [(1, 1, "/a_b/x.md", "x.md", 2, "FILE", False), (2, 1, "/axb/x.md", "x.md", 2, "FILE", False), (3, 1, "/a_b", "a_b", 1, "DIRECTORY", False), (4, 1, "/a[1].md", "a[1].md", 1, "FILE", False), (5, 2, "/a_b/x.md", "x.md", 2, "FILE", True)]
    e = spark.createDataFrame(rows, "kid long, knowledge_base_id long, virtual_path string, name string, depth int, entry_type string, is_deleted boolean")
    found = lambda p: sorted(r["kid"] for r in tree.glob(e, p).collect())
    assert (found("/a?b/*.md"), found("/a[[]1].md"), found("/[!b]*"), found("/A*")) == ([1, 2], [4], [3, 4], [])
    with pytest.raises(ValueError):
        tree.glob(e, "/**/x")
    after = {r["kid"]: (r["virtual_path"], r["name"], r["depth"]) for r in tree.moved(e, 1, "/a_b", "/n/m").collect()}
    assert after[1] == ("/n/m/x.md", "x.md", 3) and after[2] == ("/axb/x.md", "x.md", 2) and after[3] == ("/n/m", "m", 2) and after[5][0] == "/a_b/x.md"
    with pytest.raises(ValueError):
        tree.moved(e, 1, "/a_b", "/a_b/c")


def test_cover_density(spark):
    rows = [(1, "red fox"), (2, "red big fox"), (3, "fox only"), (4, None), (5, ""), (6, "red fox red"), (7, "é" * 200_000 + " red")]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_text string")
    got = {r["chunk_id"]: round(r["text_score"], 4) for r in retrieval.text_recall(chunks, "Red fox!").collect()}
    assert got == {1: 0.1, 2: 0.05, 6: 0.2}
    assert retrieval.text_recall(chunks, "?!").count() == 0


def test_fusion_weights(spark):
    t = spark.createDataFrame([(1, 0.5), (2, 0.2)], "chunk_id long, text_score double")
    v = spark.createDataFrame([(1, 0.5), (3, 0.9)], "chunk_id long, vector_score double")
    both = {r["chunk_id"]: round(r["score"], 6) for r in retrieval.fuse(t, v).collect()}
    assert both == {1: 0.55, 2: 0.08, 3: 0.54}
    assert {r["chunk_id"]: r["score"] for r in retrieval.fuse(t, v.limit(0)).collect()} == {1: 0.5, 2: 0.2}
    assert {r["chunk_id"]: r["score"] for r in retrieval.fuse(None, v).collect()} == {1: 0.5, 3: 0.9}


def test_nearest_leaves_out_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.nearest(v.where("vec_id = 1"), v, 2).collect()]
    assert sorted(got) == [(1, 1, 2), (1, 5, 1)]


def test_link_spans_and_tokens(spark):
    texts = spark.createDataFrame([(1, "a [x](b.md#t) ![i](</c d.png>) [y](http://z) kbref://7."), (2, None), (3, "")], "id long, text string")
    assert sorted((r["target"], r["path"], r["suffix"]) for r in links.spans(texts, "id", "text").where(links.is_local(F.col("target"))).collect()) == [("b.md#t", "b.md", "#t")]


def test_front_matter():
    found, rest = markup.front_matter("---\ntitle: 'A'\nn: 3\nok: true\ntags: [a, b]\nlist:\n - x\n - y\nnone:\n---\nbody")
    assert found == {"title": "A", "n": 3, "ok": True, "tags": ["a", "b"], "list": ["x", "y"], "none": None} and rest == "body"
    assert markup.front_matter("---\nno mapping\n---\nx") == ({}, "---\nno mapping\n---\nx")
    assert markup.front_matter("--- open") == ({}, "--- open")


def test_headings():
    lines = ["# A", "1. one", "2. two", "", "3.1 Nested", "```", "# code", "```", "##### five", "1. Alone", "第一章 开始"]
    assert markup.headings(lines) == [1, 0, 0, 0, 1, 0, 0, 0, 0, 2, 3]


def test_chunks_cover_every_body_line_once():
    text = "# Top\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(20)) + "\n\n## Empty\n\n## Table\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 30} |" for i in range(60)) + "\n\n" + "q" * 3000
    got = chunking.chunk(text)
    assert [c[0] for c in got] == list(range(1, len(got) + 1))
    assert all(len(c[3].split("\n\n", 1)[-1]) <= chunking.HARD for c in got)
    whole = "\n".join(c[3] for c in got)
    assert all(f"Paragraph {i} " in whole for i in range(20)) and whole.count("q") == 3000 and all(whole.count(f"| {i} | x") == 1 for i in range(60))
    assert any(c[3] == "# Top\n## Empty" for c in got)
    assert whole.count("|---|---|") > 1


def test_links_are_not_cut():
    link = "[" + "a" * 300 + "](" + "b" * 600 + ")"
    got = chunking.chunk("x" * 700 + " " + link + " " + "z" * 900)
    assert any(link in c[3] for c in got)


def test_conversions():
    assert markup.html_to_text("<h2>T</h2><p>a &amp; b</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>") == "## T\n\na & b\n\n1 | 2"
    assert markup.csv_to_text('a,"b,c"\n,\n1,2\n') == "a | b,c\n1 | 2"
    assert markup.drop_noise(["1 / 3", "2024-01-01", "x", "2024-01-01", "y.md"]) == ["x", "y.md"]


def test_chunks_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n ", None), (4, "a", "clash"), (4, "a", "clash")]
    got = chunking.chunks(spark.createDataFrame(rows, "id long, text string, chunk_no string"), "id", "text").collect()
    assert [(r["id"], r["chunk_text"]) for r in got] == [(4, "a"), (4, "a")]


def test_round_robin_budget():
    groups = [[(1, "a" * 10), (2, "b" * 10)], [(3, "One. " + "c" * 200)], [(4, "d" * 10)]]
    got = context.round_robin(groups, 100)
    assert [x[0] for x in got][:3] == [1, 3, 4] and got[1][1:] == ("One.", False)
    assert sum(context.tokens_of(t) for _, t, _ in got) <= 100
    assert context.round_robin([], 10) == [] and context.round_robin(groups, 0) == []


@pytest.mark.parametrize("reply, score", [('{"score": 1}', 1), ('x ```json\n{"score": 0}\n``` y', 0), ('so {"a": 2, "score": 1} ok', 1), ("none", None), (None, None), ('{"score": "x"}', None)])
def test_judge(spark, reply, score):
    assert spark.createDataFrame([(reply,)], "r string").select(context.parsed_score(F.col("r"))).first()[0] == score


def archive(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    data = archive(("a/x.txt", "1"), ("./a/x.txt", "2"), ("__MACOSX/x", "3"), (".hidden/y", "4"), ("../evil", "5"), ("b.md", "6"))
    df = spark.createDataFrame([("z1", bytearray(data)), ("bad", bytearray(b"no zip"))], "path string, content binary")
    got = sorted((r["archive"], r["path"] or "", bytes(r["content"] or b""), r["error"]) for r in files.read_archives(df).collect())
    assert got == [("bad", "", b"", "not an archive"), ("z1", "../evil", b"", "outside of the archive"), ("z1", "/a/x.txt", b"1", None), ("z1", "/b.md", b"6", None)]
    assert {r["path"]: r["phase"] for r in files.import_order(files.read_archives(df).where("error is null")).collect()} == {"/a/x.txt": 1, "/b.md": 2}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    assert sorted((r["text"] or "", r["valid"]) for r in files.as_text(files.read_files(spark, str(tmp_path), "*.txt")).collect()) == [("", False), ("hi", True)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", "k int, v string").count() == 2
    files.append(df, f"{tmp_path}/p", "k")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), f"{tmp_path}/p", "k")
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/p").collect()) == ["a", "c"]


def test_sheets():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = archive(
        ("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>'), ("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>3.0</v></c></row><row><c/></row></sheetData></worksheet>'))
    assert files.sheet_to_text(book) == "## S\nhello | 3"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\n\nbody"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = jobs.arriving(spark, f"{tmp_path}/in", "doc_id long, text string")
    jobs.build_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 02:00:00")], "k long, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    ends = jobs.expiring(jobs.arriving(spark, f"{tmp_path}/ev", "k long, ts timestamp"), "k", "ts", 3600)
    out = scratch_path(spark, "expired")
    jobs.run_to_end(ends, out, f"{tmp_path}/state2")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "EVICTING"), (1, "READY"), (2, "READY")]


def test_history_and_confidence_on_ties(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 1, "b"), ("u", 2, None), ("u", 3, "c")], "who string, t long, said string")
    assert [r["history"] for r in context.history(rows, "who", ["t", "said"], "said").orderBy("t", "said").collect()] == [[], ["a"], ["a", "b"], ["a", "b"]]
    none = spark.createDataFrame([("g", None, 1)], "g string, s double, i long")
    assert context.confidence(none, "g", "s", "i").first()["confidence"] == 0.0


def test_context_reaches_all_rounds_and_files(spark):
    """As round_robin() of all hits: a hot file of short texts, files without a sentence end, small budgets, null groups and scores, repeated rows."""
    rng = random.Random(7)
    rows = [("hot", "f", i, "x" * 30, float(i)) for i in range(150)] + [("hot", "f", 149, "x" * 30, 149.0)]
    rows += [("long", f"f{i}", i, "y" * 900, 1.0) for i in range(200)] + [("long", "g", 900, "One. " + "z" * 900, 0.5), ("long", "h", 901, "w" * 8, None), ("long", None, 902, "", None)]
    rows += [(None, rng.choice("abcdefgh"), i, rng.choice(["", ".", "ab.", "😀" * 40 + "。", "q" * 20]) + "t" * rng.randrange(90), rng.choice([None, 1.0, 2.0])) for i in range(400)] + [("null", "a", 1, None, 1.0)]
    hits = spark.createDataFrame(rows, "q string, g string, item long, text string, score double").repartition(5)
    for budget in (0, 40, 300, 700, 3000, 4553):
        got = {}
        for r in context.context(hits, "q", "g", budget).orderBy("position").collect():
            got.setdefault(r["q"], []).append((r["position"], r["item"], r["text"], r["whole"]))
        want = {}
        for q in {r[0] for r in rows}:
            files_of = {}
            for r in sorted((r for r in rows if r[0] == q and r[3] is not None), key=lambda r: (r[4] is None, -(r[4] or 0), r[2])):
                files_of.setdefault(r[1], []).append(r)
            turns = sorted(files_of.values(), key=lambda g: (g[0][4] is None, -(g[0][4] or 0), g[0][1] is None, g[0][1] or ""))
            if found := context.round_robin([[(r[2], r[3]) for r in g] for g in turns], budget):
                want[q] = [(n, *x) for n, x in enumerate(found, 1)]
        assert got == want
    assert len(got["hot"]) == 101


@pytest.mark.parametrize("between", ["", " |"])
def test_tables_in_one_line_keep_their_head(between):
    rows = [["name", "size"], ["---", "---"], *[[f"r{i} " + "x" * 20, str(i)] for i in range(90)]]
    line = "|" + between.join(" " + " | ".join(r) + " |" for r in rows)
    got = chunking.chunk(f"# T\n\nbefore\n{line}\nafter")
    parts = [c for c in got if "| r" in c[3]]
    assert len(parts) > 2 and all("| name | size |\n| --- | --- |\n" in c[3] and len(c[3]) <= chunking.HARD + 10 and c[1] <= 4 <= c[2] for c in parts)
    whole = "\n".join(c[3] for c in got)
    assert all(whole.count(f"| r{i} {'x' * 20} | {i} |") == 1 for i in range(90)) and "before" in whole and "after" in whole
    assert chunking.inline_table("| a | b | c |") is None and chunking.inline_table("| a | b | c | --- | --- | 1 | 2 |") is None


def test_custom_headings_and_noise(spark):
    shapes = markup.heading_patterns('[{"name": "part", "regex": "^Part \\\\d+", "reject_if_contains_colon": true}, {"name": "nested", "regex": "^S\\\\d"}]')
    assert markup.headings(["Part 1", "S1", "Part 2: x", "# no", "1.1 Old"], True, shapes) == [1, 2, 0, 0, 0]
    df = spark.createDataFrame([(1, "Part 1\n\n1 / 3\n\nbody\n\na.md\n\na.md")], "id long, text string")
    assert [r["chunk_text"] for r in chunking.chunks(df, "id", "text", False, shapes).collect()] == ["Part 1\n\nbody"]


def test_sheets_are_converted(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = archive(("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>'), ("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c><v>3</v></c></row></sheetData></worksheet>'))
    df = spark.createDataFrame([(1, bytearray(book), "XLSX"), (2, bytearray(b"no zip"), "xlsx"), (3, bytearray(b"\xef\xbb\xbfhi"), "txt"), (4, None, "txt"), (5, bytearray(b"x"), "pdf")], "id long, content binary, kind string")
    assert {r["id"]: (r["text"], r["status"]) for r in chunking.converted(df, "id", "content", "kind").collect()} == {
        1: ("## S\n3", "converted"), 2: (None, "failed"), 3: ("hi", "converted"), 4: (None, "converted"), 5: (None, "unsupported")}


def test_sub_answers(spark):
    df = spark.createDataFrame([("u", 2, None, None, None, None, None), ("u", 1, "q", "multi", "yes", ["a", "b"], 0.456)], "k string, n int, query_text string, query_type string, answer string, reasoning array<string>, confidence double")
    assert answers.sub_answers(df, "k", "n").first()["text"] == (
        "## Sub-query 1: q\nType: multi\nConfidence: 0.46\n\n### Answer\nyes\n\n### Reasoning Process\n- a\n- b\n\n\n---\n\n## Sub-query 2: Sub-query 2\nType: single-hop\nConfidence: 0.00\n\n### Answer\n\n")


def test_periodic_runs_again(spark, tmp_path):
    put = lambda n: spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(1)
    seen = []
    query = jobs.periodic(jobs.arriving(spark, f"{tmp_path}/in", "id long"), lambda b, _: seen.extend(r["id"] for r in b.collect()), f"{tmp_path}/state", "1 second")
    try:
        query.processAllAvailable()
        put(2)
        query.processAllAvailable()
        assert seen == [1, 2] and query.isActive
    finally:
        query.stop()


def test_ranks_over_slots(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(3000)] + [("a", 1.0, 5)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    found = context.ranked_by_slots(df, ["g"], "s", "i")
    assert sorted(map(str, found.collect())) == sorted(map(str, context.ranked(df, ["g"], "s", "i").collect()))


def test_sizes_of_reduced_logs_need_no_list(spark):
    rng = random.Random(10)
    log = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(9)]), i, rng.choice(["ADD"] * 20 + ["RESET"])) for i in range(600)], "u long, t long, i long, m string")
    got = answers.reduced_sizes(log, "u", ["t", "i"], "m", "i")
    want = answers.reduced(log, "u", ["t", "i"], "m", "i").select("u", F.size("items").alias("n"), F.array_max("items").alias("last_item"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "collect_list" not in got._jdf.queryExecution().toString()
