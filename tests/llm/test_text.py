"""The text operators against brute force, round trips and held-out cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkkb.llm import codepoints, encode, neardup, packing, pairs, queries, splitting, truncation

from ..conftest import DATA

TEXT = "id long, text string, words string, block long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], TEXT)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(name, spark):
    df = queries.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


# --- splitting


def brute_forced(text):
    return int(max(map(len, re.split(f"[{splitting.BOUNDARY}]", text))) > splitting.LIMIT)


def test_forced_over_ranges(spark):
    rng = random.Random(1)
    texts = [None, "", "a" * 819, "a" * 820, "a " * 500, "x" * 900 + " y", "。".join("y" * rng.randrange(1, 900) for _ in range(9)), "z" * 70_000, ("w" * 700 + "　") * 300, "é" * 819 + " " + "é" * 819]
    got = dict(splitting.forced(frame(spark, texts), "id", "text").collect())
    assert got == {i: brute_forced(t) for i, t in enumerate(texts) if t and len(t) > 819}


def rebuilt(pieces):
    out = pieces[0]
    for p in pieces[1:]:
        k = next(k for k in range(splitting.OVERLAP, -1, -1) if out.endswith(p[:k]) or not k)
        out += p[k:]
    return out


def test_pieces_are_the_same_for_any_range_size(spark):
    rng = random.Random(2)
    words = lambda n: "".join(f"w{i} " + rng.choice(["", "", ". ", "\n", "\n\n", "！"]) for i in range(n))
    texts = [None, "short", words(400), words(3000), "q" * 5000, "a " + "b" * 3000 + " " + words(100)]
    df = frame(spark, texts)
    whole = sorted(map(tuple, splitting.pieces(df, "id", "text").collect()))
    assert whole == sorted(map(tuple, splitting.pieces(df, "id", "text", size=1000).collect()))
    assert whole == sorted(map(tuple, splitting.pieces(df, "id", "text", size=2777).collect()))
    for i, t in enumerate(texts):
        mine = [r for r in whole if r[0] == i]
        assert (not mine) == (not t or len(t) <= 819)
        if mine:
            assert [r[1] for r in mine] == list(range(1, len(mine) + 1)) and max(len(r[4]) for r in mine) <= 819
            assert mine[-1][3] == 1 + t.count("\n", 0, len(t) - 1)
            at = 0
            for r in mine:  # every piece is in the text, after the begin of the one before
                found = t.find(r[4], at if r[1] == 1 else at + 1)
                assert found >= 0 and r[2] == 1 + t.count("\n", 0, found)
                at = found
            if i != 4:
                assert rebuilt([r[4] for r in mine]) == t


def test_null_and_repeated_ids_above_one_range(spark):
    """Each row for itself, whatever its id, as a text of the same kind alone in one range."""
    long, tail, big = "ab cd. " * 400, "x" * 500 + " " + "ab cd. " * 300 + " " + "y" * 500, 2**60 + 1
    rows = [(None, long), (None, long), (None, tail), (7, long), (7, long), (7, tail), (7, tail), (big, tail), (None, "z" * 2000), (None, "short"), (None, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    order = lambda found: sorted(map(tuple, found), key=str)
    by_text = {t: splitting.pieces(spark.createDataFrame([(1, t)], "id long, text string"), "id", "text").collect() for t in {t for _, t in rows if t}}
    want = [(i, *r[1:]) for i, t in rows if t for r in by_text[t]]
    assert order(splitting.pieces(df, "id", "text", size=1000).collect()) == order(splitting.pieces(df, "id", "text").collect()) == order(want)
    assert order(splitting.forced(df, "id", "text", size=1000).collect()) == order(splitting.forced(df, "id", "text").collect()) == order((i, brute_forced(t)) for i, t in rows if t and len(t) > 819)


def test_files_by_ranges_of_bytes(spark, tmp_path):
    """A file gives the pieces of its text, wherever a range cuts a character."""
    rng = random.Random(8)
    texts = {"a.txt": "".join(rng.choice(["wörter ", "中文。", "\n", "line é\n\n", "😀 ", "x" * 30]) for _ in range(3000)), "b.txt": "short", "c.txt": "", "d.txt": "中" * 4000}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, encoding="utf-8", newline="")
    want = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "id long, text string")
    want = sorted((r["id"], r["chunk_no"], r["start_line"], r["end_line"], r["chunk_text"]) for r in splitting.pieces(want, "id", "text").collect())
    for size in (4000, 4001, 1 << 16):
        found = splitting.pieces_of_ranges(splitting.file_ranges(spark, str(tmp_path), size=size)).where("id not like '%b.txt'").collect()
        got = sorted((list(texts).index(r["id"].rsplit("/", 1)[1]), r["chunk_no"], r["start_line"], r["end_line"], r["chunk_text"]) for r in found)
        assert got == want


def test_ranges_of_a_long_text(spark):
    text = "some words here. " * 200_000
    ranges = splitting.text_ranges(spark.createDataFrame([("1", text, 1)], "id string, text string, first_line long"))
    rows = ranges.orderBy("range_no").collect()
    assert "".join(r["part"] for r in rows) == text and all(len(r["part"]) <= 1 << 16 and len(r["tail"]) <= 2 * 819 for r in rows) and len({r["key"] for r in rows}) == 1


# --- near duplicates


def brute_pairs(texts, width, threshold, least):
    word = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
    sets = {}
    for i, t in enumerate(texts):
        w = word.findall((t or "").lower())
        if len(w) >= max(least, width):
            sets[i] = set(zip(*(w[k:] for k in range(width)), strict=False))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def revised(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(3)] = rng.choices(["neu", "x1", "other", "中"], k=rng.randrange(3))
    return " ".join(out)


@pytest.mark.parametrize("width, threshold, least", [(3, 0.6, 20), (5, 0.8, 5), (1, 0.5, 1)])
def test_all_pairs_are_found(spark, monkeypatch, width, threshold, least):
    monkeypatch.setattr(neardup, "FREQUENT_OVER", 6)  # so that combinations of two are needed
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4_000)
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    stem = rng.choices(vocabulary, k=60)
    texts = [None, "", "same", "same", "one two", "a a a a a a a a a a a a a a a a a a a a a a", "A a a a a a a a a a a a a a a a a a a a a a!"]
    texts += [" ".join(stem)] * 9 + [revised(rng, stem, rng.randrange(12)) for _ in range(60)]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))) for _ in range(80)]
    texts += [" ".join(stem[:40] + rng.choices(vocabulary, k=8)) for _ in range(30)] + ["你好世界" * 8, "你好世界" * 9, "x" * 9000 + " " + " ".join(stem)]
    got = [(r["kid_a"], r["kid_b"]) for r in neardup.Join(frame(spark, texts).repartition(3), "id", "text", width, threshold, least).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, width, threshold, least)


@pytest.mark.parametrize("width, threshold, least", [(3, 0.6, 20), (1, 0.5, 1)])
def test_all_pairs_are_found_by_sketched_keys(spark, monkeypatch, width, threshold, least):
    monkeypatch.setattr(neardup, "FREQUENT_OVER", 9)
    monkeypatch.setattr(neardup, "SKETCHED_OVER", 2)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(neardup, "PAIR_ROWS", 50)
    rng = random.Random(5)
    stems = [rng.choices([f"w{i}" for i in range(400)], k=n) for n in (1, 2, 24, 70, 500)]
    texts = [revised(rng, s, rng.randrange(1 + len(s) // 6)) for s in stems for _ in range(25)]
    got = [(r["kid_a"], r["kid_b"]) for r in neardup.Join(frame(spark, texts).repartition(3), "id", "text", width, threshold, least).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, width, threshold, least)


def test_unlike_texts_with_a_key_in_common_are_no_candidates(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(40)]
    texts = [" ".join([f"p{i % 20} holds more", *rng.sample(phrases, 3)]) for i in range(1200)]
    monkeypatch.setattr(neardup, "SHARED", 1)  # one key will do, so that the number of keys hides nothing
    assert neardup.Join(frame(spark, texts), "id", "text", 3, 0.6, 20).candidates().count() < 10_000  # 35,400 pairs have their first words in common


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 5, 60, 200, 290, 0)]
    rows = neardup.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    for a, x in zip(sets, rows, strict=True):
        for b, y in zip(sets, rows, strict=True):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_no_texts_no_pairs(spark):
    assert neardup.Join(frame(spark, []), "id", "text").pairs().count() == 0
    assert neardup.Join(frame(spark, []), "id", "text").groups().count() == 0


def test_groups_are_what_pairs_connect(spark):
    rng = random.Random(9)
    stems = [rng.choices([f"w{i}" for i in range(200)], k=40) for _ in range(6)]
    texts = [revised(rng, rng.choice(stems), rng.randrange(4)) for _ in range(80)] + [" ".join(stems[0])] * 3 + [None, "one two"]
    pairs = brute_pairs(texts, 3, 0.6, 20)
    join = neardup.Join(frame(spark, texts).repartition(3), "id", "text", 3, 0.6, 20)
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for p in pairs for x in p}
    got = {r["id"]: (r["group_id"], r["links"]) for r in join.groups().collect()}
    assert {i: g for i, (g, _) in got.items()} == {i: root[i] for i in linked}
    others = lambda i: {" ".join(texts[b if a == i else a].lower().split()) for a, b in pairs if i in (a, b)}
    assert {i: n for i, (_, n) in got.items()} == {i: len(others(i)) for i in linked}


def test_components_of_long_paths_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = dict(neardup.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}


def test_copies_over_slots(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLOT_COPIES", 4)
    df = frame(spark, ["same words here all five"] * 30)
    got = [tuple(r) for r in neardup.Join(df, "id", "text").pairs().collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of_a_batch(texts):
    word = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
    hashes, before = codepoints.words(*codepoints.flat(pa.array(texts, pa.string())))
    said = [word.findall(t) for t in texts]
    assert np.diff(before).tolist() == [len(w) for w in said]
    assert len({h for h in hashes.tolist()}) <= len({w.lower() for t in said for w in t}) + 2


def test_no_letters_beyond_the_planes():
    import unicodedata

    assert not any(unicodedata.category(chr(c))[0] in "LN" for c in range(codepoints.PLANES, codepoints.SENTINEL))


def test_long_words_hash_alike_alone_and_in_company():
    long = "y" * 9001
    one, _ = codepoints.words(*codepoints.flat(pa.array([long, "ab"])))
    two, _ = codepoints.words(*codepoints.flat(pa.array(["ab " + long])))
    assert one.tolist() == two[::-1].tolist()


# --- encoding and packing


@given(st.text(alphabet=st.sampled_from(list("ab'strelvmd 12\n\t 　.-中é_")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_split_is_the_pattern(text):
    import regex

    points, _ = codepoints.flat(pa.array([text]))
    at = encode.split_words(points).tolist()
    assert [text[a:b] for a, b in zip(at, at[1:], strict=False)] == regex.findall(encode.PATTERN, text)


def test_ids_and_back(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_BYTES", 200)
    texts = [None, "", " ", "don't   stop\r\n\n", "中文 text 👩‍🚀 <|endoftext|>", "a" * 5000, "x", "x", "ﬁne line\u0000"]
    df = frame(spark, texts).withColumnRenamed("id", "doc_id")
    ids = encode.Corpus(df.repartition(2)).ids()
    plain = encode.encoding(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == {i: plain(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in encode.decode(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.Corpus(df).lengths().collect()} == {i: len(plain(t or "")) for i, t in enumerate(texts)}
    assert encode.Corpus(df.limit(0)).ids().count() == 0


def test_bucket_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(60, 11, replace=False)) + 1
    counts = rng.integers(1, 9, 11)
    cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))
    best = min(cost([*some, int(lengths[-1])]) for some in combinations(map(int, lengths[:-1]), 3))
    assert cost(packing.bucket_bounds(lengths, counts, 4).tolist()) == best


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_SLOT", 100)
    rng = random.Random(4)
    sizes = [0, None, 1, 2048, 2049, 6000, 4096] + [rng.choice([3, 300, 700, 1100, 1500, 2000]) for _ in range(400)] + [rng.randrange(1, 2048) for _ in range(900)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    rows = packing.containers(df).collect()
    held = {}
    for r in rows:
        held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))
    assert {i: sum(n for _, n in p) for i, p in per.items()} == {i: n for i, n in enumerate(sizes) if n}
    assert all(sorted(k for k, _ in p) == list(range(len(p))) and (len(p) == 1 or sizes[i] > 2048) for i, p in per.items())
    total = sum(n for n in sizes if n)
    assert len(held) <= -(-total // 2048) * 1.06 + 2
    assert packing.containers(df.limit(0)).count() == 0


def test_batches_stay_in_their_bucket_and_fill_it():
    rng = np.random.default_rng(6)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5.6, 0.9, 5000).astype(int) + 1, 2048), return_counts=True)
    bounds = packing.merged_bounds(lengths, counts, packing.bucket_bounds(lengths, counts), slack=0.02)
    assert len(bounds) > 2 and bounds[-1] == lengths[-1]
    held: dict[int, dict[int, int]] = {}
    ranks = {}
    for length, first, base, use in packing.plan(lengths, counts, bounds):
        ranks.setdefault(length, []).append((first, base, use))
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        for rank in range(n):
            first, base, use = max(x for x in ranks[length] if x[0] <= rank)
            of = held.setdefault(base + (rank - first) // use, {})
            of[length] = of.get(length, 0) + 1
    assert sorted(held) == list(range(len(held)))
    assert max(sum(k * n for k, n in of.items()) for of in held.values()) <= 2048
    mixed = [c for c, of in held.items() if len(set(np.searchsorted(bounds, list(of)))) > 1]
    assert len(mixed) <= len(bounds) and all(c >= len(held) - len(bounds) for c in mixed)  # of the final batch
    assert (lengths * counts).sum() / 2048 / len(held) > 0.97
    assert packing.merged_bounds(lengths[:0], counts[:0], lengths[:0]).size == 0


# --- truncation


def test_cuts_of_intact_texts_are_found(spark):
    """Held-out accuracy: texts that end in a full stop are intact, cut ones are known."""
    rng = random.Random(5)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect() if re.search(r"[a-zß-ÿ\d][.。]\s*$", r["text"])]
    cut, whole = [], []
    for t in rows:
        if rng.random() < 0.15 and (c := truncation._cut(t, rng, [])):
            cut.append(c[0])
        else:
            whole.append(t)
    texts = [(i, t, "s", "x") for i, t in enumerate(cut + whole)] + [(10**6, None, None, None), (10**6 + 1, " ​", "s", None), (10**6 + 2, "", "s", None)]
    got = {r["doc_id"] for r in truncation.truncated(spark.createDataFrame(texts, "doc_id long, text string, source string, score string")).where("cut").collect()}
    right = len([i for i in got if i < len(cut)])
    assert right / len(got) > 0.9 and right / len(cut) > 0.85


def test_limits_and_kinds(spark):
    df = spark.createDataFrame([("a", "x" * 100)] * 6 + [("a", "y" * n) for n in range(50, 90)] + [("b", None), (None, "z" * 100)], "source string, text string")
    assert truncation.field_limits(df) == {"a": ({100}, {100})}
    assert [truncation.last_line(t)[0] for t in ("a\n- b", "| a |", "```\nx", "```\nx\n```", "x\n-- me", "see: /a/b.md", "plain")] == ["list", "table", "code", "fence", "sign", "path", "text"]
    assert truncation.truncated(df.limit(0).selectExpr("1L as doc_id", "*")).count() == 0


def test_small_tables_are_cut_as_often_as_large_ones(spark):
    texts = spark.createDataFrame([(i, f"The pump of line {i} was checked last week. It runs well again since then.", "s") for i in range(20)], "doc_id long, text string, source string")
    found = truncation.examples(texts, {}).groupBy("doc_id").agg(F.sum("cut").alias("n")).collect()
    assert len(found) == 20 and max(r["n"] for r in found) <= 4


# --- pairs


@pytest.mark.parametrize("answer", [None, "", " ​ ", "...", "{}", "[]", '""', "N/A", "null", "None", "-", "<answer></answer>", "Answer:", "**", "```\n```", '{"answer": null}'])
def test_empty_answers(answer):
    assert pairs.is_empty(answer)


@pytest.mark.parametrize("answer", ["0", "Yes", "是", "**Garmovane**", "3 minutes", "No", "x", "5 €"])
def test_short_answers_are_answers(answer):
    assert not pairs.is_empty(answer)


def test_languages():
    assert pairs.allowed_languages("Bitte auf Französisch antworten: Wie oft wird der Kühlkreis erneuert?") == {"de", "fr"}
    assert pairs.allowed_languages("请用英文回答：档案室在哪里？") == {"zh", "en"}
    assert pairs.language("XN-1234")[0] == ""


def test_field_beats_forward_probabilities():
    rng = np.random.default_rng(1)
    emit, step = rng.normal(size=(4, pairs.TAGS)), rng.normal(size=(pairs.TAGS, pairs.TAGS))
    from itertools import product

    score = {t: sum(emit[i, x] for i, x in enumerate(t)) + sum(step[a, b] for a, b in zip(t, t[1:], strict=False)) for t in product(range(pairs.TAGS), repeat=4)}
    assert pairs.decode(emit, step) == list(max(score, key=score.get))
    z = sum(np.exp(list(score.values())))
    one, two = pairs._forward_backward(emit, step)
    assert np.isclose(one[2, 3], sum(np.exp(s) for t, s in score.items() if t[2] == 3) / z)
    assert np.isclose(two[1, 0, 5], sum(np.exp(s) for t, s in score.items() if t[1:3] == (0, 5)) / z)


def test_clauses_of_a_batch():
    """Sentences, parts after a colon, a semicolon or a conjunction, list items; a table and a code block are one clause each."""
    answers = ["One. Two (three.) Four: five; six, but seven", "| a | b |\n| c | d |\nx = 1", "```\na. b\nc\n```\nend", "1. first\n2. second", None, "...", "甲。乙，丙"]
    found = pairs.Pairs(pa.array([""] * len(answers)), pa.array(answers))
    said = [[found.clause_text(i).strip() for i in np.flatnonzero(found.text == k)] for k in range(len(answers))]
    assert said == [["One.", "Two (three.)", "Four:", "five;", "six,", "but seven"], ["| a | b |\n| c | d |", "x = 1"], ["```\na. b\nc\n```", "end"], ["1. first", "2. second"], [], [], ["甲。", "乙，", "丙"]]
    assert found.kind.tolist()[6:10] == [pairs.TABLE, pairs.TEXT, pairs.CODE, pairs.TEXT]


def test_a_batch_is_judged_as_its_rows_are():
    rng = np.random.default_rng(2)
    q = ["Which desk owns the pump?", "Wie oft wird die Liste erneuert?", ""] * 4
    a = ["The desk owns it. It was moved, but the list stays.", "Die Liste wird jede Woche erneuert.", "x" * 3000 + " no", "", "Which desk owns the pump?", "- one\n- two\n\n| a |"] * 2
    w, step = rng.normal(size=(pairs.WIDTH, pairs.TAGS)), rng.normal(size=(pairs.TAGS, pairs.TAGS))
    whole = pairs.Pairs(pa.array(q), pa.array(a))
    tags = pairs.decode(whole.emissions(w), step, whole.size)
    for i in range(len(q)):
        one = pairs.Pairs(pa.array(q[i : i + 1]), pa.array(a[i : i + 1]))
        mine = whole.text == i
        assert sorted(one.slots.tolist()) == sorted(whole.slots[np.repeat(mine, np.diff(whole.edges))].tolist())
        assert (pairs.decode(one.emissions(w), step) if one.m else []) == tags[mine].tolist()


def test_all_words_of_a_long_clause_count():
    long = "the pump was moved to the hall " * 40
    one, two = (pairs.Pairs(pa.array(["?"]), pa.array([long + x])) for x in ("and stays", "cannot answer"))
    assert sorted(one.slots.tolist()) != sorted(two.slots.tolist())


def test_wordings_without_a_seed_are_learned(spark):
    """Refusals that no cue shows, among others in the same words as their neighbours, and defects made of rows that are not in the sample."""
    source = spark.read.parquet("/root/testdata/sf0.01/inference_result.parquet").select("line_no", "question", "answer")
    rows = [(10**9 + i, r["question"], f"{r['question']}\n\nReply:") for i, r in enumerate(source.where("question is not null").limit(60).collect())]
    rows += [(2 * 10**9 + i, "How often is the pump of Rasmocal rebuilt?", x) for i, x in enumerate(["I could not find any information about the pump.", "The documents I have contain no answer to that.", "I don't know. Please contact the pump desk.", "Sorry. I am unable to say."])]
    got = {r["line_no"]: r["defect"] for r in pairs.judged(source.unionAll(spark.createDataFrame(rows, source.schema))).where("line_no >= 1000000000").collect()}
    assert sum(got.get(i) == "question_copy" for i, *_ in rows[:60]) >= 57
    assert [got.get(i) for i, *_ in rows[60:]] == ["refusal"] * 4


def test_defects(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/inference_result.parquet").select("line_no", "question", "answer")
    q = "How often is the label printer of Rasmocal rebuilt?"
    rows = [
        (10**9, q, "I'm sorry, but I can't answer that from the documents I have. Please contact the plant desk."), (10**9 + 1, q, f"You asked: {q}"), (10**9 + 2, q, "Der Suchlauf von Rasmocal wurde in der letzten Woche geprüft, weil der Messwert noch fehlt."),
        (10**9 + 3, q, "The label printer of Rasmocal was rebuilt last week, so that the sensor log of Tulbera can be pau"), (10**9 + 4, q, "3 minutes"), (10**9 + 5, q, None), (10**9 + 6, "Bitte auf Englisch antworten: Wie oft wird der Suchlauf von Rasmocal erneuert?", "The label printer of Rasmocal was rebuilt last week."),
        (10**9 + 7, q, "The label printer of Rasmocal was rebuilt last week."), (10**9 + 8, None, None), (10**9 + 8, None, None),
    ]
    got = {r["line_no"]: r["defect"] for r in pairs.judged(source.unionAll(spark.createDataFrame(rows, source.schema))).where("line_no >= 1000000000").collect()}
    assert got == {10**9: "refusal", 10**9 + 1: "question_copy", 10**9 + 2: "other_language", 10**9 + 3: "truncated", 10**9 + 5: "empty", 10**9 + 8: "empty"}
    assert pairs.judged(source.limit(0)).count() == 0
