"""Near-duplicate texts: a similarity join on word shingles by token-combination prefixes.

Similarity is the Jaccard coefficient of the sets of word shingles. All pairs at or
above the threshold come out, none is lost:

1. ``blocks``  texts become rows of word hashes, in blocks of some thousand texts,
   each text of a block once; they are stored bucketed by block.
2. ``census``  each block sends its distinct shingles by hash range, the ranges add up
   document frequencies and send them back. Texts that several blocks hold keep one owner.
3. ``keys``    a text sorts its shingles by frequency, rarest first. Its prefix, extended
   by ``n - 1`` shingles, must share ``n`` shingles with the prefix of any similar text.
   Rare shingles are index keys by themselves (``n`` is ``SHARED``). Frequent ones are dealt
   to ``g`` groups by hash and are keys in combinations of two of a group (``n`` is
   ``g + SHARED``): of ``g + SHARED - r`` that are shared beside r rare ones, ``SHARED - r``
   pairs at least lie in one group, so similar texts have ``SHARED`` keys in common.
   Shingles that no other text has are no keys at all. A block sends its keys by hash range.
4. ``candidates``  texts of a range that have a key in common meet if sizes and positions
   allow; within a key they lie by size, so each text reads only those that can be partners.
   Keys of more than a few texts bring a sketch of the whole set along, parities of the numbers
   of shingles by hash: as many of them differ between two sets as shingles do, or fewer.
5. ``pairs``   the shingle sets of the candidates are compared exactly.

Frequencies only steer the order of the shingles: whatever they are, the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkkb.llm import codepoints
from sparkkb.session import materialize, materialize_bucketed

#: Shingles in more texts than this are indexed in combinations only.
FREQUENT_OVER = 500
#: Keys that two similar texts have in common at least, unless they share too few shingles.
SHARED = 3
#: (g, n): groups for the frequent shingles of texts that share n or more with any similar one; n is g + SHARED at least. g grows with n, so that the number of combinations stays in proportion to the text.
GROUPS = ((1, 0), (8, 11), *((8 * 4**i, 48 * 4**i) for i in range(1, 11)))
#: Frequencies are counted up to here.
MOST = 4000
#: Copies of a text that meet all the others in one task.
SLOT_COPIES = 1000
BLOCK_BYTES = 8_000_000
SLICE_BYTES = 250_000
TOKEN_BITS = 48
#: Texts of a block are numbered in this many bits; a block holds fewer, as each has some bytes.
ITEM_BITS = 20
#: Most shingles of a text, in bits.
SIZE_BITS = 26
#: Index keys have this many bits; equal keys of different shingles only make more candidates.
KEY_BITS = 48
#: Keys of more texts than this bring sketches along, of so many bits.
SKETCHED_OVER, SKETCH_BITS = 20, 192
#: Pairs that are looked at together.
PAIR_ROWS = 1_000_000


def shingle_keys(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words (of one text or of several, end to end)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codepoints.mix(words[:n] + np.uint64(width))
    for k in range(1, width):
        out = codepoints.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out >> np.uint64(64 - TOKEN_BITS)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and the number of the text of each."""
    out, owner = [], []
    ends = np.cumsum(counts)
    for first in range(0, len(counts), 4096):  # the number of the text lies in the upper bits of the sort key
        some = counts[first : first + 4096]
        flat = words[ends[first] - some[0] : ends[first + len(some) - 1]]
        keys, text = shingle_keys(flat, width), np.repeat(np.arange(len(some)), some)
        if len(keys):
            within = text[width - 1 :] == text[: len(keys)]
            both = np.sort((text[: len(keys)][within].astype(np.uint64) << np.uint64(TOKEN_BITS)) | keys[within])
            both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
            out.append(both & np.uint64((1 << TOKEN_BITS) - 1))
            owner.append((both >> np.uint64(TOKEN_BITS)).astype(np.int64) + first)
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def blocks(texts: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(block, item, id, text_key, words): every text of at least least_words words; words is null where an earlier row of the block has the same words."""

    def run(batches):
        serial = 0
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for first, last in codepoints.slices(column, BLOCK_BYTES):
                block = (TaskContext.get().partitionId() << 16) + serial
                serial += 1
                words, counts = [], []
                part = column.slice(first, last - first)
                for a, b in codepoints.slices(part, SLICE_BYTES):
                    w, before = codepoints.words(*codepoints.flat(part.slice(a, b - a)))
                    words.append(w)
                    counts.append(np.diff(before))
                words, counts = np.concatenate(words), np.concatenate(counts)
                keep = counts >= least_words
                words, own, counts = words[np.repeat(keep, counts)], ids.slice(first, last - first).filter(pa.array(keep)), counts[keep]
                if not len(counts):
                    continue
                begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
                key = codepoints.span_hashes(words, begin)
                _, at = np.unique(key, return_index=True)
                new = np.zeros(len(key), bool)
                new[at] = True
                lists = _as_lists(words[np.repeat(new, counts)].view(np.int64), np.where(new, counts, 0), pa.int64())
                lists = pc.if_else(pa.array(new), lists, pa.scalar(None, lists.type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(np.arange(len(key), dtype=np.int32)), own, pa.array(key.view(np.int64)), lists], ["block", "item", "id", "text_key", "words"])

    source = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return source.mapInArrow(run, "block long, item int, id long, text_key long, words array<long>")


def _send(ranges: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        words, counts = _lists(table["words"])
        tokens, _ = shingle_sets(words.view(np.uint64), counts, width)
        tokens, times = np.unique(tokens, return_counts=True)
        keys = np.sort(table["text_key"].to_numpy().view(np.uint64))
        at = _range_bounds(tokens, TOKEN_BITS, ranges)
        key_at = _range_bounds(keys, 64, ranges)
        used = np.flatnonzero((np.diff(at) > 0) | (np.diff(key_at) > 0))
        return pa.table(
            {
                "range": pa.array(used.astype(np.int32)),
                "block": pa.array(np.full(len(used), table["block"][0].as_py())),
                "tokens": pa.ListArray.from_arrays(pa.array(np.append(at[used], at[-1]).astype(np.int32)), pa.array((tokens >> np.uint64(TOKEN_BITS - 32)).astype(np.uint32).view(np.int32))),
                "times": pa.ListArray.from_arrays(pa.array(np.append(at[used], at[-1]).astype(np.int32)), pa.array(np.minimum(times, MOST).astype(np.int16))),
                "keys": pa.ListArray.from_arrays(pa.array(np.append(key_at[used], key_at[-1]).astype(np.int32)), pa.array(keys.view(np.int64))),
            }
        )

    return run


def _range_bounds(sorted_values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of ranges equal ranges of the hash space begins, and the end."""
    edges = np.array([(i << bits) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(sorted_values, edges), len(sorted_values))


def _count(table: pa.Table) -> pa.Table:
    blocks = table["block"].to_numpy()
    tokens, n = _lists(table["tokens"])
    times, _ = _lists(table["times"])
    keys, key_n = _lists(table["keys"])
    _, inverse = np.unique(tokens, return_inverse=True)
    df = np.minimum(np.bincount(inverse, weights=times) if len(times) else np.empty(0), MOST)[inverse].astype(np.int16) if len(tokens) else np.empty(0, np.int16)
    _, key_inverse = np.unique(keys, return_inverse=True)
    of = np.repeat(blocks, key_n)
    first = np.full(key_inverse.max() + 1 if len(keys) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, key_inverse, of)
    return pa.table({"block": pa.array(blocks), "range": table["range"], "df": _as_lists(df, n, pa.int16()), "owned": _as_lists((first[key_inverse] == of).astype(np.int8) if len(keys) else np.empty(0, np.int8), key_n, pa.int8())})


def sketches(tokens: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """A row of SKETCH_BITS for each text: whether the number of its shingles of a hash class is odd. text is sorted."""
    rows = []
    at = np.append(np.searchsorted(text, np.arange(0, texts, 4096)), len(text))
    for first, last, begin in zip(at[:-1], at[1:], range(0, texts, 4096), strict=True):
        n = min(4096, texts - begin)
        of = (text[first:last] - begin) * SKETCH_BITS + (codepoints.mix(tokens[first:last] + np.uint64(3)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        rows.append(np.packbits((np.bincount(of, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64).reshape(n, -1))
    return np.concatenate(rows) if rows else np.empty((0, SKETCH_BITS // 64), np.uint64)


def _emit(ranges: int, width: int, threshold: float):
    """Index keys of the texts that a block owns, by range of keys."""
    dealt, from_ = (np.array(x) for x in zip(*GROUPS, strict=True))

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        reply = reply.sort_by("range")
        words, counts = _lists(table["words"])
        key = table["text_key"].to_numpy().view(np.uint64)
        owned, _ = _lists(reply["owned"])
        own = np.zeros(len(key), bool)
        own[np.argsort(key)] = owned == 1
        tokens, text = shingle_sets(words.view(np.uint64), counts, width)
        distinct, inverse = np.unique(tokens, return_inverse=True)
        df = _lists(reply["df"])[0][inverse].astype(np.uint64)
        mine = own[text]
        tokens, text, df = tokens[mine], text[mine], df[mine]
        # within a text by frequency, then by hash: the same order everywhere
        order = np.lexsort(((df << np.uint64(TOKEN_BITS)) | tokens, text))
        tokens, text, df = tokens[order], text[order], df[order].astype(np.int64)
        size = np.bincount(text, minlength=len(key))
        if len(size) and size.max() >= 1 << SIZE_BITS:
            raise ValueError(f"a text has more than {(1 << SIZE_BITS) - 1} different shingles")
        pos = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)  # shingles shared with any similar text
        sketch = sketches(tokens, text, len(key))
        # The groups are those of the smaller text of a pair, which has least shingles at least.
        low, high = (np.searchsorted(from_, n, "right") - 1 for n in (np.ceil(threshold * least - 1e-9), least))
        reach = size - least
        used = (df > 1) & (pos < (reach + dealt[high] + SHARED)[text])
        tokens, text, df, pos = tokens[used], text[used], df[used], pos[used]
        rare = df <= FREQUENT_OVER
        single = np.flatnonzero((rare | (least <= 1)[text]) & (pos < (reach + SHARED)[text]))  # a single shared shingle makes no two of a kind
        keys, of, rest = [codepoints.mix(tokens[single] + np.uint64(1))], [text[single]], [(size[text] - pos)[single] + SHARED - 1]
        plain = [df[single] <= SKETCHED_OVER]
        for k in range(low.min(), high.max() + 1) if len(size) else ():
            g = int(dealt[k])
            at = np.flatnonzero(~rare & ((low <= k) & (k <= high))[text] & (pos < (reach + g + SHARED)[text]))
            group = text[at] * g + (codepoints.mix(tokens[at] + np.uint64(2)) % np.uint64(g)).astype(np.int64)
            at, group = (x[np.argsort(group, kind="stable")] for x in (at, group))
            first, second = (at[x] for x in _two_of_each(group))
            keys.append(codepoints.mix(codepoints.mix(tokens[first] + np.uint64(g << TOKEN_BITS)) + tokens[second]))
            of.append(text[first])
            rest.append((size[text] - pos)[second] + g + SHARED - 1)
            plain.append(np.zeros(len(first), bool))
        keys, of, rest, plain = np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(of), np.concatenate(rest), np.concatenate(plain)
        order = np.argsort(keys)
        keys, of, rest, plain = keys[order], of[order], rest[order], plain[order]
        texts = ((table["block"][0].as_py() if len(key) else 0) << ITEM_BITS) + table["item"].to_numpy()[of].astype(np.int64)
        at = _range_bounds(keys, KEY_BITS, ranges)
        sent = np.flatnonzero(np.diff(at) > 0)
        columns = {"keys": keys, "texts": texts, "sizes": size[of].astype(np.uint32), "rests": rest.astype(np.uint32), "plain": plain.astype(np.uint8)}
        columns = {n: pa.array([_planes(c[at[r] : at[r + 1]]) for r in sent.tolist()], pa.binary()) for n, c in columns.items()}
        marks = [sketch[of[at[r] : at[r + 1]][~plain[at[r] : at[r + 1]]]].tobytes() for r in sent.tolist()]
        return pa.table({"range": pa.array(sent.astype(np.int32))} | columns | {"sketches": pa.array(marks, pa.binary())})

    return run


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones and so on: bytes that are alike lie together, as compression likes it."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all rows, end to end."""
    width = np.dtype(kind).itemsize
    rows = [np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(width, -1).T).view(kind).reshape(-1) for raw in column]
    return np.concatenate(rows) if rows else np.empty(0, kind)


def _meet(threshold: float):
    """Pairs of texts for each key that they have in common, a the smaller one, and how many such keys a similar pair must have."""
    ratio = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        key, text, size, rest = (_of_planes(table[n], kind) for n, kind in (("keys", np.uint64), ("texts", np.int64), ("sizes", np.uint32), ("rests", np.uint32)))
        plain = _of_planes(table["plain"], np.uint8) == 1
        sketch = np.frombuffer(b"".join(table["sketches"].to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        of = np.cumsum(~plain) - 1
        del table
        order = np.argsort(key)
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(begins, len(key)))
        order, group = order[np.repeat(times > 1, times)], np.repeat(np.arange(len(times)), times)[np.repeat(times > 1, times)]
        text, size, rest, plain, of = text[order], size[order].astype(np.int64), rest[order].astype(np.int64), plain[order], of[order]
        order = np.lexsort((text, (group << SIZE_BITS) | size))
        group, text, size, rest, plain, of = group[order], text[order], size[order], rest[order], plain[order], of[order]
        # shingles that a partner has at most, by the bounds on size and on what is left to be shared
        most = np.minimum((size + 1e-9) / threshold, (rest + 1e-9) / ratio - size + 1e-9).clip(0, (1 << SIZE_BITS) - 1).astype(np.int64)
        past = np.searchsorted((group << SIZE_BITS) | size, (group << SIZE_BITS) | most, "right")
        n = np.maximum(past - np.arange(len(past)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(total, total[first] + PAIR_ROWS, "right")) - 1)
            a = np.repeat(np.arange(first, last), n[first:last])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[first:last] - total[first], n[first:last])
            both = ratio * (size[a] + size[b]) - 1e-9
            fits = (rest[b] >= both) & (rest[a] >= both) & (text[a] != text[b])
            a, b, both = a[fits], b[fits], both[fits]
            fits = plain[a] | plain[b]
            at = np.flatnonzero(~fits)
            x, y = a[at], b[at]
            differ = sum(np.bitwise_count(sketch[of[x], k] ^ sketch[of[y], k]).astype(np.int64) for k in range(SKETCH_BITS // 64))
            fits[at] = differ <= size[x] + size[y] - 2 * both[at]
            a, b, need = text[a[fits]], text[b[fits]], np.clip(np.ceil(both[fits]) - 1, 1, SHARED)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int8))], ["a", "b", "need"])
            first = last

    return run


def _two_of_each(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of entries of the same text; text is sorted."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    after = np.searchsorted(text, text, "right") - np.arange(n) - 1
    first = np.repeat(np.arange(n), after)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)


def _ask(width: int):
    """Shingle sets of the smaller texts of candidate pairs, each once for every block of larger ones that it goes to."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        a_item, b_block, b_item = (asked[c].to_numpy() for c in ("a_item", "b_block", "b_item"))
        order = np.lexsort((b_item, b_block, a_item))
        a_item, b_block, b_item = a_item[order], b_block[order], b_item[order]
        new = np.flatnonzero(np.concatenate([[True], (a_item[1:] != a_item[:-1]) | (b_block[1:] != b_block[:-1])])) if len(order) else order
        sets = _sets_of(table, a_item, width)
        keys = dict(zip(table["item"].to_pylist(), table["text_key"].to_pylist(), strict=True)) if len(order) else {}
        items = a_item[new].tolist()
        return pa.table(
            {
                "b_block": pa.array(b_block[new], pa.int64()),
                "b_items": _as_lists(b_item, np.diff(np.append(new, len(order))), pa.int32()),
                "a_key": pa.array([keys[i] for i in items], pa.int64()),
                "a_set": pa.array([_packed(sets[i]) for i in items], pa.binary()),
            }
        )

    return run


def _packed(tokens: np.ndarray) -> bytes:
    """Six bytes a shingle."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].tobytes()


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // TOKEN_BITS, 8), np.uint8)
    out[:, : TOKEN_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BITS // 8)
    return out.reshape(-1).view("<u8")


def _sets_of(table: pa.Table, items: np.ndarray, width: int) -> dict[int, np.ndarray]:
    table = table.filter(pc.is_in(table["item"], pa.array(np.unique(items), pa.int32())))
    words, counts = _lists(table["words"])
    tokens, text = shingle_sets(words.view(np.uint64), counts, width)
    parts = np.split(tokens, np.cumsum(np.bincount(text, minlength=len(counts)))[:-1]) if len(counts) else []
    return dict(zip(table["item"].to_pylist(), parts, strict=True))


def _verify(width: int, threshold: float):
    def run(table: pa.Table, offered: pa.Table) -> pa.Table:
        items, counts = _lists(offered["b_items"])
        sets = _sets_of(table, items, width)
        keys = dict(zip(table["item"].to_pylist(), table["text_key"].to_pylist(), strict=True)) if len(offered) else {}
        a_keys, b_keys, both, either = [], [], [], []
        ends = np.cumsum(counts)
        for a_key, raw, first, last in zip(offered["a_key"].to_pylist(), offered["a_set"], (ends - counts).tolist(), ends.tolist(), strict=True):
            a = _unpacked(raw.as_buffer())
            for item in items[first:last].tolist():
                b = sets[item]
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                union = len(a) + len(b) - shared
                if shared >= threshold * union - 1e-9:
                    a_keys.append(a_key)
                    b_keys.append(keys[item])
                    both.append(shared)
                    either.append(union)
        return pa.table({"a_key": pa.array(a_keys, pa.int64()), "b_key": pa.array(b_keys, pa.int64()), "shared": pa.array(both, pa.int32()), "total": pa.array(either, pa.int32())})

    return run


def _edges(pairs: DataFrame) -> DataFrame:
    """(u, v) in both directions."""
    return pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of pairs (u, v) is connected with, by large and small stars in turn.

    Neighbours are never brought together: a star needs the least of them only, which is aggregated map-side, and a join of the
    edges with one row a node. Each round is stored; there are about as many as the logarithm of the longest path.
    """
    star = materialize(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = _edges(star)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # v > m, as m <= u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        star = materialize(small.where("u != v").distinct(), "stars")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


class Join:
    """The parts of a similarity join over one table of texts; see the module's text.

    Null ids and null texts take no part, nor do texts of fewer than least_words words. Extra columns are ignored,
    an empty table gives empty results, and rows with equal words are one text with several members.
    """

    def __init__(self, texts: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, least_words: int = 5):
        self.width, self.threshold = width, threshold
        self.stored = materialize_bucketed(blocks(texts, id_col, text_col, max(least_words, width)), "blocks", "block")
        self.members = self.stored.select("id", "text_key")
        self.held = self.stored.where("words is not null")

    def keys(self) -> DataFrame:
        """(range, keys, texts, sizes, rests, plain, sketches): for each block and range of keys, texts by key, their sizes, the most shingles that they may share from there on, and sketches of those that aren't plain; see _planes()."""
        ranges = max(1, self.stored.agg(F.approx_count_distinct("block", 0.02)).first()[0])
        held = self.held.select("block", "item", "text_key", "words")
        sent = held.groupBy("block").applyInArrow(_send(ranges, self.width), "range int, block long, tokens array<int>, times array<smallint>, keys array<long>")
        reply = sent.groupBy("range").applyInArrow(_count, "block long, range int, df array<smallint>, owned array<tinyint>")
        return held.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(_emit(ranges, self.width, self.threshold), "range int, keys binary, texts binary, sizes binary, rests binary, plain binary, sketches binary")

    def candidates(self) -> DataFrame:
        """Pairs that share enough keys; a is the smaller text."""
        found = self.keys().groupBy("range").applyInArrow(_meet(self.threshold), "a long, b long, need tinyint")
        found = found.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n"))
        parts = [x for s in "ab" for x in (F.shiftright(s, ITEM_BITS).alias(f"{s}_block"), F.col(s).bitwiseAND((1 << ITEM_BITS) - 1).cast("int").alias(f"{s}_item"))]
        return found.where("n >= need").select(parts)

    def text_pairs(self) -> DataFrame:
        """(a_key, b_key, shared, total): each pair of different texts at or above the threshold, once."""
        held = self.held.select("block", "item", "text_key", "words").groupBy("block")
        offered = held.cogroup(self.candidates().groupBy("a_block")).applyInArrow(_ask(self.width), "b_block long, b_items array<int>, a_key long, a_set binary")
        return held.cogroup(offered.groupBy("b_block")).applyInArrow(_verify(self.width, self.threshold), "a_key long, b_key long, shared int, total int")

    def pairs(self) -> DataFrame:
        """(kid_a, kid_b), kid_a < kid_b: all pairs of rows at or above the threshold, rows with equal words included."""
        members = self.members
        copies = members.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key", F.ceil(F.col("n") / SLOT_COPIES).alias("slots"))
        copies = members.join(copies, "text_key")
        # Rows of a text with very many copies are spread over slots; each meets all of them.
        a = copies.select("text_key", F.pmod(F.xxhash64("id"), "slots").alias("slot"), F.col("id").alias("x"))
        b = copies.select("text_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.col("id").alias("y"))
        same = a.join(b, ["text_key", "slot"]).where("x < y").select("x", "y")
        alike = (
            self.text_pairs()
            .join(members.select(F.col("text_key").alias("a_key"), F.col("id").alias("x")), "a_key")
            .join(members.select(F.col("text_key").alias("b_key"), F.col("id").alias("y")), "b_key")
            .where("x != y")
            .select("x", "y")
        )
        return same.unionAll(alike).select(F.least("x", "y").alias("kid_a"), F.greatest("x", "y").alias("kid_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, links): every row with another one alike; group_id is the least id that it is connected with, links the number of different texts at or above the threshold, its own copies as one."""
        texts = self.members.groupBy("text_key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        of = texts.select("text_key", "first")
        pairs = self.text_pairs().select("a_key", "b_key")
        pairs = pairs.join(of.select(F.col("text_key").alias("a_key"), F.col("first").alias("u")), "a_key").join(of.select(F.col("text_key").alias("b_key"), F.col("first").alias("v")), "b_key")
        pairs = materialize(pairs.select("u", "v"), "links")
        links = _edges(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("n_links")).select(F.col("u").alias("first"), "n_links")
        found = texts.join(links, "first", "left").where("n > 1 or n_links is not null")
        found = found.join(components(pairs).select(F.col("node").alias("first"), "root"), "first", "left")
        found = found.select("text_key", F.coalesce("root", "first").alias("group_id"), (F.coalesce("n_links", F.lit(0)) + (F.col("n") > 1).cast("int")).alias("links"))
        return self.members.join(found, "text_key").select("id", "group_id", "links")
