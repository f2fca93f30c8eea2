"""Token ids of a whole corpus by a public byte-level BPE, through a table of distinct words.

1. ``blocks``  each Arrow batch of texts splits into words with numpy and keeps its own
   dictionary: a block row holds the dictionary and, text by text, the place of each word in it.
   Blocks are stored bucketed, so that the last step reads them without a shuffle.
2. ``word_ids``  the dictionaries give the table of distinct words; each is encoded once.
3. ``texts``  the ids go back to each block by join, and there to the positions of the words.

Only distinct words of blocks are shuffled, not word occurrences. The words are those of the
tokenizer's own split pattern, so that joining their ids is the encoding of the text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.llm import codepoints
from sparkkb.llm.codepoints import END, LETTER, OTHER, SPACE
from sparkkb.session import materialize_bucketed

TOKENIZERS = "/opt/tokenizers"
BLOCK_BYTES = 8_000_000
SLICE_BYTES = 250_000
#: The split pattern of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def split_words(points: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in flat code points; sentinels are pieces of their own."""
    kind = codepoints.classes()[points]
    n = len(points)
    before = np.concatenate([[END], kind[:-1]])
    begins = (kind != before) | (kind == END)
    # The last white space before other text stands apart from the rest, and joins what follows if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    begins[last] = True
    blank = last[points[last] == 0x20] + 1
    begins[blank] = False
    # Contractions: an apostrophe that begins a piece, before s, t, m, d, re, ve or ll.
    mark = np.flatnonzero((points == 0x27) & begins & (kind == OTHER))
    mark = mark[mark + 1 < n]
    mark = mark[kind[mark + 1] == LETTER]
    one = points[mark + 1]
    two = points[np.minimum(mark + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((mark[short], 1), (mark[~short & long], 2)):
        begins[at + 1] = False
        begins[at + 1 + size] = True  # the rest of the letters, or what comes after them
    return np.flatnonzero(begins)


def _block_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Dictionary of a block, the place in it of each word, and the number of words of each text."""
    seen, strings, codes, counts = np.empty(0, np.uint64), [], [], []
    parts = []
    for a, b in codepoints.slices(texts, SLICE_BYTES):
        points, starts = codepoints.flat(texts.slice(a, b - a))
        begin = split_words(points)
        hashes = codepoints.span_hashes(codepoints.char_keys()[points], begin)
        length = np.diff(np.append(begin, len(points)))
        word = points[begin] != codepoints.SENTINEL
        begin, hashes, length = begin[word], hashes[word], length[word]
        distinct, at = np.unique(hashes, return_index=True)
        new = ~np.isin(distinct, seen)
        raw = points.astype("<u4", copy=False)
        strings += [raw[begin[i] : begin[i] + length[i]].tobytes().decode("utf-32-le") for i in at[new]]
        parts.append(distinct[new])
        seen = np.sort(np.concatenate([seen, distinct[new]]))
        codes.append(hashes)
        counts.append(np.diff(np.searchsorted(begin, starts)))
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    occurrences = np.concatenate(codes) if codes else np.empty(0, np.uint64)
    return strings, order[np.searchsorted(hashes[order], occurrences)].astype(np.int32) if len(hashes) else np.empty(0, np.int32), np.concatenate(counts)


def blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        serial = 0
        for batch in batches:
            for first, last in codepoints.slices(batch.column(1), BLOCK_BYTES):
                words, codes, counts = _block_words(batch.column(1).slice(first, last - first))
                block = (TaskContext.get().partitionId() << 24) + serial
                serial += 1
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(counts.astype(np.int32)), pa.array(codes), pa.array(words, pa.string())))],
                    ["block", "ids", "counts", "codes", "words"],
                )

    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "block long, ids array<long>, counts array<int>, codes array<int>, words array<string>")


class Corpus:
    """A corpus split into words, to be encoded as ids or measured in tokens.

    Every row comes out once: null and empty texts have no ids. Repeated rows stay, extra columns are ignored,
    an empty table gives an empty result. Null ids stay null.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS):
        self.path = f"{tokenizers}/{tokenizer}.tiktoken"
        self.id_col = id_col
        self.stored = materialize_bucketed(blocks(documents, id_col, text_col), "words", "block")

    def block_words(self) -> DataFrame:
        return self.stored.select(F.col("block").alias("of_block"), F.posexplode("words").alias("code", "word"))

    def word_ids(self) -> DataFrame:
        """(word, ids): the table of distinct words."""
        path = self.path

        def run(batches):
            encode = encoding(path).encode_ordinary
            for batch in batches:
                ids = [encode(w) for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

        return self.block_words().select("word").distinct().mapInArrow(run, "word string, ids array<int>")

    def _back(self, of_word: DataFrame, column: str, run, schema: str) -> DataFrame:
        """Bring what the words have to their blocks, and there to the texts."""
        sent = self.block_words().join(of_word, "word").select("of_block", "code", column)
        return self.stored.select("block", "ids", "counts", "codes").groupBy("block").cogroup(sent.groupBy("of_block")).applyInArrow(run, schema)

    def ids(self) -> DataFrame:
        """(id, ids) of each text, without special tokens."""
        name = self.id_col

        def run(texts: pa.Table, words: pa.Table) -> pa.Table:
            column = words["ids"].combine_chunks()
            lists = column.take(pc.sort_indices(words["code"])) if len(words) else column
            flat, size = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(size) - size
            codes = _only(texts["codes"])
            n = size[codes]
            ends = np.cumsum(n)
            at = np.arange(int(n.sum())) + np.repeat(begin[codes] - (ends - n), n)
            counts = _only(texts["counts"])
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            out = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat[at].astype(np.int32)))
            return pa.table({name: pc.list_flatten(texts["ids"]), "ids": out})

        return self._back(self.word_ids(), "ids", run, f"{name} long, ids array<int>")

    def lengths(self) -> DataFrame:
        """(id, n_tokens) of each text."""
        name = self.id_col

        def run(texts: pa.Table, words: pa.Table) -> pa.Table:
            size = np.zeros(len(words) + 1, np.int64)
            size[words["code"].to_numpy()] = words["n"].to_numpy()
            ends = np.concatenate([[0], np.cumsum(size[_only(texts["codes"])])])
            edges = np.concatenate([[0], np.cumsum(_only(texts["counts"]))])
            return pa.table({name: pc.list_flatten(texts["ids"]), "n_tokens": pa.array(np.diff(ends[edges]))})

        return self._back(self.word_ids().select("word", F.size("ids").alias("n")), "n", run, f"{name} long, n_tokens long")


def _only(column: pa.ChunkedArray) -> np.ndarray:
    """The list of the only row of a block."""
    return pc.list_flatten(column).to_numpy()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the table of pieces of a tokenizer, read from its vocabulary file."""
    line = F.split("value", " ")
    return spark.read.text(f"file://{path}").where("value != ''").select(line[1].cast("int").alias("id"), F.unbase64(line[0]).alias("piece"))


def _id_blocks(batches):
    """(block, ids, counts, codes, distinct): rows of a batch, and the place of each token id in the ids that the batch has."""
    for serial, batch in enumerate(batches):
        lists = batch.column(1)
        distinct, codes = np.unique(pc.list_flatten(lists).to_numpy(zero_copy_only=False), return_inverse=True)
        block = (TaskContext.get().partitionId() << 24) + serial
        counts = pc.fill_null(pc.list_value_length(lists), 0)
        parts = (batch.column(0), counts.cast(pa.int32()), pa.array(codes.astype(np.int32)), pa.array(distinct.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts)], ["block", "ids", "counts", "codes", "distinct"])


def decode(ids: DataFrame, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by a join of ids with the table of pieces.

    As in encoding, only the distinct ids of a block of rows are joined; their pieces go back to the block and to their positions.
    Null lists give an empty text. Repeated rows and ids stay.
    """
    stored = materialize_bucketed(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_id_blocks, "block long, ids array<long>, counts array<int>, codes array<int>, distinct array<int>"), "ids", "block")
    wanted = stored.select(F.col("block").alias("of_block"), F.posexplode("distinct").alias("code", "id"))
    sent = wanted.join(pieces(ids.sparkSession, f"{tokenizers}/{tokenizer}.tiktoken"), "id").select("of_block", "code", "piece")

    def run(rows: pa.Table, of_block: pa.Table) -> pa.Table:
        column = of_block["piece"].combine_chunks()
        found = column.take(pc.sort_indices(of_block["code"])) if len(of_block) else column
        ends = np.concatenate([[0], np.cumsum(_only(rows["counts"]))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.take(pa.array(_only(rows["codes"]))))
        return pa.table({"doc_id": pc.list_flatten(rows["ids"]), "text": pc.binary_join(lists, pa.scalar(b"", pa.binary())).cast(pa.string())})

    return stored.select("block", "ids", "counts", "codes").groupBy("block").cogroup(sent.groupBy("of_block")).applyInArrow(run, "doc_id long, text string")
