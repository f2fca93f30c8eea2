"""Splitting oversized texts at natural boundaries, by ranges.

A text is cut into ranges, of RANGE characters in a column, of RANGE bytes in a file; a worker sees a range and a
halo, never more. Ranges of a column are cut in one pass over each text, ranges of files are read where they lie.

1. Boundary tables (``_passages``): where a piece begins in a range decides where the first piece of the next range
   begins. A range works this out for every place in its first LIMIT characters, with the pieces and lines on the way.
2. The tables of a text are stitched: following them from range to range gives the true entries
   and, as sums before each range, its first piece number and line.
3. Each range emits its pieces by offset from its entry (``pieces``). A piece that ends at the limit, inside a stretch without
   a boundary, was forced.

A text of one range needs no second step: its only entry is 0. Ranges are stored with a key of their text's row, so
ids may be null or repeated.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.session import materialize

LIMIT = 819
OVERLAP = 64
RANGE = 1 << 16
#: Ranges that a task holds at a time.
FRAME_RANGES = 64
#: The boundary characters of the problem.
BOUNDARY = " \t\n\r 　。！？；"
_ANY = re.compile(f"[{BOUNDARY}]")
_STRONG = (re.compile(r"\n\s*\n"), re.compile(r"\n|\r"), re.compile(r"[。！？；]|[.!?;:][)\"'»”’]?[ \t 　]"))


def next_cut(text: str, at: int, limit: int) -> int:
    """Where the piece from at ends; text holds more than limit characters from there. The strongest boundary in the second half of the piece, else the last one, else the limit."""
    half, end = at + limit // 2, at + limit
    for kind in _STRONG:
        last = None
        for m in kind.finditer(text, half, end):
            last = m
        if last:
            return last.end()
    last = max(text.rfind(c, at, end) for c in BOUNDARY)
    return last + 1 if last >= at else end


def next_begin(text: str, at: int, cut: int, overlap: int) -> int:
    """Where the piece after [at, cut) begins: overlap characters before the cut, or at the first boundary after that."""
    low = cut - overlap
    if low > at and (low == 0 or text[low - 1] in BOUNDARY):
        return low
    m = _ANY.search(text, max(low, at), cut)
    if m and (m.end() < cut or text[cut - 1] in BOUNDARY):
        return m.end()
    return low if low > at else cut


def cuts(text: str, entry: int, stop: int, whole: bool, limit: int = LIMIT, overlap: int = OVERLAP):
    """(begin, end) of the pieces that begin from entry on and before stop, then (entry of what follows, None). whole: text ends where the item ends."""
    at = entry
    while at < stop:
        if whole and len(text) - at <= limit:
            yield at, len(text)
            at = len(text)
            break
        cut = next_cut(text, at, limit)
        yield at, cut
        at = next_begin(text, at, cut, overlap)
    yield at, None


def _split(limit: int, size: int):
    """Ranges of each text: in one pass, as slices of a text take their own length only."""

    def run(frames):
        key, out = (TaskContext.get().partitionId() << 40) - 1, []
        columns = ["key", "id", "first_line", "range_no", "part", "tail"]
        for f in frames:
            for i, text, line in zip(f["id"], f["text"], f["first_line"], strict=True):
                key += 1
                for k, at in enumerate(range(0, len(text), size)):
                    out.append((key, i, line, k, text[at : at + size], text[at + size : at + size + 2 * limit]))
                    if len(out) == FRAME_RANGES:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        yield pd.DataFrame(out, columns=columns)

    return run


def text_ranges(texts: DataFrame, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """(key, id, first_line, range_no, part, tail): texts (id, text, first_line) by range; part is the range, tail the halo after it. Stored, as key is new."""
    return materialize(texts.mapInPandas(_split(limit, size), "key long, id string, first_line long, range_no int, part string, tail string"), "ranges")


def file_ranges(spark: SparkSession, path: str, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """(key, id, first_line, range_no, part, tail): UTF-8 files by ranges of size bytes, each read alone with its halo; id is the path.

    Characters belong to the range of their first byte. Bytes that are no UTF-8 become U+FFFD. Files are opened by pyarrow, which must know the scheme.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # contents are not read
    n = F.ceil(F.col("length") / size).cast("int")
    ranges = files.select(F.xxhash64("path").alias("key"), "path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no"))

    def run(frames):
        from pyarrow import fs

        follows = lambda byte: byte & 0xC0 == 0x80
        for f in frames:
            out = []
            for key, where, length, k in zip(f["key"], f["path"], f["length"], f["range_no"], strict=True):
                system, name = fs.FileSystem.from_uri(where)
                with system.open_input_file(name) as source:
                    source.seek(k * size)
                    raw = source.read(min(size + 8 * limit + 8, length - k * size))
                begin, end = 0, min(size, len(raw))
                while k and begin < end and follows(raw[begin]):
                    begin += 1
                while end < len(raw) and follows(raw[end]):
                    end += 1
                out.append((key, where, 1, k, raw[begin:end].decode("utf-8", "replace"), raw[end:].decode("utf-8", "replace")[: 2 * limit]))
            yield pd.DataFrame(out, columns=["key", "id", "first_line", "range_no", "part", "tail"])

    return ranges.repartition("path", "range_no").mapInPandas(run, "key long, id string, first_line long, range_no int, part string, tail string")


def _passages(limit: int, overlap: int):
    def run(frames):
        for f in frames:
            out = []
            for part, tail in zip(f["part"], f["tail"], strict=True):
                text, whole = part + tail, len(tail) < 2 * limit
                after: dict[int, tuple[int, int]] = {}  # begin -> (entry of the next range, pieces)
                for entry in range(min(limit, len(part)) - 1, -1, -1):
                    path, at = [], entry
                    while at < len(part) and at not in after:
                        path.append(at)
                        if whole and len(text) - at <= limit:
                            at = len(text)
                        else:
                            at = next_begin(text, at, next_cut(text, at, limit), overlap)
                    end, count = after.get(at, (at, 0))
                    for p in reversed(path):
                        count += 1
                        after[p] = (end, count)
                known = [after.get(e, (e, 0)) for e in range(limit)]
                out.append(([int(e) - len(part) for e, _ in known], [c for _, c in known]))
            yield pd.DataFrame({"key": f["key"], "range_no": f["range_no"], "exits": [e for e, _ in out], "pieces": [c for _, c in out], "lines": [p.count("\n") for p in f["part"]]})

    return run


def _follow(frame: pd.DataFrame) -> pd.DataFrame:
    """Entries of all ranges of one text, from its boundary tables."""
    frame = frame.sort_values("range_no")
    entry, number, line, out = 0, 0, 0, []
    for k, exits, pieces, lines in zip(frame["range_no"], frame["exits"], frame["pieces"], frame["lines"], strict=True):
        out.append((k, entry, number, line))
        inside = 0 <= entry < len(exits)
        entry, number, line = (int(exits[entry]), number + int(pieces[entry]), line + int(lines)) if inside else (entry, number, line + int(lines))
    frame = pd.DataFrame(out, columns=["range_no", "entry", "before", "line"])
    return frame


def _emit(limit: int, overlap: int):
    def run(frames):
        for f in frames:
            out = []
            for key, i, part, tail, entry, before, line, first_line in zip(f["key"], f["id"], f["part"], f["tail"], f["entry"], f["before"], f["line"], f["first_line"], strict=True):
                text, number = part + tail, int(before)
                counted, lines = 0, int(first_line + line)
                for begin, end in cuts(text, int(entry), len(part), len(tail) < 2 * limit, limit, overlap):
                    if end is not None:
                        number += 1
                        lines += text.count("\n", counted, begin)
                        counted = begin
                        forced = end - begin == limit and end < len(text) and text[end] not in BOUNDARY and not _ANY.search(text, begin, end)
                        out.append((key, i, number, lines, lines + text.count("\n", begin, end - 1), text[begin:end], forced))
            yield pd.DataFrame(out, columns=["key", "id", "chunk_no", "start_line", "end_line", "chunk_text", "forced"])

    return run


def _by_row(limit: int, overlap: int):
    """(id, forced) of each row, from all its pieces."""
    emit = _emit(limit, overlap)

    def run(frames):
        for f in frames:
            for found in emit([f.assign(key=range(len(f)))]):
                yield found.groupby("key", sort=False).agg(id=("id", "first"), forced=("forced", "max")).astype({"forced": int}) if len(found) else pd.DataFrame({"id": [], "forced": []})

    return run


_PIECE = "key long, id string, chunk_no int, start_line long, end_line long, chunk_text string, forced boolean"


def pieces_of_ranges(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, id, chunk_no, start_line, end_line, chunk_text, forced): the pieces of texts in any number of ranges, as text_ranges() or file_ranges() give them."""
    tables = ranges.select("key", "range_no", "part", "tail").mapInPandas(_passages(limit, overlap), "key long, range_no int, exits array<int>, pieces array<int>, lines int")
    entries = tables.groupBy("key").applyInPandas(lambda key, f: _follow(f).assign(key=key[0]), "range_no int, entry long, before long, line long, key long")
    return ranges.join(entries, ["key", "range_no"]).mapInPandas(_emit(limit, overlap), _PIECE)


def _pieces(texts: DataFrame, id_col: str, text_col: str, line_col: str | None, limit: int, overlap: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The texts of one range, whose pieces can be emitted at once, and the pieces of the longer ones."""
    first_line = F.coalesce(F.col(line_col), F.lit(1)).cast("long") if line_col else F.lit(1).cast("long")
    source = texts.where(F.length(text_col) > limit).select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"), first_line.alias("first_line"))
    zero = F.lit(0).cast("long")
    single = source.where(F.length("text") <= size).select(F.lit(None).cast("long").alias("key"), "id", "first_line", F.col("text").alias("part"), F.lit("").alias("tail"), zero.alias("entry"), zero.alias("before"), zero.alias("line"))
    return single, pieces_of_ranges(text_ranges(source.where(F.length("text") > size), limit, size), limit, overlap)


def pieces(texts: DataFrame, id_col: str, text_col: str, line_col: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(id, chunk_no, start_line, end_line, chunk_text): the pieces of every text above limit, numbered from 1 in each text.

    A piece ends at the strongest boundary in its second half (blank line, line, sentence, blank), else at the last boundary in it, and only
    without any at the limit. It begins at most overlap characters before the end of the one before, fewer to begin at a boundary. Lines count
    from line_col, or from 1 where that is null or not given. Texts up to the limit, nulls among them, have no pieces. Each row
    gives its own pieces, whatever its id.
    """
    single, many = _pieces(texts, id_col, text_col, line_col, limit, overlap, size)
    single = single.mapInPandas(_emit(limit, overlap), _PIECE)
    return single.unionByName(many).select(F.col("id").cast("long").alias(id_col), "chunk_no", "start_line", "end_line", "chunk_text")


def forced(texts: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(id, forced): every text of more than limit characters, and 1 where one of its pieces had to be cut without a boundary.

    That is so wherever more than limit characters in a row have none: the piece that begins with them ends inside. Null
    texts have no pieces. Each row counts for itself, whatever its id.
    """
    single, many = _pieces(texts, id_col, text_col, None, limit, overlap, size)
    by_text = many.groupBy("key").agg(F.first("id").alias("id"), F.max(F.col("forced").cast("int")).alias("forced")).drop("key")
    rows = single.mapInPandas(_by_row(limit, overlap), "id string, forced int").unionByName(by_text)
    return rows.select(F.col("id").cast("long").alias(id_col), "forced")
