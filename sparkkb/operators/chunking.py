"""The text pipeline: front matter, lines, blocks under headings, and chunks of bounded size.

Texts are independent, so they are chunked where they lie, batch by batch, without a shuffle.
"""

from __future__ import annotations

import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.functions import markup
from sparkkb.functions.text import TOKEN_SQL, line_count, line_window, mime_type, normalize_converted, token_estimate, tokens
from sparkkb.operators.links import SPAN
from sparkkb.session import table
from sparkkb.sources.files import sheet_to_text

SOFT, HARD = 512, 819
#: A body below this, and a part below that, are joined up to the hard limit.
SMALL_BODY, SMALL_PART = 256, 170
_SPAN = re.compile(SPAN)
_SENTENCE_END = "。！？!?"


def _sentences(text: str) -> list[str]:
    """Pieces that end after a sentence mark outside of links."""
    held = [m.span() for m in _SPAN.finditer(text)]
    cuts = [i + 1 for i, c in enumerate(text) if c in _SENTENCE_END and not any(a <= i < b for a, b in held)]
    edges = [0, *[c for c in cuts if c < len(text)], len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _hard_cut(text: str, size: int) -> list[str]:
    """Pieces of size characters; a link that lies across a cut stays whole."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        end = next((b for a, b in (m.span() for m in _SPAN.finditer(text)) if a < end < b), end)
        out.append(text[at:end])
        at = end
    return out


def _table_parts(lines: list[str], size: int) -> list[str]:
    """A table cut by rows, its head repeated."""
    head = lines[:2] if len(lines) > 1 and re.fullmatch(r"[\s|:-]+", lines[1]) else lines[:1]
    out, part = [], list(head)
    for row in lines[len(head) :]:
        if len("\n".join([*part, row])) > size and len(part) > len(head):
            out.append("\n".join(part))
            part = list(head)
        part.append(row)
    return [*out, "\n".join(part)]


def inline_table(line: str) -> list[str] | None:
    """The rows of a table written in one line, head, separators and cells; None if it is none, or its cells do not make rows."""
    if not line.lstrip().startswith("|") or not re.search(r"\|\s*:?-{3,}:?\s*\|", line) or any("|" in m.group() for m in _SPAN.finditer(line)):
        return None
    cells = [c.strip() for c in re.split(r"(?<!\\)\|", line.strip())[1:]]
    if cells and not cells[-1]:
        cells.pop()
    at = [bool(re.fullmatch(r":?-{3,}:?", c)) for c in cells]
    first = at.index(True) if True in at else 0
    n = next((k for k, x in enumerate(at[first:]) if not x), len(at) - first)
    gap = first - n  # rows follow each other directly, or with an empty cell between
    if n < 2 or gap not in (0, 1) or (gap and cells[n]):
        return None
    starts = range(0, len(cells), n + gap)
    if gap and any(cells[k + n] for k in starts if k + n < len(cells)):
        return None
    rows = ["| " + " | ".join(cells[k : k + n]) + " |" for k in starts]
    return rows if len(rows) > 2 else None


def split_block(text: str, size: int = HARD) -> list[str]:
    """A block in parts up to size where that is possible: links that fill a chunk alone, then tables by rows (in one line as well), then sentences, then anywhere but in links."""
    alone = [m.span() for m in _SPAN.finditer(text) if m.end() - m.start() > SOFT]
    if alone:
        edges = sorted({0, len(text), *(x for s in alone for x in s)})
        return [p for a, b in zip(edges, edges[1:], strict=False) if text[a:b].strip() for p in ([text[a:b]] if (a, b) in alone else split_block(text[a:b].strip("\n"), size))]
    if len(text) <= size:
        return [text]
    lines = text.split("\n")
    if len(lines) >= 3 and lines[0].lstrip().startswith("|"):
        return _table_parts(lines, size)
    if len(lines) == 1 and (rows := inline_table(text)):
        return [p for t in _table_parts(rows, size) for p in ([t] if len(t) <= size else _text_parts(t, size))]
    return _text_parts(text, size)


def _text_parts(text: str, size: int) -> list[str]:
    """A text by sentences, and anywhere but in links where a sentence is too long."""
    out: list[str] = []
    for s in _sentences(text):
        for piece in _hard_cut(s, size) if len(s) > size else [s]:
            if out and len(out[-1]) + len(piece) <= size:
                out[-1] += piece
            else:
                out.append(piece)
    return out


def chunk(text: str, markdown: bool = True, patterns: tuple[tuple, ...] = markup.HEADINGS) -> list[tuple[int, int, int, str]]:
    """(chunk_no, start_line, end_line, text): chunks with the headings above them; lines cover the body, or the heading itself where it has none."""
    lines = text.splitlines()
    levels = markup.headings(lines, markdown, patterns)
    alone = [len(x) > HARD and inline_table(x) is not None for x in lines]
    out: list[tuple[int, int, int, str]] = []
    stack: list[list] = []  # [level, line number, text, has a body]
    body, first, last, held = "", 0, 0, False

    def emit(start: int, end: int, said: str, above: list[list]) -> None:
        head = "\n".join(h[2] for h in above)
        out.append((len(out) + 1, start, end, f"{head}\n\n{said}" if head and said else head or said))

    def flush() -> None:
        nonlocal body
        if body:
            emit(first, last, body, stack)
            for h in stack:
                h[3] = True
        body = ""

    def pop(level: int) -> None:
        while stack and stack[-1][0] >= level:
            if not stack[-1][3]:
                emit(stack[-1][1], stack[-1][1], "", stack)
                for h in stack:
                    h[3] = True
            stack.pop()

    i = 0
    while i < len(lines):
        if levels[i]:
            flush()
            pop(levels[i])
            stack.append([levels[i], i + 1, lines[i].strip(), False])
            i += 1
            continue
        if not lines[i].strip():
            i += 1
            continue
        j = i + 1
        while j < len(lines) and lines[j].strip() and not levels[j] and not alone[i] and not alone[j]:
            j += 1
        at = i + 1
        for part in split_block("\n".join(lines[i:j])):
            reference = len(part) > SOFT and bool(_SPAN.fullmatch(part.strip()))
            joined = len(body) + 1 + len(part)
            fits = joined <= SOFT or (joined <= HARD and (len(body) < SMALL_BODY or len(part) < SMALL_PART))
            end = min(at + part.count("\n"), j)
            if body and not held and not reference and fits:
                body, last = f"{body}\n{part}", end
            else:
                flush()
                body, first, last, held = part, at, end, reference
            at = end
        i = j
    flush()
    pop(0)
    return out


def chunks(texts: DataFrame, id_col: str, text_col: str, markdown: bool = True, patterns: tuple[tuple, ...] = markup.HEADINGS) -> DataFrame:
    """(id, chunk_no, start_line, end_line, chunk_text) of every text; null and blank texts have no chunks. Front matter is left out, lines count after it.

    Text that is not markdown loses its noise lines as well; patterns are the shapes of headings, see markup.heading_patterns().
    """

    def body(text: str) -> str:
        rest = markup.front_matter(text)[1]
        return rest if markdown else "\n".join(markup.drop_noise(rest.splitlines()))

    def run(frames):
        for f in frames:
            rows = [(i, *c) for i, t in zip(f["id"], f["text"], strict=True) if t for c in chunk(body(t), markdown, patterns)]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "start_line", "end_line", "chunk_text"])

    source = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "id long, chunk_no int, start_line int, end_line int, chunk_text string").withColumnRenamed("id", id_col)


def front_matters(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, property_name, value_type, value): front matter as attribute rows; values as JSON. Nulls are left out."""

    def run(frames):
        for f in frames:
            rows = [(i, k, markup.value_type(v), markup.compact(v)) for i, t in zip(f["id"], f["text"], strict=True) for k, v in markup.front_matter(t)[0].items() if v is not None]
            yield pd.DataFrame(rows, columns=["id", "property_name", "value_type", "value"])

    source = texts.where(F.col(text_col).startswith("---")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "id long, property_name string, value_type string, value string").withColumnRenamed("id", id_col)


def converted(texts: DataFrame, id_col: str, text_col: str, kind_col: str) -> DataFrame:
    """(id, text, status): text of each file by its kind (md, markdown, txt, html, htm, csv, and xlsx where text_col is binary); other kinds are unsupported, without text. Binary content that cannot be read has failed."""
    binary = dict(texts.dtypes)[text_col] == "binary"

    def read(content: object, kind: str) -> str | None:
        if not isinstance(content, (bytes, bytearray)):
            return content if isinstance(content, str) else None
        try:
            return sheet_to_text(bytes(content)) if kind == "xlsx" else bytes(content).decode("utf-8-sig")
        except (ValueError, KeyError, SyntaxError, zipfile.BadZipFile):
            return None

    @F.pandas_udf("string")
    def extract(text: pd.Series, kind: pd.Series) -> pd.Series:
        by = {"html": markup.html_to_text, "htm": markup.html_to_text, "csv": markup.csv_to_text, "md": lambda t: markup.front_matter(t)[1], "markdown": lambda t: markup.front_matter(t)[1], "txt": str}
        by |= {"xlsx": str} if binary else {}
        return pd.Series([by[k](t) if k in by and (t := read(x, k)) is not None else None for x, k in zip(text, kind, strict=True)], dtype=object)

    kind = F.lower(F.col(kind_col))
    known = kind.isin("md", "markdown", "txt", "html", "htm", "csv", *["xlsx"] * binary)
    said = normalize_converted(extract(F.col(text_col), kind))
    status = F.when(F.coalesce(known, F.lit(False)), "converted").otherwise("unsupported")
    if binary:
        status = F.when((status == "converted") & F.col(text_col).isNotNull() & said.isNull(), "failed").otherwise(status)
    return texts.select(F.col(id_col), said.alias("text"), status.alias("status"))


def line_table(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): lines from 1, split at CR, LF or both."""
    return texts.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("n", "line")).select(id_col, (F.col("n") + 1).alias("line_no"), "line")


def repeated_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, n): stripped lines that a text has more than once."""
    lines = line_table(texts, id_col, text_col).select(id_col, F.trim("line").alias("line")).where("line != ''")
    return lines.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunk_structured(spark, sf_dir):
    return chunks(_documents(spark, sf_dir), "doc_id", "text")


def front_matter(spark, sf_dir):
    return front_matters(_documents(spark, sf_dir), "doc_id", "text")


def html_to_text(spark, sf_dir):
    """Documents wrapped as pages, and their text again."""
    page = F.concat(F.lit("<html><head><style>x{}</style></head><body><h1>"), F.col("source"), F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    return converted(_documents(spark, sf_dir).select("doc_id", page.alias("page"), F.lit("html").alias("kind")), "doc_id", "page", "kind")


def converted_files(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return converted(d.select("doc_id", "text", F.substring_index("file_name", ".", -1).alias("kind")), "doc_id", "text", "kind").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))


def chunk_lines(spark, sf_dir):
    return line_table(_documents(spark, sf_dir), "doc_id", "text")


def noise_lines(spark, sf_dir):
    return repeated_lines(_documents(spark, sf_dir), "doc_id", "text")


def line_windows(spark, sf_dir):
    """Lines 2 to 4 of each document, and whether the end is reached."""
    text = F.col("text")
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", line_window(text, 2, 4).alias("part"), (F.size(F.split(text, "\r\n|\r|\n")) <= 4).alias("reached_eof"))


def text_facts(spark, sf_dir):
    """Lines, estimated tokens, words and checksum of each document."""
    return _documents(spark, sf_dir).select("doc_id", line_count("text").alias("n_lines"), token_estimate("text").alias("tokens"), F.size(tokens("text")).alias("words"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


def file_mime_types(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_fs_entry").where("entry_type = 'FILE'").groupBy(mime_type("name").alias("mime")).agg(F.count(F.lit(1)).alias("n"))


#: The type of a name in SQL.
MIME_SQL = """CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'md' THEN 'text/markdown' WHEN 'markdown' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'csv' THEN 'text/csv' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf'
            WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'zip' THEN 'application/zip' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/octet-stream' END"""


def queries() -> dict:
    return {f.__name__: f for f in (chunk_structured, front_matter, html_to_text, converted_files, chunk_lines, noise_lines, line_windows, text_facts, file_mime_types)}


def oracle_sql() -> dict[str, str]:
    lines = "SELECT doc_id, unnest(range(1, len(l) + 1))::int AS line_no, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM documents WHERE text IS NOT NULL)"
    return {
        "chunk_lines": lines,
        "noise_lines": f"SELECT doc_id, trim(line, ' ') AS line, count(*) AS n FROM ({lines}) WHERE trim(line, ' ') <> '' GROUP BY ALL HAVING count(*) > 1",
        "line_windows": "SELECT doc_id, array_to_string(l[2:4], chr(10)) AS part, len(l) <= 4 AS reached_eof FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM documents WHERE text IS NOT NULL)",
        "text_facts": f"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::int AS n_lines, floor(length(text) * 1.3)::bigint AS tokens, coalesce(len(regexp_extract_all(lower(text), '{TOKEN_SQL}')), 0)::int AS words, sha256(text) AS checksum FROM documents",
        "file_mime_types": f"SELECT {MIME_SQL} AS mime, count(*) AS n FROM knowledge_fs_entry WHERE entry_type = 'FILE' GROUP BY ALL",
    }

