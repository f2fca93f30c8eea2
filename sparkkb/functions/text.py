"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Han character, or a run of other letters and numbers. One character class, as a repeated group would recurse in very long words.
TOKEN = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"
#: The same without intersection of classes, for SQL engines that lack it.
TOKEN_SQL = r"[\x{4e00}-\x{9fff}]|(?:[^\P{L}\x{4e00}-\x{9fff}]|\p{N})+"


def tokens(c: Column | str) -> Column:
    """Lower-case tokens in order; a null text has none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def normalize_converted(c: Column | str) -> Column:
    """Line ends as LF, no NUL, no byte order mark, no white space at line ends or around the text."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), "\x00", ""), r"^\x{feff}", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def line_count(c: Column | str) -> Column:
    """Line feeds plus one; null for a null text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def line_window(c: Column | str, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, joined by LF."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.slice(F.split(c, "\r\n|\r|\n"), first, last - first + 1), "\n")


def mime_type(name: Column | str) -> Column:
    """MIME type by extension; markdown always text/markdown, else unknown ones application/octet-stream."""
    name = F.col(name) if isinstance(name, str) else name
    known = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "zip": "application/zip",
             "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    out = F.lit("application/octet-stream")
    for e, m in known.items():
        out = F.when(ext == e, m).otherwise(out)
    return F.when(name.isNotNull(), out)


def token_estimate(c: Column | str) -> Column:
    """Characters times 1.3, rounded down."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.length(c) * 1.3).cast("long")
