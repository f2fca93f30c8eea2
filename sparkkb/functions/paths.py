"""Paths of the file tree as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_percent(c: Column | str) -> Column:
    """Decode %-escapes as UTF-8. A plus sign and a % that begins no escape stay as they are."""
    c = _col(c)
    ready = F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(c.contains("%"), F.try_url_decode(ready)).otherwise(c)


def parent_path(c: Column | str) -> Column:
    """All before the last slash; empty for a path at the top."""
    return F.regexp_replace(_col(c), r"/[^/]*$", "")


def normalize_path(c: Column | str) -> Column:
    """Resolve ``.`` and ``..`` and empty segments of an absolute path; null if it climbs above the root."""
    parts = F.filter(F.split(_col(c), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))
