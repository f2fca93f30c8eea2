"""Files and archives as tables, and tables as files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values, the bounds of an archive: entries, bytes of one entry, bytes of all, counted on what is really unpacked.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES = 10_000, 64 << 20, 256 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, content, checksum) of files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("checksum"))


def as_text(files: DataFrame) -> DataFrame:
    """Files decoded strictly as UTF-8; text is null and valid false where the bytes are none."""
    valid = F.expr("is_valid_utf8(cast(content as string))")
    return files.withColumn("valid", valid).withColumn("text", F.when(valid, F.regexp_replace(F.col("content").cast("string"), r"^\x{feff}", "")))


def location(base: F.Column, entry: F.Column, name: F.Column, converted: bool = False) -> F.Column:
    """Where an entry's original or converted bytes lie."""
    suffix = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return F.concat(F.lit("kb/"), base.cast("string"), F.lit("/fs-entry/"), entry.cast("string"), F.lit("/markdown.md") if converted else F.concat(F.lit("/original"), suffix))


def entry_name(raw: str, utf8: bool) -> str:
    """The name of an archive entry; names that were not marked as UTF-8 are tried as GBK, then as UTF-8."""
    if utf8:
        return raw
    for kind in ("gbk", "utf-8"):
        try:
            return raw.encode("cp437").decode(kind)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return raw


def _unpack(path: str, content: bytes) -> list[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return [(path, 0, None, None, "not an archive")]
    rows, total = [], 0
    for i, info in enumerate(archive.infolist()):
        name = entry_name(info.filename, bool(info.flag_bits & 0x800)).replace("\\", "/")
        parts = name.split("/")
        if info.is_dir() or parts[0] == "__MACOSX" or any(p.startswith(".") and p not in (".", "..") for p in parts):
            continue
        inside = posixpath.normpath("/" + name) if ".." not in parts else posixpath.normpath(name)
        if inside.startswith("..") or "\0" in name:
            rows.append((path, i, name, None, "outside of the archive"))
            continue
        if len(rows) >= MOST_ENTRIES:
            rows.append((path, i, name, None, "too many entries"))
            break
        try:
            with archive.open(info) as f:
                data = f.read(MOST_ENTRY_BYTES + 1)
        except (RuntimeError, zipfile.BadZipFile, NotImplementedError, OSError) as e:
            rows.append((path, i, name, None, f"unreadable: {type(e).__name__}"))
            continue
        total += len(data)
        if len(data) > MOST_ENTRY_BYTES or total > MOST_BYTES:
            rows.append((path, i, name, None, "too large"))
            continue
        rows.append((path, i, "/" + inside.lstrip("/"), data, None))
    return rows


def read_archives(files: DataFrame) -> DataFrame:
    """(archive, place, path, content, error): the entries of zip files; of entries with one path the first stays.

    Folders, resource forks and hidden entries are skipped. An entry that is too large, lies outside or can't be read has an error and no content.
    """

    def run(frames):
        for f in frames:
            rows = [r for p, c in zip(f["path"], f["content"], strict=True) for r in _unpack(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["archive", "place", "path", "content", "error"])

    entries = files.select("path", "content").mapInPandas(run, "archive string, place int, path string, content binary, error string")
    first = F.row_number().over(Window.partitionBy("archive", "path", F.col("error").isNull()).orderBy("place"))
    return entries.withColumn("__n", first).where("__n = 1").drop("__n")


def import_order(entries: DataFrame) -> DataFrame:
    """Phase of each entry: markdown after all others, so that its links find their targets."""
    return entries.withColumn("phase", F.when(F.lower("path").rlike(r"\.(md|markdown)$"), 2).otherwise(1))


#: The attribute of a sheet that names its part of the package.
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_to_text(content: bytes) -> str:
    """Sheets of an xlsx file: ``## name``, then rows with cells joined by `` | ``; empty rows are dropped. Read from the XML of the package."""
    import xml.etree.ElementTree as ET

    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            parts = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))).lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)] if "xl/sharedStrings.xml" in names else []
        sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", space)
        out = []
        for i, sheet in enumerate(sheets, 1):
            part = parts.get(sheet.get(RELATION), f"xl/worksheets/sheet{i}.xml")  # sheets may have been moved or removed
            if part not in names:
                continue
            rows = []
            for row in ET.fromstring(z.read(part)).iter(f"{{{space['m']}}}row"):
                cells = []
                for c in row.findall("m:c", space):
                    value = c.findtext("m:v", "", space) if c.get("t") != "inlineStr" else "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t"))
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif value and re.fullmatch(r"-?\d+\.0+", value):
                        value = value.split(".")[0]
                    cells.append(value.strip())
                if any(cells):
                    rows.append(" | ".join(cells))
            if rows:
                out.append("\n".join([f"## {sheet.get('name', '')}", *rows]))
    return "\n\n".join(out)


def split_urls(c: F.Column) -> F.Column:
    """A list of links: parted at commas before http, notes that a link is not required dropped, closing marks removed."""
    parts = F.split(F.regexp_replace(c, r"\s*\(NOT REQUIRED[^)]*\)", ""), r",\s*(?=https?://)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"[,.;]+$", "")), lambda x: x.startswith("http"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a table; an append log keeps all versions, readers take the last of a key."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace just the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
