"""Queries on what is read from files of several kinds, and on lines and headings of texts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.functions import markup
from sparkkb.functions.paths import decode_percent
from sparkkb.operators import chunking
from sparkkb.session import scratch_path, table
from sparkkb.sources import files

#: What ends a line, CR LF as one.
BREAKS = r"\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"


#: Where the title of a wiki page begins in a link.
PAGE_TITLE = r"wikipedia\.org/(?:wiki/|w/index\.php\?(?:[^#]*&)?title=)([^#]+)"


def line_offsets(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, start, line): the lines of each text, at whatever Unicode ends one, from 1, with the characters before each. A null or empty text has no lines; repeated ids are told apart by nothing, so ids must be unique."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+$"), F.lit(0))
    rows = texts.select(id_col, F.posexplode(pieces).alias("n", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(id_col, (F.col("n") + 1).alias("line_no"), F.coalesce(before, F.lit(0)).alias("start"), F.regexp_replace("piece", rf"[{BREAKS}]+$", "").alias("line"))


def heading_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, level, title): the headings of each text, outside of code; null texts have none."""

    def run(frames):
        for f in frames:
            rows = []
            for i, text in zip(f["id"], f["text"], strict=True):
                lines = (text or "").splitlines()
                rows += [(i, n, level, line) for n, (line, level) in enumerate(zip(lines, markup.headings(lines), strict=True), 1) if level]
            yield pd.DataFrame(rows, columns=["id", "line_no", "level", "title"])

    source = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "id long, line_no int, level int, title string").withColumnRenamed("id", id_col)


def _package(*parts: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


def _book(rows: list[tuple[str, int | None]]) -> bytes:
    """A workbook of three sheets in another order than their parts; the second is empty."""
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(f'<row><c t="inlineStr"><is><t>{escape(name)}</t></is></c><c>{"" if size is None else f"<v>{size}.0</v>"}</c></row><row><c/></row>' for name, size in rows)
    sheets = "".join(f'<sheet name="{n}" r:id="rId{k}"/>' for n, k in (("Sizes", 2), ("None", 3), ("Names", 1)))
    parts = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3))
    return _package(
        ("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{sheets}</sheets></workbook>"), ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{parts}</Relationships>'),
        ("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>names</t></is></c></row></sheetData></worksheet>'),
        ("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"), ("xl/worksheets/sheet3.xml", f"<worksheet {ns}><sheetData/></worksheet>"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def page_name(url: Column | str) -> Column:
    """The file name of a wiki page: its title, decoded twice, at most 80 characters of it, and six of the link's md5; without a title twelve of the md5."""
    url = F.col(url) if isinstance(url, str) else url
    raw = F.regexp_extract(F.substring_index(url, "#", 1), PAGE_TITLE, 1)
    title = decode_percent(decode_percent(F.substring_index(F.substring_index(F.ltrim(raw, F.lit("/")), "?", 1), "&", 1)))
    digest = F.md5(url.cast("binary"))
    return F.concat(F.when(raw != "", F.substring(F.replace(title, F.lit("/"), F.lit("_")), 1, 80)).otherwise(F.substring(digest, 1, 12)), F.lit("_"), F.substring(digest, 1, 6), F.lit(".txt"))


def page_texts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text) of wiki pages; null pages have a null text."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else markup.page_to_text(p) for p in pages], dtype=object)

    return pages.select(id_col, text(html_col).alias("text"))


def results_from_files(spark, sf_dir):
    """Results written as JSON lines, read again as files, decoded and parsed."""
    path = scratch_path(spark, "results")
    table(spark, sf_dir, "inference_result").select("line_no", "question", "answer").write.option("maxRecordsPerFile", 10_000).json(path)
    text = files.as_text(files.read_files(spark, path, "*.json")).where("valid").select(F.explode(F.split("text", "\n")).alias("line"))
    return text.where("line != ''").select(F.from_json("line", "line_no long, question string, answer string").alias("r")).select("r.*")


def results_from_lines(spark, sf_dir):
    path = scratch_path(spark, "results")
    files.write_jsonl(table(spark, sf_dir, "inference_result").select("line_no", "query_id", "score", "latency_ms"), path)
    return files.read_jsonl(spark, path, "line_no long, query_id string, score int, latency_ms double")


def archive_entries(spark, sf_dir):
    """Each document in an archive of its own, beside entries that are skipped or refused."""

    @F.pandas_udf("binary")
    def packed(name: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_package((f"notes/{n}", t), ("notes/", ""), ("__MACOSX/x", "x"), ("notes/.hidden", "x"), (f"notes/./{n}", "again"), ("../out.md", "x")) for n, t in zip(name, text, strict=True)])

    d = _documents(spark, sf_dir).where("text is not null and file_name is not null")
    found = files.read_archives(d.select(F.col("doc_id").cast("string").alias("path"), packed("file_name", "text").alias("content")))
    return found.select(F.col("archive").cast("long").alias("doc_id"), "path", F.col("content").cast("string").alias("text"), "error")


def sheet_texts(spark, sf_dir):
    """A workbook for each file entry, with its name and size."""

    @F.pandas_udf("binary")
    def book(name: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([_book([(n, None if pd.isna(s) else int(s))]) for n, s in zip(name, size, strict=True)])

    e = table(spark, sf_dir, "knowledge_fs_entry").where("entry_type = 'FILE'")
    return chunking.converted(e.select("kid", book("name", "file_size").alias("content"), F.lit("xlsx").alias("kind")), "kid", "content", "kind")


def csv_texts(spark, sf_dir):
    """A table of two rows for each file entry, with quotes and an empty row."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("virtual_path"), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("name,path\n,\n"), F.lit('"a ""b"", c",'), quoted, F.lit("\n"))
    e = table(spark, sf_dir, "knowledge_fs_entry").where("entry_type = 'FILE'")
    return chunking.converted(e.select("kid", text.alias("text"), F.lit("CSV").alias("kind")), "kid", "text", "kind")


def converted_plain(spark, sf_dir):
    """Documents as plain text files: line ends, marks and white space made alike."""
    return chunking.converted(_documents(spark, sf_dir).select("doc_id", "text", F.lit("txt").alias("kind")), "doc_id", "text", "kind")


def page_names(spark, sf_dir):
    """Links to wiki pages, and to others, by what the reference table names."""
    r = table(spark, sf_dir, "knowledge_file_reference").select("kid", "original_target").where("original_target is not null").distinct()
    urls = F.array(F.concat(F.lit("https://de.wikipedia.org/wiki/"), "original_target"), F.concat(F.lit("https://x.org/"), "original_target"))
    return r.select("kid", F.explode(urls).alias("url")).select("kid", page_name("url").alias("name"))


def page_questions(spark, sf_dir):
    """A page for each question, with boxes, references and closing sections around it."""
    said = F.replace(F.replace("question", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit('<html><head><title>t</title><style>p{}</style></head><body><div class="navbox big"><p>box</p></div><h1>'), "query_id", F.lit("</h1><p>"), said, F.lit('<sup class="reference"><a href="#1">[1]</a></sup> <a href="/x">more</a>[2]<img src="y"></p>'
        '<figure><p>seen</p></figure><div class="mw-heading"><h2 id="References">References</h2></div><ul><li>gone</li></ul><p>gone too</p></body></html>'))
    return page_texts(table(spark, sf_dir, "inference_result").select("line_no", page.alias("page")), "line_no", "page")


def document_lines(spark, sf_dir):
    return line_offsets(_documents(spark, sf_dir), "doc_id", "text")


def marked_headings(spark, sf_dir):
    """Headings by their marks."""
    return heading_lines(_documents(spark, sf_dir), "doc_id", "text").where(F.trim("title").startswith("#")).select("doc_id", "line_no", "level")


def queries() -> dict:
    return {f.__name__: f for f in (results_from_files, results_from_lines, archive_entries, sheet_texts, csv_texts, converted_plain, page_names, page_questions, document_lines, marked_headings)}


def oracle_sql() -> dict[str, str]:
    piece = rf"regexp_extract_all(text, '[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+$')"
    lines = f"l AS (SELECT doc_id, unnest(range(1, len(p) + 1))::int AS line_no, unnest(p) AS piece FROM (SELECT doc_id, {piece} AS p FROM documents))"
    return {
        "results_from_files": "SELECT line_no, question, answer FROM inference_result",
        "results_from_lines": "SELECT line_no, query_id, score, latency_ms FROM inference_result",
        "archive_entries": "SELECT doc_id, '/notes/' || file_name AS path, text, NULL AS error FROM documents WHERE text IS NOT NULL AND file_name IS NOT NULL UNION ALL SELECT doc_id, '../out.md', NULL, 'outside of the archive' FROM documents WHERE text IS NOT NULL AND file_name IS NOT NULL",
        "sheet_texts": "SELECT kid, '## Sizes' || chr(10) || name || ' |' || coalesce(' ' || file_size, '') || chr(10) || chr(10) || '## Names' || chr(10) || 'names' AS text, 'converted' AS status FROM knowledge_fs_entry WHERE entry_type = 'FILE'",
        "csv_texts": "SELECT kid, 'name | path' || chr(10) || 'a \"b\", c | ' || virtual_path AS text, 'converted' AS status FROM knowledge_fs_entry WHERE entry_type = 'FILE'",
        "converted_plain": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(0), ''), '^\x{feff}', ''), '[ \t]+(\n|$)', '\1', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text, 'converted' AS status FROM documents""",
        "page_names": r"""WITH u AS (SELECT DISTINCT kid, p || original_target AS url, p = 'https://de.wikipedia.org/wiki/' AS wiki FROM knowledge_file_reference, (VALUES ('https://de.wikipedia.org/wiki/'), ('https://x.org/')) v(p) WHERE original_target IS NOT NULL),
            t AS (SELECT *, regexp_extract(ltrim(regexp_extract(regexp_extract(url, '^[^#]*'), 'wikipedia\.org/wiki/([^#]+)', 1), '/'), '^[^?&]*') AS raw, regexp_matches(regexp_extract(url, '^[^#]*'), 'wikipedia\.org/wiki/[^#]+') AS named FROM u),
            d AS (SELECT *, url_decode(replace(regexp_replace(url_decode(replace(regexp_replace(raw, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\1', 'g'), '+', '%2B')), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\1', 'g'), '+', '%2B')) AS title FROM t)
            SELECT kid, CASE WHEN named THEN substr(replace(title, '/', '_'), 1, 80) ELSE substr(md5(url), 1, 12) END || '_' || substr(md5(url), 1, 6) || '.txt' AS name FROM d""",
        "page_questions": r"SELECT line_no, CASE WHEN query_id IS NOT NULL AND question IS NOT NULL THEN 't' || chr(10) || chr(10) || '# ' || query_id || chr(10) || chr(10) || ltrim(regexp_replace(question, '\s+', ' ', 'g'), ' ') || ' more' END AS text FROM inference_result",
        "document_lines": f"WITH {lines} SELECT doc_id, line_no, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start, regexp_replace(piece, '[{BREAKS}]+$', '') AS line FROM l",
        "marked_headings": f"""WITH {lines}, f AS (SELECT doc_id, line_no, trim(piece, ' \t' || chr(10) || chr(13)) AS line, regexp_matches(piece, '^\\s*(```|~~~)') AS mark, sum(regexp_matches(piece, '^\\s*(```|~~~)')::int) OVER (PARTITION BY doc_id ORDER BY line_no) AS marks FROM l)
            SELECT doc_id, line_no, length(regexp_extract(line, '^#+'))::int AS level FROM f WHERE regexp_matches(line, '^#{{1,4}}\\s+\\S') AND NOT mark AND marks % 2 = 0""",
    }
