"""Small parsers of one text, called on batches by the operators: front matter, headings, tables, HTML, CSV."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import unicodedata
from datetime import date, datetime
from html.parser import HTMLParser

try:
    import yaml
except ImportError:  # a reader of flat mappings does then
    yaml = None

#: Numerals of Chinese headings, the units they count, and the deepest markdown level.
NUMERALS, UNITS, DEEPEST = "一二三四五六七八九十百千万零〇", "章节部分篇", 4


def _default_headings() -> tuple[tuple, ...]:
    """(name, pattern, explicit level or 0, only in markdown) of heading lines, tried in order on lines in compatibility form: marks, units, then lists of numerals, then of numbers with a blank before the title."""
    counted = {"unit": f"第[{NUMERALS}0-9]+[{UNITS}]", "list": f"[{NUMERALS}]+、", "bracket": f"\\([{NUMERALS}]+\\)"}
    marks = [(f"mark{n}", f"#{{{n}}}\\s+\\S", n, True) for n in range(1, DEEPEST + 1)]
    numbers = [("nested", r"(\d+(?:\.\d+)+)\s+(?![\d.\s]+$)\S", 0, False), ("numbered", r"(\d+)[.、]\s+\S", 0, False)]
    return tuple((name, re.compile(shape), level, only) for name, shape, level, only in [*marks, *((n, x, 0, False) for n, x in counted.items()), *numbers])


HEADINGS = _default_headings()
_INLINE = re.compile(r"[。！？；;!?]")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")


def front_matter(text: str) -> tuple[dict[str, object], str]:
    """The mapping between a leading ``---`` and the next one, and the rest; nothing, and the whole text, where it is no mapping.

    It is read as YAML where that is installed, else by a reader of flat mappings: scalars, quoted text, lists in brackets or dashes, and text blocks; what is nested
    deeper is kept as text. Dates become ISO text, mappings JSON.
    """
    if not text.startswith("---"):
        return {}, text
    end = text.find("---", 3)
    if end < 0:
        return {}, text
    found = _yaml(text[3:end]) if yaml is not None else _flat(text[3:end])
    return ({}, text) if found is None else (found, text[end + 3 :].lstrip("\n"))


def _yaml(block: str) -> dict[str, object] | None:
    try:
        found = yaml.safe_load(block)
    except (yaml.YAMLError, ValueError):
        return None
    return {str(k): _plain(v) for k, v in found.items()} if isinstance(found, dict) else None if found is not None else {}


def _plain(value: object) -> object:
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, list):
        return [x if isinstance(x, str) else "" if x is None else compact(_plain(x)) if isinstance(x, (dict, list, bool)) else str(_plain(x)) for x in value]
    return compact({str(k): _plain(v) for k, v in value.items()}) if isinstance(value, dict) else value


def _flat(block: str) -> dict[str, object] | None:
    found: dict[str, object] = {}
    key, joined = None, ""
    for line in block.splitlines():
        if key and line[:1] in " \t" and line.strip() and not line.lstrip().startswith("-"):
            old = found.get(key)  # the lines of a text block, or of something nested
            found[key] = line.strip() if old is None else f"{old}{joined}{line.strip()}"
            continue
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if key and re.match(r"\s*-\s+", line):
            old = found.get(key)
            found[key] = [*(old if isinstance(old, list) else []), _scalar(line.split("-", 1)[1].strip())]
            continue
        m = re.match(r"^([\w .-]+?)\s*:(?:\s+(.*))?$", line)
        if not m:
            return None
        key = m.group(1)
        value = (m.group(2) or "").strip()
        joined = "\n" if value.startswith("|") else " "
        if re.fullmatch(r"[|>][+-]?", value):
            value = ""
        found[key] = [_scalar(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value)
    return found


def _scalar(value: str) -> object:
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value in ("", "~", "null"):
        return None
    if re.fullmatch(r"[+-]?\d+", value):
        return int(value)
    return float(value) if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", value) else value


def value_type(value: object) -> str:
    """The type of a front matter value as an attribute."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, list):
        return "stringList"
    return "datetime" if isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)?", value) else "string"


def code_mask(lines: list[str]) -> list[bool]:
    """Which lines lie in a code fence, its marks included; a fence closes with its own character, at least as long."""
    mask, fence = [], ""
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            mask.append(True)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        else:
            mask.append(bool(m))
            fence = m.group(1) if m else ""
    return mask


def heading_patterns(config: str) -> tuple[tuple, ...]:
    """Heading shapes in place of HEADINGS from a JSON array of objects: name, regex, explicit_level, markdown_only, reject_if_contains_colon."""
    found = json.loads(config)
    if not isinstance(found, list):
        raise ValueError("heading patterns are a JSON array")
    return tuple((x["name"], re.compile(x["regex"]), x.get("explicit_level") or 0, bool(x.get("markdown_only")), bool(x.get("reject_if_contains_colon"))) for x in found)


def headings(lines: list[str], markdown: bool = True, patterns: tuple[tuple, ...] = HEADINGS) -> list[int]:
    """The level of each line, 0 for body. Explicit levels are those of markdown; other kinds are ranked by first appearance."""
    fenced = code_mask(lines) if markdown else [False] * len(lines)
    kinds: list[tuple[str, int]] = []
    numbers: list[int | None] = []
    for line, inside in zip(lines, fenced, strict=True):
        bare = unicodedata.normalize("NFKC", line).strip()
        kind, number = ("", 0), None
        for name, pattern, level, only, *colon in patterns if not inside else ():
            m = pattern.match(bare)
            if not m or (only and not markdown) or (not only and _INLINE.search(bare)):
                continue
            own = not colon  # the shapes of HEADINGS have rules by name
            if (own and name in ("nested", "numbered") or any(colon)) and (":" in bare or "：" in bare):
                continue
            if own and name == "nested":
                name = f"nested_{m.group(1).count('.') + 1}"
            if own and name == "numbered":
                number = int(m.group(1))
            kind = (name, level)
            break
        kinds.append(kind)
        numbers.append(number)
    for i, n in enumerate(numbers):  # neighbours that count on are a list
        if n is not None and ((i + 1 < len(numbers) and numbers[i + 1] == n + 1) or (i and numbers[i - 1] == n - 1)):
            kinds[i] = ("", 0)
    ranks: dict[str, int] = {}
    return [0 if not name else level or ranks.setdefault(name, len(ranks) + 1) for name, level in kinds]


def drop_noise(lines: list[str]) -> list[str]:
    """Converted text without page marks, and without file names or dates that repeat."""
    said = [x.strip() for x in lines]
    again = lambda s: said.count(s) > 1 and bool(re.fullmatch(r"\S+\.md|\d{4}-\d{2}-\d{2}", s))
    return [x for x, s in zip(lines, said, strict=True) if not re.fullmatch(r"\d+\s*/\s*\d+", s) and not again(s)]


#: Parts of wiki pages that are no text, as a tag, a class, or a tag with a class; ids of headings that end the text; headings' boxes.
PAGE_DROPS = (
    "sup.reference", "span.reference", ".reflist", ".references", ".mw-references-wrap", "img", "figure", ".thumb", ".mw-file-element", ".mw-file-description", ".mw-editsection", ".navbox", ".navbox-styles", ".catlinks",
    ".mw-authority-control", ".sistersitebox", ".side-box")
PAGE_ENDS = ("External_links", "See_also", "Notes", "Further_reading", "References", "Citations", "Sources", "Bibliography")
HEADING_BOX = "mw-heading"


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre", "body", "main"}
    SKIP = {"script", "style", "nav", "footer", "noscript", "template"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, drops: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.cells = 0
        self.drops, self.ends = frozenset(drops) | self.SKIP, frozenset(ends)
        self.open: list[list] = []  # [tag, whether a box of headings, whether its text is skipped]

    def handle_starttag(self, tag, attrs):
        of = dict(attrs)
        classes = (of.get("class") or "").split()
        skipped = bool(self.open and self.open[-1][2]) or not self.drops.isdisjoint([tag, *(f".{c}" for c in classes), *(f"{tag}.{c}" for c in classes)])
        if not skipped and of.get("id") in self.ends:
            skipped = True
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][1]), len(self.open))
            for o in self.open[max(0, at - 1) :]:  # what holds the heading says no more, as the text after it is left out
                o[2] = True
        if tag not in self.VOID:
            self.open.append([tag, HEADING_BOX in classes, skipped])
        if skipped:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.out.append("\n")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:  # elements inside that were not closed end as well
            del self.open[at:]
        if not (self.open and self.open[-1][2]) and (tag in self.BLOCKS or re.fullmatch(r"h[1-6]", tag)):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not (self.open and self.open[-1][2]):
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_text(source: str, drops: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> str:
    """Readable markdown-like text of an HTML page, links as their text; scripts, styles, navigation and footers are left out, as are the elements that drops names and all that follows a heading whose id is in ends."""
    parser = _Text(drops, ends)
    parser.feed(source)
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
    return html.unescape(re.sub(r"\n{3,}", "\n\n", text)).strip()


def page_to_text(source: str) -> str:
    """The text of a wiki page, without references, pictures, boxes and closing sections."""
    text = re.sub(r"[ \t]*\[\d+\]", "", html_to_text(source, PAGE_DROPS, PAGE_ENDS))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", text)).strip()


def csv_to_text(source: str) -> str:
    """Rows of a CSV text, cells joined by `` | ``; rows without content are dropped."""
    return "\n".join(" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(source)) if any(c.strip() for c in row))


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
