"""Texts cut off by field limits or in transfer, by hashed logistic regression.

1. ``field_limits``  lengths that far too many texts of a source share are its limits (over all rows).
2. ``fit``           at most TRAIN_ROWS texts, chosen by hash, give features as they are and artificially cut:
                     at limits, at random places, inside lists, tables and code, with and without the signs that
                     cutting systems leave. Texts that are cut already
                     are left out, as judged by fits on the other half of the sample.
3. ``scores``        every text is scored. The share of cut texts, which the training rows don't show,
                     is estimated from the scores of all rows.

Only the training sample's features, the limits and the histogram of scores reach the driver; each is bounded.
"""

from __future__ import annotations

import random
import re
import zlib
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkkb.session import materialize

#: Bound of the training sample, in texts.
TRAIN_ROWS = 12_000
#: Cuts of each text of the sample.
CUTS = 4
WIDTH = 1 << 18
#: A length is a limit of a source if so many of its texts have it, so a source has some hundred at most; more limits in all than MOST_LIMITS are refused.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_LEAST, MOST_LIMITS = 5, 0.015, 40, 100_000
#: A text counts as cut from this probability on.
CUT_FROM = 0.9
#: Signs that cutting systems leave at the end.
SIGNS = ("…", "...", "[...]", "[…]", "[cut]", "[truncated]", "(more)", "(truncated)", "(continued)", "[more]", ">>", "�", "<cut>", "– read on", "- read on", "read more", "continue reading", "[snip]", "[continued]", "--more--")
_SIGN = re.compile(r"\s*(?:" + "|".join(re.escape(s) for s in sorted(SIGNS, key=len, reverse=True)) + r")$")
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:[-'’][^\W_一-鿿]+)*|\S")
_SENTENCE = re.compile(r"(?:[.!?][\"')\]]*\s+|[。！？])")
_LIST = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+")
_PATH = re.compile(r"^(?:\S+:? +)?\S*/\S+$")
_SIGNATURE = re.compile(r"^\s*(?:--|—|–)\s*\S")


def _shape(token: str, upper: bool) -> str:
    if any(c.isdigit() for c in token):
        return re.sub(r"\d+", "9", re.sub(r"[A-Z]+", "A", token))
    if token[:1].isupper() and not upper:
        return "Cap"
    return token.lower()


def last_line(text: str) -> tuple[str, str]:
    """Kind and text of the last line of a text without white space at its end."""
    at = max(text.rfind("\n"), text.rfind("\r")) + 1
    line = text[at:]
    fences = sum(1 for m in re.finditer(r"(?m)^[ \t]*(?:```|~~~)", text))
    if fences % 2:
        return "code", line
    if line.lstrip().startswith(("```", "~~~")):
        return "fence", line
    if line.lstrip().startswith("|"):
        return "table", line
    if _LIST.match(line):
        return "list", line
    if _SIGNATURE.match(line):
        return "sign", line
    if line.lstrip().startswith("#"):
        return "head", line
    if _PATH.match(line) and len(line) < 300:
        return "path", line
    return "text", line


def _limit_distance(n_chars: int, n_bytes: int, limits: tuple[set, set]) -> str:
    chars, size = limits
    if any(n_chars == x for x in chars) or any(n_bytes == x for x in size):
        return "at"
    if any(0 < x - n_chars <= 3 for x in chars) or any(0 < x - n_bytes <= 3 for x in size):
        return "close"
    if any(0 < x - n_chars <= 40 for x in chars) or any(0 < x - n_bytes <= 40 for x in size):
        return "near"
    return "off"


def features(text: str, limit: str) -> list[str]:
    """Names of the features of a text; limit says how far from a limit of its source it ends."""
    whole = text.rstrip().rstrip("​﻿").rstrip()
    m = _SIGN.search(whole)
    sign = m.group().strip() if m else ""
    rest = whole[: m.start()] if m else whole
    kind, line = last_line(rest)
    letters = [c for c in line if c.isalpha() and c.upper() != c.lower()]
    upper = len(letters) > 8 and all(c.isupper() for c in letters)
    end = rest[-1:] or "none"
    shut = end if not end.isalnum() else "digit" if end.isdigit() else "han" if "一" <= end <= "鿿" else "letter"
    parts = _SENTENCE.split(line)
    sentence = next((p for p in reversed(parts) if p.strip()), line)
    words = _TOKEN.findall(sentence)
    tokens = [_shape(t, upper) for t in words[-3:]]
    head = [_shape(m.group(), upper) for m in islice(_TOKEN.finditer(_LIST.sub("", sentence)), 2)]
    one, two, three = ("_".join(tokens[-k:]) for k in (1, 2, 3))
    long = min(len(words), 30)
    opened = sum(line.count(a) > line.count(b) for a, b in ("()", "[]", "{}", "（）", "「」", "“”")) + line.count('"') % 2
    out = ["bias", f"k{kind}", f"e{kind}{shut}", f"l{limit}", f"l{limit}{kind}{shut in '.!?。！？'}", f"g{sign}", f"g{bool(sign)}{shut in '.!?。！？|`'}", f"o{kind}{min(opened, 2)}", f"u{upper}"]
    out += [f"1{kind}{one}", f"2{kind}{two}", f"3{kind}{three}", f"h{kind}{'_'.join(head)}|{one}", f"n{kind}{'_'.join(head)}|{long // 2}", f"m{kind}{long // 3}", f"H{kind}{'_'.join(head)}|{two}"]
    tail = words[-1].lower() if words else ""
    out += [f"s{kind}{len(tail) > k}{tail[-k:]}" for k in (2, 3, 4)] + [f"t{kind}{min(len(tail), 12)}"]
    if kind == "table":
        before = rest[: len(rest) - len(line)].removesuffix("\n").removesuffix("\r")
        row = before[max(before.rfind("\n"), before.rfind("\r")) + 1 :]
        above = row.count("|") if row.lstrip().startswith("|") else -1
        out += [f"r{(line.count('|') > above) - (line.count('|') < above)}{end == '|'}"]
    if kind == "path":
        out += [f"p{bool(re.search(r'\.[A-Za-z0-9]{1,5}$', line))}"]
    return out


def _slots(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names]


def _cut(text: str, rng: random.Random, limits: list[int]) -> tuple[str, str] | None:
    """An intact text cut inside a sentence, line or block, with what its limit feature shall be."""
    text = text.rstrip()
    if len(text) < 8:
        return None
    fit = [x for x in limits if x < len(text)]
    limit = "off"
    if fit and rng.random() < 0.35:
        at, limit = rng.choice(fit), "at"
    elif rng.random() < 0.5:
        lines = [m for m in re.finditer(r"[^\n]+", text) if re.match(r"\s*(?:[-*|]|\d+[.)]|--|#|\S*/)|    ", m.group())]
        if not lines:
            at = rng.randrange(1, len(text))
        else:
            m = rng.choice(lines)
            at = rng.randrange(m.start() + 1, m.end() + 1)
    else:
        at = rng.randrange(1, len(text))
    kept = text[:at].rstrip()
    if len(kept) < 4:
        return None
    kind, line = last_line(kept)
    follows = text[len(kept) :]
    if kind != "code" and (kept[-1] in ".!?。！？" or not follows.strip(" \t")[:1].strip("\n\r") or (kind == "fence")):
        return None  # it may look complete
    if rng.random() < 0.3:
        kept += rng.choice(["", " "]) + rng.choice(SIGNS)
    return kept, limit


def field_limits(documents: DataFrame) -> dict[str, tuple[set, set]]:
    """Limits of each source, in characters and in bytes."""
    rows = documents.where("text is not null and source is not null").select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    by = rows.select("source", F.explode(F.array(F.struct(F.lit(0).alias("unit"), F.col("chars").alias("n")), F.struct(F.lit(1).alias("unit"), F.col("bytes").alias("n")))).alias("x"))
    counts = by.groupBy("source", "x.unit", "x.n").agg(F.count(F.lit(1)).alias("texts"))
    total = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    spikes = counts.where(f"texts >= {LIMIT_TEXTS} and n >= {LIMIT_LEAST}").join(total, "source").where(f"texts >= {LIMIT_SHARE} * total")
    out: dict[str, tuple[set, set]] = {}
    found = spikes.limit(MOST_LIMITS + 1).collect()
    if len(found) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} field limits")
    for r in found:
        out.setdefault(r["source"], (set(), set()))[r["unit"]].add(r["n"])
    return out


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 6, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by AdaGrad; x has the slots of each row's features, padded with -1."""
    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for rows in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
            at = x[rows]
            error = (1 / (1 + np.exp(-w[at].sum(1))) - y[rows]) * weight[rows]
            g = np.bincount(at.ravel(), np.repeat(error, at.shape[1]), WIDTH + 1)
            g[WIDTH] = 0
            g = g / len(rows) + decay * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def _padded(slots: list[list[int]]) -> np.ndarray:
    x = np.full((len(slots), max(map(len, slots), default=1)), WIDTH)
    for i, s in enumerate(slots):
        x[i, : len(s)] = s
    return x


def fit(documents: DataFrame, limits: dict) -> np.ndarray | None:
    """Weights of the features; None without texts to learn from."""
    sample = examples(documents, limits)
    return None if sample is None else learn(sample.toPandas().sort_values(["doc_id", "cut"], kind="stable"))


def examples(documents: DataFrame, limits: dict) -> DataFrame | None:
    """(doc_id, cut, slots): the texts of the sample, and CUTS cut forms of each at every size of the table."""
    usable = documents.where("text is not null and trim(text) != ''")
    total = usable.count()
    if not total:
        return None
    share = min(1.0, TRAIN_ROWS / total)
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "text", "source")
    in_chars = sorted({n for chars, size in limits.values() for n in chars | size})

    def run(frames):
        for f in frames:
            rows = []
            for i, text, source in zip(f["doc_id"], f["text"], f["source"], strict=True):
                rng = random.Random(zlib.crc32(str(i).encode()))
                distance = _limit_distance(len(text), len(text.encode()), limits[source]) if source in limits else "off"
                if distance in ("off", "near"):  # at a limit it is likely cut already, so it is no example of either kind
                    rows.append((i, 0, _slots(features(text, distance))))
                    rows += [(i, 1, _slots(features(*c))) for c in (_cut(text, rng, in_chars) for _ in range(CUTS)) if c]
            yield pd.DataFrame(rows, columns=["doc_id", "cut", "slots"])

    return picked.mapInPandas(run, "doc_id long, cut int, slots array<int>")


def learn(sample: pd.DataFrame) -> np.ndarray:
    """Weights from examples."""
    x, y = _padded([list(s) for s in sample["slots"]]), sample["cut"].to_numpy(float)
    weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum()))
    # Some texts that count as intact are cut; each half of the sample is cleared by what the other half teaches.
    half = sample["doc_id"].map(lambda i: zlib.crc32(f"half {i}".encode()) % 2).to_numpy() if len(sample) else np.empty(0)
    keep = y == 1
    for side in (0, 1):
        w = _descend(x[half != side], y[half != side], weight[half != side], rounds=3)
        mine = (half == side) & (y == 0)
        keep[mine] = w[x[mine]].sum(1) < 0
    return _descend(x[keep], y[keep], weight[keep])


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score): log odds of a cut, for texts neither null nor blank; before the share of cut texts is taken into account."""
    documents = documents.select("doc_id", "text", "source")
    limits = field_limits(documents)
    w = fit(documents, limits)

    def run(frames):
        for f in frames:
            out = []
            for text, source in zip(f["text"], f["source"], strict=True):
                distance = _limit_distance(len(text), len(text.encode()), limits[source]) if source in limits else "off"
                out.append(float(w[_slots(features(text, distance))].sum()))
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "score": out})

    rows = documents.where(r"text is not null and text rlike '[^\\s\\x{85}\\x{a0}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]'")
    return (rows if w is not None else rows.limit(0)).mapInPandas(run, "doc_id long, source string, score double")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, cut): every text that is not null or blank, and whether it was cut.

    Empty, blank and null texts are no case. Repeated rows are judged alike. A null source has no limits. An empty table gives an empty result.
    """
    judged = materialize(scores(documents), "scores")
    bins = judged.groupBy(F.greatest(F.lit(-400), F.least(F.lit(400), F.round(F.col("score") * 10))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    s, n = np.array([r["bin"] / 10 for r in bins]), np.array([r["n"] for r in bins], float)
    share = 0.1
    for _ in range(200 if len(s) else 0):  # expectation maximisation over the score histogram of all rows
        share = float(np.clip((n / (1 + np.exp(-(s + np.log(share / (1 - share)))))).sum() / n.sum(), 1e-9, 1 - 1e-9))
    return judged.withColumn("cut", F.col("score") + float(np.log(share / (1 - share)) - np.log(CUT_FROM / (1 - CUT_FROM))) > 0)


def by_source(judged: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, texts, truncated, share): over all rows of a source, null and blank texts included."""
    cut = judged.where("cut").groupBy("source").agg(F.count(F.lit(1)).alias("truncated"))
    total = documents.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    joined = total.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select("t.source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("texts")).alias("share"))
