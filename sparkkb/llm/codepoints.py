"""Arrow string batches as flat code point arrays.

Word splitting of a large corpus is the hottest loop of several operators, so it
runs over whole Arrow batches with numpy instead of once per text: the code
points of all texts of a slice lie in one array, with a sentinel after each text.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

SENTINEL = 0x110000
OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
#: The White_Space property of Unicode.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers lie in the first four planes; the others are unassigned, private, or hold tags.
PLANES = 0x40000
HAN_FIRST, HAN_LAST = 0x4E00, 0x9FFF


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other; END for the sentinel."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    out[:PLANES] = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLANES)), np.uint8, PLANES)
    out[SENTINEL] = END
    out[list(WHITE_SPACE)] = SPACE
    return out


@functools.lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """Lower case of each code point where that is one code point, else itself."""
    out = np.arange(SENTINEL + 1, dtype=np.uint32)
    for c in range(0x1E944):  # the last cased block ends here
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            out[c] = ord(low)
    return out


@functools.lru_cache(maxsize=1)
def char_keys() -> np.ndarray:
    """A pseudo-random 64-bit key for each code point."""
    return mix(np.arange(SENTINEL + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=1)
def lower_keys() -> np.ndarray:
    """char_keys() of the lower case of each code point."""
    return char_keys()[lower_case()]


@functools.lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by SENTINEL, and where each text begins (one more entry: the end). Nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        ends = offsets[1:] - offsets[0]
    else:
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = heads[offsets[1:] - offsets[0]]
    starts = np.concatenate([[0], ends + np.arange(1, n + 1)])
    out = np.empty(len(points) + n, np.uint32)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[~keep] = SENTINEL
    out[keep] = points
    return out, starts


def slices(texts: pa.Array, most_bytes: int):
    """(first, past last) of runs of texts that hold about most_bytes at most, a longer text alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most_bytes:
            yield first, i
            first, held = i, 0
        held += int(s)
    if first < len(sizes):
        yield first, len(sizes)


def span_hashes(keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of 64-bit character keys; spans follow one another, each from its begin. Equal spans, equal hashes."""
    if not len(begin):
        return np.empty(0, np.uint64)
    length = np.diff(np.append(begin, len(keys)))
    within = np.arange(len(keys), dtype=np.int64) - np.repeat(begin, length)
    powers = _powers()
    if length.max() <= len(powers):
        weight = powers[within]
    else:
        round_ = (within // len(powers)).astype(np.uint64)
        weight = powers[within % len(powers)] * np.where(round_ == 0, np.uint64(1), mix(round_) | np.uint64(1))
    sums = np.add.reduceat(keys * weight, begin)
    return mix(sums + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and the number of words before each text.

    Words are maximal runs of letters or numbers; a character U+4E00 to U+9FFF is a word of its own.
    """
    if not len(points):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    kind = classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    han = (points >= HAN_FIRST) & (points <= HAN_LAST)
    before = np.concatenate([[False], inside[:-1]])
    han_before = np.concatenate([[False], han[:-1]])
    begins = inside & (~before | han | han_before)
    first = np.flatnonzero(begins)
    keys = lower_keys()[points[inside]]
    rank = np.cumsum(inside)
    return span_hashes(keys, rank[first] - 1), np.searchsorted(first, starts)
