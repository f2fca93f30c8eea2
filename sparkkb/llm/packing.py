"""Filling containers of fixed capacity with texts.

A dynamic program over the global histogram of lengths chooses bucket boundaries that minimise padding.
Batches are formed inside each bucket by their token budget: a pattern says how many items of which lengths
share a container, and how many containers follow it. Batches of one length class alone can leave much
space free (a text of 1,500 tokens has no partner), so a second dynamic program merges neighbouring buckets: it
keeps as many as leave at most SLACK of the space free beyond the least possible. Only the last container of a
bucket, which may be nearly empty, is not closed: the items of these containers, one a bucket, form the final
batch. Every item finds its container from its length and its rank among the items of this length.

The plan has as many rows as there are lengths and patterns; the histogram has no more rows
than the capacity. Both are independent of the number of texts, which are ranked where they lie.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkkb.session import materialize

CAPACITY = 2048
#: Buckets of like lengths, before neighbours are merged.
BUCKETS = 32
#: Share of the tokens that may stay free for the sake of more buckets.
SLACK = 0.005
ITEMS_PER_SLOT = 50_000


def batches(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(containers, free space of each, [(length, items a container)]): batches of items within the token budget, the longest first, then the longest that still fits."""
    sizes, left = lengths.tolist(), counts.tolist()
    out = []
    while sizes:
        room, to, use = capacity, len(sizes), []
        while (at := bisect_right(sizes, room, 0, to) - 1) >= 0:
            n = min(left[at], room // sizes[at])
            use.append((at, n))
            room -= n * sizes[at]
            to = at
        times = min(left[k] // n for k, n in use)
        out.append((times, room, [(sizes[k], n) for k, n in use]))
        for k, n in use:  # from the longest on, so that places before stay
            left[k] -= n * times
            if not left[k]:
                del sizes[k], left[k]
    return out


def _opened(found: list[tuple[int, int, list[tuple[int, int]]]]) -> tuple[list, list[tuple[int, int]]]:
    """Batches without the last container, and the items of that one."""
    times, room, use = found[-1]
    return [*found[:-1], *([(times - 1, room, use)] if times > 1 else [])], use


def free_space(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Free space of the closed containers of a bucket."""
    return sum(times * room for times, room, _ in _opened(batches(lengths, counts, capacity))[0])


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most most buckets with the least total padding. lengths are distinct and ascending."""
    m = len(lengths)
    if m <= most:
        return lengths.copy()
    items = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    cut = np.zeros((most + 1, m + 1), np.int32)
    for k in range(1, most + 1):
        new = np.full(m + 1, np.inf)
        new[0] = 0
        for j in range(1, m + 1):  # bucket (i, j]: every item is padded to lengths[j - 1]
            cost = best[:j] + (items[j] - items[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            new[j], cut[k, j] = cost[i], i
        best = new
    bounds, j = [], m
    for k in range(most, 0, -1):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[k, j]
    return np.array(sorted(set(bounds)))


def merged_bounds(lengths: np.ndarray, counts: np.ndarray, bounds: np.ndarray, capacity: int = CAPACITY, slack: float = SLACK) -> np.ndarray:
    """Bounds of the buckets whose batches leave little space free, neighbours among bounds merged.

    For each number of buckets those with the least free space in all; of these the most buckets that leave no more than slack of the tokens beyond the least.
    """
    m = len(bounds) + 1
    if m == 1:
        return bounds
    at = np.append(0, np.searchsorted(lengths, bounds) + 1)
    cost = np.full((m, m), np.inf)
    for i in range(m):
        for j in range(i + 1, m):
            cost[i, j] = free_space(lengths[at[i] : at[j]], counts[at[i] : at[j]], capacity)
    best, cut = np.full((m, m), np.inf), np.zeros((m, m), int)  # by number of buckets and bound
    best[0, 0] = 0
    for k in range(1, m):
        for j in range(1, m):
            through = best[k - 1, :j] + cost[:j, j]
            cut[k, j] = int(through.argmin())
            best[k, j] = through[cut[k, j]]
    whole = best[1:, m - 1]
    k = 1 + int(np.flatnonzero(whole <= whole.min() + slack * (counts * lengths).sum()).max())
    out, j = [], m - 1
    for n in range(k, 0, -1):
        out.append(bounds[j - 1])
        j = cut[n, j]
    return np.array(out[::-1])


def plan(lengths: np.ndarray, counts: np.ndarray, bounds: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first container, items a container) of each pattern and length; the final batch has the items of the containers that buckets left open."""
    taken = dict.fromkeys(lengths.tolist(), 0)
    out, container = [], 0

    def close(found: list) -> None:
        nonlocal container
        for times, _, use in found:
            for length, n in use:
                out.append((length, taken[length], container, n))
                taken[length] += n * times
            container += times

    open_: dict[int, int] = {}
    bucket = np.searchsorted(bounds, lengths)
    for b in range(len(bounds)):
        mine = bucket == b
        closed, rest = _opened(batches(lengths[mine], counts[mine], capacity))
        close(closed)
        for length, n in rest:
            open_[length] = open_.get(length, 0) + n
    rests = np.array(sorted(open_), np.int64)
    close(batches(rests, np.array([open_[x] for x in rests.tolist()], np.int64), capacity))
    return out


def containers(lengths: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, buckets: int = BUCKETS, slack: float = SLACK) -> DataFrame:
    """(id, piece, n_tokens, container): a container for each text, or for each piece of a text above the capacity.

    lengths has (id, n_tokens). Texts of no tokens and null lengths are left out. A longer text gives full pieces and
    a rest; piece counts from 0. Repeated ids are items of their own. An empty table gives an empty result.
    """
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    items = lengths.where("n_tokens > 0").select(F.col(id_col), F.col("n_tokens").alias("total"), F.posexplode(F.sequence(F.lit(0), full)).alias("piece", "k")).select(
        id_col, "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    items = materialize(items, "items")
    seen = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more rows than the capacity
    sizes = np.array(sorted(seen), np.int64)
    counts = np.array([seen[x] for x in sizes.tolist()], np.int64)
    bounds = merged_bounds(sizes, counts, bucket_bounds(sizes, counts, buckets), capacity, slack)
    steps = pd.DataFrame(plan(sizes, counts, bounds, capacity), columns=["length", "rank", "container", "use"]).sort_values(["length", "rank"])
    by_length = {int(k): (g["rank"].to_numpy(), g["container"].to_numpy(), g["use"].to_numpy()) for k, g in steps.groupby("length")}

    @F.pandas_udf("long")
    def container(n_tokens: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), np.int64)
        sizes, ranks = n_tokens.to_numpy(), rank.to_numpy()
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = order[a:b]
            first, base, use = by_length[int(sizes[mine[0]])]
            at = np.searchsorted(first, ranks[mine], "right") - 1
            out[mine] = base[at] + (ranks[mine] - first[at]) // use[at]
        return pd.Series(out)

    slots = max(1, int(counts.sum()) // ITEMS_PER_SLOT)
    placed = items.withColumn("slot", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slots)).cast("int"))
    sums = placed.groupBy("n_tokens", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = placed.withColumn("within", F.row_number().over(Window.partitionBy("n_tokens", "slot").orderBy(id_col, "piece")) - 1)
    ranked = ranked.join(before.select("n_tokens", "slot", "before"), ["n_tokens", "slot"]).withColumn("rank", F.col("within") + F.coalesce("before", F.lit(0)))
    return ranked.select(id_col, "piece", "n_tokens", container("n_tokens", "rank").alias("container"))
