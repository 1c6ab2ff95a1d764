"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts are one group and stay together. Groups are ordered by the SHA-256 of their
text; the smallest capacity is sought for which a greedy pass over the ordered groups needs at most
n_shards shards, and the order is cut there. The groups stay distributed: the driver holds sums over
ranges of the digest order (a bounded number) and refines only the ranges in which a cut may still
fall, with one aggregate a round, until every such range is a single group. The result is the exact
minimax capacity. A row finds its shard by comparing its digest with the cuts, without a join.
DataFrame functions only.

Cases: a null text is the empty text with 0 bytes and CRC-32 0. Rows equal in everything share a
shard and take adjacent or other slots of it in any order. With fewer groups than shards some shards
are empty. An empty table gives no rows. A group larger than an even share sets the capacity. Only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bounded
from .util import staged

#: Hex digits of the first ranges, and further digits a round; ranges held by the driver at most.
FIRST_DIGITS, MORE_DIGITS, MOST_RANGES = 3, 2, 400_000
#: Cells of a shard in which slots are counted in parallel.
CELLS = 256


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("sha"))


class _Range:
    """Groups whose digest starts with prefix: one if atomic, else any number of them."""

    __slots__ = ("atomic", "largest", "prefix", "size")

    def __init__(self, prefix: str, size: int, groups: int, largest: int):
        self.prefix, self.size, self.largest, self.atomic = prefix, size, largest, groups == 1


def _greedy(ends: list[int], start: int, capacity: int, n: int) -> list[int]:
    """Positions after which a greedy pass with this capacity cuts; fewer than n if it is done."""
    cuts = []
    while start < ends[-1] and len(cuts) < n:
        k = bisect_right(ends, start + capacity)
        if k == 0 or ends[k - 1] <= start:
            return [*cuts, -1]  # one item is over the capacity
        start = ends[k - 1]
        cuts.append(start)
    return cuts


def _search(ends: list[int], low: int, n: int) -> int:
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        cuts = _greedy(ends, 0, mid, n)
        if cuts[-1] == ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _loosest(ranges: list[_Range], ends: list[int], capacity: int, n: int) -> list[tuple[int, int]]:
    """As _greedy, where a range that isn't atomic may be cut anywhere: (position, index of the range cut into)."""
    at, out = 0, []
    while at < ends[-1] and len(out) < n:
        k = bisect_right(ends, at + capacity)
        if k == len(ends):
            out.append((ends[-1], k - 1))
            break
        to = (ends[k - 1] if k else 0) if ranges[k].atomic else at + capacity
        if to <= at:
            break
        at = to
        out.append((at, k))
    return out


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """Capacity, and for every shard but the first the smallest digest prefix in it. groups: sha, size."""

    def sums(df: DataFrame, digits: int) -> list[_Range]:
        rows = df.groupBy(F.substring("sha", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).orderBy("p").collect()
        return [_Range(*r) for r in rows]

    ranges = sums(groups, FIRST_DIGITS)
    if not ranges:
        return 0, []
    digits, low = FIRST_DIGITS, max(-(-sum(r.size for r in ranges) // n_shards), max(r.largest for r in ranges))
    while True:
        ends, at = [], 0
        for r in ranges:
            at += r.size
            ends.append(at)
        high = _search(ends, low, n_shards)  # with whole ranges only, so within reach
        a, b = low, high  # below the first capacity that is enough with cuts anywhere, none is
        while a < b:
            mid = (a + b) // 2
            done = _loosest(ranges, ends, mid, n_shards)
            a, b = (a, mid) if done and done[-1][0] == ends[-1] else (mid + 1, b)
        low = a
        #: The k-th cut lies between what the tightest and the loosest reading of the ranges reach.
        first = [x for x in _greedy(ends, 0, low, n_shards) if x >= 0]
        last = [i for _, i in _loosest(ranges, ends, high, n_shards)]
        hot: set[int] = set()
        for k, i in enumerate(last):
            start = bisect_right(ends, first[k]) if k < len(first) else (bisect_right(ends, first[-1]) if first else 0)
            hot.update(j for j in range(min(start, i), i + 1) if not ranges[j].atomic)
        if low == high and not hot or not hot:
            cuts = _greedy(ends, 0, high, n_shards)
            return high, [ranges[bisect_right(ends, c)].prefix for c in cuts[:-1]]
        step = min(MORE_DIGITS, 64 - digits)
        if len(hot) * 16**step > MOST_RANGES:
            step = 1
        prefixes = sorted(ranges[j].prefix for j in hot)
        by_length: dict[int, list[str]] = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        found: list[_Range] = []
        for length, ps in sorted(by_length.items()):
            found += sums(groups.filter(F.substring("sha", 1, length).isin(ps)), length + step)
        digits += step
        ranges = sorted([r for j, r in enumerate(ranges) if j not in hot] + found, key=lambda r: r.prefix)


def _shard(sha: Column, cuts: list[str]) -> Column:
    """The number of cuts at or before the digest, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(sha < cuts[mid], _shard(sha, cuts[:mid])).otherwise(F.lit(mid + 1) + _shard(sha, cuts[mid + 1 :]))


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row of docs."""
    rows = staged(sized(docs), "sized")
    groups = staged(rows.groupBy("sha").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, n_shards)
    placed = rows.select("*", _shard(F.col("sha"), cuts).cast("int").alias("shard")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(CELLS)).cast("int"))
    #: Slots: a cell's rows are numbered on their own and moved by the count of the shard's cells before it.
    cells = placed.groupBy("shard", "cell").count()
    before = cells.select("shard", "cell", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "sha")))
    out = numbered.join(bounded(before, n_shards * CELLS * 32), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
