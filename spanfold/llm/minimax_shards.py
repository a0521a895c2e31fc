"""Sharding by minimax contiguous partition, with DataFrame operations only.

Equal texts form a group; groups are ordered by their smallest doc_id.  The
smallest capacity for which the groups, taken in order, fill at most ``shards``
shards is found by binary search; each capacity is checked greedily (fill a
shard as far as it goes, then start the next), and the cuts of the smallest one
are used.

The check needs only, for a position x, the last group end at or before x.
Group ends are running sums (distributed).  They are summarised into at most
``buckets`` buckets (first end, last end, count: all that reaches the driver).
On the summary the search gives a bracket: cutting at known ends only is
feasible for the whole too; letting a shard end anywhere inside a bucket is a
lower bound.  Only buckets that the two greedy runs can touch are summarised
again, finer, until nothing there is unknown; then the capacity is exact.

Cases: a null text is an empty text; a null doc_id sorts first; repeated rows
are rows of one group; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import exact_rank, prefix_sum
from ..session import checkpoint
from .common import ID, TEXT


class _Ends:
    """What is known of the group ends: buckets (first end, last end, count), in order."""

    def __init__(self, buckets: list[tuple[int, int, int]]):
        self.buckets = sorted(buckets)
        self.known = sorted({x for a, b, _ in buckets for x in (a, b)})
        self.firsts = [b[0] for b in self.buckets]

    def at_least(self, x: int) -> int:
        """The last known end at or before x."""
        k = bisect_right(self.known, x)
        return self.known[k - 1] if k else 0

    def inside(self, x: int) -> int | None:
        """The bucket with unknown ends around x, if there is one."""
        k = bisect_right(self.firsts, x) - 1
        if k >= 0:
            a, b, n = self.buckets[k]
            if n > 2 and a < x < b:
                return k
        return None

    def at_most(self, x: int) -> int:
        """No group end at or before x lies beyond this."""
        return x if self.inside(x) is not None else self.at_least(x)


def _path(reach, capacity: int, shards: int, total: int) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards):
        at = min(total, reach(at + capacity))
        cuts.append(at)
    return cuts


def _smallest(reach, shards: int, least: int, total: int) -> int:
    lo, hi = least, total
    while lo < hi:
        mid = (lo + hi) // 2
        if _path(reach, mid, shards, total)[-1] >= total:
            hi = mid
        else:
            lo = mid + 1
    return lo


def minimax_cuts(ends: DataFrame, shards: int, total: int, largest: int, buckets: int = 1 << 16) -> list[int]:
    """The ``shards`` greedy cuts (group ends) at the smallest feasible capacity; column ``cum``."""

    def summary(rows: DataFrame, width: int, starts: list[int]) -> list[tuple[int, int, int]]:
        span = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda x: x <= F.col("cum")))
        got = rows.groupBy(span.alias("span"), F.expr(f"(cum - 1) div {width}").alias("b")).agg(
            F.min("cum").alias("a"), F.max("cum").alias("z"), F.count(F.lit(1)).alias("n")).collect()
        return [(r["a"], r["z"], r["n"]) for r in got]

    known = _Ends(summary(ends, max(1, -(-total // buckets)), [0]))
    least = max(largest, -(-total // shards))
    while True:
        low = _smallest(known.at_most, shards, least, total)
        high = _smallest(known.at_least, shards, low, total)
        a, b = _path(known.at_least, low, shards, total), _path(known.at_most, high, shards, total)
        # buckets with unknown ends that some capacity of the bracket can reach
        open_ = sorted({k for x, y in zip(a, b) for k in _between(known, x, y)})
        if not open_:
            return _path(known.at_least, high, shards, total)
        spans: list[list[int]] = []
        for k in open_:
            first, last, _ = known.buckets[k]
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = [last, k]
            else:
                spans.append([first, last, k])
        widest = max(known.buckets[k][1] - known.buckets[k][0] for k in open_)
        width = max(1, min(-(-sum(z - x + 1 for x, z, _ in spans) // buckets), widest // 2))
        where = reduce(lambda p, q: p | q, [F.col("cum").between(x, z) for x, z, _ in spans])
        gone = set(open_)
        known = _Ends([x for k, x in enumerate(known.buckets) if k not in gone] 
                      + summary(ends.where(where), width, [x for x, _, _ in spans]))


def _between(known: _Ends, x: int, y: int) -> range | list[int]:
    lo = max(0, bisect_right(known.firsts, x) - 1)
    hi = bisect_right(known.firsts, y)
    return [k for k in range(lo, hi) if known.buckets[k][2] > 2 and known.buckets[k][1] > x]


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    text = F.coalesce(F.col(TEXT), F.lit(""))
    rows = checkpoint(docs.select(
        F.col(ID).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"))
    ends = prefix_sum(groups, "bytes", ["first", "key"], name="cum")
    ends = checkpoint(ends.select("key", "bytes", F.col("cum").cast("long").alias("cum")))
    total, largest = ends.agg(F.max("cum"), F.max("bytes")).first()
    cuts = minimax_cuts(ends, shards, total, largest) if total else [0] * shards
    place = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c < F.col("cum")))
    placed = rows.join(ends.select("key", place.alias("shard")), "key")
    return exact_rank(placed, ["doc_id", "key"], ["shard"], name="slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))
