"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, discard


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1))).alias("s")).first()
    return r["n"], r["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``; comp is the smallest node reachable.

    Each round points every node's larger neighbours, then its smaller ones, at
    the smallest node around; edges end as stars, after a number of rounds that
    grows with the logarithm of theirs.  The state lives in written tables, the
    last one deleted when the next is there; nothing but a count and a checksum
    reaches the driver.  Links with a null end are left out.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .distinct())
    state = _state(edges)
    for _ in range(10 + 8 * state[0].bit_length()):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads from a node to its root
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
