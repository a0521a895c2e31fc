"""Reproducible sampling, splits and orderings (SMP-*, SRT-*, ARR-5).

Randomness is a seeded hash of the key, so results do not depend on the
partitioning: ``md5(concat(key, '-', seed))``, the same string in Spark and
DuckDB.  Ranks come from :func:`exact_rank` (range partitioning), and the n-th
key of a class from histograms over its hash digits, never from a window over
all its rows, so a class with a third of the rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .joins import sized_join
from .ranking import exact_rank


def seeded_key(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def _cut_keys(df: DataFrame, key: str, seed: int, n: int, group_by: list[str], digits: int = 3,
              few: int = 10_000) -> DataFrame:
    """The (hash, key) of the n-th row in seeded order, per group; one row per group.

    Nothing is sorted but the last bucket: a histogram over ``digits`` more
    hash digits finds the bucket that holds the n-th row (16^digits counts a
    group), until every group's bucket has at most ``few`` rows.
    """
    g = ["_g", *group_by]
    keys = df.select(F.lit(0).alias("_g"), *group_by, key, seeded_key(key, seed).alias("_h"))
    upto = F.sum("_n").over(Window.partitionBy(*g).orderBy("_p"))
    at, length = None, 0

    def inside() -> DataFrame:
        if at is None:
            return keys.withColumn("_left", F.lit(n).cast("long"))
        return sized_join(keys, at.select(*g, "_p", "_left"), g).where(F.substring("_h", 1, length) == F.col("_p")).drop("_p")

    while True:
        counts = inside().groupBy(*g, F.substring("_h", 1, length + digits).alias("_p")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left")).withColumn("_upto", upto)
        found = counts.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        at, length = checkpoint(found.select(*g, "_p", "_n", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))), length + digits
        if length >= 32 or (at.agg(F.max("_n")).first()[0] or 0) <= few:
            break
    if length >= 32:                   # rows of one whole hash are rows of one key
        return inside().groupBy(*g, "_h").agg(F.min(key).alias(key)).drop("_g")
    place = F.row_number().over(Window.partitionBy(*g).orderBy("_h", key))
    return inside().withColumn("_rn", place).where(F.col("_rn") == F.col("_left")).drop("_g", "_rn", "_left")


def _at_or_before(h: Column, k: Column, cut_h: Column, cut_k: Column) -> Column:
    return (h < cut_h) | ((h == cut_h) & (k <= cut_k))


def stratified_sample(df: DataFrame, label: str, n: int, seed: int, key: str = "doc_id",
                      max_classes: int = 1_000_000) -> DataFrame:
    """SMP-1: exactly ``n`` rows per class, without replacement.

    Raises ValueError when a class holds fewer than ``n`` rows (checked on the
    small per-class count table first).  The rows kept are those at or before
    each class's n-th (hash, key): a filter on the input after a join with a
    per-class cut table (broadcast under a checked row bound), so the rows
    themselves are never ranked or shuffled for the ranking.
    """
    sizes = df.groupBy(label).count().where(F.col("count") < n).limit(1).collect()
    if sizes:
        raise ValueError(f"class {sizes[0][label]!r} has {sizes[0]['count']} rows, fewer than {n}")
    cuts = _cut_keys(df, key, seed, n, [label]).select(
        label, F.col("_h").alias("_cut_h"), F.col(key).alias("_cut_k"))
    j = sized_join(df.withColumn("_h", seeded_key(key, seed)), cuts, [label], max_rows=max_classes)
    return j.where(_at_or_before(F.col("_h"), F.col(key), F.col("_cut_h"), F.col("_cut_k"))).drop(
        "_h", "_cut_h", "_cut_k")


def train_test_split(df: DataFrame, test_size: float, seed: int, key: str = "doc_id") -> DataFrame:
    """SMP-2: exact random split; adds ``split`` = 'test' for ceil(test_size * N) rows.

    Not stratified.  The order is the seeded hash, so the split is the same on
    any cluster layout.  Only the keys are ranked, to find the (hash, key) of
    the last test row; the split itself is a per-row comparison with that one
    cut, so the input is neither joined nor shuffled.
    """
    n = df.count()
    n_test = math.ceil(test_size * n)
    h = seeded_key(key, seed)
    if n_test == 0:
        return df.withColumn("split", F.lit("train"))
    cut = _cut_keys(df, key, seed, n_test, []).select("_h", key).first()
    test = _at_or_before(h, F.col(key), F.lit(cut["_h"]), F.lit(cut[key]))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def seeded_shuffle(df: DataFrame, seed: int, key: str = "doc_id", name: str = "shuffle_pos") -> DataFrame:
    """SMP-3: a seeded permutation; ``name`` holds the 0-based new position."""
    h = df.withColumn("_h", seeded_key(key, seed))
    return exact_rank(h, ["_h", key], name=name).withColumn(name, F.col(name) - 1).drop("_h")


def number_rows(df: DataFrame, order_by: str = "doc_id", name: str = "sentence_no") -> DataFrame:
    """ARR-5: number rows 0..n-1 in a stable order."""
    return exact_rank(df, [order_by], name=name).withColumn(name, F.col(name) - 1)


def top_k_per_group(df: DataFrame, group: str, value: str, k: int, tie: str) -> DataFrame:
    """SRT-1: the ``k`` largest ``value`` per ``group`` (ties by ``tie``).

    Groups here are documents (bounded by a row), so a partitioned window is
    the right tool.
    """
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
