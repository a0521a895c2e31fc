"""Exact ranks and prefix sums without a single-partition window.

``Window.orderBy(...)`` with no (or a low-cardinality) ``partitionBy`` pulls
every row of a group into one task; with one group holding a third of the
data that task is the job.  Here the rows are range-partitioned on
(group, order) keys instead - a hot group spans many partitions - and each
partition's place in the order comes from a tiny per-partition count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .joins import sized_join


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def exact_rank(df: DataFrame, order_by: Sequence, group_by: Sequence[str] = (),
               name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` over (partition by ``group_by`` order by ``order_by``).

    ``order_by`` must make rows unique inside a group (add a key as the last
    tie-breaker) so the numbering is deterministic.  One range shuffle, one
    written table (pins the partition layout the ranks are read from),
    and a join with a table of at most (partitions x groups) rows.
    """
    g = list(group_by)
    tagged = _ranged(df, _cols(g) + _cols(order_by), num_partitions)
    stats = tagged.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    joined = sized_join(tagged, offsets, ["_pid", *g])
    return joined.withColumn(name, F.col("_offset") + (F.col("_mid") - F.col("_first")) + 1).drop(
        "_pid", "_mid", "_first", "_offset")


def _ranged(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range-partitioned and sorted by ``keys``, written, with each row's partition and place in it."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpoint(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))


def prefix_sums(df: DataFrame, sums: dict[str, str], order_by: Sequence, group_by: Sequence[str] = (),
                inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Running sums in (group, order), distributed like :func:`exact_rank`: ``sums`` names each new column's value column.

    One range shuffle for all of them.
    """
    g = list(group_by)
    tagged = _ranged(df, _cols(g) + _cols(order_by), num_partitions)
    stats = tagged.groupBy("_pid", *g).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("_pid", *g, *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums])
    # inside a partition the rows of a group are contiguous and ordered, so a
    # window partitioned by (_pid, group) is a per-task running sum
    local = Window.partitionBy("_pid", *g).orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    tagged = tagged.withColumns({f"_l_{n}": F.coalesce(F.sum(v).over(local), F.lit(0)) for n, v in sums.items()})
    joined = sized_join(tagged, offsets, ["_pid", *g])
    return joined.withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in sums}).drop(
        "_pid", "_mid", *[f"_o_{n}" for n in sums], *[f"_l_{n}" for n in sums])


def prefix_sum(df: DataFrame, value: str, order_by: Sequence, group_by: Sequence[str] = (),
               name: str = "cum", inclusive: bool = True,
               num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` (see :func:`prefix_sums`)."""
    return prefix_sums(df, {name: value}, order_by, group_by, inclusive, num_partitions)


def neighbours(df: DataFrame, value: str, order_by: Sequence, group_by: Sequence[str] = (),
               before: str = "before", after: str = "after", num_partitions: int | None = None) -> DataFrame:
    """The nearest non-null ``value`` at or before, and at or after, each row in (group, order).

    An as-of fill over range partitions: within a partition by windows; across
    borders the last and first values of each (partition, group), a table of at
    most (partitions x groups) rows, are carried on.  No group is one task.
    """
    g = list(group_by)
    tagged = _ranged(df, _cols(g) + _cols(order_by), num_partitions)
    own = Window.partitionBy("_pid", *g).orderBy("_mid")
    back = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = tagged.withColumns({"_b": F.last(value, ignorenulls=True).over(back),
                                 "_a": F.first(value, ignorenulls=True).over(ahead)})
    place = F.when(F.col(value).isNotNull(), F.struct("_mid", F.col(value).alias("v")))
    ends = tagged.groupBy("_pid", *g).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    w = Window.partitionBy(*g).orderBy("_pid")
    carried = ends.select("_pid", *g,
                          F.last(F.col("_hi.v"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
                          F.first(F.col("_lo.v"), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"))
    joined = sized_join(filled, carried, ["_pid", *g])
    return joined.withColumns({before: F.coalesce("_b", "_cb"), after: F.coalesce("_a", "_ca")}).drop(
        "_pid", "_mid", "_b", "_a", "_cb", "_ca")
