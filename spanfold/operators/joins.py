"""Join helpers: broadcast only behind a checked size, shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a broadcast side; a table above either is joined by shuffle.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20


def table_size(df: DataFrame) -> tuple[int, int]:
    """(rows, about how many bytes), from one distributed aggregate."""
    def width(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.greatest(F.size(name), F.lit(0)) * 24
        return F.lit(8)

    total = sum((width(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(8))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total.cast("long")).alias("bytes")).first()
    return r["n"], r["bytes"] or 0


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join with ``right`` broadcast when it holds at most ``max_rows`` rows and ``max_bytes`` bytes.

    Beyond the bounds the join is left to the planner (sort-merge; AQE may
    still switch it to a broadcast at run time and splits skewed partitions).
    """
    rows, size = table_size(right)
    if rows <= max_rows and size <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def _hot_weight(table: DataFrame, weight_col: str, max_rows: int, max_bytes: int = BROADCAST_MAX_BYTES) -> int | None:
    """The least weight (1,024 at most) whose rows fit a broadcast, from a histogram of 1,024 rows at most; else None."""
    total = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8)
                 for f in table.schema), F.lit(8))
    weight = F.least(F.floor(weight_col), F.lit(1024)).cast("int")
    counts = table.groupBy(weight.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(total.cast("long")).alias("bytes"))
    rows, size, least = 0, 0, None
    for r in counts.where("w IS NOT NULL").orderBy(F.col("w").desc()).collect():
        rows, size = rows + r["n"], size + r["bytes"]
        if rows > max_rows or size > max_bytes:
            break
        least = r["w"]
    return least


def skew_safe_lookup(rows: DataFrame, table: DataFrame, key: str, weight_col: str,
                     table_rows: int, total_weight: float, max_rows: int = BROADCAST_MAX_ROWS,
                     salt_buckets: int = 4096, how: str = "inner", stored: bool = False) -> DataFrame:
    """Inner (or left) lookup of ``rows`` in ``table`` (unique ``key``), safe for hot keys.

    * small table (checked rows and bytes): one broadcast hash join, no shuffle.
    * large table: keys whose ``weight_col`` (their row share in ``rows``) is
      at least ``total_weight / max_rows`` are "hot"; there are at most
      ``max_rows`` of them, so they are broadcast.  All other keys take a
      shuffle join in which hot rows carry a spread-out dummy key, so no
      single key can pile up in one task.
    * large table, ``stored`` rows (cheap to read twice): as many of the most
      frequent keys as a broadcast holds are looked up in place; only rows of
      the other, rare keys are shuffled.
    """
    if table_rows <= max_rows and (not table_rows or table_size(table)[1] <= BROADCAST_MAX_BYTES):
        return rows.join(F.broadcast(table), key, how)
    if weight_col not in table.columns:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(weight_col))
        table, total_weight = table.join(counts, key), rows.count()
    threshold = max(1.0, float(total_weight) / max_rows)
    value_cols = [c for c in table.columns if c != key]
    if stored:
        least = _hot_weight(table, weight_col, max_rows)
        hot = F.col(weight_col) >= (threshold if least is None else least)
        columns, often = [*rows.columns, *value_cols], table.where(hot)
        there = rows.join(F.broadcast(often), key).select(*columns)
        rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.where(~hot), key, how).select(*columns)
        return there.unionByName(rest)
    hot = table.where(F.col(weight_col) >= threshold)
    cold = table.where(F.col(weight_col) < threshold)
    hot_cols = [F.col(c).alias(f"_hot_{c}") for c in value_cols]
    step1 = rows.join(F.broadcast(hot.select(F.col(key), *hot_cols, F.lit(True).alias("_is_hot"))),
                      key, "left")
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salt_buckets)).cast("string")
    step1 = step1.withColumn("_k1", is_hot).withColumn(
        "_k2", F.when(is_hot, salt).otherwise(F.col(key)))
    cold_side = cold.select(F.lit(False).alias("_k1"), F.col(key).alias("_k2"),
                            *[F.col(c).alias(f"_cold_{c}") for c in value_cols])
    step2 = step1.join(cold_side, ["_k1", "_k2"], "left")
    out = step2.select(*[F.col(c) for c in rows.columns],
                       *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c)
                         for c in value_cols],
                       (F.col("_is_hot").isNotNull() | F.col(f"_cold_{value_cols[0]}").isNotNull()
                        ).alias("_found"))
    return (out if how == "left" else out.where("_found")).drop("_found")
