"""Session settings, written tables and the size check of broadcasts."""

import os

from pyspark.sql import functions as F
import pytest

from spanfold.operators.joins import sized_join, skew_safe_lookup, table_size
from spanfold.session import checkpoint, discard, scale_conf


def test_settings_grow_with_the_input():
    small, large = scale_conf(1e9, 2), scale_conf(100e12, 1000, 4, 16.0)
    assert small["spark.sql.shuffle.partitions"] == "16"              # two waves of the cores
    assert 370_000 < int(large["spark.sql.shuffle.partitions"]) < 375_000
    assert large["spark.sql.files.maxPartitionBytes"] == "64m" and scale_conf(1e9, 2, 32, 16.0)["spark.sql.files.maxPartitionBytes"] == "32m"


def test_written_tables_are_read_back_and_deleted(spark):
    df = checkpoint(spark.range(10).select("id", F.array(F.lit("x")).alias("a"), F.lit(None).cast("string").alias("n")))
    path = df._written_at
    assert df.count() == 10 and df.where("n IS NULL").count() == 10
    assert os.path.isdir(path.removeprefix("file:"))
    discard(df)
    discard(df)
    assert not os.path.isdir(path.removeprefix("file:"))
    assert checkpoint(spark.range(5).where("id > 9")).count() == 0


def test_broadcast_only_below_rows_and_bytes(spark):
    left = spark.range(50).select(F.col("id").alias("k"))
    right = spark.range(20).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    rows, size = table_size(right)
    assert rows == 20 and 20_000 < size < 25_000
    assert "strategy=broadcast" in str(sized_join(left, right, "k")._jdf.queryExecution().analyzed())
    for limits in ({"max_rows": 19}, {"max_bytes": 1000}):
        assert "strategy=broadcast" not in str(sized_join(left, right, "k", **limits)._jdf.queryExecution().analyzed())
        assert sized_join(left, right, "k", **limits).count() == 20


def test_left_lookup_keeps_rows_without_an_entry(spark):
    rows = spark.createDataFrame([(1, "hot")] * 30 + [(2, "cold"), (3, "none")], "i int, k string")
    table = spark.createDataFrame([("hot", 7, 30), ("cold", 8, 1), ("other", 9, 1)], "k string, v int, n long")
    for max_rows in (100, 1):
        got = skew_safe_lookup(rows, table, "k", "n", 3, 32, max_rows=max_rows, how="left")
        assert sorted((r["i"], r["v"]) for r in got.collect() if r["i"] > 1) == [(2, 8), (3, None)]
        assert got.where("i = 1 AND v = 7").count() == 30


@pytest.mark.parametrize("how", ["inner", "left"])
def test_stored_rows_of_frequent_keys_stay_in_place(spark, how):
    table = spark.createDataFrame([("a", 1, 2000), ("b", 2, 30), ("c", 3, 30), ("d", 4, 1)], "k string, v int, n long")
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "a", "b", "c", "d", "d", "z", None])], "k string, i int")
    for most in (1, 2, 3, 10):
        got = skew_safe_lookup(rows, table, "k", "n", 4, 2061, max_rows=most, how=how, stored=True)
        assert got.columns == ["k", "i", "v", "n"]
        expected = {(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)} | ({(6, None), (7, None)} if how == "left" else set())
        assert {(r.i, r.v) for r in got.collect()} == expected
