"""Distributed exact ranks, sampling and splits against plain Python."""

import hashlib
import math

from pyspark.sql import functions as F

from spanfold.operators.ranking import exact_rank, prefix_sum
from spanfold.operators.sampling import stratified_sample, train_test_split


def test_exact_rank_with_hot_group(spark):
    # one group holds most rows: its ranks must still be exact
    rows = [(i, "hot" if i % 4 else f"g{i % 3}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r.id: r.rank for r in exact_rank(df, ["v", "id"], group_by=["g"], num_partitions=7).collect()}
    exp = {}
    for g in {r[1] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            exp[r[0]] = k
    assert got == exp


def test_prefix_sum(spark):
    rows = [(i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.cum for r in prefix_sum(df, "v", ["k"], num_partitions=6, inclusive=False).collect()}
    acc, exp = 0, {}
    for k, v in rows:
        exp[k] = acc
        acc += v
    assert got == exp


def _md5_key(i, seed):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


def test_split_is_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in train_test_split(df, 0.2, 1289).where("split = 'test'").collect()}
    exp = set(sorted(range(103), key=lambda i: (_md5_key(i, 1289), i))[:math.ceil(0.2 * 103)])
    assert got == exp


def test_stratified_sample(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("c"))
    s = stratified_sample(df, "c", 10, 7)
    assert sorted(r[1] for r in s.groupBy("c").count().collect()) == [10, 10, 10]
    exp = set()
    for c in "012":
        ids = [i for i in range(200) if str(i % 3) == c]
        exp |= set(sorted(ids, key=lambda i: (_md5_key(i, 7), i))[:10])
    assert {r.doc_id for r in s.collect()} == exp


def test_stratified_sample_too_small(spark):
    import pytest
    df = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("c"))
    with pytest.raises(ValueError):
        stratified_sample(df, "c", 10, 1)
