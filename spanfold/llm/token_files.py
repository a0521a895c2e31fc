"""Token ids as Parquet list columns, written in doc_id order and read back selectively.

Rows are range-partitioned by (doc_id, hash of the text) and sorted, so file k
holds the k-th range and a hot id spreads over files.  Each row has its part,
its token count, the tokens before it in its part, and the ids as a list column.
The writer sets dictionary or delta encoding for the ids, the row-group size and
the rows a page (Parquet's page index then lets a reader skip to a few rows'
pages).  Counts and places are read without touching the ids' pages; a
document's place in the whole is its place in its part plus the sum of the
parts before, a table of one row a file.

Cases: null or empty text is the end id alone; a null doc_id comes first;
repeated rows follow one another; an empty table reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from ..session import scratch_path
from .common import ID, SLICE_BYTES, TEXT, default_tokenizer, partitions_of, slices
from .word_ids import WordIds


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None,
                 encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 1000) -> None:
    """Write (part, doc_id, start_in_part, n_tokens, tokens) under ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    file = tokenizer or default_tokenizer("word_bpe_49k.json")
    rows = docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text"), F.xxhash64(TEXT).alias("h"))
    ordered = rows.repartitionByRange(partitions_of(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part_no, start = WordIds.shared(file), TaskContext.get().partitionId(), 0
        for part, _ in slices(batches, limit=SLICE_BYTES // 2):
            ids, sizes = words.encode_column(part.column("text"), end_id)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part_no, np.int32)), part.column("doc_id"),
                 pa.array(start + ends - sizes), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                                          pa.array(ids.view(np.int32)))],
                ["part", "doc_id", "start_in_part", "n_tokens", "tokens"])
            start += int(ends[-1])

    kind = docs.schema[ID].dataType.simpleString()
    out = ordered.mapInArrow(run, f"part int, doc_id {kind}, start_in_part long, n_tokens long, tokens array<int>")
    (out.write.option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens) without the ids; ``start`` counts over all documents."""
    rows = spark.read.parquet(path).select("part", "doc_id", "start_in_part", "n_tokens")
    return _placed(rows, spark, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, tokens); a filter on doc_id reaches the page index."""
    return _placed(spark.read.parquet(path), spark, path)


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row a file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rest = [c for c in rows.columns if c not in ("part", "doc_id", "start_in_part")]
    return sized_join(rows, parts, "part").select(
        "part", "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), *rest)


def ids_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` with the checksum of each row's ids (little-endian 32 bits) in place of the ids."""
    kept = [c for c in rows.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())],
                                             [*kept, "ids_crc32"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(run, fields + ", ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_tokens(docs, path, **options)
    return ids_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
