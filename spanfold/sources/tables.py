"""Readers for the driver's parquet tables and for labelled corpora.

All readers declare schemas (no inference) and return plain DataFrames, so
Catalyst prunes columns and pushes filters into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import read_csv

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Canonical split table: TARGET + text, keyed by doc_id.
SPLIT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("TARGET", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])


def read_corpus_csv(spark: SparkSession, path: str, schema: T.StructType = SPLIT_SCHEMA,
                    encoding: str = "UTF-8") -> DataFrame:
    """SRC-1 / SRC-3: labelled split from CSV with a header.

    ``multiLine`` because texts hold newlines; quotes are doubled inside
    fields; ``encoding`` covers ISO-8859-1 sources.  With line breaks inside
    fields a CSV file cannot be split: one task reads a file, so large corpora
    need many files (Spark's own writer makes one per task).
    """
    return read_csv(spark, path, schema, encoding)


def first_rows(df: DataFrame, n: int, order_col: str = "doc_id") -> DataFrame:
    """SRC-2: the first ``n`` rows in a stated order (a top-k, not a bare limit)."""
    return df.orderBy(order_col).limit(n)


class SourceSpec:
    """SRC-4: one reader for several corpora: path, encoding, text and label columns.

    ``text_cols`` of length two are combined with ``sep`` (null-aware when
    ``optional_first``).  The result is the canonical (doc_id, TARGET, text).
    """

    def __init__(self, name: str, text_cols: tuple[str, ...], label_col: str, id_col: str = "doc_id",
                 sep: str = " \n", optional_first: bool = False):
        self.name, self.text_cols, self.label_col = name, text_cols, label_col
        self.id_col, self.sep, self.optional_first = id_col, sep, optional_first

    def canonical(self, df: DataFrame) -> DataFrame:
        from ..functions.text import concat_optional, concat_title_body
        if len(self.text_cols) == 1:
            text = F.col(self.text_cols[0])
        elif self.optional_first:
            text = concat_optional(F.col(self.text_cols[0]), F.col(self.text_cols[1]), self.sep)
        else:
            text = concat_title_body(F.col(self.text_cols[0]), F.col(self.text_cols[1]), self.sep)
        return df.select(F.col(self.id_col).cast("bigint").alias("doc_id"),
                         F.col(self.label_col).cast("string").alias("TARGET"), text.alias("text"))
