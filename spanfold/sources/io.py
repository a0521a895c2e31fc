"""Sinks and stored representations (SNK-1..4, SRC-5, SRC-6).

A representation is stored long and keyed, not as a dense matrix:
``weights/`` (doc_id, term, weight) and ``targets/`` (doc_id, TARGET) of each
split, and one ``vocabulary/`` (term, feature_idx where known), all Parquet.  Counts are checked with
aggregates, never by collecting the data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, table_size
from ..session import write_table


# nulls are written as \N so that an empty string reads back as an empty string
NULL_TOKEN = "\\N"


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists",
              encoding: str = "UTF-8") -> None:
    """SNK-1: CSV with header; quotes doubled; blanks kept; texts may hold newlines.

    ``partition_by`` columns become folders: a reader that filters on them opens no other folder.
    """
    w = (df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", NULL_TOKEN)
         .option("encoding", encoding)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("encoding", encoding).option("nullValue", NULL_TOKEN)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "FAILFAST").csv(path))


def _folder(path: str, split: str | None) -> str:
    return path if split is None else f"{path}/{split}"


def save_representation(path: str, weights: DataFrame, targets: DataFrame, vocabulary: DataFrame,
                        mode: str = "errorifexists", shape_only: bool = False, split: str | None = None) -> None:
    """SNK-2 (+ SNK-3 guard): save or check the vocabulary, then write weights and targets.

    ``path`` names one dataset and state; its splits ("train", "test", ...) are
    sub-folders that share one vocabulary.
    """
    validate_or_save_vocabulary(vocabulary, f"{path}/vocabulary", shape_only=shape_only)
    write_table(weights.select("doc_id", "term", "weight"), f"{_folder(path, split)}/weights", mode)
    write_table(targets.select("doc_id", "TARGET"), f"{_folder(path, split)}/targets", mode)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where the path is missing; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def validate_or_save_vocabulary(vocab: DataFrame, path: str, shape_only: bool = False) -> DataFrame:
    """SNK-3: first call writes the vocabulary; later calls must match it.

    Default: the term sets must be equal (``exceptAll`` both ways is empty).
    ``shape_only=True`` compares only the number of terms.  The feature index is
    stored along with the terms where the vocabulary has one.
    """
    spark = vocab.sparkSession
    stored = _stored(spark, path)
    if stored is None:
        vocab.select("term", *(c for c in ("feature_idx",) if c in vocab.columns)).write.parquet(path)
        return spark.read.parquet(path)
    if shape_only:
        a, b = stored.count(), vocab.count()
        if a != b:
            raise AssertionError(f"vocabulary size {b} differs from stored {a}")
        return stored
    diff = stored.select("term").exceptAll(vocab.select("term")).unionByName(
        vocab.select("term").exceptAll(stored.select("term"))).limit(1).collect()
    if diff:
        raise AssertionError(f"vocabulary differs from stored one, e.g. {diff[0]['term']!r}")
    return stored


def read_representation(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-5: weights with feature names and the target attached.

    A document without weights stays, with null ``term`` and ``weight``.
    Checks: every weight's term is in the vocabulary and every document of
    the weights has a target (anti joins must be empty).  Only distinct terms and
    ids are shuffled for the checks, and the weights stay in place where the
    targets fit a broadcast.
    """
    w = spark.read.parquet(f"{_folder(path, split)}/weights")
    t = spark.read.parquet(f"{_folder(path, split)}/targets")
    v = spark.read.parquet(f"{path}/vocabulary").select("term")
    ids = w.select("doc_id").distinct()
    if w.select("term").distinct().join(v, "term", "left_anti").limit(1).count():
        raise AssertionError("weights hold a term outside the vocabulary")
    if ids.join(t, "doc_id", "left_anti").limit(1).count():
        raise AssertionError("weights hold a document without target")
    n, size = table_size(t)
    if n > BROADCAST_MAX_ROWS or size > BROADCAST_MAX_BYTES:
        return t.join(w, "doc_id", "left").select("doc_id", "term", "weight", "TARGET")
    columns = ["doc_id", "term", "weight", "TARGET"]
    empty = t.join(ids, "doc_id", "left_anti").withColumns({c: F.lit(None).cast(w.schema[c].dataType) for c in ("term", "weight")})
    return w.join(F.broadcast(t), "doc_id").select(*columns).unionByName(empty.select(*columns))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The stored vocabulary (term, feature_idx) of a representation."""
    return spark.read.parquet(f"{path}/vocabulary")


def save_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-4: metric tables as CSV."""
    write_csv(df, path, mode=mode)


PREDICTION_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                                  T.StructField("prediction", T.StringType())])


SCORE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cls", T.StringType()),
                             T.StructField("score", T.DoubleType())])


def save_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SRC-6: class scores, a row per document and class."""
    write_csv(scores.select("doc_id", "cls", "score"), path, mode=mode)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SCORE_SCHEMA)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: predictions keyed by doc_id."""
    return read_csv(spark, path, PREDICTION_SCHEMA)
