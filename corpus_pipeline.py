"""A training-data pipeline over ``documents``: five stages, each one operator.

language ID -> quality rules -> near duplicates -> personal data -> packing.
Each stage reads what the one before kept; all but the last return the columns
of documents.

Cases: texts that are null, empty or without a letter go in the first stage; a
null doc_id, source or lang is a value like others (source null is one host); of
equal or near equal texts, repeated rows included, one row stays; very long
texts are handled whole; extra columns, whatever their names, are carried to the
last stage; an empty table gives empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import partenum, quality_lines, rank_order_langid, semi_crf_pii, sum_of_squares
from spanfold.session import scratch_path

#: Least score where no language has enough labelled rows to learn one; documents without a letter go anyway.
MIN_LANGUAGE_SCORE = 0.1

#: Lines of so many words that 20 documents of a host share go, whatever their share of the host.
LONG_LINE_WORDS = 8


#: Documents handed to Python at a time: whole texts of 10,000 rows (Spark's default) take most of a small worker's memory.
ARROW_ROWS = 2_000


def _few_at_a_time(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language (op 5).

    Profiles come from the labelled rows of ``docs``, each language's least score from
    those held out of the profiles; a language with too few of them takes the smallest of the others'.
    """
    _few_at_a_time(spark)
    held_out = rank_order_langid.held_out()
    profiles = rank_order_langid.learn(docs.where(~held_out))
    limits = rank_order_langid.least_scores(docs.where(held_out), profiles)
    found = rank_order_langid.predict(docs, profiles, ("__lang", "__score"))
    least = F.lit(min(limits.values(), default=MIN_LANGUAGE_SCORE))
    for lang, score in sorted(limits.items()):
        least = F.when(F.col("__lang") == lang, F.lit(score)).otherwise(least)
    known = (F.col("__lang") != rank_order_langid.UND) & (F.col("__score") >= least)
    return found.where(known).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines common to a host's documents and rejects depleted documents (op 1)."""
    _few_at_a_time(spark)
    return quality_lines.clean(docs, long_words=LONG_LINE_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (op 8)."""
    _few_at_a_time(spark)
    return partenum.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind (op 4)."""
    _few_at_a_time(spark)
    return semi_crf_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences (op 9)."""
    _few_at_a_time(spark)
    return sum_of_squares.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

#: Learnt profiles, a learnt field and library token ids: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
