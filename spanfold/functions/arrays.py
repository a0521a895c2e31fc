"""Array -> rows helpers.

``explode`` makes Catalyst infer ``size(arr) > 0 AND arr IS NOT NULL`` and
push that filter below the projections that build ``arr`` - inlining, for a
text pipeline, every cleaning step into one predicate.  ``explode_outer``
infers nothing; the null row it emits for an empty array is dropped right
after the generator, where no pushdown can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr: Column, name: str, *keep) -> DataFrame:
    """One row per element of ``arr`` (documents with an empty array vanish)."""
    return df.select(*keep, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, arr: Column, pos: str, name: str, *keep) -> DataFrame:
    """Like :func:`explode_rows` with the 0-based position in ``pos``."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, name)).where(F.col(pos).isNotNull())


def barrier(df: DataFrame, col: str) -> DataFrame:
    """Optimizer barrier on ``col``: a projection Catalyst neither inlines into
    its consumers nor pushes filters through.

    Per-document pipelines (cleaning, tagging) reference a step's output
    several times; a pushed-down predicate such as an inferred
    ``isnotnull(size(pairs))`` would otherwise carry the whole chain, with every
    step re-evaluated per reference.  The guard ``spark_partition_id() >= 0``
    is always true (the value is unchanged) but nondeterministic, which stops
    both CollapseProject and predicate pushdown at this projection.  (A
    ``rand() >= 0`` guard would be folded away by the optimizer.)
    """
    return df.withColumn(col, F.when(F.spark_partition_id() >= F.lit(0), F.col(col)))
