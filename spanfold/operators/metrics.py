"""Evaluation metrics as aggregations (MET-*).

Inputs are long tables: ``(id, truth, prediction)`` for precision and
``(id, truth, score)`` (one row per id, or per id and class for one-vs-rest)
for ROC.  Ranks over scores come from grouped counts and a distributed prefix
sum, so no step orders all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .ranking import neighbours, prefix_sum, prefix_sums


def binary_precision(df: DataFrame, truth: str, pred: str, positive) -> DataFrame:
    """MET-1: tp / predicted positives; 0 when nothing is predicted positive."""
    pp = F.sum(F.when(F.col(pred) == F.lit(positive), 1).otherwise(0))
    tp = F.sum(F.when((F.col(pred) == F.lit(positive)) & (F.col(truth) == F.lit(positive)), 1).otherwise(0))
    return df.agg(F.coalesce(F.try_divide(tp.cast("double"), pp), F.lit(0.0)).alias("precision"))


def macro_precision(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """MET-2: mean over classes seen in truth or prediction; 0 for a class never predicted."""
    per_pred = df.groupBy(F.col(pred).alias("cls")).agg(
        F.count(F.lit(1)).alias("pp"),
        F.sum(F.when(F.col(truth) == F.col(pred), 1).otherwise(0)).alias("tp"))
    classes = df.select(F.col(truth).alias("cls")).union(df.select(F.col(pred).alias("cls"))).distinct()
    j = classes.join(per_pred, "cls", "left")
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pp")), F.lit(0.0))
    return j.agg(F.avg(p).alias("macro_precision"))


def _score_groups(df: DataFrame, truth: str, score: str, positive, by: Sequence[str]) -> DataFrame:
    """(by..., score, pos, neg) per distinct score: partial + final aggregate."""
    is_pos = F.col(truth) == F.lit(positive) if positive is not None else F.col(truth).cast("boolean")
    return df.groupBy(*by, score).agg(
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(1)).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, truth: str, score: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """MET-3: tie-aware ROC AUC (Mann-Whitney) per ``by`` group.

    AUC = sum over score levels of pos * (neg below + neg at the level / 2),
    divided by P * N.  Score levels are distinct values, so ties share half.
    """
    g = _score_groups(df, truth, score, positive, by)
    g = prefix_sum(g, "neg", [score], group_by=list(by), name="neg_below", inclusive=False)
    part = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    out = g.groupBy(*by).agg(F.sum(part).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return out.select(*by, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def macro_ovr_auc(scores: DataFrame, truth: str, cls: str, score: str) -> DataFrame:
    """MET-4: one-vs-rest AUC per class on long scores (id, truth, cls, score), averaged."""
    pos = scores.withColumn("_is", (F.col(truth) == F.col(cls)).cast("int"))
    per = roc_auc(pos, "_is", score, positive=1, by=[cls])
    return per.agg(F.avg("roc_auc").alias("macro_roc_auc"))


def roc_curve(df: DataFrame, truth: str, score: str, positive=1) -> DataFrame:
    """MET-5: (threshold, fpr, tpr) at every distinct score, highest first."""
    g = _score_groups(df, truth, score, positive, [])
    g = g.withColumn("_desc", -F.col(score))
    g = prefix_sums(g, {"tp": "pos", "fp": "neg"}, ["_desc"])
    P, N = _totals(g)
    return g.select(F.col(score).alias("threshold"),
                    F.try_divide(F.col("fp").cast("double"), F.lit(N)).alias("fpr"),
                    F.try_divide(F.col("tp").cast("double"), F.lit(P)).alias("tpr"))


def _totals(groups: DataFrame) -> tuple[int, int]:
    """(positives, negatives) of the score groups: two scalars from one aggregate."""
    r = groups.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return int(r["P"] or 0), int(r["N"] or 0)


def average_precision(df: DataFrame, truth: str, score: str, positive=1) -> DataFrame:
    """MET-6: sum over thresholds of (recall step) * precision at that threshold."""
    g = _score_groups(df, truth, score, positive, [])
    g = g.withColumn("_desc", -F.col(score))
    g = prefix_sums(g, {"tp": "pos", "fp": "neg"}, ["_desc"])
    P, _ = _totals(g)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    step = F.try_divide(F.col("pos").cast("double"), F.lit(P))
    return g.agg(F.sum(step * prec).alias("average_precision"))


def metric_grid(long: DataFrame, row: str, col: str, value: str, max_columns: int = 10_000) -> DataFrame:
    """MET-7: long metrics (row, col, value) -> one column per ``col`` value.

    The column names are collected (one per metric), so their number is checked.
    """
    names = long.select(col).distinct().limit(max_columns + 1).collect()
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} metric columns; keep the long form")
    cols = sorted(r[0] for r in names)
    return long.groupBy(row).pivot(col, cols).agg(F.first(value))


def class_roc_points(scores: DataFrame, truth: str, cls: str, score: str) -> DataFrame:
    """One-vs-rest ROC points per class: (cls, fpr, tpr_min, tpr_max), starting at (0, 0).

    Points at one false-positive rate are collapsed; tpr_min/tpr_max are the
    lowest and highest true-positive rate reached there.
    """
    pos = scores.withColumn("_is", (F.col(truth) == F.col(cls)).cast("int"))
    g = _score_groups(pos, "_is", score, 1, [cls]).withColumn("_desc", -F.col(score))
    g = prefix_sums(g, {"tp": "pos", "fp": "neg"}, ["_desc"], group_by=[cls])
    tot = g.groupBy(cls).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = g.join(F.broadcast(tot), cls)   # one row per class
    pts = pts.select(cls, F.try_divide(F.col("fp").cast("double"), F.col("_N")).alias("fpr"),
                     F.try_divide(F.col("tp").cast("double"), F.col("_P")).alias("tpr"))
    origin = tot.select(cls, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin).groupBy(cls, "fpr").agg(F.min("tpr").alias("tpr_min"),
                                                           F.max("tpr").alias("tpr_max"))


def macro_roc_curve(scores: DataFrame, truth: str, cls: str, score: str, max_classes: int = 10_000) -> DataFrame:
    """MET-5 (multi-class): mean one-vs-rest TPR on the union of all classes' FPR values.

    Each class's curve is read at every union point: the highest TPR where the
    class has that FPR, else linear interpolation between its neighbouring
    points (highest TPR on the left, lowest on the right).  The neighbours are
    carried along the points in order, across partition borders too, so the
    work is the number of (class, FPR) pairs and no class is one task.
    """
    pts = checkpoint(class_roc_points(scores, truth, cls, score))
    names = [r[0] for r in pts.select(cls).distinct().limit(max_classes + 1).collect()]
    if len(names) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    grid = pts.select("fpr").distinct().select("fpr", F.explode(F.array(*[F.lit(c) for c in names])).alias(cls))
    at = F.when(F.col("tpr_max").isNotNull(), F.struct("fpr", "tpr_min", "tpr_max"))
    rows = grid.join(pts, [cls, "fpr"], "left").select(cls, "fpr", "tpr_max", at.alias("_at"))
    near = neighbours(rows, "_at", ["fpr"], group_by=[cls], before="_lo", after="_hi")
    x0, y0, x1, y1 = F.col("_lo.fpr"), F.col("_lo.tpr_max"), F.col("_hi.fpr"), F.col("_hi.tpr_min")
    y = F.coalesce("tpr_max", y0 + (F.col("fpr") - x0) * (y1 - y0) / (x1 - x0))
    return near.select("fpr", y.alias("tpr")).groupBy("fpr").agg(F.avg("tpr").alias("tpr"))
