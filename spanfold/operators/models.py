"""Models on vector features (MOD-*).

* :func:`standardize` - mean 0, population std, zero variance kept at scale 1.
* :func:`balanced_weights` - N / (K * n_class).
* :func:`knn` - exact k nearest neighbours of dense vectors, all pairs of bounded
  blocks, two-level top-k.  Sparse rows: ``sparse_knn``.
* :func:`fit_classifier` - ``pyspark.ml`` logistic regression, random forest
  and one-vs-rest linear SVM with the reference's parameter mapping.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, discard, scratch_path


# --- MOD-1 ------------------------------------------------------------------
def column_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """(i, mean, std) per vector position; population std."""
    long = df.select(F.posexplode(vec).alias("i", "x"))
    return long.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"),
                                 F.stddev_pop(F.col("x").cast("double")).alias("std"))


def standardize_long(df: DataFrame, stats: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, i, z): z = (x - mean) / std, std 0 treated as 1.  Stats: one row per position."""
    long = df.select(key, F.posexplode(vec).alias("i", "x"))
    j = long.join(F.broadcast(stats), "i")   # one row per vector position
    scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return j.select(key, "i", ((F.col("x").cast("double") - F.col("mean")) / scale).alias("z"))


def standardize(df: DataFrame, stats_rows: list, vec: str = "embedding", out: str = "features") -> DataFrame:
    """Array form with fitted per-position (mean, std) (dimension-bounded)."""
    means = F.array(*[F.lit(float(r["mean"])) for r in stats_rows])
    scales = F.array(*[F.lit(float(r["std"]) if r["std"] else 1.0) for r in stats_rows])
    z = F.zip_with(F.zip_with(F.col(vec), means, lambda x, m: x.cast("double") - m), scales,
                   lambda d, s: d / s)
    return df.withColumn(out, z)


def fit_scaler(train: DataFrame, vec: str = "embedding") -> list:
    """Per-position stats, ordered by position (one small collect of dim rows)."""
    return column_stats(train, vec).orderBy("i").collect()


# --- MOD-6 ------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, class_weight) = N / (K * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()   # over the per-class table (K rows)
    return counts.select(label, (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
                                 ).alias("class_weight"))


# --- MOD-2 ------------------------------------------------------------------
#: Values (rows x dimensions) of one block of train rows, of one block of queries; queries of a block at least.
ROW_VALUES, QUERY_VALUES, LEAST_QUERIES = 4_000_000, 1_000_000, 256
#: Queries and rows compared at a time: their distances stay in the processor's cache.
TILE_QUERIES, TILE_ROWS = 16, 1_024


@dataclass
class KnnParams:
    k: int = 5
    p: int = 2                      # 1 = Manhattan, 2 = Euclidean
    weights: str = "uniform"        # uniform | distance
    n_pivots: int | None = None     # not used any more: blocks are compared without pivots
    bucket_rows: int = 200_000      # train rows of a block at most


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.unique(lists.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    return lists.flatten().to_numpy().reshape(len(lists), int(sizes[0]))


def _distances(queries: np.ndarray, columns: np.ndarray, p: int) -> np.ndarray:
    """Distances of every query to every row (given by dimension), summed in the order of the dimensions."""
    out = np.zeros((len(queries), columns.shape[1]))
    for first in range(0, columns.shape[1], TILE_ROWS):
        rows = columns[:, first:first + TILE_ROWS]
        total = np.zeros((len(queries), rows.shape[1]))
        apart = np.empty_like(total)
        for q, r in zip(queries.T, rows):
            np.subtract(q[:, None], r, out=apart)
            np.abs(apart, out=apart) if p == 1 else np.multiply(apart, apart, out=apart)
            total += apart
        out[:, first:first + TILE_ROWS] = total
    return out if p == 1 else np.sqrt(out)


def _nearest_of_block(k: int, p: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of a block for each of a block's queries, by (distance, train key)."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        which, near, dists = [], [], []
        if queries.num_rows and rows.num_rows:
            # rows in the order of their keys: a stable sort by distance then breaks ties as Spark does
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("t_id", "ascending")], null_placement="at_start"))
            q, t = _matrix(queries.column("vec")), _matrix(rows.column("vec"))
            if q.shape[1] != t.shape[1]:
                raise ValueError(f"vectors of different lengths: {q.shape[1]} and {t.shape[1]}")
            columns = np.ascontiguousarray(t.T)
            for first in range(0, len(q), TILE_QUERIES):
                for j, dist in enumerate(_distances(q[first:first + TILE_QUERIES], columns, p), first):
                    some = np.arange(len(dist))
                    if len(dist) > k:
                        last = np.partition(dist, k - 1)[k - 1]
                        some = some if np.isnan(last) else np.flatnonzero(dist <= last)
                    some = some[np.argsort(dist[some], kind="stable")][:k]
                    which.append(np.full(len(some), j))
                    near.append(some)
                    dists.append(dist[some])
        which, near = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (which, near))
        return pa.table({"q_id": queries.column("q_id").take(pa.array(which)), "t_id": rows.column("t_id").take(pa.array(near)),
                         "t_label": rows.column("t_label").take(pa.array(near)),
                         "dist": pa.array(np.concatenate([np.zeros(0), *dists]), pa.float64())})

    return run


def nearest(train: DataFrame, test: DataFrame, params: KnnParams, key: str = "id", vec: str = "features",
            label: str = "label") -> DataFrame:
    """(q_id, t_id, t_label, dist) of the k nearest train rows of each block, for every test row.

    Both sides are dealt evenly into bounded blocks and a task compares one pair of blocks, so no pair but the k
    nearest leaves it.  Keys may repeat or be null; rows whose vector is null or holds a null have no distance
    and are left out.  The work is that of all pairs.
    """
    whole = F.col(vec).isNotNull() & F.forall(F.coalesce(vec, F.array()), lambda x: x.isNotNull())

    def side(df: DataFrame, *names: Column) -> tuple[DataFrame, int, int]:
        rows = checkpoint(df.where(whole).select(*names, F.col(vec).cast("array<double>").alias("vec")))
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
        return rows, r["n"], max(1, r["dims"] or 1)

    rows, n_rows, dims = side(train, F.col(key).alias("t_id"), F.col(label).alias("t_label"))
    queries, n_queries, _ = side(test, F.col(key).alias("q_id"))
    n_t = max(1, math.ceil(n_rows / max(1, min(params.bucket_rows, ROW_VALUES // dims))))
    cores = train.sparkSession.sparkContext.defaultParallelism
    n_q = max(1, math.ceil(n_queries / max(1, QUERY_VALUES // dims)),
              min(math.ceil(2 * cores / n_t), math.ceil(n_queries / LEAST_QUERIES)))
    parts = min(n_q * n_t, 100_000)

    def block(n: int) -> Column:
        return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("qb", block(n_q)).withColumn("tb", every(n_t))
    right = rows.withColumn("tb", block(n_t)).withColumn("qb", every(n_q))
    left, right = (x.repartition(parts, "qb", "tb").groupBy("qb", "tb") for x in (left, right))
    kinds = {**dict(queries.dtypes), **dict(rows.dtypes)}
    return left.cogroup(right).applyInArrow(
        _nearest_of_block(params.k, params.p),
        f"q_id {kinds['q_id']}, t_id {kinds['t_id']}, t_label {kinds['t_label']}, dist double")


def knn(train: DataFrame, test: DataFrame, params: KnnParams, key: str = "id",
        vec: str = "features", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Exact k-NN classification.  Returns (predictions, scores).

    predictions: (key, prediction); scores: (key, label, score) with the
    normalised vote share.  Neighbours tie-break by (distance, train key);
    the vote by (score desc, label).  With ``weights='distance'`` a zero
    distance takes the whole vote.
    """
    near = checkpoint(nearest(train, test, params, key, vec, label))   # all pairs are compared once: scores and predictions read it
    order = Window.partitionBy("q_id").orderBy("dist", "t_id")
    found = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= params.k).drop("_r")
    return vote(found, params.weights, key, label)


def vote(neighbours: DataFrame, weights: str, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores) from ``neighbours(q_id, t_label, dist)``: shares of the votes, best by (score, label)."""
    if weights == "distance":
        has_zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy("q_id"))
        wt = F.when(has_zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist"))
    else:
        wt = F.lit(1.0)
    votes = neighbours.withColumn("_w", wt).groupBy("q_id", "t_label").agg(F.sum("_w").alias("_v"))
    tot = Window.partitionBy("q_id")
    scores = votes.select(F.col("q_id").alias(key), F.col("t_label").alias(label),
                          (F.col("_v") / F.sum("_v").over(tot)).alias("score"))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(label))
    preds = scores.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        key, F.col(label).alias("prediction"))
    return preds, scores


# --- MOD-3 / MOD-4 / MOD-5 / MOD-7 ----------------------------------------------------
#: Nodes of a forest that are fitted, or read back, on the driver at a time.
FOREST_NODES = 600_000


def as_vector(df: DataFrame, features: str) -> Column:
    """The features column as an ``ml`` vector: arrays are turned into one, vectors stay (sparse ones sparse)."""
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.col(features)) if dict(df.dtypes)[features].startswith("array") else F.col(features)


def fit_classifier(kind: str, train: DataFrame, params: dict, features: str = "features",
                   label: str = "label", weight_col: str | None = None):
    """Fit a ``pyspark.ml`` model on array or vector features; returns the fitted model.

    log: C -> regParam = 1 / (C * n), L2, no internal standardisation.
    rf:  n_estimators, max_features ('log2' | 'sqrt' | fraction), random_state.
    svc: one-vs-rest linear SVM with balanced weights (kernel SVMs are not built).
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier

    data = train.withColumn("_fv", as_vector(train, features)).withColumn("_label", F.col(label).cast("double"))
    if kind in ("log", "svc"):
        # each task sends a sum as long as the coefficients at every step: one task a core, added up on the executors
        tasks = data.sparkSession.sparkContext.defaultParallelism
        data, depth = data.coalesce(tasks), max(2, math.ceil(math.log(max(tasks, 2), 4)))
    if kind == "log":
        n = data.count()
        est = LogisticRegression(featuresCol="_fv", labelCol="_label", regParam=1.0 / (params.get("C", 1.0) * n),
                                 elasticNetParam=0.0, standardization=False, maxIter=params.get("max_iter", 100),
                                 aggregationDepth=depth)
    elif kind == "rf":
        est = RandomForestClassifier(featuresCol="_fv", labelCol="_label", numTrees=params.get("n_estimators", 100),
                                     featureSubsetStrategy=str(params.get("max_features", "sqrt")),
                                     seed=params.get("random_state", 0), maxDepth=params.get("max_depth", 30))
        return fit_forest(est, data)
    elif kind == "svc":
        # the loss is a mean: C counts against the sum of the weights
        total = data.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0] or 1
        svc = LinearSVC(featuresCol="_fv", labelCol="_label",
                        regParam=1.0 / (max(params.get("C", 1.0), 1e-12) * total),
                        maxIter=params.get("max_iter", 50), standardization=False, aggregationDepth=depth)
        # one binary fit per class; classes are fitted concurrently
        est = OneVsRest(classifier=svc, featuresCol="_fv", labelCol="_label",
                        parallelism=params.get("parallelism", 8))
        if weight_col:
            est = est.setWeightCol(weight_col)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return est.fit(data)


@dataclass
class Forest:
    """A forest whose trees are stored in several models: the driver holds one of them at a time."""
    paths: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the rawPrediction (votes of all trees), probability and prediction of the whole forest."""
        from pyspark.ml.classification import RandomForestClassificationModel
        from pyspark.ml.functions import array_to_vector, vector_to_array

        last = None
        for path in self.paths:
            model = RandomForestClassificationModel.load(path)
            votes = vector_to_array("rawPrediction")
            if last is not None:
                votes = F.zip_with("_votes", votes, lambda a, b: a + b)
            voted = checkpoint(model.transform(df if last is None else last).select(*df.columns, votes.alias("_votes")))
            if last is not None:
                discard(last)
            last = voted
        total = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
        return last.select(*df.columns, array_to_vector("_votes").alias("rawPrediction"),
                           array_to_vector(F.transform("_votes", lambda x: x / total)).alias("probability"),
                           (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias("prediction"))


def fit_forest(est, data: DataFrame):
    """All trees of ``est``, at most ``FOREST_NODES`` nodes (one tree at least) on the driver at a time.

    A tree has fewer than two nodes for each distinct row of its bootstrap sample (1.27 a train row).  If all trees
    stay below the bound, they are fitted at once.  Otherwise they are fitted in groups, each stored and
    dropped, and the nodes of the trees fitted so far tell how many come next.
    """
    trees = est.getNumTrees()
    a_tree = min(1.27 * max(1, data.count()), 2.0 ** (est.getMaxDepth() + 1))
    if trees * a_tree <= FOREST_NODES:
        return est.fit(data)
    rows = checkpoint(data.select(est.getFeaturesCol(), est.getLabelCol()))   # read by every group
    folder, paths, done, nodes = scratch_path(data.sparkSession, "forest"), [], 0, 0
    while done < trees:
        some = min(trees - done, max(1, int(FOREST_NODES / a_tree)))
        model = est.copy({est.numTrees: some, est.seed: est.getSeed() + done}).fit(rows)
        paths.append(f"{folder}/{len(paths)}")
        model.write().save(paths[-1])
        done, nodes = done + some, nodes + model.totalNumNodes
        a_tree = nodes / done
        del model
    discard(rows)
    return Forest(paths)


def random_fourier_features(df: DataFrame, dim: int, n_components: int = 128, gamma: float | None = None,
                            seed: int = 12890, vec: str = "features", out: str = "features") -> DataFrame:
    """MOD-5 (rbf): z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    A linear model on z approximates an RBF-kernel model.  W is a seeded
    (D x dim) literal - bounded by the parameters, not by the data - so the
    projection is one in-row expression, no join.  ``gamma`` defaults to
    1 / dim (unit-variance inputs).
    """
    g = gamma if gamma is not None else 1.0 / dim
    rng = np.random.default_rng(seed)
    w = (rng.normal(size=(n_components, dim)) * math.sqrt(2.0 * g)).tolist()
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components).tolist()
    scale = math.sqrt(2.0 / n_components)
    x = F.col(vec)

    def project(row: Column, i: Column) -> Column:
        dot = F.aggregate(F.zip_with(row, x, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
        return F.cos(dot + F.try_element_at(F.lit(b), i + 1)) * scale

    return df.withColumn(out, F.transform(F.lit(w), project))


def predict(model, df: DataFrame, key: str, features: str = "features") -> DataFrame:
    data = df.withColumn("_fv", as_vector(df, features))
    out = model.transform(data)
    return out.select(key, F.col("prediction").cast("int").alias("prediction"))
