"""Metrics and k-NN against brute force on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from spanfold.operators import metrics as M
from spanfold.operators import models as ML


def _auc(truth, score):
    pos = [s for t, s in zip(truth, score) if t]
    neg = [s for t, s in zip(truth, score) if not t]
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_roc_auc_with_ties(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random() < 0.4, float(rnd.randint(0, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    got = M.roc_auc(df, "y", "s", positive=1).first().roc_auc
    assert abs(got - _auc([r[1] for r in rows], [r[2] for r in rows])) < 1e-12


def test_precision(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (1, 1)], "t int, p int")
    assert abs(M.binary_precision(df, "t", "p", 1).first()[0] - 2 / 3) < 1e-12
    none = spark.createDataFrame([(1, 0)], "t int, p int")
    assert M.binary_precision(none, "t", "p", 1).first()[0] == 0.0


def test_macro_precision_counts_unpredicted_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "t string, p string")
    # classes a, b, c: precision a = 1/2, b = 0 (never predicted), c = 1
    assert abs(M.macro_precision(df, "t", "p").first()[0] - 0.5) < 1e-12


def test_knn_exact_against_brute_force(spark):
    rnd = random.Random(5)
    train = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randint(0, 2)) for i in range(300)]
    test = [(1000 + i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    tr = spark.createDataFrame(train, "id long, features array<double>, label int")
    te = spark.createDataFrame(test, "id long, features array<double>")
    for p, weights in ((2, "uniform"), (1, "distance")):
        params = ML.KnnParams(k=7, p=p, weights=weights, n_pivots=9, bucket_rows=50)
        got = {r.id: r.prediction for r in ML.knn(tr, te, params)[0].collect()}
        for qid, qv in test:
            d = sorted(((sum(abs(a - b) ** p for a, b in zip(qv, tv)) ** (1 / p), tid, lab)
                        for tid, tv, lab in train))[:7]
            votes = {}
            for dist, _, lab in d:
                votes[lab] = votes.get(lab, 0) + (1.0 if weights == "uniform" else 1 / dist)
            best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
            assert got[qid] == best


def test_knn_in_blocks_with_null_and_repeated_keys(spark, monkeypatch):
    """Both sides in several blocks, ties, copies, null keys and rows without a whole vector; k rows a query and block leave a task."""
    monkeypatch.setattr(ML, "ROW_VALUES", 60)
    monkeypatch.setattr(ML, "QUERY_VALUES", 14)
    rnd = random.Random(9)
    train = [(i % 90 if i % 30 else None, [float(rnd.randint(0, 4)) for _ in range(2)], rnd.randint(0, 2)) for i in range(120)]
    test = [(1000 + i % 25 if i % 10 else None, [float(rnd.randint(0, 4)) for _ in range(2)]) for i in range(40)]
    odd = [(7, None), (8, [1.0, None])]
    tr = spark.createDataFrame([*train, *((i, v, 0) for i, v in odd)], "id long, features array<double>, label int")
    te = spark.createDataFrame([*test, *odd], "id long, features array<double>")
    for p in (1, 2):
        near = ML.nearest(tr, te, ML.KnnParams(k=5, p=p))
        pairs = [(r.q_id, r.t_id, r.dist) for r in near.collect()]
        assert len(pairs) == 40 * 5 * 4                                       # 120 rows in 4 blocks of 30
        got = {(r.id, r.label): r.score for r in ML.knn(tr, te, ML.KnnParams(k=5, p=p, weights="distance"))[1].collect()}
        for qid in {q for q, _ in test}:
            all_pairs = sorted((sum(abs(a - b) ** p for a, b in zip(qv, tv)) ** (1 / p), -1 if tid is None else tid)
                               for q, qv in test if q == qid for tid, tv, _ in train)
            mine = sorted((d, -1 if t is None else t) for q, t, d in pairs if q == qid)
            assert [(round(d, 9), t) for d, t in mine[:5]] == [(round(d, 9), t) for d, t in all_pairs[:5]]
            assert abs(sum(s for (i, _), s in got.items() if i == qid) - 1) < 1e-9
        assert {i for i, _ in got} == {q for q, _ in test}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    got = {r.label: r.class_weight for r in ML.balanced_weights(df, "label").collect()}
    assert math.isclose(got[0], 4 / 6) and math.isclose(got[1], 2.0)


def test_random_fourier_features_approximate_rbf_kernel(spark):
    rnd = random.Random(11)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    z = {r.id: r.features for r in ML.random_fourier_features(df, 4, n_components=4000, gamma=0.3, seed=3).collect()}
    for (i, x), (j, y) in zip(rows, rows[1:]):
        approx = sum(a * b for a, b in zip(z[i], z[j]))
        exact = math.exp(-0.3 * sum((a - b) ** 2 for a, b in zip(x, y)))
        assert abs(approx - exact) < 0.06


def test_macro_roc_curve_matches_interpolation(spark):
    import numpy as np
    rnd = random.Random(8)
    classes = ["a", "b", "c"]
    rows = []
    for i in range(150):
        t = rnd.choice(classes)
        for c in classes:
            rows.append((i, t, c, float(rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "id long, truth string, cls string, score double")
    got = {round(r.fpr, 9): r.tpr for r in M.macro_roc_curve(df, "truth", "cls", "score").collect()}
    curves = {}
    for c in classes:
        sc = [(s, t == c) for i, t, cc, s in rows if cc == c]
        P = sum(1 for _, p in sc if p)
        N = len(sc) - P
        fpr, tpr, tp, fp = [0.0], [0.0], 0, 0
        for level in sorted({s for s, _ in sc}, reverse=True):
            tp += sum(1 for s, p in sc if s == level and p)
            fp += sum(1 for s, p in sc if s == level and not p)
            fpr.append(fp / N)
            tpr.append(tp / P)
        curves[c] = (fpr, tpr)
    xs = sorted({x for f, _ in curves.values() for x in f})
    exp = {round(x, 9): float(np.mean([np.interp(x, f, t) for f, t in curves.values()])) for x in xs}
    assert set(got) == set(exp)
    assert all(abs(got[x] - exp[x]) < 1e-9 for x in exp)


def test_linear_models_are_fitted_in_one_task_a_core(spark, monkeypatch):
    """However many partitions the rows come in: every task sends a sum as long as the coefficients at each step."""
    from pyspark.ml.classification import LogisticRegression
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"),
                                 F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("features")).repartition(50)
    model = ML.fit_classifier("log", df, {"C": 1.0})
    assert seen == [spark.sparkContext.defaultParallelism]
    assert ML.predict(model, df, "id").where("prediction <> id % 2").count() == 0


def test_a_large_forest_is_fitted_and_read_a_few_trees_at_a_time(spark, monkeypatch):
    """As many trees as asked for, never more nodes at once than the bound; the votes are those of all trees."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.functions import vector_to_array
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randint(0, 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    monkeypatch.setattr(ML, "FOREST_NODES", 600)
    model = ML.fit_classifier("rf", df, {"n_estimators": 7, "random_state": 3})
    groups = [RandomForestClassificationModel.load(p) for p in model.paths]
    assert sum(g.getNumTrees for g in groups) == 7 and len(groups) < 7
    assert all(g.totalNumNodes <= 750 for g in groups) and sum(g.totalNumNodes for g in groups) > 600
    data = df.withColumn("_fv", ML.as_vector(df, "features"))
    votes = {}
    for g in groups:
        for r in g.transform(data).collect():
            votes[r.id] = [a + b for a, b in zip(votes.get(r.id, [0.0] * 3), r.rawPrediction)]
    found = model.transform(data).select("id", "label", vector_to_array("probability").alias("p"), "prediction").collect()
    assert len(found) == 200
    for r in found:
        assert all(abs(a - b / 7) < 1e-9 for a, b in zip(r.p, votes[r.id]))
        assert r.prediction == max(range(3), key=lambda c: (votes[r.id][c], -c))
    assert sum(r.prediction == r.label for r in found) > 160      # seven trees leave some rows out of most samples
    monkeypatch.undo()
    assert ML.fit_classifier("rf", df, {"n_estimators": 7, "random_state": 3}).getNumTrees == 7     # all at once
