"""Operator 13: segments by definition, the extreme-value law, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from spanfold.llm import toxic_passages as tp

from tests.llm.tables import frame, odd_rows, words


def all_maximal(scores):
    """The highest-scoring stretch (shortest, first), then the same left and right of it."""
    def cut(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (best is None or (total, -(b - a)) > (best[2], -(best[1] - best[0] - 1))):
                    best = (a, b + 1, total)
        return cut(lo, best[0]) + [best] + cut(best[1], hi) if best else []
    return cut(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice((-3, -2, -1, -0.5, 0, 0.5, 1, 2, 5)) + rng.random() / 64 for _ in range(rng.randrange(0, 24))]
        got = tp.segments(np.array(scores, float))
        want = all_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_long_rows_take_linear_time():
    falling = np.tile([1.0, -1.5], 300_000)                  # each segment stands alone, none merges
    rising = np.tile([2.0, -1.0], 300_000)                   # every new one merges with all before
    assert len(tp.segments(falling)) == 300_000
    assert tp.segments(rising) == [(0, 599_999, 300_001.0)]


def test_extreme_law_is_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 3000, 4000).astype(float)
    best = (np.log(0.3 * n) - np.log(-np.log(rng.random(4000)))) / 1.7
    rate, factor = tp.extreme_law(n, best)
    assert abs(rate - 1.7) < 0.1 and abs(math.log(factor / 0.3)) < 0.5


def test_evidence_grows_with_the_scores_however_high():
    model = tp.Model(rate=3.0, factor=0.01)
    found = [model.evidence(100, [s])[0] for s in (0.001, 0.5, 1, 2, 5, 8, 9, 50, 400, 2000)]
    assert found == sorted(found) and found[0] >= 0 and math.isfinite(found[-1])
    assert model.evidence(100, [6.0, 6.0])[0] > model.evidence(100, [6.0])[0]
    assert model.evidence(0, []) == (0.0, 0)


def test_word_scores_follow_the_counts(spark):
    rows = [("idiot and the", 1)] * 6 + [("the and of", 0)] * 14 + [("idiot of", 0)] + [("rare", 1)]
    got = tp.word_scores(spark.createDataFrame(rows, "text string, toxic int"), prior=0.1, pseudo=1.0)
    bad, good = {"idiot": 6, "and": 6, "the": 6, "rare": 1}, {"the": 14, "and": 14, "of": 15, "idiot": 1}
    share = {1: 19 / 63, 0: 44 / 63}
    for w in ("idiot", "and", "the", "of"):
        pooled = 0.1 * (bad.get(w, 0) + good.get(w, 0)) + 1.0
        a, b = bad.get(w, 0) + share[1] * pooled, good.get(w, 0) + share[0] * pooled
        odds = math.log(a / share[1]) - math.log(b / share[0])
        want = math.copysign(max(0.0, abs(odds) - math.sqrt(1 / a + 1 / b)), odds)
        assert got.get(w, 0.0) == pytest.approx(want)
    assert "rare" not in got


def made(n=900):
    rng = random.Random(6)
    bad = ["idiot", "moron", "réeux", "trash"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = words(rng, rng.randrange(30, 120)).split()
        for _ in range(4 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad).upper() + rng.choice(("!", "", "$$$"))
        rows.append((k, " ".join(text), "en", "a", 1))
        labels.append((k, None, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = made()
    odd = [((r[0] + 10_000) if r[0] is not None else None, *r[1:]) for r in odd_rows()]
    labels += [(k, 1, t) for k, t in ((3, None), (None, 1), (7, 1), (10_001, 0), (10_005, 0), (10_005, 1), (99_999, 1))]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS fold", "1 AS score")
    got = tp.toxicity(frame(spark, rows + odd), marks).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {k: t for k, _, t in labels[:len(rows)]}
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10_002]["n_passages"] == 0 and by_id[10_002]["score"] == min(r["score"] for r in got)
    toxic = next(r for r in held if truth[r["doc_id"]])
    text = tp.words_of(rows[toxic["doc_id"]][1])
    assert any({"idiot", "moron", "réeux", "trash"} & set(text[p["first"]:p["end"]]) for p in toxic["passages"])


def test_a_labelled_id_on_many_rows_is_sampled(spark):
    rows, labels = made(300)
    rows += [(1, f"text {k} of a hot id", "en", "a", 1) for k in range(600)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample, size = tp.labelled(frame(spark, rows), marks, most=50)
    assert sample.count() < 250 and sum(size.values()) < 300
    assert tp.toxicity(frame(spark, rows), marks, most=50).count() == len(rows)


def test_without_labels_of_both_classes(spark):
    docs = frame(spark, odd_rows())
    for toxic, want in ((1, 1.0), (0, 0.0)):
        marks = spark.createDataFrame([(1, toxic), (5, toxic)], "doc_id long, toxic int")
        assert {r["score"] for r in tp.toxicity(docs, marks).collect()} == {want}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tp.toxicity(docs, none).collect()} == {0.0}
    assert tp.toxicity(frame(spark, [], clash=False), none).collect() == []
