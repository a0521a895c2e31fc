"""Toxicity by maximum-scoring segments (operator 13).

**Token scores.** From labelled documents: the log-odds of a word between toxic
and clean ones, each word counted once a document, under a Dirichlet prior for
each class that follows the pooled counts (``prior`` times the class's size, and
``pseudo`` occurrences more), drawn to 0 by one standard deviation.  Words never
learnt score 0; ``drift`` is taken from every word.

**Passages.** A linear scan of a document's scores finds all maximal scoring
segments (each the highest-scoring stretch of its part of the text, none
touching another).  How high the best segment of a clean document of n words
comes follows an extreme-value law P(S < x) = exp(-K n e^(-lambda x)); lambda
and K are the most likely ones for clean labelled documents that took no part in
the word counts.  A passage is significant if K n e^(-lambda S) <= ``expected``.

**Score.** The significant passages' normalised scores lambda S - ln(K n) are
summed and the sum's probability under the law of sums of r segments is taken
(without any, that of the best segment); a logistic curve over log(1 - ln p),
fitted to the same labelled documents and weighted back to the whole label
table's classes, makes it a probability.

Learning reads only rows whose ``crc32(doc_id) mod 4`` is 0, 1 (word counts) or
3 (laws and curve); at most about ``most`` label rows of each class (drawn by a
hash of the id) and ``2 * most`` documents of them.  Everything else covers all
rows and whole texts.

Results: null and empty texts and texts without a word have no passage and the
curve's lowest score.  A null doc_id is not held out and never learnt from.
Null labels and ids labelled both ways are not learnt from.  Without labels of
both classes the score is the toxic share of the labels (0 without any).
Repeated rows give one result row each.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, slices

#: Labelled rows of each class learnt from, about.
MOST = 20_000
#: The score from which a document is predicted toxic.
LIMIT = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a row of scores, in linear time.

    Kept segments stand in a row; each knows the nearest one before it that begins at a lower sum.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []                            # [first, end, sum before, sum behind, link]
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, float(sums[at]), float(sums[at + 1]), -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, behind - before) for a, b, before, behind, _ in kept]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    expected: float = 0.05
    rate: float = 1.0                                # lambda
    factor: float = 1.0                              # K
    curve: tuple[float, float] = (0.0, 0.0)
    constant: float | None = None                    # the score where nothing could be learnt

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(words, maximal segments) of one text."""
        words = words_of(text)
        get = self.scores.get
        row = np.fromiter((get(w, 0.0) for w in words), np.float64, len(words))
        return len(words), segments(row - self.drift)

    def evidence(self, n: int, found: list[float]) -> tuple[float, int]:
        """(-ln p of the document's segment scores under the law of clean texts, significant ones)."""
        if not found:
            return 0.0, 0
        base = math.log(self.factor * n)
        over = [x for s in found if (x := self.rate * s - base) >= -math.log(self.expected)]
        high = self.rate * max(found) - base         # -ln of the expected number of segments so high
        best = high if high > 25 else -math.log(-math.expm1(-math.exp(min(700.0, -high))))
        if over:
            t, r = sum(over), len(over)
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r))
        return max(0.0, best), len(over)

    def probability(self, evidence: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * math.log1p(evidence))))


def word_scores(rows: DataFrame, prior: float = 0.1, pseudo: float = 5.0, least: int = 3) -> dict[str, float]:
    """Log-odds of the words of ``rows(text, toxic)``; words in fewer than ``least`` documents score 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            both: tuple[dict, dict] = ({}, {})
            for toxic, text in zip(part.column("toxic").to_pylist(), texts):
                held = both[toxic]
                for w in set(words_of(text)):
                    held[w] = held.get(w, 0) + 1
            for toxic, held in enumerate(both):
                n = [list(held.values()), [0] * len(held)]
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(n[1 - toxic], pa.int64()),
                                                  pa.array(n[toxic], pa.int64())], ["word", "bad", "good"])

    counts = rows.select("toxic", "text").mapInArrow(run, "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).cache()
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total["bad"] or not total["good"]:
        counts.unpersist()
        return {}
    share = {c: total[c] / (total["bad"] + total["good"]) for c in ("bad", "good")}
    own = {c: F.col(c) + share[c] * (prior * (F.col("bad") + F.col("good")) + pseudo) for c in share}
    odds = F.log(own["bad"] / share["bad"]) - F.log(own["good"] / share["good"])
    sure = F.greatest(F.abs(odds) - F.sqrt(1 / own["bad"] + 1 / own["good"]), F.lit(0.0))
    found = (counts.where(F.col("bad") + F.col("good") >= least)
             .select("word", (F.signum(odds) * sure).alias("score")).where("score <> 0").collect())   # of a bounded sample
    counts.unpersist()
    return {r["word"]: r["score"] for r in found}


def extreme_law(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """The most likely (lambda, K) of P(S < x) = exp(-K n e^(-lambda x)) for best scores of texts."""
    def factor(rate: float) -> float:
        return len(best) / float((lengths * np.exp(-rate * best)).sum())

    def likelihood(log_rate: float) -> float:
        rate = math.exp(log_rate)
        return len(best) * (log_rate + math.log(factor(rate))) - rate * float(best.sum())

    lo, hi, cut = math.log(0.01), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (a, hi) if likelihood(a) < likelihood(b) else (lo, b)
    rate = math.exp((lo + hi) / 2)
    return rate, factor(rate)


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic fit (Newton, with a little ridge); never falling."""
    z, beta = np.stack((np.ones_like(x), x), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ beta)))
        curved = z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curved, z.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic, fold) of a bounded sample outside fold 2; label rows of each class there."""
    known = (labels.select(F.col(ID).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
             .select("doc_id", "toxic", fold(F.col("doc_id")).alias("fold")).where("fold <> 2"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    def drawn(of: dict[int, int], *by: str) -> Column:
        share = F.when(F.col("toxic") == 1, most / max(1, of.get(1, 1))).otherwise(most / max(1, of.get(0, 1)))
        return F.pmod(F.xxhash64(*by, F.lit("drawn")), F.lit(1_000_000)) < share * 1_000_000

    sample = F.broadcast(known.where(drawn(size, "doc_id")))                 # about 2 * most narrow rows
    of = docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text"))
    met = {r["toxic"]: r["count"] for r in of.select("doc_id").join(sample, "doc_id").groupBy("toxic").count().collect()}
    rows = of.join(sample, "doc_id")
    if max(met.values(), default=0) > 2 * most:                              # an id that many documents carry
        rows = rows.where(drawn(met, "doc_id", "text"))
    return rows, size


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST, drift: float = 0.1, expected: float = 0.05) -> Model:
    """The model of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``."""
    rows, size = labelled(docs, labels, most)
    if not size.get(0) or not size.get(1):
        return Model(constant=float(bool(size.get(1))))
    model = Model(word_scores(rows.where("fold <> 3")), drift, expected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [model.passages(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))], ["toxic", "n", "found"])

    seen = rows.where("fold = 3").select("toxic", "text").mapInArrow(run, "toxic int, n long, found array<double>").collect()
    clean = [r for r in seen if not r["toxic"] and r["n"]]
    if not clean or len(clean) == len(seen):
        model.constant = size[1] / (size[0] + size[1])
        return model
    model.rate, model.factor = extreme_law(np.array([r["n"] for r in clean], float),
                                           np.array([max(r["found"], default=0.0) for r in clean]))
    y = np.array([r["toxic"] for r in seen], float)
    x = np.array([math.log1p(model.evidence(r["n"], r["found"])[0]) for r in seen])
    per = {k: size[k] / max(1, (y == k).sum()) for k in (0, 1)}              # as frequent as in the label table
    weight = np.where(y == 1, per[1], per[0])
    model.curve = logistic_curve(x, y, weight * len(y) / weight.sum())
    return model


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_words, passages, evidence, score) of every document.

    ``passages`` are the significant ones: first word, end (exclusive) and score, words counted from 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)                   # learnt on a bounded sample
    kind = docs.schema[ID].dataType.simpleString()
    spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        least = -math.log(m.expected)
        for part, texts in slices(batches):
            out = []
            for t in texts:
                n, found = m.passages(t)
                evidence, some = m.evidence(n, [s for _, _, s in found])
                base = math.log(m.factor * n) if some else 0.0
                out.append((n, [{"first": a, "end": b, "score": s} for a, b, s in found if m.rate * s - base >= least]
                            if some else [], evidence, m.probability(evidence)))
            n, found, evidence, score = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(found, spans),
                 pa.array(evidence, pa.float64()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "n_words", "passages", "evidence", "score"])

    rows = docs.select(F.col(ID).alias("doc_id"), F.coalesce(fold(F.col(ID)) == 2, F.lit(False)).alias("held_out"),
                       F.col(TEXT).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_words long, "
                                "passages array<struct<first:int,end:int,score:double>>, evidence double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """Learns from ``labels`` and scores every document: find_passages, n_passages and predicted (0, 1)."""
    return find_passages(docs, learn(docs, labels, **learning)).withColumns(
        {"n_passages": F.size("passages"), "predicted": (F.col("score") >= LIMIT).cast("int")})
