"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its ``top`` most frequent letter n-grams
(lengths 1 to 3; letters are lower-cased, every run of other characters is one
space).  A document gets the same kind of list; the distance to a language is
the sum over the document's n-grams of how far out of place each one stands
in the profile (``top`` where it is absent).  The nearest language wins, ties
by name.

Profiles are learnt on every labelled row, and so are the least scores.
Prediction reads every document's whole text and nothing else.

Cases: null text, empty text or one without a letter gives ``und`` and score
0; the same holds for every row when there is no labelled row; null languages
are not learnt; repeated rows give repeated, equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import ID, LANG, TEXT, free_caches, slices

UND = "und"
#: Parts of a language's n-grams that are ranked apart.
BUCKETS = 64
_SPACE = 0x20
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or space for all that is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD = table
    return _FOLD


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as integers, ascending) of a whole text and their counts."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes != _SPACE
    if not letter.any():
        return none, none
    keep = letter.copy()
    keep[1:] |= letter[:-1]           # of each run of other characters the first stays
    c = np.concatenate(([_SPACE], codes[keep], [_SPACE])).astype(np.int64)
    if c[-2] == _SPACE:
        c = c[:-1]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    grams, counts = np.unique(np.concatenate((c[c != _SPACE], two, three)), return_counts=True)
    return grams, counts


def top_grams(text: str | None, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, ties by n-gram."""
    grams, counts = gram_counts(text)
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.argsort(-counts, kind="stable")][:top]


@dataclass
class Profiles:
    """Rank of every profile n-gram in each language (``top`` where absent)."""

    langs: list[str]
    grams: np.ndarray        # ascending
    ranks: np.ndarray        # languages x n-grams
    top: int

    def predict(self, text: str | None) -> tuple[str, float]:
        doc = top_grams(text, self.top)
        if not len(doc) or not self.langs:
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.grams, doc), len(self.grams) - 1)
        theirs = self.ranks[:, at]
        absent = (self.grams[at] != doc) | (theirs == self.top)
        apart = np.where(absent, self.top, np.abs(theirs - np.arange(len(doc))))
        dist = apart.sum(axis=1)
        best = int(np.argmin(dist))          # languages are in name order
        return self.langs[best], float(1.0 - dist[best] / (self.top * len(doc)))


def _labelled(labelled: DataFrame) -> DataFrame:
    """(lang, text) of every row with both."""
    return labelled.select(F.col(TEXT).alias("text"), F.col(LANG).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")


def learn(labelled: DataFrame, top: int = 300) -> Profiles:
    """Profiles from all labelled rows (columns ``text``, ``lang``)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for part, texts in slices(batches):
            sums: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                sums.setdefault(lang, []).append(gram_counts(text))
            for lang, found in sums.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n for _, n in found]), len(grams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()),
                     pa.array(total.astype(np.int64), pa.int64())], ["lang", "gram", "n"])

    counts = _labelled(labelled).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # the best of each bucket first: no group holds more than its share of a language's n-grams
    order = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))).orderBy(F.desc("n"), "gram")
    few = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    best = few.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))), 1, top).alias("g"))
    # at most `top` n-grams a language come to the driver
    table = {r["lang"]: [x["gram"] for x in r["g"]] for r in best.collect()}
    langs = sorted(table)
    grams = np.array(sorted({g for gs in table.values() for g in gs}), np.int64)
    ranks = np.full((len(langs), len(grams)), top, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(grams, np.array(table[lang], np.int64))] = np.arange(len(table[lang]))
    if not len(grams):
        langs = []
    return Profiles(langs, grams, ranks, top)


def predict(docs: DataFrame, profiles: Profiles, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns: the predicted language and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for part, values in slices(batches, TEXT):
            found = [profiles.predict(t) for t in values]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())], [*part.schema.names, *names])

    more = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def least_scores(labelled: DataFrame, profiles: Profiles, low: float = 0.01,
                 margin: float = 0.05, least_rows: int = 20) -> dict[str, float]:
    """For each language a score that its own documents hardly ever fall below.

    From all labelled rows that the profiles were not learnt on: the ``low``
    quantile of the scores (of six digits, so that their table is bounded) of
    rows predicted as labelled, less its distance to the median (``margin`` at
    least).  A language with fewer than ``least_rows`` such rows has no entry.
    """
    own = predict(_labelled(labelled), profiles).where("lang = lang_pred").withColumn("score", F.round("score", 6))
    rows = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(low)).alias("low"),
                                   F.percentile("score", F.lit(0.5)).alias("mid")).where(F.col("n") >= least_rows)
    return {r["lang"]: r["low"] - max(margin, r["mid"] - r["low"]) for r in rows.collect()}    # one row a language


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 4 is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(ID).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, top: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    profiles = learn(docs.where(~held_out()), top)
    out = predict(docs.select(ID, TEXT), profiles)
    return out.select(ID, held_out().alias("held_out"), "lang_pred", "score")
