"""TOK-13 with TOK-12: lemmas by form and word class.

The lexicon is data: ``DataFrame(form, lemma)``, or ``(form, lemma, pos)`` with
a word class (``a`` adjective, ``v`` verb, ``r`` adverb, ``n`` noun) and, if
wanted, a ``weight`` (how often the form has the class).  Token rows are looked
up with a left join, broadcast when the lexicon's row count is within the
bound, a shuffle join otherwise; a form is one row there, so no class needs
another join.

With word classes every token first gets one: the best path over a document's
tokens, by the lexicon's share of each class for the form and a bigram table of
classes.  Its lemma is that of (form, class), else of (form, noun), else of the
form's first class; a form without an entry is a noun and stays as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import barrier, explode_rows
from ..session import checkpoint
from .joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, sized_join, table_size

CLASSES = ("a", "n", "r", "v")
NOUN = "n"


def normalize_lexicon(lexicon: DataFrame) -> DataFrame:
    """(form, entries array<struct<pos, lemma, weight>>): one row a form, classes in order (null pos: any class)."""
    pos = F.col("pos") if "pos" in lexicon.columns else F.lit(None).cast("string")
    weight = F.col("weight").cast("double") if "weight" in lexicon.columns else F.lit(1.0)
    one = lexicon.select("form", "lemma", pos.alias("pos"), weight.alias("weight")).groupBy("form", "pos").agg(
        F.min("lemma").alias("lemma"), F.sum("weight").alias("weight"))
    return one.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma", "weight"))).alias("entries"))


@dataclass(frozen=True)
class ClassBigrams:
    """log P(class | class before), '' being a document's start; absent pairs have ``floor``."""

    logs: dict = field(default_factory=dict)
    floor: float = -8.0

    @classmethod
    def fit(cls, tagged: DataFrame, smooth: float = 1.0) -> ClassBigrams:
        """Counts over ``tagged(doc_id, pos, cls)``, a row per token; at most (classes + 1) x classes numbers."""
        before = F.coalesce(F.lag("cls").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(""))
        counts = {(r["b"], r["cls"]): r["count"] for r in
                  tagged.select(before.alias("b"), "cls").where(F.col("cls").isin(*CLASSES)).groupBy("b", "cls").count().collect()}
        total = {b: sum(counts.get((b, c), 0) + smooth for c in CLASSES) for b in ("", *CLASSES)}
        return cls({(b, c): math.log((counts.get((b, c), 0) + smooth) / total[b]) for b in total for c in CLASSES})

    def move(self, before: str, to: str) -> float:
        return self.logs.get((before, to), self.floor if self.logs else 0.0)


def best_classes(shares: list[dict[str, float]], bigrams: ClassBigrams) -> list[str]:
    """The best path of classes, given each token's log shares; the first in order among equals."""
    paths: dict[str, tuple] = {"": (0.0, None)}        # class -> (score, (path before, class))
    for own in shares:
        step = {}
        for c in sorted(own):
            # max() takes the first of equal ones
            before = max(sorted(paths), key=lambda b: paths[b][0] + bigrams.move(b, c))
            score, path = paths[before]
            step[c] = (score + bigrams.move(before, c) + own[c], (path, c))
        paths = step
    node, out = paths[max(sorted(paths), key=lambda c: paths[c][0])][1], []
    while node:
        node, c = node
        out.append(c)
    return out[::-1]


def word_classes(entries: Column, bigrams: ClassBigrams) -> Column:
    """The class of each token from ``entries``, an array per token of its lexicon entries (null: none)."""
    @F.pandas_udf("array<string>")
    def choose(classes: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for per_class, per_weight in zip(classes, weights):
            shares = []
            for names, sizes in zip(per_class, per_weight):
                total = sum(sizes) if names is not None and len(names) else 0
                shares.append({n: math.log(w / total) for n, w in zip(names, sizes) if w > 0} if total > 0 else {NOUN: 0.0})
            out.append(best_classes([{(NOUN if n is None else n): v for n, v in s.items()} for s in shares], bigrams))
        return pd.Series(out)

    return choose(F.transform(entries, lambda e: F.transform(F.coalesce(e, F.array().cast(_ENTRIES)), lambda x: x["pos"])),
                  F.transform(entries, lambda e: F.transform(F.coalesce(e, F.array().cast(_ENTRIES)), lambda x: x["weight"])))


_ENTRIES = "array<struct<pos:string,lemma:string,weight:double>>"


def lemma_of(token: Column, entries: Column, cls: Column) -> Column:
    """The lemma of (form, class), else of (form, noun), else of the form's first entry, else the form."""
    def of(want: Column) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["pos"].eqNullSafe(want)), F.lit(1))["lemma"]
    return F.coalesce(of(cls), of(F.lit(NOUN)), F.try_element_at(entries, F.lit(1))["lemma"], token)


def looked_up(rows: DataFrame, lexicon: DataFrame, token: str = "token", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``rows`` with the ``entries`` of their token (null without any)."""
    return sized_join(rows, normalize_lexicon(lexicon).withColumnRenamed("form", token), [token], "left", max_rows=max_rows)


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token rows, those of a document behind each other, as one row a document."""
    held, last = [], -1
    for b in chain(batches, [None]):
        held = held if b is None else [*held, b]
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if t is None or not t.num_rows:
            continue
        row = t.column("row").to_numpy()
        if row[0] < last or (np.diff(row) < 0).any():
            raise ValueError("the rows of a document are apart")
        start = np.flatnonzero(np.diff(row, prepend=-1))
        end = t.num_rows if b is None else int(start[-1])          # the last document may go on
        last, held = int(row[-1]), t.slice(end).to_batches() if end < t.num_rows else []
        start = start[start < end]
        if not len(start):
            continue
        t = t.slice(0, end)
        there = t.column("pos").is_valid().to_numpy()
        ends = np.concatenate(([0], np.cumsum(there)))[np.append(start, end)]
        tokens = t.filter(pa.array(there)).combine_chunks()
        s = pa.StructArray.from_arrays([pa.concat_arrays(tokens.column(c).chunks) if tokens.num_rows else pa.array([], tokens.schema.field(c).type)
                                        for c in ("token", "tag", "entries")], ["token", "tag", "entries"])
        one = t.select(["doc_id", "n_tokens"]).take(pa.array(start)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(one.column(c).chunks) for c in ("doc_id", "n_tokens")),
                                          pa.ListArray.from_arrays(pa.array(ends, pa.int32()), s)], ["doc_id", "n_tokens", "s"])


def with_entries(docs: DataFrame, lexicon: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(doc_id, n_tokens, s array<struct<token, tag, entries>>) of ``docs(doc_id, n_tokens, pairs)``.

    A lexicon within the broadcast bounds is looked up where the documents are: their tokens stay in order, and no text is
    shuffled.  Beyond them a document's distinct tokens are looked up by shuffle, and only those found come back to it.
    """
    table = checkpoint(normalize_lexicon(lexicon).withColumnRenamed("form", "token"))
    n, size = table_size(table)
    if n <= max_rows and size <= BROADCAST_MAX_BYTES:
        rows = docs.withColumn("row", F.monotonically_increasing_id()).select(
            "row", "doc_id", "n_tokens", F.posexplode_outer("pairs").alias("pos", "p"))
        found = rows.select("row", "doc_id", "n_tokens", "pos", F.col("p.token").alias("token"), F.col("p.tag").alias("tag")).join(
            F.broadcast(table), "token", "left").select("row", "doc_id", "n_tokens", "pos", "token", "tag", "entries")
        kinds = dict(docs.dtypes)
        return found.mapInArrow(_regrouped, f"doc_id {kinds['doc_id']}, n_tokens {kinds['n_tokens']}, "
                                            f"s array<struct<token:string,tag:string,entries:{_ENTRIES}>>")
    forms = explode_rows(docs, F.array_distinct(F.transform("pairs", lambda x: x["token"])), "token", "doc_id")
    found = forms.join(table, "token").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.map_from_entries(F.collect_set(F.struct("token", "entries"))).alias("known"))
    g = barrier(docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc"), "known")
    return g.select("doc_id", "n_tokens", F.transform("pairs", lambda x: F.struct(
        x["token"].alias("token"), x["tag"].alias("tag"), F.try_element_at("known", x["token"]).alias("entries"))).alias("s"))


def lemmatize_rows(rows: DataFrame, lexicon: DataFrame, token: str = "token",
                   max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Replace ``token`` by its lemma where the lexicon has the form, whatever the word class."""
    j = looked_up(rows, lexicon, token, max_rows)
    return j.withColumn(token, lemma_of(F.col(token), F.col("entries"), F.lit(None).cast("string"))).drop("entries")
