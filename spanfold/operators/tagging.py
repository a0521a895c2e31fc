"""Entity tagging: documents -> tokens with BIO tags.

A tagger maps ``DataFrame(doc_id, text)`` to the grouped form
``DataFrame(doc_id, pairs: array<struct<token, tag>>)``; :func:`to_long` gives
the one-row-per-token contract ``(doc_id, pos, token, tag)``.

Taggers here:
* :class:`NullTagger` - whitespace tokens, every tag ``O``.
* :class:`ShapeTagger` - token-shape rules, JVM-side, no shuffle.
* :class:`GazetteerTagger` - longest phrase match against a phrase table
  (join on a phrase's first words, the rest verified in the document's row).
* :class:`ModelTagger` - a user model run with ``mapInPandas`` (loaded once
  per Python worker); the slow path for statistical taggers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import barrier, explode_rows, posexplode_rows
from ..functions.tokens import PAIR_TYPE, is_bio_tag, pairs_of, whitespace_tokens
from ..session import checkpoint
from .joins import sized_join

SpanFn = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def tokenize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text) -> (doc_id, tokens)."""
    return docs.select("doc_id", whitespace_tokens(F.col(text_col)).alias("tokens"))


def all_outside(tokens: Column) -> Column:
    return pairs_of(tokens, F.transform(tokens, lambda _: F.lit("O")))


class NullTagger:
    """NER-2: whitespace tokens, all tags ``O``."""

    def tag(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        t = tokenize(docs, text_col)
        return t.select("doc_id", all_outside(F.col("tokens")).alias("pairs"))


# --- fixed values: shape rules (pattern, label, not at a sentence's start), first hit wins
SHAPE_RULES = (
    (r"^\p{Lu}{2,}$", "ORG", False),       # acronym
    (r"^\p{Lu}\p{Ll}+$", "NAME", True),    # capitalised word
)
SENTENCE_END = r"[.!?]$"


class ShapeTagger:
    """NER-3b: token-shape tagger.

    A token is an entity when it matches a shape rule; a capitalised word at
    the start of a sentence (first token, or after a token ending in . ! ?)
    is not a NAME.  Consecutive tokens with the same label form one span:
    ``B-`` on the first, ``I-`` on the rest.
    """

    def __init__(self, rules: Iterable[tuple] = SHAPE_RULES):
        """``rules``: (pattern, label) or (pattern, label, not at a sentence's start)."""
        self.rules = tuple((*r, False)[:3] for r in rules)

    def labels(self, tokens: Column) -> Column:
        def label(tok: Column, i: Column) -> Column:
            prev = F.try_element_at(tokens, F.greatest(i, F.lit(1)))
            initial = (i == 0) | prev.rlike(SENTENCE_END)
            expr = None
            for pattern, name, inside_only in self.rules:
                cond = tok.rlike(pattern)
                if inside_only:
                    cond = cond & ~initial
                expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
            if expr is None:
                return F.lit(None).cast("string")
            if self.rules != SHAPE_RULES:
                return expr
            # both built-in rules start with an upper-case letter: tokens starting with an
            # ASCII lower-case letter or digit (most of them) skip the regexes
            plain = ((tok >= "a") & (tok < "{")) | ((tok >= "0") & (tok < ":"))
            return F.when(~plain, expr)

        return F.transform(tokens, label)

    def tag(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        t = tokenize(docs, text_col).withColumn("labels", self.labels(F.col("tokens")))
        lab = F.col("labels")

        def bio(cur: Column, i: Column) -> Column:
            prev = F.when(i > 0, F.try_element_at(lab, F.greatest(i, F.lit(1))))
            return (F.when(cur.isNull(), F.lit("O"))
                    .when(prev.eqNullSafe(cur), F.concat(F.lit("I-"), cur))
                    .otherwise(F.concat(F.lit("B-"), cur)))

        return t.select("doc_id", pairs_of(F.col("tokens"), F.transform(lab, bio)).alias("pairs"))


def bio_from_spans(n_tokens: Column, spans: Column) -> Column:
    """Tags array from non-overlapping spans sorted by start.

    ``spans``: array<struct<start:int, n:int, label:string>> (end exclusive).
    Built as O-runs and span runs, linear in the number of tokens.
    """
    def segment(s: Column, j: Column) -> Column:
        prev = F.try_element_at(spans, F.greatest(j, F.lit(1)))
        prev_end = F.when(j == 0, F.lit(0)).otherwise(prev["start"] + prev["n"])
        return F.concat(F.array_repeat(F.lit("O"), s["start"] - prev_end),
                        F.array(F.concat(F.lit("B-"), s["label"])),
                        F.array_repeat(F.concat(F.lit("I-"), s["label"]), s["n"] - 1))

    last = F.try_element_at(spans, F.size(spans))
    last_end = F.coalesce(last["start"] + last["n"], F.lit(0))
    body = F.flatten(F.transform(spans, segment))
    return F.when(F.size(spans) > 0,
                  F.concat(body, F.array_repeat(F.lit("O"), n_tokens - last_end))
                  ).otherwise(F.array_repeat(F.lit("O"), n_tokens))


def spans_fit(n_tokens: Column, spans: Column) -> Column:
    """True where spans sorted by start hold a token each, do not overlap and end within ``n_tokens``."""
    def fits(s: Column, j: Column) -> Column:
        prev = F.try_element_at(spans, F.greatest(j, F.lit(1)))
        free = F.when(j == 0, F.lit(0)).otherwise(prev["start"] + prev["n"])
        return (s["n"] >= 1) & (s["start"] >= free) & (s["start"] + s["n"] <= n_tokens)

    return F.forall(F.transform(spans, fits), lambda ok: ok)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _kept(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Places of the spans that begin at or after the end of the last one kept; one pass."""
    out = []
    for s, e in zip(starts, ends):
        free, kept = 0, []
        for i in range(len(s)):
            if s[i] >= free:
                kept.append(i)
                free = e[i]
        out.append(kept)
    return pd.Series(out)


def greedy_spans(candidates: Column) -> Column:
    """Leftmost-longest, non-overlapping choice among match candidates.

    ``candidates``: array<struct<start, n, label>>.  Sorted by start, then
    longer first, then label; a candidate is kept when it starts at or after
    the end of the last kept one.
    """
    ordered = F.array_sort(F.transform(candidates, lambda c: F.struct(
        c["start"].cast("int").alias("start"), (-c["n"]).cast("int").alias("neg_n"), c["label"].alias("label"))))
    kept = _kept(F.transform(ordered, lambda c: c["start"]), F.transform(ordered, lambda c: c["start"] - c["neg_n"]))
    return F.transform(kept, lambda i: F.struct(
        F.try_element_at(ordered, i + 1)["start"].alias("start"),
        (-F.try_element_at(ordered, i + 1)["neg_n"]).alias("n"), F.try_element_at(ordered, i + 1)["label"].alias("label")))


class GazetteerTagger:
    """NER-3a: phrase-table tagger.

    ``phrases``: DataFrame(phrase string, label string); matching is on the
    lowercase whitespace tokens.  The table is indexed by a hash of a phrase's
    first word (one-word phrases) or first two words.  Every position of a
    document looks up both hashes, whatever the longest phrase; the hits of a
    document are verified word by word in its row, and the leftmost-longest
    non-overlapping ones are kept.  No n-gram is ever built.
    """

    def __init__(self, phrases: DataFrame, broadcast_max_rows: int = 2_000_000):
        words = F.transform(whitespace_tokens(F.col("phrase")), F.lower)
        norm = phrases.select(words.alias("words"), "label").where(F.size("words") > 0)
        # one label per phrase: the smallest, so the result is deterministic
        one = norm.groupBy("words").agg(F.min("label").alias("label"))
        first, second = F.try_element_at("words", F.lit(1)), F.try_element_at("words", F.lit(2))
        self.table = checkpoint(one.select(
            F.when(F.size("words") == 1, F.xxhash64(first)).otherwise(F.xxhash64(first, second)).alias("key"), "words", "label"))
        self.broadcast_max_rows = broadcast_max_rows

    def hits(self, toks: DataFrame) -> DataFrame:
        """(doc_id, start, words, label) where a phrase's first words stand; at most two lookups a position."""
        low = barrier(toks.select("doc_id", F.transform(F.col("tokens"), F.lower).alias("t")), "t")
        t = F.col("t")
        keys = F.transform(t, lambda w, i: F.array(F.xxhash64(w), F.when(
            i + 1 < F.size(t), F.xxhash64(w, F.try_element_at(t, i + 2)))))
        at = posexplode_rows(low.select("doc_id", keys.alias("keys")), F.col("keys"), "start", "pair", "doc_id")
        return sized_join(explode_rows(at, F.col("pair"), "key", "doc_id", "start"), self.table, ["key"],
                          max_rows=self.broadcast_max_rows).drop("key")

    def spans(self, toks: DataFrame) -> DataFrame:
        """(doc_id, tokens, spans) of every document."""
        found = self.hits(toks).groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "label")).alias("hits"))
        rows = toks.select("doc_id", "tokens", F.transform("tokens", F.lower).alias("t")).join(found, "doc_id", "left")
        right = F.filter("hits", lambda h: F.slice(F.col("t"), h["start"] + 1, F.size(h["words"])) == h["words"])
        cands = F.transform(right, lambda h: F.struct(h["start"].alias("start"), F.size(h["words"]).alias("n"),
                                                      h["label"].alias("label")))
        none = F.array().cast("array<struct<start:int,n:int,label:string>>")
        return barrier(rows.select("doc_id", "tokens", F.coalesce(cands, none).alias("cands")), "cands").select(
            "doc_id", "tokens", greedy_spans(F.col("cands")).alias("spans"))

    def tag(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        # the tokens feed both the lookups and the final tags: written once
        found = barrier(self.spans(checkpoint(tokenize(docs, text_col))), "spans")
        return found.select("doc_id", pairs_of(F.col("tokens"), bio_from_spans(F.size("tokens"), F.col("spans"))).alias("pairs"))


class ModelTagger:
    """NER-3c / UDF-3: a user model behind ``mapInPandas``.

    ``load`` returns a function ``spans(texts) -> [[(start_token, end_token,
    label), ...], ...]`` over whitespace tokens (end exclusive).  It is called
    once per Python worker partition iterator, so a model loads once per task.
    The spans are turned into BIO tags on the JVM side.
    """

    def __init__(self, load: Callable[[], SpanFn]):
        self.load = load

    def tag(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        load = self.load

        def run(batches):
            fn = load()
            for pdf in batches:
                spans = fn(list(pdf["text"].fillna("")))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"], "spans": [
                    [{"start": int(s), "n": int(e - s), "label": str(lab)} for s, e, lab in sorted(doc)]
                    for doc in spans]})

        out = docs.select("doc_id", F.col(text_col).alias("text")).mapInPandas(
            run, "doc_id bigint, text string, spans array<struct<start:int,n:int,label:string>>")
        # tokens and their number are columns before the spans are checked: the check reads them for every span
        rows = barrier(out.select("doc_id", "spans", whitespace_tokens(F.col("text")).alias("tokens")), "tokens")
        rows = barrier(rows.withColumn("n_tokens", F.size("tokens")), "n_tokens")
        n, spans = F.col("n_tokens"), F.col("spans")
        tags = F.when(spans_fit(n, spans), bio_from_spans(n, spans)).otherwise(
            F.raise_error(F.lit("the model's spans overlap or leave the document's tokens")).cast("array<string>"))
        return rows.select("doc_id", pairs_of(F.col("tokens"), tags).alias("pairs"))


# --- NER-1 / ARR-1 / ARR-2 ----------------------------------------------------------
def predict(tagger, docs: DataFrame | None, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token, tag) of every token; no documents at all are refused."""
    if docs is None or docs.isEmpty():
        raise TypeError("a tagger needs at least one document")
    return to_long(tagger.tag(docs, text_col))


def to_long(tagged: DataFrame) -> DataFrame:
    """(doc_id, pairs) -> (doc_id, pos, token, tag), one row per token."""
    return posexplode_rows(barrier(tagged, "pairs"), F.col("pairs"), "pos", "p", "doc_id").select(
        "doc_id", "pos", F.col("p.token").alias("token"), F.col("p.tag").alias("tag"))


def from_token_lists(df: DataFrame, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """Tokenized input (two aligned list columns) -> (doc_id, pairs)."""
    return df.select("doc_id", pairs_of(F.col(tokens), F.col(tags)).alias("pairs"))


# --- NER-4 ------------------------------------------------------------------
def spans_to_bio(tokens_long: DataFrame, spans: DataFrame) -> DataFrame:
    """Range join of token rows with entity spans (end exclusive).

    ``tokens_long``: (doc_id, pos, token); ``spans``: (doc_id, start, end,
    label).  Each span is expanded to the positions it covers (bounded by the
    span length), so the range condition becomes an equi-join on
    (doc_id, pos).  Overlapping spans, a negative start and an empty or
    inverted span raise an error when the result is computed; a span that ends
    after its document tags the tokens that are there.
    """
    valid = (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    positions = F.when(F.coalesce(valid, F.lit(False)), F.sequence("start", F.col("end") - 1)).otherwise(
        F.raise_error(F.lit("span with a negative start or without tokens")).cast("array<long>"))
    spread_out = spans.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "label").select(
        "doc_id", "start", "label", F.explode(positions).alias("pos"))
    one = spread_out.groupBy("doc_id", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "label")).alias("s"))
    start = F.when(F.col("n") == 1, F.col("s.start")).otherwise(
        F.raise_error(F.lit("overlapping spans")).cast("long"))
    covered = one.select("doc_id", "pos", start.alias("start"), F.col("s.label").alias("label"))
    j = tokens_long.join(covered, ["doc_id", "pos"], "left")
    tag = (F.when(F.col("start").isNull(), F.lit("O"))
           .when(F.col("pos") == F.col("start"), F.concat(F.lit("B-"), "label"))
           .otherwise(F.concat(F.lit("I-"), "label")))
    return j.select("doc_id", "pos", "token", tag.alias("tag"))


# --- NER-5 / NER-6 ------------------------------------------------------------
def violations(df: DataFrame, tokens: str = "tokens", tags: str = "tags",
               keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows whose token and tag lists differ in length or hold a non-BIO tag."""
    # a null list, or a null tag in a list, is a violation too
    bad_len = F.coalesce(F.size(tokens) != F.size(tags), F.lit(True)) | F.col(tokens).isNull() | F.col(tags).isNull()
    bad_tag = F.coalesce(F.exists(F.col(tags), lambda t: F.coalesce(~is_bio_tag(t), F.lit(True))), F.lit(True))
    return df.where(bad_len | bad_tag).select(
        *keys, bad_len.alias("length_mismatch"), bad_tag.alias("bad_tag"))


def check_tagged(df: DataFrame, tokens: str = "tokens", tags: str = "tags") -> None:
    """Raise ValueError on the first violation (one distributed pass)."""
    bad = violations(df, tokens, tags).limit(1).collect()
    if bad:
        row = bad[0]
        if row.length_mismatch:
            raise ValueError(f"document {row.doc_id} has unequal numbers of tokens and tags")
        raise ValueError(f"a tag of document {row.doc_id} is not O, B-... or I-...")


__all__ = ["NullTagger", "ShapeTagger", "GazetteerTagger", "ModelTagger", "tokenize",
           "predict", "to_long", "from_token_lists", "spans_to_bio", "bio_from_spans",
           "greedy_spans", "violations", "check_tagged", "PAIR_TYPE"]
