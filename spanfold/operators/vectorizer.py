"""Entity-aware term weighting: ``fit`` builds a vocabulary, ``transform`` weights.

Data flow (one row per document until the terms are exploded):

    docs(doc_id, text) -> clean -> tag -> pairs array<struct<token, tag>>
      -> lemmatize / lower / stop words / token filter      (per document)
      -> encode (double | bio | plain) -> count in the row
      -> (doc_id, n_tokens, counts array<struct<term, cnt, first>>)
    fit:       explode counts -> groupBy(term) -> bounds -> idf   vocabulary (written)
    transform: counts (written) -> explode -> x vocabulary (size-checked broadcast) -> tf, idf -> L2 by doc

Terms are counted inside the document's row, so texts are never shuffled:
``fit`` has only the vocabulary aggregate (partial + final, which absorbs hot
terms), hashed and not sorted.  ``transform`` writes the counted rows, one a
document, and reads them twice: for the documents' norms (one number a document
is shuffled) and for the weights, which get the norm before they are exploded.
Only rows of terms too rare for the broadcast table are ever shuffled.
``fit_transform`` writes the counted rows once for both.

Compatibility modes (defaults = the observed behaviour):
* ``count_mode``: ``occurrences`` counts every occurrence for the vocabulary
  bounds and idf; ``documents`` counts documents (the textbook rule).
* ``weighting``: ``divide`` gives tf / idf; ``multiply`` gives tf * idf.
* ``tf_mode``: ``ratio`` divides the count by the document's token count
  before any filtering; ``raw`` uses the count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import barrier, explode_rows
from ..functions.text import ColumnFn, document_pipeline
from ..functions.tokens import (STOPWORDS, filter_pairs, strip_bio_prefix, whitespace_tokens,
                                word_tokens)
from ..session import checkpoint, spread
from .joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, skew_safe_lookup, table_size
from .lexicon import ClassBigrams, lemma_of, with_entries, word_classes
from .ranking import exact_rank
from .tagging import NullTagger, check_tagged, from_token_lists, tokenize

PairsFn = Callable[[Column], Column]
PUNCTUATION = r"^[\p{P}\p{S}]+$"


@dataclass(frozen=True)
class VectorizerParams:
    encoding: object = "double"           # double | bio | plain | Column function (UDF-4)
    min_df: int | float = 1
    max_df: int | float = 1.0
    filter_stopwords: bool = True
    lemmatize: bool = True                # needs a lexicon; identity without one
    normalize: bool = True
    filter_punctuation: bool = False      # drop tokens made only of punctuation/symbols
    lower: bool = True
    fix_contractions: bool = True
    count_mode: str = "occurrences"       # occurrences | documents
    weighting: str = "divide"             # divide | multiply
    tf_mode: str = "ratio"                # ratio | raw
    idf_add_one: bool = True
    stopwords: tuple[str, ...] = field(default=STOPWORDS, repr=False)

    def get_params(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "stopwords"}


STANDARD = dict(count_mode="documents", weighting="multiply", tf_mode="raw")


def bound(value: int | float, n_docs: int) -> float:
    """``int`` is an absolute count, ``float`` a share of the documents."""
    return value * n_docs if isinstance(value, float) else value


class TermPipeline:
    """Per-document token steps and term encoding (shared by fit and transform)."""

    def __init__(self, params: VectorizerParams, tagger=None,
                 preprocessor: ColumnFn | None = None,
                 token_filter: PairsFn | None = None,
                 lexicon: DataFrame | None = None,
                 contractions: dict[str, str] | None = None,
                 analyzer: Callable[[Column], Column] | None = None,
                 bigrams: ClassBigrams | None = None):
        self.params = params
        self.bigrams = bigrams or ClassBigrams()
        self.tagger = tagger if tagger is not None else NullTagger()
        self.preprocessor = preprocessor
        self.token_filter = token_filter
        self.lexicon = lexicon
        self.contractions = contractions
        self.analyzer = analyzer

    # documents -> (doc_id, pairs)
    def tag(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        if self.analyzer is not None:      # word analyzer: no tagger, all "O"
            toks = self.analyzer(F.col(text_col))
            return docs.select("doc_id", F.transform(toks, lambda t: F.struct(
                t.alias("token"), F.lit("O").alias("tag"))).alias("pairs"))
        pipe = document_pipeline(self.preprocessor, self.params.fix_contractions, self.contractions)
        cleaned = pipe.apply(docs.select("doc_id", F.col(text_col).alias("text")), "text")
        return self.tagger.tag(cleaned, "text")

    def _lemmatize(self, tagged: DataFrame) -> DataFrame:
        """TOK-13 before lowering: the tokens of a document with their lexicon entries (with word classes: tagged there).

        Documents of one id and length are one, their tokens by place.
        """
        if not (self.params.lemmatize and self.lexicon is not None):
            return tagged
        none = F.array().cast("array<struct<token:string,tag:string>>")
        t = tagged.select("doc_id", "n_tokens", F.coalesce("pairs", none).alias("pairs"))
        if not t.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            placed = F.transform("pairs", lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"), x["tag"].alias("tag")))
            t = t.groupBy("doc_id", "n_tokens").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("s")).select(
                "doc_id", "n_tokens", F.transform("s", lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag"))).alias("pairs"))
        g = barrier(with_entries(t, self.lexicon), "s")
        classes = F.array_repeat(F.lit(None).cast("string"), F.size("s"))
        if "pos" in self.lexicon.columns:
            classes = word_classes(F.transform("s", lambda x: x["entries"]), self.bigrams)
        g = barrier(g.select("doc_id", "n_tokens", "s", classes.alias("c")), "c")
        return g.select("doc_id", "n_tokens", F.transform("s", lambda x, i: F.struct(
            lemma_of(x["token"], x["entries"], F.try_element_at("c", i + 1)).alias("token"), x["tag"].alias("tag"))).alias("pairs"))

    def filter_pairs(self, pairs: Column) -> Column:
        """TOK-14: lower -> stop words -> punctuation -> user token filter."""
        p = self.params
        if p.filter_stopwords:             # on the lowered token, before any pair is made anew
            stop = list(p.stopwords)
            pairs = F.filter(pairs, lambda x: ~(F.lower(x["token"]) if p.lower else x["token"]).isin(stop))
        if p.lower:
            pairs = F.transform(pairs, lambda x: F.struct(F.lower(x["token"]).alias("token"),
                                                          x["tag"].alias("tag")))
        if p.filter_punctuation:
            pairs = F.filter(pairs, lambda x: ~x["token"].rlike(PUNCTUATION))
        if self.token_filter is not None:
            pairs = self.token_filter(pairs)
        return pairs

    def encode(self, pairs: Column) -> Column:
        """VEC-1/VEC-2: array<struct<term, first>> with first = (position, sub).

        UDF-4: ``encoding`` may also be a function ``pairs -> array<struct<term
        string, first bigint>>`` built from Column expressions.
        """
        enc = self.params.encoding
        if callable(enc):
            return enc(pairs)

        def key(i: Column, sub: int) -> Column:
            return (i * 2 + sub).cast("bigint")

        if enc == "double":
            return F.transform(pairs, lambda x, i: F.struct(
                F.when(x["tag"] == "O", x["token"]).otherwise(F.concat(x["token"], F.lit("_NE"))).alias("term"),
                key(i, 0).alias("first")))
        if enc == "bio":
            return F.flatten(F.transform(pairs, lambda x, i: F.when(
                x["tag"] == "O", F.array(F.struct(x["token"].alias("term"), key(i, 0).alias("first"))))
                .otherwise(F.array(F.struct(x["token"].alias("term"), key(i, 0).alias("first")),
                                   F.struct(strip_bio_prefix(x["tag"]).alias("term"),
                                            key(i, 1).alias("first"))))))
        if enc == "plain":
            return F.transform(pairs, lambda x, i: F.struct(x["token"].alias("term"), key(i, 0).alias("first")))
        raise ValueError(f"unknown encoding {enc!r}")

    def counted(self, tagged: DataFrame) -> DataFrame:
        """(doc_id, pairs) -> (doc_id, n_tokens, counts array<struct<term, cnt, first>>), within the row.

        The terms are sorted; each run of equal ones is one entry with its length and first place.
        """
        tagged = barrier(tagged, "pairs")
        t = tagged.select("doc_id", F.size("pairs").alias("n_tokens"), "pairs")
        t = self._lemmatize(t)
        t = barrier(t.select("doc_id", "n_tokens", F.sort_array(self.encode(self.filter_pairs(F.col("pairs")))).alias("e")), "e")
        n, e = F.size("e"), F.col("e")
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & (
            (i == 1) | (F.try_element_at(e, i)["term"] != F.try_element_at(e, F.greatest(i - 1, F.lit(1)))["term"])))
        t = barrier(t.select("doc_id", "n_tokens", "e", starts.alias("s")), "s")
        run = F.transform("s", lambda i, j: F.struct(
            F.try_element_at(e, i)["term"].alias("term"),
            (F.coalesce(F.try_element_at("s", j + 2), n + 1) - i).cast("bigint").alias("cnt"),
            F.try_element_at(e, i)["first"].alias("first")))
        return t.select("doc_id", "n_tokens", run.alias("counts"))

    def counts(self, tagged: DataFrame) -> DataFrame:
        """(doc_id, pairs) -> (doc_id, n_tokens, term, cnt, first)."""
        return exploded(self.counted(tagged))


def exploded(counted: DataFrame, *carried: str) -> DataFrame:
    """Counted rows -> (doc_id, n_tokens, carried columns, term, cnt, first)."""
    kept = ("doc_id", "n_tokens", *carried)
    return explode_rows(barrier(counted, "counts"), F.col("counts"), "c", *kept).select(
        *kept, F.col("c.term").alias("term"), F.col("c.cnt").alias("cnt"), F.col("c.first").alias("first"))


#: Places within a document are below it; the number of a null doc_id, which comes before every other.
PLACES, NO_ID = "10000000000", "-9223372036854775809"


def first_seen(kind: T.DataType, built_in: bool) -> tuple[Column, Callable[[Column], Column]]:
    """(least (doc_id, first), how to read the struct from it).

    Whole ids and the places of built-in encodings make one decimal: its minimum is hashed, that of a struct is sorted.
    """
    if not (built_in and isinstance(kind, T.IntegralType)):
        return F.min(F.struct("doc_id", "first")), lambda x: x
    places, none = F.lit(PLACES).cast("decimal(11,0)"), F.lit(NO_ID).cast("decimal(19,0)")
    number = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), none)

    def read(x: Column) -> Column:
        first = F.pmod(x, places)
        number = ((x - first) / places).cast("decimal(19,0)")
        return F.struct(F.when(number != none, number.cast(kind)).alias("doc_id"), first.cast("bigint").alias("first"))

    return F.min(number * places + F.col("first").cast("decimal(10,0)")), read


class NerVectorizer:
    """Estimator: ``fit`` returns a :class:`VectorizerModel`.

    Inputs are either raw documents ``DataFrame(doc_id, text)`` or tokenized
    ``DataFrame(doc_id, tokens array<string>, tags array<string>)`` - never both.
    """

    def __init__(self, params: VectorizerParams | None = None, *, tagger=None,
                 preprocessor: ColumnFn | None = None, token_filter: PairsFn | None = None,
                 lexicon: DataFrame | None = None, contractions: dict[str, str] | None = None,
                 analyzer: Callable[[Column], Column] | None = None, bigrams: ClassBigrams | None = None,
                 broadcast_max_rows: int = BROADCAST_MAX_ROWS, validate: bool = True, **kw):
        self.params = replace(params or VectorizerParams(), **kw)
        self.pipeline = TermPipeline(self.params, tagger, preprocessor, token_filter, lexicon,
                                     contractions, analyzer, bigrams)
        self.broadcast_max_rows = broadcast_max_rows
        self.validate = validate

    def get_params(self) -> dict:
        return self.params.get_params()

    # --- input handling ---------------------------------------------------------
    def tagged(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
               text_col: str = "text") -> DataFrame:
        """Validated (doc_id, pairs), in the input's partitions."""
        if (raw_documents is None) == (tokenized is None):
            raise ValueError("give documents or tokenized rows, not both and not neither")
        if tokenized is not None:
            if not {"tokens", "tags"} <= set(tokenized.columns):
                raise ValueError("tokenized input needs both 'tokens' and 'tags' columns")
            if self.validate:
                check_tagged(tokenized)
            return from_token_lists(spread(tokenized))
        return self.pipeline.tag(spread(raw_documents.select("doc_id", text_col)), text_col)

    # --- fit ----------------------------------------------------------------------
    def fit(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
            text_col: str = "text") -> "VectorizerModel":
        return self._model(self.pipeline.counted(self.tagged(raw_documents, tokenized, text_col)), raw_documents, tokenized)

    def _model(self, counted: DataFrame, raw_documents, tokenized) -> "VectorizerModel":
        n_docs = (raw_documents if raw_documents is not None else tokenized).count()
        return VectorizerModel(self, self._vocabulary(exploded(counted), n_docs), n_docs)

    def _vocabulary(self, counts: DataFrame, n_docs: int) -> DataFrame:
        p = self.params
        least, read = first_seen(counts.schema["doc_id"].dataType, not callable(p.encoding))
        per_term = counts.groupBy("term").agg(
            F.sum("cnt").alias("cf"), F.count(F.lit(1)).alias("df"), least.alias("first_seen"))
        freq = F.col("cf") if p.count_mode == "occurrences" else F.col("df")
        lo, hi = bound(p.min_df, n_docs), bound(p.max_df, n_docs)
        kept = per_term.where((freq >= F.lit(lo)) & (freq <= F.lit(hi)))
        ratio = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + freq))
        idf = ratio + 1.0 if p.idf_add_one else ratio
        return checkpoint(kept.select("term", freq.alias("freq"), "cf", "df", idf.alias("idf"),
                                      read(F.col("first_seen")).alias("first_seen")))

    # --- fit + transform ----------------------------------------------------------
    def fit_transform(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
                      use_idf: bool = True, text_col: str = "text") -> DataFrame:
        """``fit`` and ``transform`` sharing one pass over the documents: the counted rows, written once."""
        self.model_, counted = self.fit_counted(raw_documents, tokenized, text_col)
        return self.model_.weights(counted, use_idf)

    def fit_counted(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
                    text_col: str = "text") -> tuple["VectorizerModel", DataFrame]:
        """The fitted model and the counted rows it was fitted on, written once: its ``weights`` are those of ``transform``."""
        counted = checkpoint(self.pipeline.counted(self.tagged(raw_documents, tokenized, text_col)))
        return self._model(counted, raw_documents, tokenized), counted


class VectorizerModel:
    """Fitted vocabulary ``(term, freq, cf, df, idf, first_seen)`` and parameters."""

    def __init__(self, est: NerVectorizer, vocabulary: DataFrame, n_docs: int):
        self.est = est
        self.params = est.params
        self.vocabulary = vocabulary
        self.n_docs = n_docs
        stats = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("total")).first()
        self.vocab_rows = int(stats["n"])
        self.total_freq = float(stats["total"] or 0)
        self._index = None

    def get_idf(self) -> DataFrame:
        return self.vocabulary.select("term", "idf")

    def feature_index(self) -> DataFrame:
        """VOC-5: (term, feature_idx) in first-seen order (document, position, term)."""
        if self._index is None:
            ranked = exact_rank(self.vocabulary.select(
                "term", F.col("first_seen.doc_id").alias("_d"), F.col("first_seen.first").alias("_f")),
                ["_d", "_f", "term"], name="feature_idx")
            self._index = ranked.select("term", (F.col("feature_idx") - 1).cast("int").alias("feature_idx"))
        return self._index

    def get_feature_names(self) -> DataFrame:
        return self.feature_index().orderBy("feature_idx")

    def transform(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
                  use_idf: bool = True, text_col: str = "text") -> DataFrame:
        return self.weights(self.counted(raw_documents, tokenized, text_col), use_idf)

    def counted(self, raw_documents: DataFrame | None = None, tokenized: DataFrame | None = None,
                text_col: str = "text") -> DataFrame:
        """The counted rows of documents, written once: :meth:`weights` reads them more than once."""
        return checkpoint(self.est.pipeline.counted(self.est.tagged(raw_documents, tokenized, text_col)))

    def weights(self, counted: DataFrame, use_idf: bool = True) -> DataFrame:
        """(doc_id, term, weight): TFW-1..4 on written counted rows."""
        if not self.params.normalize:
            return self._raw_weights(counted, use_idf)
        norms = self._raw_weights(counted, use_idf).groupBy(F.col("doc_id").alias("_doc")).agg(
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        n, size = table_size(counted.select("doc_id"))          # as many norms at most
        if n <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES:
            norms = F.broadcast(norms)
        normed = counted.join(norms, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
        return self._raw_weights(normed, use_idf, "norm").select("doc_id", "term", F.when(
            F.col("norm") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("norm")).alias("weight"))

    def _raw_weights(self, counted: DataFrame, use_idf: bool, *carried: str) -> DataFrame:
        """(doc_id, carried columns, term, weight) before the L2 norm."""
        p = self.params
        vocab = self.vocabulary.select("term", "idf", "freq")
        rows = exploded(counted, *carried).select("doc_id", "n_tokens", *carried, "term", "cnt")
        j = skew_safe_lookup(rows, vocab, "term", "freq", self.vocab_rows, self.total_freq,
                             max_rows=self.est.broadcast_max_rows, stored=True)
        tf = F.col("cnt").cast("double")
        if p.tf_mode == "ratio":
            tf = tf / F.col("n_tokens")
        if not use_idf:
            w = tf
        elif p.weighting == "divide":
            w = F.try_divide(tf, F.col("idf"))
        else:
            w = tf * F.col("idf")
        return j.select("doc_id", *carried, "term", w.alias("weight")).where(F.col("weight").isNotNull())


def standard_vectorizer(min_df: int | float = 1, max_df: int | float = 1.0, normalize: bool = True,
                        idf_add_one: bool = True, **kw) -> NerVectorizer:
    """STD-1: word analyzer, document frequency, tf * idf, L2 (like a textbook TF-IDF)."""
    params = VectorizerParams(encoding="plain", min_df=min_df, max_df=max_df, normalize=normalize,
                              filter_stopwords=False, lemmatize=False, lower=False,
                              fix_contractions=False, idf_add_one=idf_add_one, **STANDARD)
    return NerVectorizer(params, analyzer=kw.pop("analyzer", word_tokens), **kw)


# TOK-11 as the ``token_filter`` hook: placeholders, drop non-alphanumeric tokens
builtin_token_filter = filter_pairs


def analyzer_tokens(vec: NerVectorizer, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """TOK-15 / UDF-5: the vectorizer's own cleaning, lemma and token steps, no tagger.

    (doc_id, text) -> (doc_id, tokens array<string>), all tags taken as ``O``.
    """
    pl = vec.pipeline
    pipe = document_pipeline(pl.preprocessor, vec.params.fix_contractions, pl.contractions)
    cleaned = pipe.apply(docs.select("doc_id", F.col(text_col).alias("text")), "text")
    toks = whitespace_tokens(F.col("text"))
    pairs = F.transform(toks, lambda t: F.struct(t.alias("token"), F.lit("O").alias("tag")))
    rows = pl._lemmatize(cleaned.select("doc_id", F.size(toks).alias("n_tokens"), pairs.alias("pairs")))
    return rows.select("doc_id", F.transform(pl.filter_pairs(F.col("pairs")), lambda x: x["token"]).alias("tokens"))


__all__ = ["VectorizerParams", "NerVectorizer", "VectorizerModel", "TermPipeline", "exploded",
           "standard_vectorizer", "builtin_token_filter", "analyzer_tokens",
           "bound", "tokenize"]
