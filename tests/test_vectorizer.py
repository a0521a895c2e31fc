"""Vectorizer behaviour: worked examples, argument checks, fit/transform parity,
standard-mode equality with a plain TF-IDF, unit norms."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanfold.operators.tagging import NullTagger
from spanfold.operators.vectorizer import NerVectorizer, VectorizerParams, analyzer_tokens, first_seen

ROWS = [(0, "Alice met Bob in Paris".split(), "B-PER O B-PER O B-GPE".split()),
        (1, "Paris is in France".split(), "B-GPE O O B-GPE".split()),
        (2, "alice in paris met met".split(), "O O O O O".split())]

DOUBLE = {0: {"alice_NE": 0.325087, "met": 0.550420, "bob_NE": 0.325087, "in": 0.550420, "paris_NE": 0.427450},
          1: {"paris_NE": 0.511985, "is": 0.389378, "in": 0.659274, "france_NE": 0.389378},
          2: {"alice": 0.247433, "in": 0.418940, "paris": 0.247433, "met": 0.837880}}
BIO = {0: {"alice": 0.286171, "PER": 0.572343, "met": 0.368498, "bob": 0.217641, "in": 0.368498,
           "paris": 0.368498, "GPE": 0.368498},
       1: {"paris": 0.386401, "GPE": 0.772803, "is": 0.228215, "in": 0.386401, "france": 0.228215},
       2: {"alice": 0.302216, "in": 0.389158, "paris": 0.389158, "met": 0.778317}}


def _tok(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, tags array<string>")


def _as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, {})[r.term] = round(r.weight, 6)
    return out


@pytest.mark.parametrize("enc,expected", [("double", DOUBLE), ("bio", BIO)])
def test_worked_examples(spark, enc, expected):
    v = NerVectorizer(VectorizerParams(encoding=enc, filter_stopwords=False, lemmatize=False, max_df=20))
    assert _as_dict(v.fit_transform(tokenized=_tok(spark))) == expected


def _rows(spark, rows, fields):
    return spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{f} array<string>" for f in fields))


REFUSED = {
    "unknown tag": ([(7, ["Oslo", "is", "cold"], ["B-GPE", "O", "PLACE"])], ["tokens", "tags"], False),
    "fewer tags than tokens": ([(7, ["Oslo", "shines"], ["B-GPE"])], ["tokens", "tags"], False),
    "no tags column": ([(7, ["Oslo", "shines"])], ["tokens"], False),
    "no tokens column": ([(7, ["B-GPE", "O"])], ["tags"], False),
    "tokens, tags and texts": ([(7, ["Oslo"], ["B-GPE"])], ["tokens", "tags"], True),
    "tokens and texts": ([(7, ["Oslo"])], ["tokens"], True),
}


@pytest.mark.parametrize("case", REFUSED)
def test_refused_arguments(spark, case):
    rows, fields, with_texts = REFUSED[case]
    texts = spark.createDataFrame([(7, "Oslo shines")], "doc_id bigint, text string") if with_texts else None
    with pytest.raises(ValueError):
        NerVectorizer().fit(raw_documents=texts, tokenized=_rows(spark, rows, fields))


def test_nothing_to_fit_is_refused(spark):
    with pytest.raises(ValueError):
        NerVectorizer().fit()


SENTENCES = ["Quick brown foxes jump over lazy dogs", "Pack my box with five dozen liquor jugs",
             "Sphinx of black quartz judge my vow", "Bright vixens jump in the dozy fowl quack in the pond"]


def _docs(spark, texts=SENTENCES):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_fit_transform_equal_to_fit_and_transform(spark):
    docs = _docs(spark)
    a = _as_dict(NerVectorizer(tagger=NullTagger(), max_df=20).fit_transform(docs))
    m = NerVectorizer(tagger=NullTagger(), max_df=20).fit(docs)
    assert _as_dict(m.transform(docs)) == a


def test_standard_mode_equals_plain_tfidf(spark):
    """Without entities, the vectorizer in standard mode equals a textbook TF-IDF
    (document frequency, smooth idf, count * idf, L2) on its own tokens."""
    docs = _docs(spark)
    v = NerVectorizer(VectorizerParams(encoding="double", count_mode="documents", weighting="multiply",
                                       tf_mode="raw"), tagger=NullTagger())
    got = _as_dict(v.fit_transform(docs))
    toks = {r.doc_id: r.tokens for r in analyzer_tokens(v, docs).collect()}
    n = len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    exp = {}
    for d, ts in toks.items():
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        exp[d] = {t: round(x / norm, 6) for t, x in w.items()}
    assert got == exp


def test_rows_have_unit_norm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    w = NerVectorizer(tagger=NullTagger()).fit_transform(docs)
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert norms and all(abs(r.s - 1.0) < 1e-9 for r in norms)


def test_analyzer_and_vectorizer_share_tokens(spark):
    """The exported analyzer yields exactly the vectorizer's feature names."""
    from spanfold.functions.text import CLEANER
    from spanfold.operators.vectorizer import builtin_token_filter
    texts = ["This sentence has an url http://www.google.com and @mention and a number 12 12.3 12,5"] + SENTENCES[:3]
    docs = _docs(spark, texts)
    v = NerVectorizer(tagger=NullTagger(), preprocessor=CLEANER, token_filter=builtin_token_filter, max_df=20)
    names = {r.term for r in v.fit(docs).vocabulary.collect()}
    toks = {t for r in analyzer_tokens(v, docs).collect() for t in r.tokens}
    assert names == toks


def test_min_max_df_types(spark):
    """int bounds are counts, float bounds are shares of the documents."""
    docs = _docs(spark)
    m = NerVectorizer(tagger=NullTagger(), filter_stopwords=False, min_df=2, max_df=1.0).fit(docs)
    # occurrence counts >= 2 and <= 1.0 * 4 documents
    assert {r.term for r in m.vocabulary.collect()} == {"jump", "my", "in", "the"}


def test_large_vocabulary_path_equals_broadcast_path(spark):
    """Above the broadcast bound the lookup splits hot terms (broadcast) from the
    rest (salted shuffle join); the weights must not change."""
    from spanfold.functions.text import CLEANER
    from spanfold.operators.tagging import ShapeTagger
    from spanfold.operators.vectorizer import builtin_token_filter
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def run(bound):
        v = NerVectorizer(VectorizerParams(encoding="bio"), tagger=ShapeTagger(), preprocessor=CLEANER,
                          token_filter=builtin_token_filter, broadcast_max_rows=bound)
        return {(r.doc_id, r.term): round(r.weight, 9) for r in v.fit_transform(docs).collect()}

    small = run(50)          # forces the hot/cold split: the vocabulary has thousands of terms
    assert small == run(10_000_000)


def test_custom_encoding_hook(spark):
    """UDF-4: a user term encoding (entity type only, for tagged tokens)."""
    def types_only(pairs):
        kept = F.filter(pairs, lambda x: x["tag"] != "O")
        return F.transform(kept, lambda x, i: F.struct(F.regexp_replace(x["tag"], "^[BI]-", "").alias("term"),
                                                       (i * 2).cast("bigint").alias("first")))
    v = NerVectorizer(VectorizerParams(encoding=types_only, filter_stopwords=False, max_df=20))
    got = _as_dict(v.fit_transform(tokenized=_tok(spark)))
    assert set(got) == {0, 1} and set(got[0]) == {"PER", "GPE"} and set(got[1]) == {"GPE"}


def test_analyzer_uses_the_lexicon(spark):
    lexicon = spark.createDataFrame([("rivers", "river"), ("stones", "stone")], "form string, lemma string")
    vec = NerVectorizer(VectorizerParams(lemmatize=True), lexicon=lexicon)
    docs = _docs(spark, ["rivers stones rivers", ""])
    got = {r.doc_id: r.tokens for r in analyzer_tokens(vec, docs).collect()}
    assert got == {0: ["river", "stone", "river"], 1: []}
    assert {r.term for r in vec.pipeline.counts(vec.tagged(docs)).select("term").distinct().collect()} == {"river", "stone"}


def test_weights_are_neither_shuffled_nor_sorted(spark):
    """A broadcast vocabulary: one number a document is shuffled for the norms; the vocabulary's minimum is hashed."""
    vec = NerVectorizer(tagger=NullTagger(), max_df=20)
    plan = vec.fit_transform(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert all("term" not in line for line in plan.splitlines() if " Exchange " in line)
    counts = vec.pipeline.counts(vec.tagged(_docs(spark)))
    least, _ = first_seen(counts.schema["doc_id"].dataType, True)
    assert "SortAggregate" not in counts.groupBy("term").agg(least)._jdf.queryExecution().executedPlan().toString()


def test_first_seen_is_the_least_pair(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(d, f, t) for t, pairs in {"a": [(3, 9), (3, 4), (5, 0)], "b": [(low, 2), (None, 8), (None, 7)], "c": [(low, 6), (-1, 0)],
                                       "d": [(high, (1 << 32) - 1)]}.items() for d, f in pairs]
    df = spark.createDataFrame(rows, "doc_id bigint, first bigint, term string")
    for built_in in (True, False):
        least, read = first_seen(df.schema["doc_id"].dataType, built_in)
        got = df.groupBy("term").agg(least.alias("x")).select("term", read(F.col("x")).alias("x"))
        assert {r.term: tuple(r.x) for r in got.collect()} == {"a": (3, 4), "b": (None, 7), "c": (low, 6), "d": (high, (1 << 32) - 1)}


@pytest.mark.parametrize("bound", [2, 10_000])
def test_norms_of_null_and_repeated_ids(spark, bound):
    """Rows of one id, null included, share a norm, whichever way the vocabulary is looked up."""
    docs = spark.createDataFrame([(None, "red blue"), (None, "red"), (4, "red green"), (4, "blue green"), (5, "")],
                                 "doc_id bigint, text string")
    w = NerVectorizer(tagger=NullTagger(), max_df=20, broadcast_max_rows=bound).fit_transform(docs, use_idf=False).collect()
    raw = {None: [("red", .5), ("blue", .5), ("red", 1.)], 4: [("red", .5), ("green", .5), ("blue", .5), ("green", .5)]}
    expected = [(d, t, round(x / math.sqrt(sum(y * y for _, y in rows)), 9)) for d, rows in raw.items() for t, x in rows]
    assert Counter((r.doc_id, r.term, round(r.weight, 9)) for r in w) == Counter(expected)
