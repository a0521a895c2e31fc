"""Taggers, span -> BIO conversion and tag validation."""

import pytest
from pyspark.sql import functions as F

from spanfold.operators.tagging import (GazetteerTagger, ModelTagger, ShapeTagger, check_tagged, spans_to_bio,
                                        to_long)


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_shape_tagger_bio(spark):
    docs = _docs(spark, ["The talk of Anna Maria at NASA ended. Then Bob left"])
    got = [(r.token, r.tag) for r in to_long(ShapeTagger().tag(docs)).orderBy("pos").collect()]
    assert got == [("The", "O"), ("talk", "O"), ("of", "O"), ("Anna", "B-NAME"), ("Maria", "I-NAME"),
                   ("at", "O"), ("NASA", "B-ORG"), ("ended.", "O"), ("Then", "O"), ("Bob", "B-NAME"),
                   ("left", "O")]


def test_gazetteer_leftmost_longest(spark):
    phrases = spark.createDataFrame([("river bank", "LOC"), ("bank holiday", "EVT"), ("chief engineer", "PER"),
                                     ("engineer", "X")], "phrase string, label string")
    docs = _docs(spark, ["Chief Engineer walked to the River Bank holiday", "solo", ""])
    tagged = GazetteerTagger(phrases).tag(docs)
    got = {r.doc_id: r.tags for r in tagged.select("doc_id", F.transform("pairs", lambda p: p["tag"]).alias("tags")).collect()}
    assert got[0] == ["B-PER", "I-PER", "O", "O", "O", "B-LOC", "I-LOC", "O"]
    assert got[1] == ["O"] and got[2] == []


def test_spans_to_bio_range_join(spark):
    toks = spark.createDataFrame([(0, i, t) for i, t in enumerate("a b c d e".split())],
                                 "doc_id bigint, pos int, token string")
    spans = spark.createDataFrame([(0, 1, 3, "ORG"), (0, 4, 5, "PER")], "doc_id bigint, start int, end int, label string")
    got = [r.tag for r in spans_to_bio(toks, spans).orderBy("pos").collect()]
    assert got == ["O", "B-ORG", "I-ORG", "O", "B-PER"]


@pytest.mark.parametrize("spans", [[(0, 1, 3, "ORG"), (0, 2, 4, "PER")], [(0, 2, 2, "ORG")], [(0, -1, 1, "ORG")]])
def test_bad_spans_are_refused(spark, spans):
    toks = spark.createDataFrame([(0, i, t) for i, t in enumerate("a b c d e".split())],
                                 "doc_id bigint, pos int, token string")
    bad = spark.createDataFrame(spans, "doc_id bigint, start int, end int, label string")
    with pytest.raises(Exception, match="span"):
        spans_to_bio(toks, bad).collect()


@pytest.mark.parametrize("tokens,tags", [([["Oslo", "is", "cold"]], [["B-GPE", "O", "PLACE"]]), ([["Oslo", "shines"]], [["B-GPE"]])])
def test_check_tagged_rejects(spark, tokens, tags):
    df = spark.createDataFrame([(0, tokens[0], tags[0])], "doc_id bigint, tokens array<string>, tags array<string>")
    with pytest.raises(ValueError):
        check_tagged(df)


def test_tags_stay_aligned_after_filter(spark):
    """Every dropped token drops its tag: the pairs array never misaligns."""
    from spanfold.operators.vectorizer import builtin_token_filter
    docs = _docs(spark, ["Hello NASA , ok :) http://x.y Bob !"])
    pairs = ShapeTagger().tag(docs).select(builtin_token_filter(F.col("pairs")).alias("p")).first().p
    assert [(p.token, p.tag) for p in pairs] == [("Hello", "O"), ("NASA", "B-ORG"), ("ok", "O"),
                                                 ("<EMOTE>", "O"), ("<URL>", "O"), ("Bob", "B-NAME")]


def test_empty_documents_and_own_rules(spark):
    docs = _docs(spark, ["", "ééé", "in 1999 the iPhone"])
    assert [len(r.pairs) for r in ShapeTagger().tag(docs).orderBy("doc_id").collect()] == [0, 1, 4]
    own = ShapeTagger(rules=[(r"^\d{4}$", "YEAR"), (r"^i[A-Z]\w+$", "PROD")])
    got = [r.tag for r in to_long(own.tag(docs.where("doc_id = 2"))).orderBy("pos").collect()]
    assert got == ["O", "B-YEAR", "O", "B-PROD"]


@pytest.mark.parametrize("tags", [None, [None]])
def test_null_tags_are_refused(spark, tags):
    df = spark.createDataFrame([(1, ["a"], tags)], "doc_id int, tokens array<string>, tags array<string>")
    with pytest.raises(ValueError):
        check_tagged(df)


@pytest.mark.parametrize("spans", [[(0, 2, "ORG"), (1, 3, "PER")], [(3, 5, "ORG")], [(2, 2, "ORG")]])
def test_model_spans_are_checked(spark, spans):
    docs = _docs(spark, ["red green blue grey"])
    with pytest.raises(Exception, match="spans overlap or leave"):
        ModelTagger(lambda: lambda texts: [spans for _ in texts]).tag(docs).collect()


def test_model_spans_become_tags(spark):
    docs = _docs(spark, ["red green blue grey"])
    got = ModelTagger(lambda: lambda texts: [[(3, 4, "X"), (0, 2, "ORG")] for _ in texts]).tag(docs).first().pairs
    assert [p.tag for p in got] == ["B-ORG", "I-ORG", "O", "B-X"]
