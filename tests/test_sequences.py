"""Sequence tagger, word classes, phrase lookup, carried neighbours and cut keys against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanfold.operators import lexicon, ranking, sampling, sequence
from spanfold.operators.tagging import GazetteerTagger, NullTagger, predict, to_long, tokenize


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = sequence.SequenceModel(["B-X", "I-X", "O"], rng.normal(size=(64, 3)), rng.normal(size=(4, 3)))
    for n in range(1, 6):
        places = rng.integers(0, 64, (n, 4))
        own = model.weights[places].sum(axis=1)

        def score(path):
            return sum(own[i][t] + model.moves[path[i - 1] if i else 3][t] for i, t in enumerate(path))
        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tuple(model.best(places)) == best


def test_trained_tagger_finds_held_out_entities(spark):
    rng = random.Random(4)
    rows = []
    for d in range(120):
        tokens, tags = [], []
        for _ in range(25):
            if rng.random() < 0.2:
                tokens += [rng.choice(("Mr", "Dr")), f"Name{rng.randrange(500)}"]
                tags += ["B-PER", "I-PER"]
            else:
                tokens.append(rng.choice(("the", "a", "runs", "Big", "of")))
                tags.append("O")
        rows.append((d, [{"token": a, "tag": b} for a, b in zip(tokens, tags)]))
    df = spark.createDataFrame(rows, "doc_id long, pairs array<struct<token:string,tag:string>>")
    model = sequence.train(df.where("doc_id < 90"), epochs=3, partitions=2)
    texts = df.where("doc_id >= 90").select("doc_id", F.array_join(F.transform("pairs", lambda p: p["token"]), " ").alias("text"))
    got = predict(sequence.model_tagger(spark, model), texts)
    both = to_long(df).join(got.withColumnRenamed("tag", "found").drop("token"), ["doc_id", "pos"])
    assert both.where("tag = found").count() > 0.98 * both.count()
    with pytest.raises(TypeError):
        predict(NullTagger(), texts.limit(0))
    with pytest.raises(TypeError):
        predict(NullTagger(), None)


def test_bio_spans():
    assert sequence.bio_spans(["O", "B-X", "I-X", "I-Y", "B-Y", "B-Y", "I-Y"]) == [(1, 3, "X"), (3, 4, "Y"), (4, 5, "Y"), (5, 7, "Y")]


def test_best_classes_equal_the_best_of_all_paths():
    rng = random.Random(5)
    logs = {(b, c): -3 * rng.random() for b in ("", *lexicon.CLASSES) for c in lexicon.CLASSES}
    bigrams = lexicon.ClassBigrams(logs)
    for _ in range(60):
        shares = [{c: -2 * rng.random() for c in rng.sample(lexicon.CLASSES, rng.randrange(1, 4))} for _ in range(rng.randrange(1, 6))]

        def score(path):
            return sum(s[c] + logs[(path[i - 1] if i else "", c)] for i, (s, c) in enumerate(zip(shares, path)))
        best = max(itertools.product(*[sorted(s) for s in shares]), key=score)
        assert math.isclose(score(lexicon.best_classes(shares, bigrams)), score(best))
    assert lexicon.best_classes([], bigrams) == []


def test_lemmas_follow_the_word_class(spark):
    from spanfold.operators.vectorizer import NerVectorizer
    lex = spark.createDataFrame([("leaves", "leaf", "n", 1.0), ("leaves", "leave", "v", 1.0), ("saw", "see", "v", 3.0), ("saw", "saw", "n", 1.0),
                                 ("better", "good", "a", 1.0)], "form string, lemma string, pos string, weight double")
    tagged = spark.createDataFrame([(1, [(0, "she", "n"), (1, "leaves", "v")]), (2, [(0, "the", "a"), (1, "leaves", "n")])],
                                   "doc_id long, t array<struct<pos:int,token:string,cls:string>>").select(
        "doc_id", F.explode("t").alias("x")).select("doc_id", "x.pos", "x.cls")
    bigrams = lexicon.ClassBigrams.fit(tagged, smooth=0.01)
    assert bigrams.move("n", "v") > bigrams.move("n", "n") and bigrams.move("", "a") > bigrams.move("", "v")
    docs = spark.createDataFrame([(1, "she leaves better"), (2, "leaves"), (3, ""), (4, "saw unknown")], "doc_id long, text string")
    toks = tokenize(docs).select("doc_id", F.size("tokens").alias("n_tokens"), F.transform(
        "tokens", lambda t: F.struct(t.alias("token"), F.lit("O").alias("tag"))).alias("pairs"))
    pipe = NerVectorizer(lexicon=lex, bigrams=bigrams).pipeline
    got = {r["doc_id"]: [p["token"] for p in r["pairs"]] for r in pipe._lemmatize(toks).collect()}
    assert got[1] == ["she", "leave", "good"] and got[3] == [] and got[4][1] == "unknown"
    plain = NerVectorizer(lexicon=lex.select("form", "lemma").where("form = 'better'")).pipeline
    assert {r["doc_id"]: [p["token"] for p in r["pairs"]] for r in plain._lemmatize(toks).collect()}[1] == ["she", "leaves", "good"]


def slow_spans(tokens, phrases):
    low, out, i = [t.lower() for t in tokens], [], 0
    while i < len(low):
        hit = max((n for n in range(1, 6) if tuple(low[i:i + n]) in phrases and i + n <= len(low)), default=0)
        if hit:
            out.append((i, hit, phrases[tuple(low[i:i + hit])]))
        i += max(1, hit)
    return out


def test_gazetteer_equals_scanning_every_position(spark):
    rng = random.Random(9)
    words = ["a", "b", "c", "New", "york"]
    phrases = {tuple(rng.choice(words).lower() for _ in range(rng.randrange(1, 5))): f"L{k % 3}" for k in range(12)}
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for d in range(40)]
    table = spark.createDataFrame([(" ".join(p), lab) for p, lab in phrases.items()], "phrase string, label string")
    tagger = GazetteerTagger(table)
    toks = tokenize(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in tagger.spans(toks).collect()}
    assert got == {d: slow_spans(t.split(), phrases) for d, t in docs}
    # at most one lookup for a word and one for a pair of words, however long the phrases are
    assert tagger.hits(toks).where(F.size("words") > 2).groupBy("doc_id", "start", "words").count().where("count > 1").count() == 0


def test_neighbours_are_carried_across_partitions(spark):
    rng = random.Random(6)
    rows = [(g, x, float(x) if rng.random() < 0.1 else None) for g in "ab" for x in range(200)]
    df = spark.createDataFrame(rows, "g string, x int, v double")
    got = {(r.g, r.x): (r.before, r.after) for r in ranking.neighbours(df, "v", ["x"], ["g"], num_partitions=7).collect()}
    for g in "ab":
        known = [x for h, x, v in rows if h == g and v is not None]
        for x in range(200):
            assert got[g, x] == (max((float(k) for k in known if k <= x), default=None),
                                 min((float(k) for k in known if k >= x), default=None))


@pytest.mark.parametrize("few", [1, 10_000])
def test_cut_keys_by_histogram(spark, few):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("c"))
    got = {r["c"]: (r["_h"], r["doc_id"]) for r in sampling._cut_keys(df, "doc_id", 7, 400, ["c"], digits=1, few=few).collect()}
    keys = {r["doc_id"]: (r["c"], r["h"]) for r in df.withColumn("h", sampling.seeded_key("doc_id", 7)).collect()}
    for c in ("hot", "cold"):
        assert got[c] == sorted((h, d) for d, (k, h) in keys.items() if k == c)[399]


def test_fit_does_not_shuffle_documents(spark):
    from spanfold.operators.vectorizer import NerVectorizer, exploded
    docs = spark.createDataFrame([(d, "a b a C" * d) for d in range(5)], "doc_id long, text string").coalesce(4)
    v = NerVectorizer()
    plan = exploded(v.pipeline.counted(v.tagged(docs)))._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" not in plan
    counts = {(r["doc_id"], r["term"]): r["cnt"] for r in v.pipeline.counts(v.tagged(docs.where("doc_id = 1"))).collect()}
    assert counts == {(1, "b"): 1, (1, "c"): 1}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_documents_are_not_shuffled_for_lemmas(spark, bound):
    """Entries come to the tokens in their documents, whether the lexicon is broadcast or not; empty documents stay."""
    from spanfold.operators.lexicon import with_entries
    texts = {1: "cats sat on cats", 2: "", 3: "no hits here", None: "dogs"}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, t string").repartition(3).select(
        "doc_id", F.lit(9).alias("n_tokens"), F.expr(
            "transform(filter(split(t, ' '), x -> x <> ''), x -> struct(x AS token, 'O' AS tag))").alias("pairs"))
    lexicon = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    out = with_entries(docs, lexicon, bound)
    got = {r["doc_id"]: [(x["token"], x["entries"] and x["entries"][0]["lemma"]) for x in r["s"]] for r in out.collect()}
    assert got == {1: [("cats", "cat"), ("sat", None), ("on", None), ("cats", "cat")], 2: [],
                   3: [("no", None), ("hits", None), ("here", None)], None: [("dogs", "dog")]}
    if bound:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "broadcast" in plan
