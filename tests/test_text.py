"""Cleaner and token rules on the literal cases of FIXTURES.md."""

import html

import pytest
from pyspark.sql import functions as F

from spanfold.functions import text as T
from spanfold.functions import tokens as K

CLEAN_CASES = [
    ("AT amp;T", "AT&T"), ("it #39;s", "it's"), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("a&nbsp;b", "ab"),
    ("#BlackLivesMatter", "Black Lives Matter"), ("#USAToday", "USAT oday"), ("x#a#b", "xab"),
    ("##", ""), ("#a#", "a#"), ("naïve", "nave"), ("&amp;lt;b", "&lt;b"), ("word### more", "word more"),
]


def _one(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("t"))).collect()]


def test_cleaner_cases(spark):
    got = _one(spark, T.clean_text, [a for a, _ in CLEAN_CASES])
    assert got == [b for _, b in CLEAN_CASES]


def test_cleaner_table_form_equals_column_form(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN_CASES)], "doc_id int, text string")
    got = [r.text for r in T.CLEANER.apply(df, "text").orderBy("doc_id").collect()]
    assert got == [b for _, b in CLEAN_CASES]


@pytest.mark.parametrize("s", ["&#128512; &#x41;&#65 &#0; &#150;", "&ampx &notanentity; &copy2", "&#99999999999;",
                               "a &lt;&gt;&quot;&apos; b", "&Eacute;t&eacute; &hellip; &mdash;", "a &lbrace;b&rbrace; &alpha;&lpar;&dollar;", "&#x" + "0" * 70 + "41; &#" + "0" * 80 + "66;"])
def test_unescape_matches_python(spark, s):
    assert _one(spark, T.unescape_html, [s]) == [html.unescape(s)]


def test_hashtag_pairs(spark):
    """Literal pairs worked out by hand from the rule's description."""
    pairs = [("go #OneTwo now", "go One Two now"), ("#allsmall", "allsmall"), ("#LOUD", "LOUD"),
             ("x #Top10Films", "x Top 10 Films"), ("no tag # here", "no tag # here"), ("plain", "plain")]
    assert _one(spark, T.split_hashtags, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_token_rules(spark):
    toks = ["12", "12.3", "12,5", "1x2", "1.2.3", "foo.", "don't", ":)", "<3", "@me", "http://a", "", "abc"]
    exp = ["<NUMBER>"] * 4 + [None, None, None, "<EMOTE>", "<EMOTE>", "<USER>", "<URL>", None, "abc"]
    assert _one(spark, K.replace_token, toks) == exp


def test_url_sentence_tokens(spark):
    s = "Ask @helper or see http://docs.example.org for 12 12.3 12,5 more"
    df = spark.createDataFrame([(s,)], "t string")
    toks = K.whitespace_tokens(T.clean_text(F.col("t")))
    pairs = K.pairs_of(K.lower_tokens(toks), F.transform(toks, lambda _: F.lit("O")))
    out = K.filter_pairs(K.remove_stopwords(pairs))
    got = df.select(F.transform(out, lambda p: p["token"]), F.size(toks)).first()
    assert got[0] == ["ask", "<USER>", "see", "<URL>", "<NUMBER>", "<NUMBER>", "<NUMBER>"]
    assert got[1] == 10


def test_contractions(spark):
    got = _one(spark, T.expand_contractions, ["I'm sure they're here, don't WORRY", "It’s fine"])
    assert got == ["I am sure they are here, do not WORRY", "It is fine"]


def test_cleaning_leaves_ascii_only(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bad = T.CLEANER.apply(df, "text").where(F.col("text").rlike(r"[^\x00-\x7F]")).count()
    assert bad == 0


def test_whitespace_runs_skip_single_blanks_and_guards_change_nothing(spark):
    """The collapse matches only what changes; steps behind a guard give what their patterns give alone."""
    texts = ["a b", " a  b ", "a\tb", "\n\n", " \t x  y", "", None, "a  b", "x amp; y #12; z", "x amp y", "1 < 2", "2 > 1", "a<b>c</b>",
             "> <", "hééllo€", "it's", "it’s", "#aB#cD##", "x#y#Zz", "##", "#one#TWO", "a#b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = F.col("t")
    for got, want in ((T.collapse_whitespace(c), F.regexp_replace(c, T.WS_RUN, " ")),
                      (T.add_missing_amps(c), F.regexp_replace(c, T.MISSING_AMP, "&$1")),
                      (T.strip_tags(c), F.regexp_replace(c, T.HTML_TAG, "")),
                      (T.remove_nonascii(c), F.regexp_replace(c, r"[^\x00-\x7F]", ""))):
        assert df.where(~got.eqNullSafe(want)).count() == 0
    assert spark.range(1).select(F.regexp_count(F.lit("one two  three\tfour"), F.lit(T.WS_TO_COLLAPSE))).first()[0] == 2


def test_plain_words_keep_the_placeholder_rules(spark):
    words = ["abc", "Abc", "http", "https", "httpx1", "http://a", "@me", "12", "1,2", "1.2", ":)", "a1", "a-b", "", None, "abc\n", "été", "HTTPx"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(K.replace_token(F.col("w"))).collect()]
    assert got == ["abc", "Abc", "http", "<URL>", "<URL>", "<URL>", "<USER>", "<NUMBER>", "<NUMBER>", "<NUMBER>", "<EMOTE>", "a1", None, None, None,
                   "abc\n", "été", "HTTPx"]


def test_tokens_and_hashtags_of_any_blanks(spark):
    """Texts with and without other whitespace than the blank: the same tokens, and hashtag chunks with their blanks."""
    import random
    import re

    from pyspark.sql import functions as F

    from spanfold.functions import text as T
    from spanfold.functions.tokens import OTHER_WS, whitespace_tokens
    rng = random.Random(3)
    alphabet = ["a", "B", "1", "#", " ", "é", *OTHER_WS, "\x85", " "]
    texts = ["".join(rng.choice(alphabet[:n]) for _ in range(rng.randint(0, 25))) for n in (5, 6, 12, len(alphabet)) for _ in range(60)]
    texts += ["", " ", "#", "x" * 20_000 + "#One" + "y" * 20_000, "#" * 500, " #aB \t#oneTwo\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    chunks = F.regexp_extract_all("text", F.lit(T.CHUNK), 0)
    for r in df.select("text", whitespace_tokens(F.col("text")).alias("t"), chunks.alias("c"),
                       T.split_hashtags(F.col("text")).alias("h")).collect():
        assert r["t"] == r["text"].split()
        assert "".join(r["c"]) == r["text"] and all(re.fullmatch(r"\S*\s*", c) for c in r["c"])
        if "#" not in r["text"]:
            assert r["h"] == r["text"]
    got = df.where(F.col("text").startswith(" #aB")).select(T.split_hashtags(F.col("text"))).first()[0]
    assert got == "  \tone Two\n"            # single letters vanish
