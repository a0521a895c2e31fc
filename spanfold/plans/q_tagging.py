"""Tagging and array queries (NER-*, ARR-2/3/5, STA-6/7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import barrier, explode_rows, posexplode_rows
from ..functions.text import CLEANER
from ..functions.tokens import whitespace_tokens
from ..operators.sampling import number_rows, train_test_split
from ..operators.sequence import model_tagger, train
from ..operators.tagging import (GazetteerTagger, ModelTagger, NullTagger, ShapeTagger, predict, spans_to_bio,
                                 to_long, tokenize, violations)
from ..operators.vectorizer import NerVectorizer, VectorizerParams
from ..session import checkpoint, spread
from ..sources.tables import table
from . import duck as D
from .common import SPLIT_SEED, SQL_SPLIT, SQL_TAGGED_TOKENS, documents, sql_weights
from .registry import r6, register


def cleaned_documents(spark, sf):
    return CLEANER.apply(spread(documents(spark, sf)), "text")


# --- NER-2 / NER-3b ------------------------------------------------------------------
@register("ner2_null_tagger", f"""SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token, 'O' AS tag
FROM (SELECT doc_id, {D.tokens('text')} AS toks FROM documents)""")
def ner2_null_tagger(spark, sf):
    return to_long(NullTagger().tag(documents(spark, sf))).withColumn("pos", F.col("pos").cast("bigint"))


@register("ner3_shape_tagger", f"WITH {SQL_TAGGED_TOKENS} SELECT doc_id, pos, tok AS token, tag FROM u")
def ner3_shape_tagger(spark, sf):
    return predict(ShapeTagger(), cleaned_documents(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@register("arr2_explode_pairs", f"WITH {SQL_TAGGED_TOKENS} SELECT doc_id, pos, tok AS token, tag FROM u")
def arr2_explode_pairs(spark, sf):
    return to_long(ShapeTagger().tag(cleaned_documents(spark, sf))).withColumn("pos", F.col("pos").cast("bigint"))


# --- NER-3a gazetteer: phrases derived from the benchmark passages ---------------------
def gazetteer_phrases(spark, sf):
    """Bigrams seen at least twice in the benchmark ('B2') and words of 10+ letters ('W10')."""
    bench = CLEANER.apply(table(spark, sf, "benchmark").select("item_id", "text"), "text")
    toks = bench.select("item_id", F.transform(whitespace_tokens(F.col("text")), F.lower).alias("t"))
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))),
                          lambda i: F.when(F.size("t") > 1, F.concat_ws(" ", F.try_element_at("t", i),
                                                                         F.try_element_at("t", i + 1))))
    bg = explode_rows(toks, bigrams, "phrase").groupBy("phrase").count().where("count >= 2")
    words = explode_rows(toks, F.col("t"), "phrase").where(F.length("phrase") >= 10).distinct()
    return bg.select("phrase", F.lit("B2").alias("label")).unionByName(
        words.select("phrase", F.lit("W10").alias("label")))


SQL_GAZETTEER = f"""bd AS (SELECT item_id, list_transform({D.tokens(D.clean('text'))}, lambda x: lower(x)) AS t
       FROM benchmark),
g2 AS (SELECT key, 'B2' AS label, 2 AS n FROM (
         SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS key FROM bd)
       GROUP BY key HAVING count(*) >= 2),
g1 AS (SELECT DISTINCT key, 'W10' AS label, 1 AS n FROM (SELECT unnest(t) AS key FROM bd) WHERE length(key) >= 10),
gaz AS (SELECT * FROM g2 UNION ALL SELECT * FROM g1),
dd AS (SELECT doc_id, {D.tokens(D.clean('text'))} AS toks FROM documents),
cand AS (SELECT doc_id, unnest(range(len(toks))) AS start, 1 AS n,
                unnest(list_transform(toks, lambda x: lower(x))) AS key FROM dd
         UNION ALL
         SELECT doc_id, unnest(range(len(toks) - 1)) AS start, 2 AS n,
                unnest(list_transform(range(1, len(toks)), lambda i: lower(toks[i]) || ' ' || lower(toks[i + 1]))) AS key
         FROM dd WHERE len(toks) > 1),
hits AS (SELECT c.doc_id, c.start, c.n, g.label FROM cand c JOIN gaz g ON g.key = c.key AND g.n = c.n),
best AS (SELECT doc_id, start, n, label FROM (
           SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY n DESC, label) AS r FROM hits) WHERE r = 1),
nxt AS (SELECT b.doc_id, b.start, b.n, b.label, b2.start AS next_start
        FROM best b ASOF LEFT JOIN best b2 ON b.doc_id = b2.doc_id AND b2.start >= b.start + b.n),
chosen AS (SELECT * FROM nxt WHERE (doc_id, start) IN (SELECT (doc_id, min(start)) FROM best GROUP BY doc_id)
           UNION ALL
           SELECT x.* FROM chosen c JOIN nxt x ON x.doc_id = c.doc_id AND x.start = c.next_start),
spans AS (SELECT doc_id, start, start + n AS "end", label FROM chosen),
tagged AS (SELECT s.doc_id, s.start + k AS pos, CASE WHEN k = 0 THEN 'B-' ELSE 'I-' END || s.label AS tag
           FROM spans s, (SELECT unnest(range(2)) AS k) r WHERE k < s."end" - s.start)"""

SQL_GAZETTEER_ROWS = f"""WITH RECURSIVE {SQL_GAZETTEER},
u AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM dd)
SELECT doc_id, pos, token, coalesce(tag, 'O') AS tag FROM u LEFT JOIN tagged USING (doc_id, pos)"""


@register("ner3_gazetteer_tagger", SQL_GAZETTEER_ROWS)
def ner3_gazetteer_tagger(spark, sf):
    long = predict(GazetteerTagger(gazetteer_phrases(spark, sf)), cleaned_documents(spark, sf))
    return long.withColumn("pos", F.col("pos").cast("bigint"))


@register("ner4_spans_to_bio", SQL_GAZETTEER_ROWS)
def ner4_spans_to_bio(spark, sf):
    """Range join of token rows with (start, end) spans, end exclusive."""
    docs = cleaned_documents(spark, sf)
    tagger = GazetteerTagger(gazetteer_phrases(spark, sf))
    toks = checkpoint(tokenize(docs))
    spans = explode_rows(tagger.spans(toks), F.col("spans"), "s", "doc_id").select(
        "doc_id", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.n")).alias("end"),
        F.col("s.label").alias("label"))
    long = posexplode_rows(toks, F.col("tokens"), "pos", "token", "doc_id")
    return spans_to_bio(long, spans).withColumn("pos", F.col("pos").cast("bigint"))


# --- NER-5 / NER-6 ---------------------------------------------------------------------
ROLE_TAG = "CASE role WHEN 'user' THEN 'O' WHEN 'assistant' THEN 'B-ASSISTANT' ELSE 'SYSTEM' END"


@register("ner5_invalid_tags", f"""SELECT conv_id, turn, len(toks) <> len(tags) AS length_mismatch,
  len(list_filter(tags, lambda g: NOT regexp_matches(g, '^(O$|B-|I-)'))) > 0 AS bad_tag
FROM (SELECT conv_id, turn, {D.tokens('text')} AS toks,
             list_transform({D.tokens('text')}, lambda x: {ROLE_TAG}) AS tags FROM conversations)
WHERE len(toks) <> len(tags) OR len(list_filter(tags, lambda g: NOT regexp_matches(g, '^(O$|B-|I-)'))) > 0""")
def ner5_invalid_tags(spark, sf):
    c = table(spark, sf, "conversations")
    toks = whitespace_tokens(F.col("text"))
    tag = F.expr(ROLE_TAG)
    df = c.select("conv_id", "turn", toks.alias("tokens"), F.transform(toks, lambda _: tag).alias("tags"))
    return violations(df, keys=("conv_id", "turn"))


@register("ner6_length_mismatch", f"""SELECT conv_id, turn, len(toks) <> len(tags) AS length_mismatch,
  len(list_filter(tags, lambda g: NOT regexp_matches(g, '^(O$|B-|I-)'))) > 0 AS bad_tag
FROM (SELECT conv_id, turn, {D.tokens('text')} AS toks,
             list_transform(string_split(text, ' '), lambda x: 'O') AS tags FROM conversations)
WHERE len(toks) <> len(tags) OR len(list_filter(tags, lambda g: NOT regexp_matches(g, '^(O$|B-|I-)'))) > 0""")
def ner6_length_mismatch(spark, sf):
    """Tags from a single-blank split: newlines and blank runs make the lengths differ."""
    c = table(spark, sf, "conversations")
    df = c.select("conv_id", "turn", whitespace_tokens(F.col("text")).alias("tokens"),
                  F.transform(F.split("text", " ", -1), lambda _: F.lit("O")).alias("tags"))
    return violations(df, keys=("conv_id", "turn"))


# --- NER-8: tag once, feed two vectorizers ------------------------------------------------
@register("ner8_tag_once_two_encodings",
          f"SELECT 'double' AS state, * FROM ({sql_weights('double')}) UNION ALL "
          f"SELECT 'bio' AS state, * FROM ({sql_weights('bio')})")
def ner8_tag_once_two_encodings(spark, sf):
    from ..operators.vectorizer import builtin_token_filter
    tagged = checkpoint(ShapeTagger().tag(cleaned_documents(spark, sf)))
    tokenized = tagged.select("doc_id", F.transform("pairs", lambda p: p["token"]).alias("tokens"),
                              F.transform("pairs", lambda p: p["tag"]).alias("tags"))
    out = None
    for enc in ("double", "bio"):
        v = NerVectorizer(VectorizerParams(encoding=enc), token_filter=builtin_token_filter)
        w = v.fit_transform(tokenized=tokenized).select(
            F.lit(enc).alias("state"), "doc_id", "term", r6("weight").alias("weight"))
        out = w if out is None else out.unionByName(w)
    return out


# --- ARR-3 / ARR-5 -------------------------------------------------------------------------
@register("arr3_regroup_turns", f"""SELECT conv_id, turn, count(*) AS n_tokens,
  string_agg(token, ' ' ORDER BY pos) AS text
FROM (SELECT conv_id, turn, unnest(range(len(toks))) AS pos, unnest(toks) AS token
      FROM (SELECT conv_id, turn, {D.tokens('text')} AS toks FROM conversations)) GROUP BY conv_id, turn""")
def arr3_regroup_turns(spark, sf):
    """Token rows -> one ordered list per sentence (here a turn: one source row, a bounded group)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", whitespace_tokens(F.col("text")).alias("t"))
    rows = posexplode_rows(c, F.col("t"), "pos", "token", "conv_id", "turn")
    g = rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return g.select("conv_id", "turn", F.size("s").cast("bigint").alias("n_tokens"),
                    F.array_join(F.transform("s", lambda x: x["token"]), " ").alias("text"))


@register("arr5_number_documents",
          "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sentence_no FROM documents")
def arr5_number_documents(spark, sf):
    return number_rows(documents(spark, sf).select("doc_id"), "doc_id", "sentence_no")


# --- STA-6 / STA-7 ---------------------------------------------------------------------------
@register("sta6_avg_words_per_document", f"""WITH {SQL_TAGGED_TOKENS}
SELECT lang, round(avg(len(toks)), 6) AS avg_words FROM d JOIN documents USING (doc_id) GROUP BY lang""")
def sta6_avg_words_per_document(spark, sf):
    """The class travels with the text: no join back, one partial aggregate by lang."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    t = CLEANER.apply(docs, "text").select("lang", F.size(whitespace_tokens(F.col("text"))).alias("n"))
    return t.groupBy("lang").agg(r6(F.avg("n")).alias("avg_words"))


@register("sta7_entities_per_doc", f"""WITH {SQL_TAGGED_TOKENS}
SELECT lang, round(avg(len(list_filter(tags, lambda g: starts_with(g, 'B-')))), 6) AS avg_entities
FROM t JOIN documents USING (doc_id) GROUP BY lang""")
def sta7_entities_per_doc(spark, sf):
    """Entities (B- tags) per document, zero-entity documents included, averaged by class."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    toks = barrier(CLEANER.apply(docs, "text").select(
        "lang", whitespace_tokens(F.col("text")).alias("tokens")), "tokens")
    labs = barrier(toks.select("lang", ShapeTagger().labels(F.col("tokens")).alias("l")), "l")
    n = F.size(F.filter("l", lambda x, i: x.isNotNull() & ~x.eqNullSafe(
        F.when(i > 0, F.try_element_at("l", F.greatest(i, F.lit(1)))))))
    return labs.select("lang", n.alias("n")).groupBy("lang").agg(r6(F.avg("n")).alias("avg_entities"))


# --- TOK-13: lexicon lemmatization; TOK-17: BIO prefix ------------------------------------
def plural_lexicon(toks: DataFrame) -> DataFrame:
    """A lexicon derived from the corpus: a form ending in 's' whose stem is also a token."""
    words = explode_rows(toks, F.col("tokens"), "w").select("w").distinct()
    plural = words.where(F.col("w").endswith("s") & (F.length("w") > 3)).select(
        F.col("w").alias("form"), F.expr("substring(w, 1, length(w) - 1)").alias("lemma"))
    return plural.join(words.select(F.col("w").alias("lemma")), "lemma", "left_semi")


@register("tok13_lemmatize", f"""WITH d AS (SELECT doc_id, {D.tokens(D.clean('text'))} AS toks FROM documents),
w AS (SELECT DISTINCT unnest(toks) AS w FROM d),
lx AS (SELECT w AS form, left(w, length(w) - 1) AS lemma FROM w
       WHERE w LIKE '%s' AND length(w) > 3 AND left(w, length(w) - 1) IN (SELECT w FROM w)),
u AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM d)
SELECT doc_id, pos, coalesce(lemma, token) AS token FROM u LEFT JOIN lx ON lx.form = u.token""")
def tok13_lemmatize(spark, sf):
    from ..operators.lexicon import lemmatize_rows
    toks = checkpoint(tokenize(cleaned_documents(spark, sf)))
    rows = posexplode_rows(toks, F.col("tokens"), "pos", "token", "doc_id")
    out = lemmatize_rows(rows, plural_lexicon(toks))
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


@register("tok17_strip_bio_prefix", f"""WITH {SQL_TAGGED_TOKENS}
SELECT DISTINCT tag, regexp_replace(tag, '^[BI]-', '') AS entity_type FROM u""")
def tok17_strip_bio_prefix(spark, sf):
    from ..functions.tokens import strip_bio_prefix
    tags = to_long(ShapeTagger().tag(cleaned_documents(spark, sf))).select("tag").distinct()
    return tags.select("tag", strip_bio_prefix(F.col("tag")).alias("entity_type"))


# --- NER-3c / UDF-3: a user model behind mapInPandas ------------------------------------------
def acronym_model():
    """A stand-in statistical model: runs of all-capital words (2+ letters) are ORG spans."""
    import re
    cap = re.compile(r"[A-Z]{2,}")

    def spans(texts):
        out = []
        for t in texts:
            toks, doc, start = t.split(), [], None
            for i, w in enumerate(toks + [""]):
                if cap.fullmatch(w):
                    start = i if start is None else start
                elif start is not None:
                    doc.append((start, i, "ORG"))
                    start = None
            out.append(doc)
        return out
    return spans


@register("ner3_model_tagger", f"""WITH d AS (SELECT doc_id, {D.tokens(D.clean('text'))} AS toks FROM documents),
l AS (SELECT doc_id, toks, list_transform(toks, lambda w: CASE WHEN regexp_full_match(w, '[A-Z]{{2,}}')
        THEN 'ORG' END) AS labs FROM d),
t AS (SELECT doc_id, toks, {D.bio_from_labels('labs')} AS tags FROM l),
u AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token, unnest(tags) AS tag FROM t)
SELECT doc_id, pos, token, tag FROM u""")
def ner3_model_tagger(spark, sf):
    long = predict(ModelTagger(acronym_model), cleaned_documents(spark, sf))
    return long.withColumn("pos", F.col("pos").cast("bigint"))


# --- TOK-13 with word classes --------------------------------------------------------------------
def class_lexicon(toks: DataFrame) -> DataFrame:
    """A lexicon with classes derived from the corpus: plurals as nouns and as verbs (weighted by how often form and
    lemma occur), words in 'ed' and 'ing' as verbs, words in 'ly' as adverbs."""
    words = explode_rows(toks, F.col("tokens"), "form").groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(
        F.length("form") > 4)
    cut = [(("s",), "n", 1, "n"), (("s",), "v", 1, "n DIV 2"), (("ed",), "v", 2, "n"), (("ing",), "v", 3, "n"), (("ly",), "r", 2, "n")]
    out = None
    for ends, cls, drop, weight in cut:
        part = words.where(F.col("form").endswith(ends[0])).select(
            "form", F.expr(f"substring(form, 1, length(form) - {drop})").alias("lemma"), F.lit(cls).alias("pos"),
            F.expr(weight).cast("double").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


@register("tok13_class_lemmas", f"""WITH d AS (SELECT doc_id, {D.tokens(D.clean('text'))} AS toks FROM documents),
u AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM d),
w AS (SELECT token AS form, count(*) AS n FROM u WHERE length(token) > 4 GROUP BY token),
lx AS (SELECT form, left(form, length(form) - 1) AS lemma, 'n' AS pos, n AS weight FROM w WHERE form LIKE '%s'
       UNION ALL SELECT form, left(form, length(form) - 1), 'v', n // 2 FROM w WHERE form LIKE '%s'
       UNION ALL SELECT form, left(form, length(form) - 2), 'v', n FROM w WHERE form LIKE '%ed'
       UNION ALL SELECT form, left(form, length(form) - 3), 'v', n FROM w WHERE form LIKE '%ing'
       UNION ALL SELECT form, left(form, length(form) - 2), 'r', n FROM w WHERE form LIKE '%ly'),
best AS (SELECT form, lemma FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY weight DESC, pos) AS r FROM lx)
         WHERE r = 1)
SELECT doc_id, pos, coalesce(lemma, token) AS token FROM u LEFT JOIN best ON form = token""")
def tok13_class_lemmas(spark, sf):
    """Lemmas by (form, word class) in the vectorizer's own step; without a bigram table the likeliest class of each form."""
    toks = checkpoint(tokenize(cleaned_documents(spark, sf)))
    pipe = NerVectorizer(VectorizerParams(), lexicon=class_lexicon(toks)).pipeline
    tagged = toks.select("doc_id", F.size("tokens").alias("n_tokens"),
                         F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit("O").alias("tag"))).alias("pairs"))
    return to_long(pipe._lemmatize(tagged).select("doc_id", "pairs")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


# --- NER-3c: a trained sequence tagger -------------------------------------------------------------
@register("ner3_sequence_tagger", f"""WITH {SQL_TAGGED_TOKENS}, {SQL_SPLIT}
SELECT doc_id, max(n_tokens)::BIGINT AS n_tokens, TRUE AS mostly_right FROM u JOIN sp USING (doc_id)
WHERE split = 'test' GROUP BY doc_id""")
def ner3_sequence_tagger(spark, sf):
    """A perceptron trained on shape-tagged train documents tags the test documents; right where most entity
    tokens and most other tokens of the whole test split get the shape tagger's tag."""
    split = train_test_split(documents(spark, sf), 0.2, SPLIT_SEED)
    tagged = {part: ShapeTagger().tag(CLEANER.apply(spread(split.where(F.col("split") == part).drop("split")), "text"))
              for part in ("train", "test")}
    model = train(tagged["train"], max_documents=400)
    truth = checkpoint(tagged["test"])
    texts = truth.select("doc_id", F.array_join(F.transform("pairs", lambda p: p["token"]), " ").alias("text"))
    found = predict(model_tagger(spark, model), texts).withColumnRenamed("tag", "found")
    rows = checkpoint(to_long(truth).join(found.drop("token"), ["doc_id", "pos"], "left"))
    right = (F.col("tag") == F.col("found")).cast("double")
    share = rows.agg((F.least(F.avg(F.when(F.col("tag") != "O", right)), F.avg(F.when(F.col("tag") == "O", right)))
                      >= 0.8).alias("mostly_right"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens")).join(F.broadcast(share))     # one row
