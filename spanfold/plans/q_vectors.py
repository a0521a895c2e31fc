"""Term encoding, vocabulary and weighting queries (VEC, VOC, TFW, FIT, STD, FLT, SRT, ARR-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sampling import number_rows, top_k_per_group, train_test_split
from ..operators.vectorizer import NerVectorizer, VectorizerParams, standard_vectorizer
from ..functions.tokens import strip_bio_prefix, word_tokens
from ..session import checkpoint
from . import duck as D
from .common import (SPLIT_SEED, SQL_FILTERED, SQL_SPLIT, SQL_TERMS, SQL_WORDS, documents, entity_vectorizer,
                     sql_counts, sql_weights)
from .registry import r6, register


def _counts(spark, sf, encoding):
    v = entity_vectorizer(encoding)
    return v.pipeline.counts(v.tagged(documents(spark, sf)))


# --- VEC-1 / VEC-2 --------------------------------------------------------------
@register("vec1_double_terms", f"WITH {sql_counts('double')} SELECT doc_id, term, cnt, n_tokens FROM c")
def vec1_double_terms(spark, sf):
    return _counts(spark, sf, "double").select("doc_id", "term", "cnt", F.col("n_tokens").cast("bigint"))


@register("vec2_bio_terms", f"WITH {sql_counts('bio')} SELECT doc_id, term, cnt, n_tokens FROM c")
def vec2_bio_terms(spark, sf):
    return _counts(spark, sf, "bio").select("doc_id", "term", "cnt", F.col("n_tokens").cast("bigint"))


# --- UDF-4: a user's own encoding -------------------------------------------------------
@register("udf4_user_encoding", f"""WITH {SQL_FILTERED},
e AS (SELECT doc_id, n_tokens, CASE WHEN tag = 'O' THEN left(tok, 3) ELSE regexp_replace(tag, '^[BI]-', '') || ':' || left(tok, 3) END AS term
      FROM f)
SELECT doc_id, term, count(*) AS cnt, n_tokens FROM e GROUP BY doc_id, n_tokens, term""")
def udf4_user_encoding(spark, sf):
    """Terms of a user's function: the first three characters, behind the entity type where there is one."""
    def encoding(pairs):
        return F.transform(pairs, lambda x, i: F.struct(
            F.when(x["tag"] == "O", F.substring(x["token"], 1, 3)).otherwise(F.concat(
                strip_bio_prefix(x["tag"]), F.lit(":"), F.substring(x["token"], 1, 3))).alias("term"),
            i.cast("bigint").alias("first")))
    return _counts(spark, sf, encoding).select("doc_id", "term", "cnt", F.col("n_tokens").cast("bigint"))


# --- VOC-1..5 ---------------------------------------------------------------------
@register("voc1_term_counts", f"WITH {sql_counts('double')} SELECT term, sum(cnt)::BIGINT AS cf FROM c GROUP BY term")
def voc1_term_counts(spark, sf):
    return _counts(spark, sf, "double").groupBy("term").agg(F.sum("cnt").alias("cf"))


@register("voc2_bounded_vocabulary", f"""WITH {sql_counts('double')},
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, sum(cnt)::BIGINT AS cf FROM c GROUP BY term)
SELECT term, cf FROM v, n WHERE cf >= 2 AND cf <= 0.05 * n""")
def voc2_bounded_vocabulary(spark, sf):
    m = entity_vectorizer("double", min_df=2, max_df=0.05).fit(documents(spark, sf))
    return m.vocabulary.select("term", "cf")


@register("voc3_idf", f"""WITH {sql_counts('double')},
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, sum(cnt) AS cf FROM c GROUP BY term)
SELECT term, round(ln((1 + n) / (1 + cf)) + 1, 6) AS idf FROM v, n WHERE cf >= 1 AND cf <= 1.0 * n""")
def voc3_idf(spark, sf):
    m = entity_vectorizer("double").fit(documents(spark, sf))
    return m.get_idf().select("term", r6("idf").alias("idf"))


@register("voc5_feature_index", f"""WITH {sql_counts('double')},
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, sum(cnt) AS cf, min(doc_id) AS d0 FROM c GROUP BY term),
v1 AS (SELECT v.term, v.cf, v.d0, (SELECT min(first) FROM c WHERE c.term = v.term AND c.doc_id = v.d0) AS f0
       FROM v)
SELECT term, (row_number() OVER (ORDER BY d0, f0, term) - 1)::INTEGER AS feature_idx
FROM v1, n WHERE cf >= 1 AND cf <= 1.0 * n""")
def voc5_feature_index(spark, sf):
    m = entity_vectorizer("double").fit(documents(spark, sf))
    return m.feature_index()


# --- TFW-1..4 ----------------------------------------------------------------------
@register("tfw1_term_frequency",
          f"WITH {sql_counts('double')} SELECT doc_id, term, round(cnt / n_tokens, 6) AS tf FROM c")
def tfw1_term_frequency(spark, sf):
    c = _counts(spark, sf, "double")
    return c.select("doc_id", "term", r6(F.col("cnt") / F.col("n_tokens")).alias("tf"))


@register("tfw2_double_weights", sql_weights("double"))
def tfw2_double_weights(spark, sf):
    out = entity_vectorizer("double").fit_transform(documents(spark, sf))
    return out.select("doc_id", "term", r6("weight").alias("weight"))


@register("tfw2_bio_weights", sql_weights("bio"))
def tfw2_bio_weights(spark, sf):
    out = entity_vectorizer("bio").fit_transform(documents(spark, sf))
    return out.select("doc_id", "term", r6("weight").alias("weight"))


@register("tfw3_tf_only_weights", sql_weights("double", weight="cnt / n_tokens"))
def tfw3_tf_only_weights(spark, sf):
    out = entity_vectorizer("double").fit_transform(documents(spark, sf), use_idf=False)
    return out.select("doc_id", "term", r6("weight").alias("weight"))


@register("tfw4_unnormalized_weights", sql_weights("double", normalize=False))
def tfw4_unnormalized_weights(spark, sf):
    out = entity_vectorizer("double", normalize=False).fit_transform(documents(spark, sf))
    return out.select("doc_id", "term", r6("weight").alias("weight"))


# --- FIT-1..3: fit on train, transform test ------------------------------------------
@register("fit2_train_test_weights", f"""WITH {sql_counts('double')}, {SQL_SPLIT},
ct AS (SELECT c.* FROM c JOIN sp USING (doc_id) WHERE split = 'train'),
n AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
v AS (SELECT term, sum(cnt) AS cf FROM ct GROUP BY term),
vk AS (SELECT term, ln((1 + n) / (1 + cf)) + 1 AS idf FROM v, n WHERE cf >= 1 AND cf <= 1.0 * n),
w AS (SELECT doc_id, term, (cnt / n_tokens) / idf AS w FROM c JOIN sp USING (doc_id) JOIN vk USING (term)
      WHERE split = 'test')
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def fit2_train_test_weights(spark, sf):
    split = train_test_split(documents(spark, sf), 0.2, SPLIT_SEED)
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")
    model = entity_vectorizer("double").fit(train)
    return model.transform(test).select("doc_id", "term", r6("weight").alias("weight"))


# --- STD-1..6 ---------------------------------------------------------------------
STD_SQL = f"""WITH {SQL_WORDS},
v AS (SELECT term, count(*) AS df FROM c GROUP BY term),
vk AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n WHERE df >= 1 AND df <= 1.0 * n),
w AS (SELECT doc_id, term, cnt * idf AS w FROM c JOIN vk USING (term)),
std AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w)"""


def _std(spark, sf, **kw):
    return standard_vectorizer(**kw).fit_transform(documents(spark, sf))


@register("std1_standard_tfidf", STD_SQL + " SELECT * FROM std")
def std1_standard_tfidf(spark, sf):
    return _std(spark, sf).select("doc_id", "term", r6("weight").alias("weight"))


@register("std2_standard_tf", f"WITH {SQL_WORDS} SELECT doc_id, term, cnt::DOUBLE AS tf FROM c")
def std2_standard_tf(spark, sf):
    out = standard_vectorizer(normalize=False).fit_transform(documents(spark, sf), use_idf=False)
    return out.select("doc_id", "term", F.col("weight").alias("tf"))


@register("std3_count_vectorizer", f"WITH {SQL_WORDS} SELECT doc_id, term, cnt FROM c")
def std3_count_vectorizer(spark, sf):
    v = standard_vectorizer(normalize=False)
    return v.pipeline.counts(v.tagged(documents(spark, sf))).select("doc_id", "term", "cnt")


@register("std4_document_frequency", f"WITH {SQL_WORDS} SELECT term, count(*) AS df FROM c GROUP BY term")
def std4_document_frequency(spark, sf):
    m = standard_vectorizer().fit(documents(spark, sf))
    return m.vocabulary.select("term", "df")


@register("std5_textbook_tfidf", f"""WITH {SQL_WORDS},
tot AS (SELECT doc_id, sum(cnt) AS total FROM c GROUP BY doc_id),
v AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term, round(cnt / total * ln((1 + n) / (1 + df)), 6) AS weight
FROM c JOIN tot USING (doc_id) JOIN v USING (term), n""")
def std5_textbook_tfidf(spark, sf):
    v = NerVectorizer(VectorizerParams(encoding="plain", filter_stopwords=False, lemmatize=False, lower=False,
                                       fix_contractions=False, normalize=False, count_mode="documents",
                                       weighting="multiply", tf_mode="ratio", idf_add_one=False),
                      analyzer=word_tokens)
    return v.fit_transform(documents(spark, sf)).select("doc_id", "term", r6("weight").alias("weight"))


@register("std6_document_total", f"WITH {SQL_WORDS} SELECT doc_id, sum(cnt)::BIGINT AS total FROM c GROUP BY doc_id")
def std6_document_total(spark, sf):
    v = standard_vectorizer()
    c = v.pipeline.counts(v.tagged(documents(spark, sf)))
    return c.groupBy("doc_id").agg(F.sum("cnt").alias("total"))


# --- FLT-2..4, SRT-1, SRT-3, ARR-6 on the standard weights -------------------------------
@register("flt2_nonzero_weights", STD_SQL + " SELECT std.* FROM std JOIN w USING (doc_id, term) WHERE w.w <> 0")
def flt2_nonzero_weights(spark, sf):
    kept = _std(spark, sf).where(F.col("weight") != 0)       # before rounding
    return kept.select("doc_id", "term", r6("weight").alias("weight"))


@register("flt3_one_document", STD_SQL + """ SELECT std.* FROM std JOIN (
  SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p = 12)
  USING (doc_id)""")
def flt3_one_document(spark, sf):
    """FLT-3: the weights of the document at position 12 (0-based, in doc_id order),
    after weighting the whole table."""
    pos = number_rows(documents(spark, sf).select("doc_id"), "doc_id", "p").where(F.col("p") == 12)
    return std1_standard_tfidf(spark, sf).join(pos.select("doc_id"), "doc_id", "left_semi")


NAMED = ("the", "and", "of", "de", "la", "und", "los")


@register("flt4_named_features", STD_SQL + " SELECT * FROM std WHERE term IN ("
          + ", ".join(f"'{t}'" for t in NAMED) + ")")
def flt4_named_features(spark, sf):
    return std1_standard_tfidf(spark, sf).where(F.col("term").isin(*NAMED))


@register("srt1_top_terms", STD_SQL + """ SELECT doc_id, rank, term, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM std) WHERE rank <= 5""")
def srt1_top_terms(spark, sf):
    top = top_k_per_group(_std(spark, sf), "doc_id", "weight", 5, "term")
    return top.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", r6("weight").alias("weight"))


@register("arr6_dense_pivot", f"WITH {SQL_WORDS} SELECT doc_id, "
          + ", ".join(f"sum(CASE WHEN term = '{t}' THEN cnt ELSE 0 END)::BIGINT AS t_{t}" for t in NAMED)
          + " FROM c GROUP BY doc_id")
def arr6_dense_pivot(spark, sf):
    """Bounded pivot: one column per named term; never the whole vocabulary."""
    v = standard_vectorizer(normalize=False)
    c = v.pipeline.counts(v.tagged(documents(spark, sf)))
    wide = c.groupBy("doc_id").pivot("term", list(NAMED)).agg(F.sum("cnt"))
    return wide.select("doc_id", *[F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(f"t_{t}") for t in NAMED])


@register("sta4_features_per_representation", f"""WITH {sql_counts('double')},
n AS (SELECT count(*) AS n FROM documents),
dv AS (SELECT term, sum(cnt) AS cf FROM c GROUP BY term),
eb AS ({SQL_TERMS['bio']}),
bv AS (SELECT term, count(*) AS cf FROM eb GROUP BY term),
w0 AS (SELECT doc_id, unnest({D.word_tokens('text')}) AS term FROM documents),
sv AS (SELECT term, count(DISTINCT doc_id) AS df FROM w0 GROUP BY term)
SELECT 'double' AS state, count(*) AS n_features FROM dv, n WHERE cf >= 1 AND cf <= n
UNION ALL SELECT 'bio', count(*) FROM bv, n WHERE cf >= 1 AND cf <= n
UNION ALL SELECT 'std', count(*) FROM sv, n WHERE df >= 1 AND df <= n""")
def sta4_features_per_representation(spark, sf):
    """STA-4: vocabulary size per representation (the target is not a feature); documents are tagged once for both encodings."""
    docs = documents(spark, sf)
    tagged = checkpoint(entity_vectorizer("double").tagged(docs))
    tokenized = tagged.select("doc_id", F.transform("pairs", lambda p: p["token"]).alias("tokens"),
                              F.transform("pairs", lambda p: p["tag"]).alias("tags"))
    out = None
    for state, vec, given in (("double", entity_vectorizer("double"), {"tokenized": tokenized}),
                              ("bio", entity_vectorizer("bio"), {"tokenized": tokenized}),
                              ("std", standard_vectorizer(), {"raw_documents": docs})):
        m = vec.fit(**given)
        row = m.vocabulary.agg(F.count(F.lit(1)).alias("n_features")).select(
            F.lit(state).alias("state"), "n_features")
        out = row if out is None else out.unionByName(row)
    return out
