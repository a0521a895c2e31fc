"""Text and token queries (TXT-*, TOK-*, PRJ-1/2/5, UDF-1)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_rows, posexplode_rows
from ..functions import tokens as K
from ..operators.vectorizer import analyzer_tokens
from ..session import spread
from ..sources.tables import table
from . import duck as D
from .common import SQL_FILTERED, documents, entity_vectorizer
from .registry import register

# Literal cases appended with concat where the tables lack a rule's input.
AMP_CASES = " AT amp;T it #39;s say quot;hi quot; "
HASH_CASES = " #BlackLivesMatter #USAToday x#a#b ## #a# "
ENTITY_CASES = " &amp;lt;b&amp;gt; &lt;i&gt;x&lt;/i&gt; a&nbsp;b "
CONTRACTION_CASES = " I'm sure they're here, don't WORRY, It's fine "


@register("txt1_collapse_whitespace", f"SELECT doc_id, {D.ws('text')} AS text FROM documents")
def txt1_collapse_whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", T.collapse_whitespace(F.col("text")).alias("text"))


@register("txt2_missing_amps", f"SELECT doc_id, {D.amps('text || ' + D.q(AMP_CASES))} AS text "
                               f"FROM documents")
def txt2_missing_amps(spark, sf):
    t = F.concat(F.col("text"), F.lit(AMP_CASES))
    return documents(spark, sf).select("doc_id", T.add_missing_amps(t).alias("text"))


@register("txt3_unescape_html", f"SELECT page_id, {D.unescape('html || ' + D.q(ENTITY_CASES))} "
                                f"AS html FROM pages")
def txt3_unescape_html(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.unescape_html(F.concat("html", F.lit(ENTITY_CASES))).alias("html"))


@register("txt4_strip_tags", f"SELECT page_id, {D.strip_tags('html')} AS html FROM pages")
def txt4_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("html"))


@register("txt5_clean_html", f"SELECT page_id, {D.strip_tags(D.unescape('html'))} AS html FROM pages")
def txt5_clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_html(F.col("html")).alias("html"))


@register("txt6_split_hashtags", f"SELECT doc_id, {D.hashtags('(text || ' + D.q(HASH_CASES) + ')')} "
                                 f"AS text FROM documents")
def txt6_split_hashtags(spark, sf):
    t = F.concat(F.col("text"), F.lit(HASH_CASES))
    return documents(spark, sf).select("doc_id", T.split_hashtags(t).alias("text"))


# TXT-7 input: a part name written as one camel-case hashtag body
_CAMEL = ("array_to_string(list_transform(string_split(p_name, ' '), "
          "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')")


@register("txt7_segment_hashtag", f"""SELECT p_partkey, CASE WHEN {D.single_case('h')} THEN h
  ELSE array_to_string(regexp_extract_all(h, '{T.HASHTAG_WORDS}'), ' ') END AS words
FROM (SELECT p_partkey, {_CAMEL} || upper(p_brand) AS h FROM part)""")
def txt7_segment_hashtag(spark, sf):
    p = table(spark, sf, "part")
    h = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.upper("p_brand"))
    return p.select("p_partkey", F.array_join(T.segment_hashtag(h), " ").alias("words"))


@register("txt8_remove_nonascii", f"SELECT doc_id, {D.nonascii('text')} AS text FROM documents")
def txt8_remove_nonascii(spark, sf):
    return documents(spark, sf).select("doc_id", T.remove_nonascii(F.col("text")).alias("text"))


@register("txt9_clean_documents", f"SELECT doc_id, {D.clean('text')} AS text FROM documents")
def txt9_clean_documents(spark, sf):
    return T.CLEANER.apply(spread(documents(spark, sf)), "text")


@register("txt9_clean_pages", f"SELECT page_id, {D.clean('html')} AS html FROM pages")
def txt9_clean_pages(spark, sf):
    return T.CLEANER.apply(table(spark, sf, "pages").select("page_id", "html"), "html")


def _duck_contractions(x: str) -> str:
    keys = ", ".join(D.q(k) for k in T.CONTRACTIONS)
    vals = ", ".join(D.q(v) for v in T.CONTRACTIONS.values())
    m = f"map_from_entries(list_zip([{keys}], [{vals}]))"
    hit = f"{m}[lower(replace(p, '’', ''''))]"
    piece = (f"CASE WHEN {hit} IS NULL THEN p "
             f"WHEN length(p) > 1 AND upper(p) = p THEN upper({hit}) "
             f"WHEN regexp_matches(left(p, 1), '[A-Z]') THEN upper(left({hit}, 1)) || substr({hit}, 2) "
             f"ELSE {hit} END")
    pieces = f"regexp_extract_all({x}, '[A-Za-z''’]+|[^A-Za-z''’]+')"
    return f"array_to_string(list_transform({pieces}, lambda p: {piece}), '')"


@register("txt10_expand_contractions",
          f"SELECT doc_id, {_duck_contractions('(text || ' + D.q(CONTRACTION_CASES) + ')')} AS text "
          f"FROM documents")
def txt10_expand_contractions(spark, sf):
    t = F.concat(F.col("text"), F.lit(CONTRACTION_CASES))
    return documents(spark, sf).select("doc_id", T.expand_contractions(t).alias("text"))


@register("txt11_pipeline", f"SELECT doc_id, {D.nonascii(D.ws('text'))} AS text FROM documents")
def txt11_pipeline(spark, sf):
    pipe = T.Pipeline().add(T.collapse_whitespace).add(T.remove_nonascii)
    return pipe.apply(documents(spark, sf), "text")


@register("txt12_document_pipeline",
          f"SELECT doc_id, {_duck_contractions(D.clean('(text || ' + D.q(CONTRACTION_CASES) + ')'))} "
          f"AS text FROM documents")
def txt12_document_pipeline(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.concat("text", F.lit(CONTRACTION_CASES)).alias("text"))
    return T.document_pipeline(T.CLEANER, fix_contractions=True).apply(docs, "text")


def hide_numbers(text: str) -> str:
    """A user's own cleaner: every run of digits becomes its length in a mark."""
    return re.sub(r"[0-9]+", lambda m: f"<{'#' * min(3, len(m.group()))}>", text)


@register("udf1_python_preprocessor", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '[0-9]{3,}', '<###>', 'g'), '[0-9]{2}', '<##>', 'g'), '[0-9]', '<#>', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g') AS html FROM pages""")
def udf1_python_preprocessor(spark, sf):
    """UDF-1: a user's Python function and a built-in step in one pipeline."""
    steps = T.Pipeline([T.python_preprocessor(hide_numbers), lambda c: F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0b]+", " ")])
    return steps.apply(table(spark, sf, "pages").select("page_id", "html"), "html")


@register("prj1_concat_title_body", "SELECT p_partkey, p_name || ' \n' || p_type AS text FROM part")
def prj1_concat_title_body(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.concat_title_body(F.col("p_name"), F.col("p_type")).alias("text"))


@register("prj2_null_aware_concat", """SELECT d.doc_id,
  CASE WHEN b.text IS NULL THEN d.text ELSE b.text || '\n ' || d.text END AS text
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def prj2_null_aware_concat(spark, sf):
    d = documents(spark, sf)
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("summary"))
    j = d.join(b, "doc_id", "left")   # benchmark is a small side; the planner picks the strategy
    return j.select("doc_id", T.concat_optional(F.col("summary"), F.col("text")).alias("text"))


# fixed values: display names of the language codes
LANG_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


@register("prj5_label_names", "SELECT doc_id, lang AS TARGET, CASE lang "
          + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANG_NAMES.items()) + " END AS label_name FROM documents")
def prj5_label_names(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in LANG_NAMES.items() for x in kv])
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("TARGET"), F.try_element_at(m, F.col("lang")).alias("label_name"))


# --- tokens ------------------------------------------------------------------------
@register("tok1_whitespace_tokens", f"""SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token
FROM (SELECT doc_id, {D.tokens('text')} AS toks FROM documents)""")
def tok1_whitespace_tokens(spark, sf):
    d = documents(spark, sf).select("doc_id", K.whitespace_tokens(F.col("text")).alias("t"))
    return posexplode_rows(d, F.col("t"), "pos", "token", "doc_id").withColumn("pos", F.col("pos").cast("bigint"))


@register("tok2_lower_tokens", f"""SELECT doc_id, lower(token) AS token, count(*) AS cnt
FROM (SELECT doc_id, unnest({D.tokens('text')}) AS token FROM documents) GROUP BY ALL""")
def tok2_lower_tokens(spark, sf):
    d = documents(spark, sf).select("doc_id", K.lower_tokens(K.whitespace_tokens(F.col("text"))).alias("t"))
    return explode_rows(d, F.col("t"), "token", "doc_id").groupBy("doc_id", "token").agg(
        F.count(F.lit(1)).alias("cnt"))


@register("tok3_remove_stopwords", f"""SELECT doc_id, count(*) AS n_kept
FROM (SELECT doc_id, unnest({D.tokens('lower(text)')}) AS token FROM documents)
WHERE NOT list_contains({D.STOP_LIST}, token) GROUP BY doc_id""")
def tok3_remove_stopwords(spark, sf):
    toks = K.whitespace_tokens(F.lower("text"))
    pairs = K.pairs_of(toks, F.transform(toks, lambda _: F.lit("O")))
    d = documents(spark, sf).select("doc_id", F.size(K.remove_stopwords(pairs)).alias("n_kept"))
    return d.where("n_kept > 0").withColumn("n_kept", F.col("n_kept").cast("bigint"))


TOKEN_CASES = ["12", "12.3", "12,5", "1x2", "1.2.3", "foo.", "don't", ":)", "<3", "@me", "http://a", ":p", "):"]


@register("tok10_replace_token", f"""SELECT token, {D.replace_token('token')} AS replaced FROM (
  SELECT DISTINCT unnest({D.tokens('text')}) AS token FROM documents
  UNION SELECT unnest({D.sql_list(TOKEN_CASES)}))""")
def tok10_replace_token(spark, sf):
    d = explode_rows(documents(spark, sf), K.whitespace_tokens(F.col("text")), "token")
    cases = spark.createDataFrame([(t,) for t in TOKEN_CASES], "token string")
    toks = d.unionByName(cases).distinct()
    return toks.select("token", K.replace_token(F.col("token")).alias("replaced"))


@register("tok11_token_filter", f"""WITH {SQL_FILTERED.split('f0 AS', 1)[0].rstrip().rstrip(',')},
k AS (SELECT doc_id, pos, {D.replace_token('tok')} AS token, tag FROM u)
SELECT doc_id, pos, token, tag FROM k WHERE token IS NOT NULL AND token <> ''""")
def tok11_token_filter(spark, sf):
    """TOK-11 on the tagged tokens: placeholders, drop the rest, tags stay aligned."""
    v = entity_vectorizer("double")
    tagged = v.pipeline.tag(documents(spark, sf))
    def row(p, i):
        token, tag = K.token_filter_row(p["token"], p["tag"])
        return F.struct(token.alias("token"), tag.alias("tag"), i.cast("bigint").alias("pos"))

    kept = F.filter(F.transform("pairs", row),
        lambda x: x["token"].isNotNull() & (x["token"] != ""))
    rows = explode_rows(tagged, kept, "p", "doc_id")
    return rows.select("doc_id", "p.pos", "p.token", "p.tag")


@register("tok12_wordnet_class", """SELECT tag, CASE WHEN starts_with(tag, 'J') THEN 'a'
  WHEN starts_with(tag, 'V') THEN 'v' WHEN starts_with(tag, 'R') THEN 'r' ELSE 'n' END AS wn
FROM (SELECT DISTINCT upper(p_type) AS tag FROM part)""")
def tok12_wordnet_class(spark, sf):
    tags = table(spark, sf, "part").select(F.upper("p_type").alias("tag")).distinct()
    return tags.select("tag", K.wordnet_class(F.col("tag")).alias("wn"))


@register("tok14_filter_sentence", f"WITH {SQL_FILTERED} SELECT doc_id, fpos AS pos, tok AS token, tag FROM f")
def tok14_filter_sentence(spark, sf):
    v = entity_vectorizer("double")
    tagged = v.pipeline.tag(documents(spark, sf))
    rows = posexplode_rows(tagged, v.pipeline.filter_pairs(F.col("pairs")), "pos", "p", "doc_id")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.token").alias("token"),
                       F.col("p.tag").alias("tag"))


@register("tok15_analyzer", f"""WITH {SQL_FILTERED}
SELECT doc_id, fpos AS pos, tok AS token FROM f""")
def tok15_analyzer(spark, sf):
    v = entity_vectorizer("double")
    d = analyzer_tokens(v, documents(spark, sf))
    return posexplode_rows(d, F.col("tokens"), "pos", "token", "doc_id").withColumn(
        "pos", F.col("pos").cast("bigint"))


@register("tok16_word_tokens", f"""SELECT doc_id, term, count(*) AS cnt
FROM (SELECT doc_id, unnest({D.word_tokens('text')}) AS term FROM documents) GROUP BY ALL""")
def tok16_word_tokens(spark, sf):
    d = explode_rows(documents(spark, sf), K.word_tokens(F.col("text")), "term", "doc_id")
    return d.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
