"""Shared inputs and SQL pieces of the registered queries."""

from __future__ import annotations


from ..functions.text import CLEANER
from ..operators.tagging import ShapeTagger
from ..operators.vectorizer import NerVectorizer, VectorizerParams, builtin_token_filter
from ..sources.tables import table
from . import duck as D

# --- shared pieces -------------------------------------------------------------
def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def entity_vectorizer(encoding: str = "double", **kw) -> NerVectorizer:
    """The survey's entry-A configuration: cleaner, shape tagger, token filter."""
    return NerVectorizer(VectorizerParams(encoding=encoding, **kw), tagger=ShapeTagger(),
                         preprocessor=CLEANER, token_filter=builtin_token_filter)


# SQL: cleaned + shape-tagged tokens of `documents`, one row per token
SQL_TAGGED_TOKENS = f"""
d AS (SELECT doc_id, {D.tokens(D.clean('text'))} AS toks FROM documents),
l AS (SELECT doc_id, toks, {D.shape_labels('toks')} AS labs FROM d),
t AS (SELECT doc_id, toks, {D.bio_from_labels('labs')} AS tags FROM l),
u AS (SELECT doc_id, len(toks) AS n_tokens, unnest(range(len(toks))) AS pos, unnest(toks) AS tok,
       unnest(tags) AS tag FROM t)"""

SQL_FILTERED = f"""{SQL_TAGGED_TOKENS},
f0 AS (SELECT doc_id, n_tokens, pos, lower(tok) AS tok, tag FROM u),
f1 AS (SELECT doc_id, n_tokens, pos, {D.replace_token('tok')} AS tok, tag FROM f0
       WHERE NOT list_contains({D.STOP_LIST}, tok)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS fpos FROM f1
      WHERE tok IS NOT NULL AND tok <> '')"""


DOUBLE_TERM = "CASE WHEN tag = 'O' THEN tok ELSE tok || '_NE' END"
# SQL: encoded terms (`e`) and per-document counts (`c`) for both encodings
SQL_TERMS = {
    "double": f"SELECT doc_id, n_tokens, {DOUBLE_TERM} AS term, fpos * 2 AS first FROM f",
    "bio": ("SELECT doc_id, n_tokens, tok AS term, fpos * 2 AS first FROM f UNION ALL "
            "SELECT doc_id, n_tokens, regexp_replace(tag, '^[BI]-', '') AS term, fpos * 2 + 1 AS first "
            "FROM f WHERE tag <> 'O'"),
}


def sql_counts(encoding: str = "double") -> str:
    return f"""{SQL_FILTERED},
e AS ({SQL_TERMS[encoding]}),
c AS (SELECT doc_id, n_tokens, term, count(*) AS cnt, min(first) AS first FROM e GROUP BY doc_id, n_tokens, term)"""


SQL_WORDS = f"""w0 AS (SELECT doc_id, unnest({D.word_tokens('text')}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS cnt FROM w0 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)"""

SPLIT_SEED = 1289
SQL_SPLIT = f"""s0 AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-{SPLIT_SEED}'), doc_id) AS rn,
       count(*) OVER () AS n_all FROM documents),
sp AS (SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n_all) THEN 'test' ELSE 'train' END AS split FROM s0)"""


def sql_weights(encoding: str = "double", min_df: str = "1", max_df: str = "1.0 * n",
                weight: str = "(cnt / n_tokens) / idf", normalize: bool = True) -> str:
    """Observed-mode weights: occurrence counts, bounds, idf, tf / idf, L2."""
    out = ("round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6)" if normalize else "round(w, 6)")
    return f"""WITH {sql_counts(encoding)},
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, sum(cnt) AS cf FROM c GROUP BY term),
vk AS (SELECT term, cf, ln((1 + n) / (1 + cf)) + 1 AS idf FROM v, n WHERE cf >= {min_df} AND cf <= {max_df}),
w AS (SELECT doc_id, term, {weight} AS w FROM c JOIN vk USING (term))
SELECT doc_id, term, {out} AS weight FROM w"""
