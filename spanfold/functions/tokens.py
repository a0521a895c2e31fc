"""Token-level functions.  A token stream is ``array<string>``; a tagged stream is
``array<struct<token:string, tag:string>>`` so a dropped token always drops its
tag.  Row-level forms (one token per row) are given too: the vectorizer runs
its token steps on exploded rows, where every step stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS

# --- fixed values -----------------------------------------------------------
# The usual English stop list (179 words), matched case-sensitively.
STOPWORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())
# Emoticons that become <EMOTE>; ") :" holds a blank, so no token ever equals it.
EMOTES = (":(", ":)", ":-)", ":p", ";)", "<3", ") :", "):")
PLACEHOLDERS = ("<EMOTE>", "<URL>", "<USER>", "<NUMBER>")
URL_PATTERN = f"^http[^{WS_CLASS}]+$"
USER_PATTERN = f"^@[^{WS_CLASS}]+$"
NUMERIC_PATTERN = r"^\p{N}+$"
# The separator is an unescaped dot: any character but a newline.
NUMBER_WITH_SEPARATOR = r"^[0-9]+(,|.)[0-9]+$"
ALNUM_PATTERN = r"^[\p{L}\p{N}]+$"
# Most tokens: kept by the last placeholder rule, matched by none before it.
PLAIN_WORD = "^(?!http)[A-Za-z]+$"
# Standard analyzer: runs of two or more word characters.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
BIO_PATTERN = r"^(O$|B-|I-)"
# ASCII whitespace but the blank
OTHER_WS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f"

PAIR_TYPE = "array<struct<token:string,tag:string>>"


# --- TOK-1 / TOK-2 ------------------------------------------------------------
def whitespace_tokens(text: Column) -> Column:
    """Split on whitespace runs; no punctuation splitting, no empty tokens.

    ASCII texts whose only whitespace is the blank, most cleaned ones, are split at it without a pattern.
    """
    only_blanks = F.octet_length(text) == F.length(text)
    for c in OTHER_WS:
        only_blanks = only_blanks & ~F.contains(text, F.lit(c))
    return F.filter(F.when(only_blanks, F.split(text, " ")).otherwise(F.split(text, f"[{WS_CLASS}]+")), lambda x: x != "")


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


# --- TOK-4 .. TOK-10 ----------------------------------------------------------
def replace_token(tok: Column) -> Column:
    """Placeholder rules in order; null means "drop the token"."""
    return (F.when(tok.rlike(PLAIN_WORD), tok)
            .when(tok.isin(*EMOTES), F.lit("<EMOTE>"))
            .when(tok.rlike(URL_PATTERN), F.lit("<URL>"))
            .when(tok.rlike(USER_PATTERN), F.lit("<USER>"))
            .when(tok.rlike(NUMERIC_PATTERN), F.lit("<NUMBER>"))
            .when(tok.rlike(NUMBER_WITH_SEPARATOR), F.lit("<NUMBER>"))
            .when(tok.rlike(ALNUM_PATTERN), tok))


# --- TOK-11 -----------------------------------------------------------------
def pairs_of(tokens: Column, tags: Column) -> Column:
    """ARR-4: zip tokens with tags into one aligned array of structs."""
    return F.zip_with(tokens, tags, lambda token, tag: F.struct(token.alias("token"), tag.alias("tag")))


def filter_pairs(pairs: Column) -> Column:
    """Apply :func:`replace_token` to every token; drop the tag with the token."""
    replaced = F.transform(pairs, lambda p: F.struct(replace_token(p["token"]).alias("token"),
                                                     p["tag"].alias("tag")))
    return F.filter(replaced, lambda p: p["token"].isNotNull() & (p["token"] != ""))


def token_filter_row(token: Column, tag: Column) -> tuple[Column, Column]:
    """Row form of the built-in token filter: (token or null, tag)."""
    return replace_token(token), tag


# --- TOK-3 ------------------------------------------------------------------
def remove_stopwords(pairs: Column, stopwords=STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(pairs, lambda p: ~F.array_contains(stop, p["token"]))


# --- TOK-12 -----------------------------------------------------------------
def wordnet_class(pos_tag: Column) -> Column:
    """Penn tag -> WordNet class: J adjective, V verb, R adverb, else noun."""
    return (F.when(pos_tag.startswith("J"), F.lit("a"))
            .when(pos_tag.startswith("V"), F.lit("v"))
            .when(pos_tag.startswith("R"), F.lit("r"))
            .otherwise(F.lit("n")))


# --- TOK-16 / TOK-17 ----------------------------------------------------------
def word_tokens(text: Column) -> Column:
    """Standard analyzer: lowercase, runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def strip_bio_prefix(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[BI]-", "")


def is_bio_tag(tag: Column) -> Column:
    return tag.rlike(BIO_PATTERN)
