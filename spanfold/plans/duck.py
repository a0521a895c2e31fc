"""DuckDB SQL fragments for the oracle queries (RE2 regex, 1-based lists).

Independent SQL forms of the cleaning and token rules; they share only the
fixed values (patterns, word lists) with the Spark code.
"""

from __future__ import annotations

from ..functions.text import HASHTAG_WORDS, WS_CLASS
from ..functions.tokens import EMOTES, STOPWORDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


WS = f"[{WS_CLASS}]"
STOP_LIST = sql_list(STOPWORDS)
EMOTE_LIST = ", ".join(q(e) for e in EMOTES)


def ws(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def amps(x: str) -> str:
    x = f"regexp_replace({x}, '{WS}(#[0-9]+;)', '&\\1', 'g')"
    x = f"regexp_replace({x}, '{WS}amp;', '&amp;', 'g')"
    return f"regexp_replace({x}, '{WS}quot;', '&quot;', 'g')"


# entities replaced one after another; &amp; last so '&amp;lt;' decodes once
ENTITY_CHAIN = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#34;", '"'),
                ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
                ("&amp;", "&"))


def unescape(x: str) -> str:
    for a, b in ENTITY_CHAIN:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^\\n]*?>', '', 'g')"


def nonascii(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')"


def single_case(s: str) -> str:
    return f"((upper({s}) = {s}) <> (lower({s}) = {s}))"


def words(s: str) -> str:
    return f"array_to_string(regexp_extract_all({s}, '{HASHTAG_WORDS}'), ' ')"


def hashtags(x: str) -> str:
    p = "string_split(c, '#')"
    k = f"(len({p}) - 1)"

    def suffix(i: str) -> str:
        return f"array_to_string(({p})[{i} + 1:], '#')"

    first = (f"(list_filter(range(1, {k} + 1), lambda i: {suffix('i')} = '' "
             f"OR NOT {single_case(suffix('i'))}))[1]")
    head = f"array_to_string(({p})[1:{first}], '')"
    chunk = (f"CASE WHEN {k} = 0 THEN c WHEN {first} IS NULL THEN array_to_string({p}, '') "
             f"WHEN {suffix(first)} = '' THEN {head} || '#' "
             f"ELSE {head} || {words(suffix(first))} END")
    runs = f"regexp_extract_all({x}, '[^{WS_CLASS}]+|{WS}+')"
    return (f"CASE WHEN contains({x}, '#') THEN array_to_string(list_transform({runs}, "
            f"lambda c: CASE WHEN contains(c, '#') THEN {chunk} ELSE c END), '') ELSE {x} END")


def clean(x: str) -> str:
    """TXT-9 in DuckDB (entity chain limited to the entities in the tables)."""
    return nonascii(hashtags(strip_tags(unescape(amps(ws(x))))))


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def replace_token(t: str) -> str:
    return (f"CASE WHEN {t} IN ({EMOTE_LIST}) THEN '<EMOTE>' "
            f"WHEN regexp_matches({t}, '^http[^{WS_CLASS}]+$') THEN '<URL>' "
            f"WHEN regexp_matches({t}, '^@[^{WS_CLASS}]+$') THEN '<USER>' "
            f"WHEN regexp_matches({t}, '^\\p{{N}}+$') THEN '<NUMBER>' "
            f"WHEN regexp_matches({t}, '^[0-9]+(,|.)[0-9]+$') THEN '<NUMBER>' "
            f"WHEN regexp_matches({t}, '^[\\p{{L}}\\p{{N}}]+$') THEN {t} END")


def shape_labels(toks: str) -> str:
    return (f"list_transform({toks}, lambda tok, i: CASE "
            f"WHEN regexp_full_match(tok, '\\p{{Lu}}{{2,}}') THEN 'ORG' "
            f"WHEN regexp_full_match(tok, '\\p{{Lu}}\\p{{Ll}}+') AND NOT (i = 1 OR "
            f"regexp_matches({toks}[i - 1], '[.!?]$')) THEN 'NAME' END)")


def bio_from_labels(labels: str) -> str:
    return (f"list_transform({labels}, lambda l, i: CASE WHEN l IS NULL THEN 'O' "
            f"WHEN i > 1 AND {labels}[i - 1] IS NOT DISTINCT FROM l THEN 'I-' || l "
            f"ELSE 'B-' || l END)")


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
