"""Text cleaning as Column -> Column expressions (all JVM-side, codegen-friendly).

The composed cleaner runs, in this order: whitespace collapse, missing
ampersands, entity decoding, tag removal, hashtag splitting, non-ASCII removal.
Order matters: entities are decoded *before* tags are removed, and whitespace
is collapsed *before* entities are decoded (so ``a&nbsp;b`` ends as ``ab``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]

# --- fixed values -----------------------------------------------------------
# Characters Python's ``\s`` matches in a str pattern, written for Java regex
# (and RE2): ASCII blanks, the four information separators, NEL and the
# Unicode space separators (Zs, Zl, Zp), listed as code points.
WS_CLASS = (r"\t\n\x0b\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_RUN = f"[{WS_CLASS}]+"
WS_TO_COLLAPSE = f" [{WS_CLASS}]+|[{WS_CLASS.replace(' ', '', 1)}][{WS_CLASS}]*"
# Hashtag word alternatives, in priority order.
HASHTAG_WORDS = r"[A-Z][A-Z]+|[a-z][a-z]+|[0-9]+|[A-Z][a-z]+"
# Tag pattern: non-greedy, does not cross a newline.
HTML_TAG = r"<[^\n]*?>"
NON_ASCII = r"[^\x00-\x7F]+"
# Missing ampersand repairs: blank + "#ddd;", "amp;" or "quot;" -> "&" + the
# same text; the blank is consumed.  Each repair writes "&" before what it
# matched, so the three rules run as one pass.
MISSING_AMP = f"[{WS_CLASS}](#[0-9]+;|amp;|quot;)"
# Numeric references 0x80..0x9F are read as windows-1252 (HTML rule).
WINDOWS_1252_C1 = {
    0x80: "€", 0x81: "\x81", 0x82: "‚", 0x83: "ƒ", 0x84: "„",
    0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8D: "\x8d", 0x8E: "Ž",
    0x8F: "\x8f", 0x90: "\x90", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜",
    0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9D: "\x9d",
    0x9E: "ž", 0x9F: "Ÿ", 0x00: "�", 0x0D: "\r",
}


# the whole HTML5 table, from the standard library: names with ";" and the old names without
ENTITIES = dict(html5)
LEGACY_NO_SEMICOLON = tuple(n for n in ENTITIES if not n.endswith(";"))


def _map_literal(d: dict) -> Column:
    return F.map_from_arrays(F.lit(list(d)), F.lit(list(d.values())))


# --- TXT-1 ------------------------------------------------------------------
def collapse_whitespace(c: Column) -> Column:
    """Every whitespace run becomes one blank.  A single blank, which most runs are, is no match."""
    return F.regexp_replace(c, WS_TO_COLLAPSE, " ")


# --- TXT-2 ------------------------------------------------------------------
def add_missing_amps(c: Column) -> Column:
    """Blank + ``#ddd;``/``amp;``/``quot;`` becomes an entity; the blank goes."""
    return F.when(c.contains(";"), F.regexp_replace(c, MISSING_AMP, "&$1")).otherwise(c)


# --- TXT-3 ------------------------------------------------------------------
_REF_PIECES = (r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?"
               r"|[^&]+|&")


def _codepoint_to_str(cp: Column) -> Column:
    as_utf32 = F.unhex(F.lpad(F.hex(cp), 8, "0"))
    return F.decode(as_utf32, "UTF-32")


def _numeric_ref(piece: Column) -> Column:
    body = F.regexp_replace(piece, r"^&#|;$", "")
    is_hex = body.startswith("x") | body.startswith("X")
    digits = F.regexp_replace(body, "^[xX]?0*", "")
    too_long = F.when(is_hex, F.length(digits) > 6).otherwise(F.length(digits) > 7)
    cp = F.when(digits == "", F.lit(0)).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint"))
    c1 = F.try_element_at(_map_literal({k: v for k, v in WINDOWS_1252_C1.items()}),
                      cp.cast("int"))
    invalid = (((cp >= 0x1) & (cp <= 0x8)) | (cp == 0xB) | ((cp >= 0xE) & (cp <= 0x1F))
               | ((cp >= 0x7F) & (cp <= 0x9F)) | ((cp >= 0xFDD0) & (cp <= 0xFDEF))
               | (F.pmod(cp, F.lit(0x10000)) >= 0xFFFE))
    return (F.when(too_long, F.lit("�"))
            .when(c1.isNotNull(), c1)
            .when(((cp >= 0xD800) & (cp <= 0xDFFF)) | (cp > 0x10FFFF), F.lit("�"))
            .when(invalid, F.lit(""))
            .otherwise(_codepoint_to_str(cp)))


def _named_ref(piece: Column) -> Column:
    name = F.substring(piece, 2, 64)
    direct = F.try_element_at(_map_literal(ENTITIES), name)
    legacy = sorted(LEGACY_NO_SEMICOLON, key=lambda s: (-len(s), s))
    prefix = F.regexp_extract(name, "^(" + "|".join(legacy) + ")", 1)
    via_prefix = F.concat(F.try_element_at(_map_literal(ENTITIES), prefix),
                          F.substring(name, F.length(prefix) + 1, 64))
    return (F.when(direct.isNotNull(), direct)
            .when(prefix != "", via_prefix)
            .otherwise(piece))


def unescape_html(c: Column) -> Column:
    """Decode character references: numeric ones and the whole HTML5 table of names.

    Numeric references follow the HTML rules (windows-1252 for 0x80-0x9F,
    U+FFFD for surrogates/out of range, control points dropped).
    """
    pieces = F.regexp_extract_all(c, F.lit(_REF_PIECES), 0)

    def one(p: Column) -> Column:
        return (F.when(p.rlike(r"^&#[xX]?[0-9a-fA-F]"), _numeric_ref(p))
                .when(p.rlike(r"^&[^\t\n\f <&#;]"), _named_ref(p))
                .otherwise(p))

    # texts without '&' skip the split; as its own projection (Pipeline.apply)
    # the input is an attribute, so the second reference costs nothing
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def python_preprocessor(fn: Callable[[str], str]) -> ColumnFn:
    """UDF-1: a user's own text function as a step of a :class:`Pipeline` (nulls stay null).

    It runs in Arrow batches.  Prefer column expressions: this is for what they cannot say.
    """
    import pandas as pd

    def run(s):
        return s.map(lambda v: None if v is None else fn(v))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(run, "string")(c)


# --- TXT-4 / TXT-5 ------------------------------------------------------------
def strip_tags(c: Column) -> Column:
    return F.when(c.contains("<") & c.contains(">"), F.regexp_replace(c, HTML_TAG, "")).otherwise(c)


def clean_html(c: Column, unescape: ColumnFn = unescape_html) -> Column:
    """Decode entities, then drop tags (so decoded ``&lt;b&gt;`` goes too)."""
    return strip_tags(unescape(c))


# --- TXT-7 ------------------------------------------------------------------
def _single_case(s: Column) -> Column:
    """True when ``s`` has cased letters of one case only (upper or lower)."""
    return (F.upper(s) == s) != (F.lower(s) == s)


def segment_hashtag(body: Column) -> Column:
    """Words of a hashtag body (without '#') as array<string>.

    One-case bodies are kept whole; otherwise the word alternatives are found
    left to right in priority order (single letters vanish).
    """
    return F.when(_single_case(body), F.array(body)).otherwise(
        F.regexp_extract_all(body, F.lit(f"({HASHTAG_WORDS})"), 0))


# --- TXT-6 ------------------------------------------------------------------
def _let(value: Column, use: ColumnFn) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` reads it (per part of a long chunk, say)."""
    return F.transform(F.array(value), use)[0]


def _split_chunk(chunk: Column) -> Column:
    """Closed form of repeated hashtag replacement on one blank-free chunk.

    With parts p0#p1#...#pk, the i-th suffix s_i = p_i#...#pk.  Replacement
    walks i = 1..k: a one-case suffix just loses its '#'; the first suffix that
    is not one-case is replaced by its words and stops the walk; an empty last
    suffix (chunk ends in '#') is no hashtag and keeps its '#'.

    s_i has an upper-case letter iff some part j >= i has one, i.e. iff i is at
    most the last such part's index (same for lower case), so the walk needs
    one pass over the parts, not one join per suffix.
    """
    def walked(parts: Column, last: Column) -> Column:
        k = F.size(parts) - 1

        def stops(i: Column) -> Column:
            has_up = F.coalesce(last["up"] >= i, F.lit(False))
            has_lo = F.coalesce(last["lo"] >= i, F.lit(False))
            empty_tail = (i == k) & (F.try_element_at(parts, k + 1) == "")
            return empty_tail | (has_up == has_lo)

        found = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                                          lambda i: (i <= k) & stops(i)), F.lit(1))
        return _let(found, lambda first: _let(F.array_join(F.slice(parts, first + 1, k - first + 1), "#"),
                                              lambda suffix: joined(parts, k, first, suffix)))

    def joined(parts: Column, k: Column, first: Column, suffix: Column) -> Column:
        head = F.array_join(F.slice(parts, 1, first), "")
        words = F.array_join(F.regexp_extract_all(suffix, F.lit(f"({HASHTAG_WORDS})"), 0), " ")
        return (F.when(k == 0, chunk)
                .when(first.isNull(), F.array_join(parts, ""))
                .when(suffix == "", F.concat(head, F.lit("#")))
                .otherwise(F.concat(head, words)))

    def with_case(parts: Column) -> Column:
        last = F.struct(F.array_max(F.transform(parts, lambda p, j: F.when(F.lower(p) != p, j))).alias("up"),
                        F.array_max(F.transform(parts, lambda p, j: F.when(F.upper(p) != p, j))).alias("lo"))
        return _let(last, lambda x: walked(parts, x))

    return _let(F.split(chunk, "#", -1), with_case)


# a blank-free chunk (whole, from its first '#' on without a way back) and the blanks behind it: the matches cover a text, end to
# end, so no place is looked at twice
CHUNK = f"[^{WS_CLASS}#]*+(?:#[^{WS_CLASS}]*+)?+[{WS_CLASS}]*+"


def split_hashtags(c: Column) -> Column:
    """TXT-6: hashtags replaced by their words.

    The text is cut into its blank-free chunks, each with the blanks behind it;
    only chunks holding a '#' are rewritten, and all are joined again.
    """
    def one(piece: Column) -> Column:
        return F.when(piece.contains("#"), _let(F.regexp_extract(piece, f"^[^{WS_CLASS}]+", 0), lambda chunk: F.concat(
            _split_chunk(chunk), F.substr(piece, F.length(chunk) + 1)))).otherwise(piece)

    out = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(CHUNK), 0), one), "")
    return F.when(c.contains("#"), out).otherwise(c)


# --- TXT-8 ------------------------------------------------------------------
def remove_nonascii(c: Column) -> Column:
    return F.regexp_replace(c, NON_ASCII, "")


# --- TXT-9 ------------------------------------------------------------------


# --- TXT-10 -----------------------------------------------------------------
# Common English contractions and their expansions.
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have",
    "could've": "could have", "couldn't": "could not", "couldn't've": "could not have",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will",
    "he's": "he is", "how'd": "how did", "how'll": "how will", "how's": "how is",
    "i'd": "I would", "i'll": "I will", "i'm": "I am", "i've": "I have",
    "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "ma'am": "madam", "mightn't": "might not", "might've": "might have",
    "mustn't": "must not", "must've": "must have", "needn't": "need not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will", "she's": "she is",
    "should've": "should have", "shouldn't": "should not", "that'd": "that would",
    "that's": "that is", "there'd": "there would", "there's": "there is",
    "they'd": "they would", "they'll": "they will", "they're": "they are",
    "they've": "they have", "wasn't": "was not", "we'd": "we would", "we'll": "we will",
    "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what're": "what are", "what's": "what is", "what've": "what have",
    "where'd": "where did", "where's": "where is", "who'll": "who will",
    "who's": "who is", "who've": "who have", "why's": "why is", "won't": "will not",
    "would've": "would have", "wouldn't": "would not", "y'all": "you all",
    "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
}


def expand_contractions(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Replace contractions by their expansion, keeping a leading capital.

    ``mapping`` keys are lowercase with a straight apostrophe; curly
    apostrophes in the text are matched too.
    """
    table = _map_literal(mapping or CONTRACTIONS)
    pieces = F.regexp_extract_all(c, F.lit(r"[A-Za-z'’]+|[^A-Za-z'’]+"), 0)

    def one(p: Column) -> Column:
        hit = F.try_element_at(table, F.lower(F.regexp_replace(p, "’", "'")))
        cap = F.concat(F.upper(F.substring(hit, 1, 1)), F.substring(hit, 2, 1 << 20))
        return (F.when(hit.isNull(), p)
                .when((F.length(p) > 1) & (F.upper(p) == p), F.upper(hit))
                .when(F.substring(p, 1, 1).rlike("[A-Z]"), cap)
                .otherwise(hit))

    return F.when(c.contains("'") | c.contains("’"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


# --- TXT-11 -----------------------------------------------------------------
class Pipeline:
    """Ordered Column -> Column steps; an empty pipeline is the identity."""

    def __init__(self, steps: Sequence[ColumnFn] = ()):
        self.steps: list[ColumnFn] = list(steps)

    def add(self, step: ColumnFn) -> "Pipeline":
        self.steps.append(step)
        return self

    def run(self, c: Column) -> Column:
        """Compose the steps into one Column (fine for single use)."""
        return functools.reduce(lambda acc, f: f(acc), self.flat_steps(), c)

    __call__ = run

    def flat_steps(self) -> list[ColumnFn]:
        out: list[ColumnFn] = []
        for s in self.steps:
            out.extend(s.flat_steps() if isinstance(s, Pipeline) else [s])
        return out

    def apply(self, df, col: str):
        """Run the steps on column ``col`` of ``df``, one projection per step.

        Steps read their input more than once (guards, split + extract); as
        separate projections each input is computed once - Catalyst does not
        merge a projection whose expensive output is referenced twice.
        """
        from .arrays import barrier
        for step in self.flat_steps():
            df = df.withColumn(col, step(F.col(col)))
        return barrier(df, col) if self.steps else df


def document_pipeline(preprocessor: ColumnFn | None = None,
                      fix_contractions: bool = True,
                      contractions: dict[str, str] | None = None) -> Pipeline:
    """TXT-12: user cleaner first, then contraction expansion."""
    p = Pipeline()
    if preprocessor is not None:
        p.add(preprocessor)
    if fix_contractions:
        p.add(lambda c: expand_contractions(c, contractions))
    return p


def concat_title_body(title: Column, body: Column, sep: str = " \n") -> Column:
    """PRJ-1: ``title + sep + body`` (null if either is null)."""
    return F.concat(title, F.lit(sep), body)


def concat_optional(summary: Column, body: Column, sep: str = "\n ") -> Column:
    """PRJ-2: body alone when the summary is null, else ``summary + sep + body``."""
    return F.when(summary.isNull(), body).otherwise(F.concat(summary, F.lit(sep), body))


# --- TXT-9 ------------------------------------------------------------------
CLEANER = Pipeline([collapse_whitespace, add_missing_amps, unescape_html, strip_tags,
                    split_hashtags, remove_nonascii])


def clean_text(c: Column) -> Column:
    """Full document cleaner as one Column (whitespace, ampersands, HTML,
    hashtags, ASCII).  For tables use ``CLEANER.apply(df, col)``: one
    projection per step, so no step's input is evaluated twice."""
    return CLEANER.run(c)
