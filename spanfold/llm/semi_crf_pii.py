"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from four fixed patterns (e-mail, IP, card, phone).  The field
adds spans written otherwise (e.g. a phone number without "+", an address with "(at)").
A text is looked at in windows around anchors (digits, "@", a bracketed or
spelled "at"/"dot").  A window's tokens are split into segments: single tokens
outside, or entities of at most ``MAX_TOKENS`` tokens with a type.  A segment is
scored by features of the whole span (digit count, checksum, parts, separators,
words before it); Viterbi over segments chooses boundaries and types jointly.

Weights are learnt by maximum likelihood (forward-backward over segments) from
windows of at most about ``sample_rows`` documents of the corpus (a documented
bound), labelled by the base patterns, and rewritten copies of these windows.
With no such window nothing is added.

Cases: null or empty text has no spans; very long texts are linear work; a table
without personal data or without rows gives base results; repeated rows get
equal results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
CONTEXT = 32
MARGIN = 2.0

# fixed values: the contract's base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_CUE = r"[\[({]\s?(?:at|AT)\s?[\])}]"
_ANCHOR = re.compile(rf"[0-9@]|{_CUE}|\s(?:dot|DOT)\s")
_TOKEN = re.compile(rf"{_CUE}|[A-Za-z]+|[0-9]+|\S|\n")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if _small_parts(m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = digits_of(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- windows, segments and their features ------------------------------------------

def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of ``CONTEXT`` characters around anchors, widened to white space; overlaps are one."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.end() + CONTEXT <= out[-1][1]:
            continue
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        least, most = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        while a > least and not text[a - 1].isspace():
            a -= 1
        while b < most and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FEATURES = ("bias", "at", "spelled_at", "one_at", "dots_after_at", "tail_alpha", "ip_form", "ip_small", "card_luhn",
            "card_digits", "phone_digits", "plus", "zero_zero", "paren", "grouped", "one_run", "dashes", "points",
            "spaces", "letters", "letters_without_at", "glued_left", "glued_right", "quote", "equals", "long",
            "cue_phone", "cue_mail", "cue_ip", "cue_card", "digits_7_8", "digits_9_11", "digits_12_15",
            "digits_16_19", "digits_more", "luhn_fails", "paren_open", "odd_start", "label_parts")
_F = {n: i for i, n in enumerate(FEATURES)}
_CUES = {"cue_phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|cell)\b"),
         "cue_mail": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
         "cue_ip": re.compile(r"(?i)\b(?:ip|host|server|address)\b"),
         "cue_card": re.compile(r"(?i)\b(?:card|visa|credit|payment)\b")}
_IP_FORM = re.compile(r"[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.)\s?[0-9]{1,3}){3}")
_AT = re.compile(rf"@|{_CUE}|\sat\s")
_CARD_FORM = re.compile(r"[0-9]{12,19}|(?:[0-9]{4}[ .-]){2,4}[0-9]{3,4}")
_PHONE_FORM = re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,5}")


def features(text: str, a: int, b: int, lo: int) -> list[int]:
    """Indexes of the features that the span [a, b) of a window from ``lo`` has."""
    span = text[a:b]
    d = digits_of(span)
    n = len(d)
    ats = _AT.findall(span)
    before, after = text[a - 1:a], text[b:b + 1]
    f = ["bias"]
    add = f.append
    if ats:
        add("at" if "@" in ats else "spelled_at")
        if len(ats) == 1:
            add("one_at")
        tail = _AT.split(span)[-1]
        dots = re.findall(r"\.|\bdot\b", tail)
        if dots:
            add("dots_after_at")
            if re.search(r"(?:\.|\bdot\b)[\])}]?\s?[A-Za-z]{2,8}$", tail):
                add("tail_alpha")
        if len(tail.split()) > 2 * len(dots) + 2 or len(_AT.split(span)[0].split()) > 1:
            add("label_parts")
    elif re.search(r"[A-Za-z]", span):
        add("letters_without_at")
    if _IP_FORM.fullmatch(span):
        add("ip_form")
        if _small_parts(re.findall(r"[0-9]+", span)):
            add("ip_small")
    if _CARD_FORM.fullmatch(span):
        add("card_digits")
        add("card_luhn" if luhn(d) else "luhn_fails")
    if _PHONE_FORM.fullmatch(span):
        add("phone_digits")
    for name, hit in (("plus", span[0] == "+"), ("zero_zero", span.startswith("00")), ("paren", "(" in span),
                      ("grouped", len(re.findall(r"[0-9]+", span)) > 1), ("one_run", span.isdigit()),
                      ("dashes", "-" in span), ("points", "." in span), ("spaces", " " in span),
                      ("letters", any(c.isalpha() for c in span)), ("quote", before in ('"', "'")),
                      ("glued_left", bool(before) and (before.isalnum() or before in "._%+-@:/=")),
                      ("glued_right", bool(after) and (after.isalnum() or after in "_%+-@/"
                                                       or after in ".-" and text[b + 1:b + 2].isalnum())),
                      ("equals", before in ("=", ":")), ("long", b - a > 40),
                      ("paren_open", span.count("(") != span.count(")")),
                      ("odd_start", not (span[0].isalnum() or span[0] in "+("))):
        if hit:
            add(name)
    add("digits_more" if n > 19 else "digits_16_19" if n > 15 else "digits_12_15" if n > 11
        else "digits_9_11" if n > 8 else "digits_7_8" if n > 6 else "bias")
    context = text[max(lo, a - CONTEXT):a]
    f += [name for name, cue in _CUES.items() if cue.search(context)]
    return sorted({_F[x] for x in f})


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A window's tokens and its candidate segments (first token, last token)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    kind = []
    for a, b in tokens:
        c = text[a]
        kind.append("n" if c == "\n" else "@" if c == "@" or (c in "[({" and b - a > 1) else
                    "9" if c.isdigit() else "a" if c.isalpha() else c)
    word_at = [k == "a" and text[a:b].lower() == "at" for k, (a, b) in zip(kind, tokens)]
    has_dot = any(text[a:b].lower() == "dot" for k, (a, b) in zip(kind, tokens) if k == "a")
    out = []
    for i, (a, _) in enumerate(tokens):
        if kind[i] not in "9a+(":
            continue
        digits, at, gaps = 0, False, 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if kind[j] == "n" or (j > i and tokens[j][0] - tokens[j - 1][1] > 1):
                break
            gaps += j > i and tokens[j][0] > tokens[j - 1][1]
            digits += tokens[j][1] - tokens[j][0] if kind[j] == "9" else 0
            at |= kind[j] == "@" or (has_dot and word_at[j] and j > i)
            if digits > 19 and not at:
                break
            if kind[j] in "9a" and (at and kind[i] in "9a" or digits >= 7 and kind[i] != "a"
                                    or digits >= 4 and kind[i] == "9" and kind[j] == "9" and j - i >= 6):
                if at or not gaps or gaps <= 8:
                    out.append((i, j))
            if kind[j] == "a" and kind[i] in "9+(" and not at and gaps:
                break
    return tokens, out


class SemiCrf:
    """Weights of (feature, kind); a segment outside scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def lattice(text: str, lo: int, hi: int):
        tokens, segs = segments(text, lo, hi)
        feats = [features(text, tokens[i][0], tokens[j][1], lo) for i, j in segs]
        return tokens, segs, feats

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in feats]).reshape(len(feats), len(KINDS))

    def best(self, text: str, lo: int, hi: int, margin: float = MARGIN) -> list[tuple[int, int, str]]:
        """The best segmentation's entities; each must beat "outside" by ``margin``."""
        tokens, segs, feats = self.lattice(text, lo, hi)
        if not segs:
            return []
        s = self.scores(feats) - margin
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(segs):
            ending.setdefault(j, []).append(k)
        top, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(len(tokens)):
            top[j + 1] = top[j]
            for k in ending.get(j, ()):
                y = int(np.argmax(s[k]))
                if top[segs[k][0]] + s[k, y] > top[j + 1]:
                    top[j + 1], back[j + 1] = top[segs[k][0]] + s[k, y], (k, y)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                k, y = back[j]
                i = segs[k][0]
                out.append((tokens[i][0], tokens[segs[k][1]][1], KINDS[y]))
                j = i
        return out[::-1]

    @classmethod
    def fit(cls, examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 60, rate: float = 0.5,
            ridge: float = 2e-3) -> SemiCrf:
        """Maximum likelihood over windows (text, spans), by full gradient steps (AdaGrad)."""
        data = []
        for text, spans in examples:
            tokens, segs, feats = cls.lattice(text, 0, len(text))
            if not segs:
                continue
            where = {(tokens[i][0], tokens[j][1]): k for k, (i, j) in enumerate(segs)}
            gold = [(where[a, b], KINDS.index(y)) for a, b, y in spans if (a, b) in where]
            x = np.zeros((len(segs), len(FEATURES)))
            for k, f in enumerate(feats):
                x[k, f] = 1
            data.append((len(tokens), segs, x, gold))
        w = np.zeros((len(FEATURES), len(KINDS)))
        square = np.full_like(w, 1e-8)
        for _ in range(rounds if data else 0):
            grad = -ridge * len(data) * w
            for n, segs, x, gold in data:
                s = x @ w
                weight = np.logaddexp.reduce(s, axis=1)
                fore, back = np.zeros(n + 1), np.zeros(n + 1)
                ending, starting = [[] for _ in range(n)], [[] for _ in range(n)]
                for k, (i, j) in enumerate(segs):
                    ending[j].append(k)
                    starting[i].append(k)
                for j in range(n):
                    ks = ending[j]
                    fore[j + 1] = np.logaddexp.reduce([fore[j], *(fore[segs[k][0]] + weight[k] for k in ks)]) if ks else fore[j]
                for i in range(n - 1, -1, -1):
                    ks = starting[i]
                    back[i] = np.logaddexp.reduce([back[i + 1], *(back[segs[k][1] + 1] + weight[k] for k in ks)]) if ks else back[i + 1]
                ends = np.array([(fore[i], back[j + 1]) for i, j in segs])
                p = np.exp(s + (ends.sum(axis=1) - fore[n])[:, None])
                for k, y in gold:
                    grad[:, y] += x[k]
                grad -= x.T @ p
            square += grad * grad
            w = w + rate * grad / np.sqrt(square)
        return cls(w)


def rewritten(text: str, spans: list[tuple[int, int, str]], turn: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The window with its spans written otherwise, and where they are then."""
    out, moved, done = "", [], 0
    for a, b, kind in spans:
        span = text[a:b]
        if kind == "email":
            left, right = span.split("@", 1)
            span = (left + (" (at) ", " [at] ", "(at)", " at ")[turn % 4]
                    + (right if turn % 4 < 3 and turn % 2 else right.replace(".", (" (dot) ", ".", ".", " dot ")[turn % 4])))
        elif kind == "phone":
            d = digits_of(span)
            span = (span.lstrip("+"), "00" + span[1:], f"{d[:-10]}-{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}".lstrip("-"),
                    f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}")[turn % 4]
        elif kind == "card":
            d = digits_of(span)
            span = (". ".strip() if turn % 2 else " ").join(d[k:k + 4] for k in range(0, len(d), 4))
        elif kind == "ip":
            span = span.replace(".", ("[.]", "(.)")[turn % 2])
        out += text[done:a]
        moved.append((len(out), len(out) + len(span), kind))
        out += span
        done = b
    return out + text[done:], moved


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that overlap no earlier one."""
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


#: Where a base span of a kind may be: texts without a match have none.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9]([ -]?[0-9]){11}", "phone": r"\+[0-9]"}


def learn(docs: DataFrame, sample_rows: int = 8000, max_windows: int = 600, window_chars: int = 400,
          per_document: int = 20) -> SemiCrf:
    """A field learnt on a bounded sample of windows, drawn per kind.

    Of the documents that may hold each kind, and of the others with a digit or an ``@``, about ``sample_rows / 5`` are
    drawn by a hash of id and text; of each document the first ``per_document`` windows of at most ``window_chars``
    characters that hold the kind (or none).  Of each kind's windows, and of those without any, ``max_windows / 5`` are learnt from.
    """
    hints = {k: F.coalesce(F.col(TEXT).rlike(h), F.lit(False)) for k, h in _HINTS.items()}
    other = F.coalesce(F.col(TEXT).rlike("[0-9@]"), F.lit(False)) & ~reduce(lambda x, y: x | y, hints.values())
    groups = {**hints, "": other}
    sizes = docs.agg(*[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in groups.items()]).first()
    place = F.pmod(F.xxhash64(F.coalesce(F.col(ID).cast("string"), F.lit("")), F.col(TEXT)), F.lit(1 << 30))
    drawn = reduce(lambda x, y: x | y, [c & (place < int(min(1.0, sample_rows / 5 / max(1, sizes[f"n_{k}"])) * (1 << 30)))
                                        for k, c in groups.items()])
    rows = docs.where(drawn).select(place.alias("place"), F.col(TEXT).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = []
            for p, t in zip(part.column("place").to_pylist(), texts):
                taken = dict.fromkeys(("", *KINDS), 0)
                for a, b in windows(t):
                    if b - a > window_chars:
                        continue
                    for kind in {k for *_, k in base_spans(t[a:b])} or {""}:
                        taken[kind] += 1
                        if taken[kind] <= per_document:
                            found.append((p, t[a:b], kind))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["place", "window", "kind"])

    order = Window.partitionBy("kind").orderBy("place", "window")
    sample = rows.mapInArrow(run, "place long, window string, kind string").distinct().withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= max_windows // 5)
    found = sorted((r["place"], r["window"]) for r in sample.collect())          # at most max_windows short strings
    examples = []
    for turn, window in enumerate(dict.fromkeys(w for _, w in found)):
        spans = _apart(base_spans(window))
        examples.append((window, spans))
        if spans:
            examples.append(rewritten(window, spans, turn))
    return SemiCrf.fit(examples)


def find_spans(text: str | None, model: SemiCrf) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text; added spans overlap no base one."""
    base = base_spans(text)
    if not text or not model.weights.any():
        return base, base
    taken = sorted((a, b) for a, b, _ in base)
    added = [s for lo, hi in windows(text) for s in model.best(text, lo, hi) if _free(taken, s)]
    return base, sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _free(taken: list[tuple[int, int]], span: tuple[int, int, str]) -> bool:
    """No base span overlaps (at most one of each kind can reach over a place)."""
    k = bisect_left(taken, (span[1], -1))
    return all(b <= span[0] for _, b in taken[max(0, k - 2 * len(KINDS)):k])


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in angle brackets (overlapping spans: the first's)."""
    out, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def detect(docs: DataFrame, model: SemiCrf | None = None, sample_rows: int = 8000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    model = model or learn(docs, sample_rows)
    kind = docs.schema[ID].dataType.simpleString()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for t in texts:
                base, every = find_spans(t, model)
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS),
                             hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 *(pa.array(c, pa.string()) for c in cols[4:])], names)

    return docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SemiCrf | None = None, sample_rows: int = 8000) -> DataFrame:
    """``docs`` with all spans replaced in the texts (same columns; n_chars follows)."""
    model = model or learn(docs, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, TEXT):
            out = [redacted(t, s) if t and (s := find_spans(t, model)[1]) else t for t in texts]
            at = part.schema.get_field_index(TEXT)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(TEXT).isNotNull(), F.length(TEXT)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
