"""Quality rules: cross-document line frequency.

Every line is normalised (A-Z lower-cased, digits to 0, white space runs to
one space) and hashed.  For each host the distinct documents that hold a line
are counted (equal texts count as one document).  A line above both limits
(``min_docs`` documents and ``max_share`` of the host's documents) is
boilerplate, and so is, where ``long_words`` is given, a line of at least so
many words in ``min_docs`` documents, whatever its share of the host (a share
alone would keep it on a large host).  Boilerplate is removed, except in the text that holds it first (smallest
doc_id), so a group of copies never loses its content altogether.  A document
left with too little is rejected as depleted: fewer than ``min_words`` words,
or less than ``min_left`` of its words.

The first pass turns each text into its counts and the hashes of its distinct
lines (a few per cent of the text); only these are shuffled.  Counting per
(host, line) aggregates on (host, line, text) first, so neither a hot host, a
hot line nor a large group of copies meets in one task unreduced.

Cases: null text has no words (counts 0, base_failed, not kept); a null host is
the host ``""``; repeated rows count once and get equal results; a null
doc_id sorts last; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from ..session import checkpoint
from .common import HOST, ID, TEXT, free_caches, slices

SYMBOLS = b"#*$%&|<>"
_LINE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_BLANKS = b" \t\n\x0b\x0c\r"

SCHEMA = ("doc_id {id}, host string, tkey long, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long,len:long>>")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    m = len(ids)
    if m >= n:
        return 0
    pair = w[:-1] * m + w[1:]
    if m > 2_000_000:                      # keep the keys inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, where, counts = np.unique(pair[:-1] * m + w[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[tuple[int, int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, its words in the text, in one line)]."""
    if not text:
        return 0, 0, 0, 0, 0, []
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of_line: dict[int, tuple[int, int]] = {}
    for line in raw.translate(_LINE).split(b"\n"):
        parts = line.split()
        if parts:
            h = xxhash.xxh3_64_intdigest(b" ".join(parts))
            h -= (h >> 63) << 64
            of_line[h] = of_line.get(h, (0, 0))[0] + len(parts), len(parts)
    return (len(words), len(text) - int(sum(seen[c] for c in _BLANKS)), int(sum(seen[c] for c in SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), [(h, *n) for h, n in of_line.items()])


def line_table(docs: DataFrame) -> DataFrame:
    """One narrow row per document: counts and the hashes of its distinct lines."""
    rows = docs.select(F.col(ID).alias("doc_id"), F.coalesce(F.col(HOST).cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(TEXT).alias("tkey"), F.col(TEXT).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64()), ("len", pa.int64())]))
        for part, texts in slices(batches):
            found = [measure(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "host", "tkey")),
                 *(pa.array([x[k] for x in found], pa.int64()) for k in range(5)),
                 pa.array([[{"h": h, "w": w, "len": n} for h, w, n in x[5]] for x in found], line)],
                ["doc_id", "host", "tkey", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "lines"])

    return rows.mapInArrow(run, SCHEMA.format(id=docs.schema[ID].dataType.simpleString()))


def boilerplate(table: DataFrame, min_docs: int, max_share: float, long_words: int | None = None) -> DataFrame:
    """(host, h, n_docs, first): lines above the limits, and the text that holds each first."""
    lines = table.select("doc_id", "host", "tkey", F.explode("lines").alias("l")).select(
        "doc_id", "host", "tkey", F.col("l.h").alias("h"), F.col("l.len").alias("len"))
    per_text = lines.groupBy("host", "h", "tkey").agg(F.min("doc_id").alias("d"), F.first("len").alias("len"))
    per_line = per_text.groupBy("host", "h").agg(
        F.count(F.lit(1)).alias("n_docs"), F.first("len").alias("len"),
        F.min(F.struct(F.col("d").isNull().alias("last"), "d", "tkey")).alias("first"))
    hosts = table.groupBy("host", "tkey").agg(F.lit(1).alias("one")).groupBy("host").agg(
        F.count(F.lit(1)).alias("of_host"))
    common = per_line.where(F.col("n_docs") >= min_docs)
    over = F.col("n_docs") > max_share * F.col("of_host")
    if long_words is not None:
        over = over | (F.col("len") >= long_words)
    return sized_join(common, hosts, "host").where(over).select(
        "host", "h", "n_docs", F.col("first.tkey").alias("first"))


def judge(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05, min_words: int = 50,
          min_left: float = 0.5, long_words: int | None = None) -> DataFrame:
    """One row per document: base counts, removed line hashes, words left, ``base_failed``, ``kept``."""
    table = checkpoint(line_table(docs))
    common = checkpoint(boilerplate(table, min_docs, max_share, long_words))
    lines = table.select("doc_id", "host", "tkey", F.explode("lines").alias("l")).select(
        "doc_id", "host", "tkey", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    hit = sized_join(lines, common.drop("n_docs"), ["host", "h"]).where(F.col("tkey") != F.col("first"))
    removed = hit.groupBy("doc_id", "host", "tkey").agg(F.collect_set(F.struct("h", "w")).alias("gone"))
    a, b = table.drop("lines").alias("a"), removed.alias("b")
    same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.host") == F.col("b.host"))
            & (F.col("a.tkey") == F.col("b.tkey")))
    out = a.join(b, same, "left").select("a.*", F.coalesce("b.gone", F.array().cast("array<struct<h:long,w:long>>")
                                                            ).alias("gone"))
    left = F.col("n_words") - F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x["w"])
    out = out.select("*", left.alias("n_left"), F.col("gone.h").alias("removed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.size("removed") > 0) & (
        (F.col("n_left") < min_words) | (F.col("n_left") < min_left * F.col("n_words")))
    return out.select("doc_id", "host", "tkey", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", failed.alias("base_failed"), F.size("removed").cast("long").alias("n_removed_lines"),
                      "n_left", (~failed & ~depleted).alias("kept"), "removed")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected documents and without removed lines (same columns)."""
    verdict = judge(docs, **limits).where("kept").dropDuplicates(["doc_id", "host", "tkey"]).select(
        F.col("doc_id").alias("__d"), F.col("host").alias("__h"), F.col("tkey").alias("__t"),
        F.col("removed").alias("__gone"))
    on = (F.col(ID).eqNullSafe(F.col("__d")) & (F.coalesce(F.col(HOST).cast("string"), F.lit("")) == F.col("__h"))
          & (F.xxhash64(TEXT) == F.col("__t")))
    joined = docs.join(verdict, on).select(*docs.columns, "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for part, texts in slices(batches, TEXT):
            out = [without_lines(t, set(g)) if g else t for t, g in zip(texts, part.column("__gone").to_pylist())]
            at = part.schema.get_field_index(TEXT)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    done = joined.mapInArrow(run, joined.schema).drop("__gone")
    if "n_chars" in docs.columns:
        changed = F.when(F.col(TEXT).isNotNull(), F.length(TEXT)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose hash is in ``gone``."""
    kept = []
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").translate(_LINE).split()
        if parts:
            h = xxhash.xxh3_64_intdigest(b" ".join(parts))
            if h - ((h >> 63) << 64) in gone:
                continue
        kept.append(line)
    return "\n".join(kept)
