"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Byte triplets (three spacings inside a five-byte window) are hashed into 128
buckets.  A bucket's code is the quartile its count falls in; the digest is a
checksum byte, a length byte (logarithmic) and two bits a bucket, in hex.  Two
digests differ by the sum over buckets of the codes' distance (opposite ends
count double), plus the length bytes' distance; the likeness falls from 1 to 0 as that
difference rises to ``BOUND``.

Neighbours: rows are dealt by ranges of doc_id; the first row of each range is
also sent to the range before it as a guest, so every row meets the next one in
its own task and no text is moved twice otherwise.

Cases: null is an empty text; texts of under three bytes have no triplets (all codes
0); rows of one doc_id are ordered by text, a null doc_id comes first; an only
document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from .common import ID, TEXT, partitions_of, slices

BUCKETS = 128
BOUND = 300
SPACINGS = ((1, 2), (1, 3), (2, 4))
_WEIGHT = np.array([0, 1, 2, 6])
_ODD = np.uint32(0x9E3779B1)


def bucket_counts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(SPACINGS):
        if len(data) > j:
            n = len(data) - j
            key = data[:n] | (data[i:n + i] << np.uint32(8)) | (data[j:] << np.uint32(16)) | np.uint32(k << 24)
            key ^= key >> np.uint32(15)
            counts += np.bincount((key * _ODD) >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    counts = bucket_counts(raw)
    ranked = np.sort(counts)
    q = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = np.searchsorted(q, counts, side="left").astype(np.uint8)     # counts up to a quartile share its code
    packed = code.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    length = min(255, round(16 * np.log2(len(raw) + 1) / 2))
    check = hashlib.sha256(raw).digest()[0]
    return bytes([check, length]).hex() + packed.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[1]), ((raw[2:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 at a difference of ``BOUND`` or more."""
    if a == b:
        return 1.0
    (la, ca), (lb, cb) = _codes(a), _codes(b)
    apart = int(_WEIGHT[np.abs(ca.astype(int) - cb.astype(int))].sum()) + min(40, abs(la - lb))
    return 1.0 - min(BOUND, apart) / BOUND


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> tuple[DataFrame, list]:
    """(doc_id, text, part, guest); each range's first id goes to the range before it as well."""
    rows = docs.select(F.col(ID).alias("doc_id"), F.coalesce(F.col(TEXT), F.lit("")).alias("text"))
    kind = docs.schema[ID].dataType
    n = 2 * partitions_of(docs)
    shares = [k / n for k in range(1, n)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 20 * n)).first()[0] or []))
    ends = F.array(*[F.lit(x).cast(kind) for x in bounds]).cast(f"array<{kind.simpleString()}>")
    part = F.coalesce(F.size(F.filter(ends, lambda x: x < F.col("doc_id"))), F.lit(0))
    firsts = rows.groupBy(part.alias("part")).agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("first"))
    order = sorted((r["part"], r["first"]["doc_id"]) for r in firsts.collect())    # a row a range
    return rows.withColumn("part", part), order


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, guest) dealt and sorted so that each row's successor follows it."""
    rows, order = _ranges(docs)
    if not order:
        return rows.withColumn("guest", F.lit(False))
    spark, kind = docs.sparkSession, docs.schema[ID].dataType.simpleString()
    to = [(first, order[k - 1][0]) for k, (_, first) in enumerate(order)]
    named = spark.createDataFrame([x for x in to if x[0] is not None], f"doc_id {kind}, part int")
    guests = sized_join(rows.select("doc_id", "text"), named, "doc_id")
    guests = guests.unionByName(rows.where("doc_id is null").sort("text").limit(1).select(
        "doc_id", "text", F.lit(next((p for f, p in to if f is None), 0)).alias("part")))
    both = rows.withColumn("guest", F.lit(False)).unionByName(
        guests.select("doc_id", "text", "part", F.lit(True).alias("guest")))
    return both.repartition(partitions_of(docs), "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").asc_nulls_first(), "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[ID].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                       # the last row: part, id, text, digest; it waits for its successor
        for part, texts in slices(batches):
            rows = []
            for where, doc, text, guest in zip(part.column("part").to_pylist(), part.column("doc_id").to_pylist(),
                                               texts, part.column("guest").to_pylist()):
                if held is None and guest:
                    continue              # a later guest of the same range
                own = digest(text)
                if held is not None:
                    changed = edited(held[2], text)
                    theirs = digest(changed)
                    rows.append((held[1], len(held[2]),
                                 hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                 held[3], theirs, likeness(held[3], theirs), likeness(held[3], own)))
                held = None if guest else (where, doc, text, own)
            if rows:
                cols = list(zip(*rows))
                types = [part.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return neighbours(docs).mapInArrow(run, schema)
