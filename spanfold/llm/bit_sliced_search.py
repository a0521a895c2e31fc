"""Ranked lexical search by bit-sliced Bloom signatures (operator 12).

**Index.** Every text has a Bloom signature of its terms: an entry (term, level)
for each level of 1, 2, 4 and 8 occurrences it reaches.  Signatures of like
size stand side by side as the columns of a block, so that one bit position of
all its documents is one row: a slice.  Beside the blocks the index holds, per
task, document frequencies of all terms and the totals N and L.  Documents are
indexed where they are read; no text is shuffled.  Copies met in one task have
one column there, but count in the statistics.

**Search.** The AND of a term's slices marks every document that holds it (and
some that do not): an overestimate.  Weighted sums of these marks, level by
level, give each document an upper bound of its score, since the number of
occurrences is known up to the next level and the document's length exactly.
First the texts with the highest bounds are scored exactly; the k-th best score
of a query is its threshold.  Then every text whose bound reaches the threshold
is scored exactly: those below it are provably outside the answer.  Only the
texts to be scored are read again.

Score: with N documents that hold a term, L terms in all, n terms in the
document, a term's weight w = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 75 + 25 n N div L, the sum of w * (10^9 tf div (1000 tf + 12 m)) over the
query's terms, repeats included.

Results: null and empty texts (documents or queries) have no terms: they are
in no answer and get none.  Every row is a document: rows that repeat a doc_id
or a whole row are ranked each.  Equal scores go by ascending doc_id, null ids
last.  Every row of the queries is an item of its own.  Queries with fewer than
k documents above 0 return those.  Other columns are ignored.  Empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ID, TEXT, slices, worker_cache

#: Occurrences at which a term gets another entry, and the most it can have below the next level.
LEVELS = (1, 2, 4, 8)
#: Slices a term's entry is in, and the least bits of a signature for each entry.
PROBES, BITS = 4, 12
#: Bits of one block, most documents in one.
BLOCK_BITS, BLOCK_DOCS = 1 << 21, 512
#: Terms in one row of frequencies; terms that a task holds before it writes them.
TERMS_PER_ROW, MAX_HELD_TERMS = 20_000, 400_000
#: Queries searched together, and their bytes of text.
BLOCK_QUERIES, BLOCK_QUERY_BYTES = 2_000, 4 << 20
#: Texts to be scored that are broadcast as keys; more are joined by shuffle.
MAX_SENT_KEYS = 200_000

_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_FIELDS = [("m", pa.int32()), ("keys", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()),
           ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
_SCHEMA = ("m int, keys array<binary>, lengths array<long>, bits binary, terms array<binary>, dfs array<long>, "
           "n_docs long, n_terms long")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Hashes:
    """64-bit hashes of terms; a worker keeps those of the terms it has met, up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.of = most, {}

    def __call__(self, terms) -> np.ndarray:
        if len(self.of) > self.most:
            self.of.clear()
        of = self.of
        for t in terms:
            if t not in of:
                of[t] = xxhash.xxh64_intdigest(t)
        return np.fromiter(map(of.__getitem__, terms), np.uint64, len(terms))


def slice_numbers(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
    """(entries x PROBES) slices of (term, level) entries among ``m``, a power of two."""
    start, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(level * PROBES, (level + 1) * PROBES, dtype=np.uint64)
    return ((start[:, None] + probes * step[:, None]) & np.uint64(m - 1)).astype(np.int64)


def docs_per_block(m: int) -> int:
    return max(8, min(BLOCK_DOCS, BLOCK_BITS // m))


class _Block:
    """Signatures of one size, a document a column."""

    def __init__(self, m: int):
        self.m, self.keys, self.lengths = m, [], []
        self.bits = np.zeros((m, docs_per_block(m) // 8), np.uint8)

    def add(self, key: bytes, length: int, hashes: np.ndarray, tf: np.ndarray) -> bool:
        byte, bit = divmod(len(self.keys), 8)
        for level, least in enumerate(LEVELS):
            some = hashes[tf >= least]
            if not len(some):
                break
            self.bits[slice_numbers(some, level, self.m).ravel(), byte] |= np.uint8(128 >> bit)
        self.keys.append(key)
        self.lengths.append(length)
        return len(self.keys) == self.bits.shape[1] * 8

    def row(self) -> dict:
        used = -(-len(self.keys) // 8)
        return {"m": self.m, "keys": self.keys, "lengths": self.lengths,
                "bits": np.ascontiguousarray(self.bits[:, :used]).tobytes()}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    hashes = worker_cache("term hashes", Hashes)
    blocks: dict[int, _Block] = {}
    seen, dfs, n_docs, n_terms = set(), Counter(), 0, 0

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in found], schema)

    def frequencies() -> Iterator[pa.RecordBatch]:
        held = iter(dfs.items())
        while some := list(islice(held, TERMS_PER_ROW)):
            yield rows([{"terms": [t for t, _ in some], "dfs": [n for _, n in some]}])

    for part, texts in slices(batches):
        for key, text in zip(part.column("key").to_pylist(), texts):
            tf = Counter(terms_of(text))
            if not tf:
                continue
            size = tf.total()
            n_docs, n_terms = n_docs + 1, n_terms + size
            dfs.update(tf.keys())
            if key in seen:
                continue
            seen.add(key)
            counts = np.fromiter(tf.values(), np.int64, len(tf))
            entries = sum(int((counts >= least).sum()) for least in LEVELS)
            m = 1 << max(6, math.ceil(math.log2(entries * BITS)))
            if m not in blocks:
                blocks[m] = _Block(m)
            if blocks[m].add(key, size, hashes(tf.keys()), counts):
                yield rows([blocks.pop(m).row()])
        if len(dfs) > MAX_HELD_TERMS:
            yield from frequencies()
            dfs.clear()
    for block in blocks.values():
        yield rows([block.row()])
    yield from frequencies()
    yield rows([{"n_docs": n_docs, "n_terms": n_terms}])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the documents with a text; key is its sha-256."""
    return docs.where(F.col(TEXT) != "").select(F.col(ID).alias("doc_id"), F.unhex(F.sha2(F.col(TEXT), 256)).alias("key"),
                                                F.col(TEXT).alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs``, written to and read from the shared folder (see the module)."""
    path = scratch_path(docs.sparkSession, "search-index")
    keyed(docs).select("key", "text").mapInArrow(_index, _SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(_SCHEMA).parquet(path)


class Queries:
    """A block of queries: terms with hashes and weights; each query's term numbers and weight sums."""

    def __init__(self, texts: list[str | None], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        of = [Counter(terms_of(t)) for t in texts]
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                  for t in dict.fromkeys(chain.from_iterable(of)) if df.get(t)}
        self.terms = {t: k for k, t in enumerate(weight)}
        self.hashes = Hashes()(list(self.terms))
        self.at = [np.fromiter((self.terms[t] for t in c if t in weight), np.int64) for c in of]
        self.weights = [np.fromiter((n * weight[t] for t, n in c.items() if t in weight), np.int64) for c in of]
        exact = max((int(w.sum()) for w in self.weights), default=0) < 1 << 24
        self.kind = np.float32 if exact else np.float64     # sums of whole numbers stay exact
        self.floats = [w.astype(self.kind) for w in self.weights]

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths * self.n_docs) // self.n_terms

    def bounds(self, m: int, lengths: np.ndarray, bits: bytes) -> np.ndarray:
        """(queries x documents): no score is above its bound."""
        n = len(lengths)
        slices_of = np.frombuffer(bits, np.uint8).reshape(m, -1)
        damping, before = self.damping(lengths), np.zeros(n, np.int64)
        out = np.zeros((len(self.at), n), np.int64)
        marks = np.full((len(self.hashes), slices_of.shape[1]), 255, np.uint8)
        for level, (_, above) in enumerate(zip(LEVELS, (*LEVELS[1:], None))):
            at = slice_numbers(self.hashes, level, m)
            for probe in range(PROBES):
                marks &= slices_of[at[:, probe]]
            most = 10 ** 6 if above is None else (10 ** 9 * (above - 1)) // (1000 * (above - 1) + 12 * damping)
            gain, before = most - before, most
            held = marks.any(axis=1)
            if not held.any():
                break
            held_at = np.cumsum(held) - 1
            flags = np.unpackbits(marks[held], axis=1, count=n).astype(self.kind)
            for k, (terms, w) in enumerate(zip(self.at, self.floats)):
                some = held[terms]
                if some.any():
                    out[k] += (w[some] @ flags[held_at[terms[some]]]).astype(np.int64) * gain
        return out

    def scores(self, tf: Counter, items: list[int]) -> list[int]:
        """Exact scores of one text for some queries."""
        at = self.terms
        found = {at[t]: n for t, n in tf.items() if t in at}
        if not found:
            return [0] * len(items)
        damping = int(self.damping(np.int64(tf.total())))
        gains = np.zeros(len(at), np.int64)
        gains[list(found)] = [10 ** 9 * n // (1000 * n + 12 * damping) for n in found.values()]
        return [int((self.weights[k] * gains[self.at[k]]).sum()) for k in items]


def _highest(index: DataFrame, sent, k: int) -> DataFrame:
    """(item, key, bound): the k highest bounds of each query in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        bound = np.zeros((len(queries.at), 0), np.int64)
        keys, at = [], np.zeros((len(queries.at), 0), np.int64)
        for b in batches:
            for m, own, lengths, bits in zip(*(b.column(c).to_pylist() for c in ("m", "keys", "lengths", "bits"))):
                new = queries.bounds(m, np.array(lengths), bits)
                first = len(keys)
                keys += own
                bound = np.concatenate((bound, new), axis=1)
                at = np.concatenate((at, np.broadcast_to(np.arange(first, len(keys)), new.shape)), axis=1)
                best = np.argpartition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k]
                bound, at = np.take_along_axis(bound, best, 1), np.take_along_axis(at, best, 1)
                if len(keys) > 100 * BLOCK_DOCS:               # keys that no query has left go
                    used, at = np.unique(at, return_inverse=True)
                    keys, at = [keys[j] for j in used.tolist()], at.reshape(bound.shape)
        item, place = np.nonzero(bound > 0)
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)),
                                              pa.array([keys[j] for j in at[item, place].tolist()], pa.binary()),
                                              pa.array(bound[item, place])], ["item", "key", "bound"])

    found = index.where("m IS NOT NULL").select("m", "keys", "lengths", "bits").mapInArrow(
        run, "item int, key binary, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    return found.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("item", "key")


def _reaching(index: DataFrame, sent, limits) -> DataFrame:
    """(item, key) of every text whose bound is above 0 and reaches the query's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.maximum(limits.value, 1)[:, None]
        for b in batches:
            for m, own, lengths, bits in zip(*(b.column(c).to_pylist() for c in ("m", "keys", "lengths", "bits"))):
                item, place = np.nonzero(sent.value.bounds(m, np.array(lengths), bits) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)),
                                                  pa.array([own[j] for j in place.tolist()], pa.binary())], ["item", "key"])

    return index.where("m IS NOT NULL").select("m", "keys", "lengths", "bits").mapInArrow(run, "item int, key binary")


def _score(docs: DataFrame, pairs: DataFrame, sent, max_sent: int) -> DataFrame:
    """(key, doc_id, items, scores) of the documents whose key is in ``pairs(item, key)``, written and read back.

    A text is scored where its first copy in a task is; the other rows of that task have no scores.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "search-texts")
    pairs.groupBy("key").agg(F.collect_set("item").alias("items")).write.parquet(path)
    wanted = spark.read.schema("key binary, items array<int>").parquet(path)
    rows = keyed(docs)
    rows = rows.join(F.broadcast(wanted), "key") if wanted.count() <= max_sent else rows.join(wanted, "key")
    kind = docs.schema[ID].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, seen = sent.value, set()
        for part, texts in slices(batches):
            scores = []
            keys, items = part.column("key").to_pylist(), part.column("items").to_pylist()
            for key, some, text in zip(keys, items, texts):
                scores.append(None if key in seen else queries.scores(Counter(terms_of(text)), some))
                seen.add(key)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), part.column("items"),
                                              pa.array(scores, pa.list_(pa.int64()))], ["key", "doc_id", "items", "scores"])

    out = scratch_path(spark, "search-scores")
    schema = f"key binary, doc_id {kind}, items array<int>, scores array<long>"
    rows.select("key", "doc_id", "items", "text").mapInArrow(run, schema).write.parquet(out)
    return spark.read.schema(schema).parquet(out)


def _pairs_scored(scored: DataFrame) -> DataFrame:
    return (scored.where("scores IS NOT NULL").select("key", F.explode(F.arrays_zip("items", "scores")).alias("s"))
            .select("key", F.col("s.items").alias("item"), F.col("s.scores").alias("score")).where("score > 0").distinct())


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank): the k best documents of each item.

    Of a text's copies only the k with the smallest ids can be among the k best.
    """
    copies = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last())
    few = scored.select("key", "doc_id").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (_pairs_scored(scored).join(few, "key").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("item", "doc_id", "score", "rank"))


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    """The queries in lists of bounded length and bytes."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        block.append(row)
        size += len(row["text"] or "")
        if len(block) >= BLOCK_QUERIES or size >= BLOCK_QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 20,
           max_sent: int = MAX_SENT_KEYS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each row of ``queries(item_id, text)``.

    ``index`` is that of ``docs`` (``build_index``).  Queries are searched in blocks of bounded size.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = queries.schema["item_id"].dataType.simpleString(), docs.schema[ID].dataType.simpleString()
    total = index.where("n_docs IS NOT NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for block in _query_blocks(queries.select("item_id", "text")) if total["n"] else ():
        own = set(chain.from_iterable(terms_of(r["text"]) for r in block))
        if not own:
            continue
        wanted = spark.createDataFrame([(bytearray(t),) for t in own], "term binary")
        held = (index.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
                .select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
                .join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")))
        of = Queries([r["text"] for r in block], {bytes(r["term"]): r["df"] for r in held.collect()}, total["n"], total["l"])
        sent = spark.sparkContext.broadcast(of)
        first = _score(docs, _highest(index, sent, k), sent, max_sent)
        limits = np.zeros(len(block), np.int64)              # the k-th best score so far: a bounded table
        for r in _ranked(first, k).where(F.col("rank") == k).collect():
            limits[r["item"]] = r["score"]
        scored = _score(docs, _reaching(index, sent, spark.sparkContext.broadcast(limits)), sent, max_sent)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(block)], f"item int, item_id {item_kind}")
        out = out.unionByName(_ranked(scored, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Indexes ``docs`` and searches them for every row of ``queries``."""
    return search(build_index(docs), docs, queries, k)
