"""Exact Jaccard self-join of documents on word shingles by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct ``width``-word
shingles.  Two sets of sizes s and t whose Jaccard similarity is at least
0.8 differ in at most (s + t) / 9 elements.  Sizes are cut into bands; all
sets that may link within a band share one bound k.  The feature domain is cut
into n1 parts, each part into n2 cells.  Since at most k elements differ, some
part differs in at most k2 = floor(k / n1) of its cells, so some subset of
n2 - k2 of its cells agrees entirely: enumerating these subsets and hashing
the elements inside gives signatures of which linked sets share at least one.

Empty subsets would match everywhere.  n1 leaves ``slack`` parts more than the
bound needs: a pair in which either set has at most ``slack`` parts with an empty
subset shares a signature that is not empty.  The few other sets are cut anew
under further seeds; what is left after the last emits its empty subsets too.
No link is lost.

Shingles that many texts share (a common passage) would make unrelated sets agree.
The sets are first cut without them: what is left differs in no more elements,
so the bound holds; sets of which too little is left are cut as a whole.

Candidates are not expanded to all pairs: first every class is tested against
the nearest of the smallest classes of its signature groups.  Only groups that still
hold several components are searched further, streaming through rows sorted by
signature: first the nearest pair of each member and other component is tested,
then, where components are still apart, all pairs across.  Sizes and a 256-cell count vector (its L1
distance never exceeds the sets' distance) drop most, and exact intersections
of the whole sets decide.  Equal sets are one class throughout.

Cases: null or empty text, or one without words, has size 0 and is linked with
nothing (its own component); a text shorter than ``width`` words has its whole
sequence as one element; repeated rows get equal results; a null doc_id counts
only where its component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from ..session import checkpoint, discard
from .common import ID, TEXT, key_part, partitions_of, slices, worker_cache
from .components import components

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
CELLS = 256
COARSE = 64
SEEDS = 4
BROADCAST_BYTES = 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, cache: dict, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    span = min(width, n)
    h = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        h = h * _STEP + w[k:n - span + 1 + k]
    h = np.sort(_mix(h))
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h if new.all() else h[new]


def set_id(values: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(values.tobytes())
    return h - ((h >> 63) << 64)


@lru_cache(maxsize=None)
def bands(upto: int) -> list[tuple[int, int]]:
    """Size bands [least, most]; each reaches a third further than it starts."""
    out, least = [], 1
    while least <= upto:
        most = max(least, least * 4 // 3)
        out.append((least, most))
        least = most + 1
    return out


@lru_cache(maxsize=None)
def band_plan(most: int) -> tuple[int, int, int, tuple[tuple[int, ...], ...], int]:
    """(n1, n2, k2, subsets, slack) for sets of at most ``most`` elements at similarity 0.8."""
    k = 2 * most // 9
    if k <= 3:            # small sets: one part, all subsets of its cells
        k2, n1, slack = k, 1, 0
        n2 = 1 if k == 0 else k + 2
    elif k <= 8:          # two of three cells in each part
        k2, n2 = 1, 3
        slack = 1 + k // 6
        n1 = k // 2 + 1 + slack
    else:                 # large sets: whole parts
        k2, n2 = 0, 1
        slack = 1 + k // 7
        n1 = k + 1 + slack
    return n1, n2, k2, tuple(combinations(range(n2), n2 - k2)), slack


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    return next(i for i, (_, most) in enumerate(bands(max(size, 1) * 2)) if size <= most)


def _dealt(h: np.ndarray, n1: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by cell, and their cells in that order."""
    cell = (((h >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)) * np.uint64(n2) + (
        ((h & _LOW) * np.uint64(n2)) >> np.uint64(32))
    order = np.argsort(cell, kind="stable")
    return order, cell[order]


def without(values: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """The (ascending) values that are not among the (ascending) hot ones."""
    if hot is None or not len(hot):
        return values
    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
    return values[hot[at] != values]


def signatures(values: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a set, for its band and, where it may link upwards, the next one."""
    size = len(values)
    if not size:
        return np.zeros(0, np.uint64)
    own = band_of(size)
    edges = bands(size * 4)
    tags = [own] + ([own + 1] if size * 5 // 4 >= edges[own + 1][0] else [])
    rare = without(values, hot)
    out = []
    for tag in tags:
        n1, n2, _, subsets, slack = band_plan(edges[tag][1])
        for seed in range(SEEDS):
            part = rare if seed < SEEDS // 2 else values
            h = part if not seed else _mix(part + np.uint64(seed * int(_M3) % (1 << 64)))
            if n2 == 1 and not seed:         # hashes are in order, and so are their parts
                order = slice(None)
                cells = (h >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)
            else:
                order, cells = _dealt(h, n1, n2)
            ends = np.searchsorted(cells, np.arange(n1 * n2 + 1, dtype=np.uint64))
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part[order], dtype=np.uint64)))
            sums = (run[ends[1:]] - run[ends[:-1]]).reshape(n1, n2)
            counts = (ends[1:] - ends[:-1]).reshape(n1, n2)
            parts = np.arange(n1, dtype=np.uint64)
            empty = np.zeros(n1, bool)
            found = []
            for i, subset in enumerate(subsets):
                pick = list(subset)
                name = _mix(((np.uint64(tag * SEEDS + seed) << np.uint64(40))
                             + (parts << np.uint64(8)) + np.uint64(i)) * _M3 + np.uint64(1))
                sig = _mix(sums[:, pick].sum(axis=1, dtype=np.uint64) ^ name)
                none = counts[:, pick].sum(axis=1) == 0
                empty |= none
                found.append((sig, none))
            last = seed == SEEDS - 1
            enough = int(empty.sum()) <= slack
            out += [sig if last and not enough else sig[~none] for sig, none in found]
            if enough:
                break
    return np.concatenate(out)


def _sketch(values: np.ndarray) -> np.ndarray:
    counts = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text"))


def hot_shingles(docs: DataFrame, width: int = 5, one_of: int = 32, least: int = 5, most: int = 500_000) -> np.ndarray:
    """Shingles in many texts, ascending: at least ``least`` among one text in ``one_of``, the ``most`` most frequent.

    They only tell which elements signatures leave out first; any choice is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("word hashes", _WordHashes)
        for _, texts in slices(batches):
            sets = {len(s) and set_id(s): s for s in (shingle_set(t, cache, width) for t in texts)}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(sets.values())).view(np.int64))], ["h"])

    some = docs.select(F.col(TEXT).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0)
    found = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(
        F.desc("count"), "h").limit(most).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def signature_rows(docs: DataFrame, width: int = 5, hot=None, hashed: bool = False) -> DataFrame:
    """Two kinds of rows (sig, cid, n) in one pass over the texts.

    n null: a signature of a class (copies within a task emit once).  Else a
    document: sig is its class, cid its id, n its set size (-1 - size without an id)
    times 65,536 plus a running number, by which the documents of a class are spread.
    With ``hashed`` a document's row also has t, the hash of its text.
    """
    names = ["sig", "cid", "n", "t"][:3 + hashed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, dealt = worker_cache("word hashes", _WordHashes), set(), 0
        frequent = None if hot is None else hot.value
        for part, texts in slices(batches):
            sigs, owner, sizes, classes = [], [], [], []
            for t in texts:
                values = shingle_set(t, cache, width)
                cid = set_id(values) if len(values) else xxhash.xxh32_intdigest(str(len(seen) + len(sizes)))
                sizes.append(len(values))
                classes.append(cid)
                if not len(values) or cid in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(cid)
                s = signatures(values, frequent)
                sigs.append(s)
                owner.append(np.full(len(s), cid, np.int64))
            if sigs:
                none = pa.nulls(sum(map(len, sigs)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owner)),
                     none, *[none][:hashed]], names)
            ids = part.column("doc_id").to_pylist()
            dealt += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array([i or 0 for i in ids], pa.int64()),
                 pa.array([((-1 - n if i is None else n) << 16) | (k & 0xFFFF)
                           for k, (i, n) in enumerate(zip(ids, sizes), dealt)], pa.int64()),
                 *[part.column(k) for k in range(2, 2 + hashed)]], names)

    rows = docs.select(F.col(ID).cast("long").alias("doc_id"), F.col(TEXT).alias("text"),
                       *[F.xxhash64(TEXT).alias("t")][:hashed])
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, cid, hub, n): signatures that at least two classes share (hub: their smallest class), and all documents.

    Text hashes (t), where the rows have them, stay with the documents.
    """
    hashed = "t" in rows.columns
    names = ["sig", "cid", "hub", "n", "t"][:4 + hashed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                       # last row so far: sig, cid, hub, has a neighbour
        for batch in batches:
            document = batch.column(2).is_valid()
            some = batch.filter(document)
            if some.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.nulls(some.num_rows, pa.int64()),
                     pa.array(some.column(2).to_numpy() >> 16), *(some.column(k) for k in range(3, 3 + hashed))], names)
            batch = batch.filter(pc.invert(document))
            sig, cid = (batch.column(k).to_numpy() for k in range(2))
            if held is not None:
                sig, cid = np.concatenate(([held[0]], sig)), np.concatenate(([held[1]], cid))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])
            sig, cid = sig[new], cid[new]
            if not len(sig):
                continue
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            hub = cid[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            if held is not None:
                same = sig == held[0]     # the first group goes on
                hub[same] = held[2]
            near = ~first
            near[:-1] |= ~first[1:]
            if held is not None:
                near[0] |= held[3]
            held = (sig[-1], cid[-1], hub[-1], bool(near[-1]))
            out = near.copy()
            out[-1] = False
            if out.any():
                none = pa.nulls(int(out.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (sig, cid, hub)),
                                                  none, *[none][:hashed]], names)
        if held is not None and held[3]:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in held[:3]),
                                              none, *[none][:hashed]], names)

    # signatures meet; documents only pass, the many of a hot class spread over all tasks
    to = F.when(F.col("n").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", F.col("n").bitwiseAND(0xFFFF)))
    dealt = rows.repartition(partitions_of(rows), to).sortWithinPartitions("sig", "cid")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and count vectors allow the similarity, and how far they are (0 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_vectors(batch.column(k)) for k in (4, 5))
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                far = 9 * np.abs(x - y).sum(axis=1) - n
                rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["a", "b", "far"])
                yield rows.filter(pa.array(far <= 0))

    x = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    y = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    near = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    rows = pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "na", "nb", "va", "vb")
    return rows.mapInArrow(run, "a long, b long, far long")


def _across(groups: DataFrame) -> DataFrame:
    """Pairs (a, b, far) of different components within a signature that sizes and vectors allow."""

    def pairs(sig, cid, comp, n, vec) -> Iterator[pa.RecordBatch]:
        coarse = vec.reshape(len(vec), COARSE, -1).sum(axis=2, dtype=np.int16)
        for d in range(1, len(sig)):                # rows d apart in the same group
            same = sig[d:] == sig[:-d]
            if not same.any():
                break
            p = np.flatnonzero(same & (comp[d:] != comp[:-d])
                               & (5 * np.minimum(n[d:], n[:-d]) >= 4 * np.maximum(n[d:], n[:-d])))
            q = p + d
            for v in (coarse, vec):
                far = 9 * np.abs(v[p] - v[q]).sum(axis=1, dtype=np.int64) - n[p] - n[q]
                p, q, far = p[far <= 0], q[far <= 0], far[far <= 0]
            if len(p):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(cid[p], cid[q])), pa.array(np.maximum(cid[p], cid[q])), pa.array(far)],
                    ["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                 # the rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [*(batch.column(k).to_numpy() for k in range(4)), _vectors(batch.column(4))]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if last:
                yield from pairs(*(x[:last] for x in cols))
            held = [x[last:] for x in cols]
        if held is not None:
            yield from pairs(*held)

    dealt = groups.select("sig", "cid", "comp", "n", "vec").repartition(partitions_of(groups), "sig"
                                                                        ).sortWithinPartitions("sig", "comp")
    return dealt.mapInArrow(run, "a long, b long, far long").groupBy("a", "b").agg(F.first("far").alias("far"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of different components, with these (ca, cb)."""
    x = found.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = found.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select(
        "a", "b", "far", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each member and other component the nearest pair."""
    one = pairs.groupBy("a", "cb").agg(F.min(F.struct("far", "b", "ca")).alias("m")).select(
        "a", "m.far", "m.b", "m.ca")
    return one.groupBy("b", "ca").agg(F.min(F.struct("far", "a")).alias("m")).select("m.a", "b")


def _class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted classes (cid, rep): one document each, all where the id is null."""
    named = sized_join(_texts(docs), wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(),
                       "doc_id", "left_semi")
    return named.union(_texts(docs).where("doc_id is null")).select("text")


def _written_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted classes' documents, as a table in the shared folder."""
    named = sized_join(_texts(docs), wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(),
                       "doc_id", "left_semi")
    return checkpoint(named.unionByName(_texts(docs).where("doc_id is null")))


def sketches(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, n, vec) of the wanted classes: set size and count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("word hashes", _WordHashes)
        for _, texts in slices(batches):
            sets = [s for s in (shingle_set(t, cache, width) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_sketch(s).tobytes() for s in sets], pa.binary())], ["cid", "n", "vec"])

    got = _class_texts(docs, wanted).mapInArrow(run, "cid long, n long, vec binary")
    return got.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = checkpoint(classes.select("cid", "rep").join(ids, "cid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("word hashes", _WordHashes)
        for _, texts in slices(batches):
            sets = [s for s in (shingle_set(t, cache, width) for t in texts) if len(s)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["cid", "s"])

    sets = _class_texts(docs, wanted).mapInArrow(run, "cid long, s array<long>")
    sets = checkpoint(sets.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    x, y = (sets.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    if 8 * (sets.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_BYTES:
        x, y = F.broadcast(x), F.broadcast(y)       # few sets in many pairs
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = checkpoint(both.where(100 * common >= 80 * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    discard(wanted, sets)
    return out


def _linked(docs: DataFrame, width: int, hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, cid) of every document (cid null: no words; t with ``hashed``), (cid, rep) of every class,
    (node, comp) of the linked classes."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, width))
    both = checkpoint(shared_signatures(signature_rows(docs, width, hot, hashed)))
    shared = both.where("n is null").select("sig", "cid", "hub")
    size = F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("n"))
    table = both.where("n is not null").select(
        F.when(F.col("n") >= 0, F.col("cid")).cast(docs.schema[ID].dataType).alias("doc_id"), size.alias("n"),
        F.when(size > 0, F.col("sig")).alias("cid"), *["t"][:hashed])
    full = table.where("n > 0")
    classes = checkpoint(full.groupBy("cid").agg(F.min("doc_id").alias("rep")))
    wanted = checkpoint(shared.select("cid").distinct().join(classes, "cid"))
    texts = _written_texts(docs, wanted)
    vectors = checkpoint(sketches(texts, wanted, width))

    # round 1: every class against the nearest of the smallest classes of its groups
    star = shared.where("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    tested = checkpoint(_plausible(star, vectors).groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select(
        F.col("m.a").alias("a"), "b"))
    links = _verify(tested, texts, wanted, width)
    found = checkpoint(components(links))

    # across the components left in a group: first the nearest pair of each member, then all pairs left
    of = checkpoint(shared.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "sig", "cid", F.coalesce("comp", "cid").alias("comp")))
    mixed = of.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    left = checkpoint(_across(of.join(mixed, "sig").join(vectors, "cid")))
    discard(of, vectors)
    tried = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for choose in (_nearest, lambda pairs: pairs.select("a", "b")):
        before, left = left, checkpoint(_apart(left.select("a", "b", "far").join(tried.distinct(), ["a", "b"], "left_anti"), found))
        discard(before)
        if not left.take(1):
            break
        tried = checkpoint(choose(left))
        more = _verify(tried, texts, wanted, width)
        if more.take(1):
            found = checkpoint(components(more.unionByName(
                found.select(F.col("node").alias("a"), F.col("comp").alias("b")))))
        discard(more)
    discard(texts, wanted, tested, links, left)
    return table, classes, found


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    table, classes, found = _linked(docs, width)
    full = table.where("n > 0")
    least = found.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("comp").agg(
        F.min("rep").alias("component_id"))
    of_class = classes.select("cid", "rep").join(
        found.join(least, "comp").select(F.col("node").alias("cid"), "component_id"), "cid", "left").select(
        "cid", F.coalesce("component_id", "rep").alias("component_id"))
    linked = full.select("doc_id", "n", "cid").join(of_class, "cid").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), then text hash (same columns).

    Components are told apart by their classes and rows by (doc_id, text hash):
    ids may be null or repeat.  Rows without words are linked with nothing and
    stay.  The kept keys are a narrow table, broadcast behind its row count;
    only rows whose id and text both repeat are shuffled with their texts.
    """
    table, _, found = _linked(docs, width, hashed=True)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "rows")
    copies = table.where("n > 0").groupBy("cid", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    first = copies.groupBy("cid").agg(F.min(order).alias("m")).join(
        found.withColumnRenamed("node", "cid"), "cid", "left").groupBy(F.coalesce("comp", "cid").alias("comp")).agg(
        F.min("m").alias("m")).select("m.doc_id", "m.t", (F.col("m.rows") > 1).alias("__many"))
    bare = table.where("n = 0").select("doc_id", "t", F.lit(False).alias("__many")).distinct()
    kept = checkpoint(first.unionByName(bare).select(key_part("doc_id").alias("__key"), F.col("t").alias("__t"), "__many"))
    joined = sized_join(docs.withColumns({"__key": key_part(ID), "__t": F.xxhash64(TEXT)}), kept, ["__key", "__t"])
    out = joined.where("not __many").select(*docs.columns)
    if kept.where("__many").take(1):
        out = out.unionByName(joined.where("__many").dropDuplicates(["__key", "__t"]).select(*docs.columns))
    return out
