"""Cross-tokenizer alignment (operator 11), each distinct text tokenised and aligned once.

Texts are shuffled by full text: equal texts meet as one row with their number
of copies.  That row is tokenised by both tokenizers and aligned on bytes; its
pair counts are weighted by the copies, and its measures go back to the doc_ids
by a hash of the text.

Inside a task the work is shared once more.  Both tokenizers always have a
token boundary in front of white space that follows something else, so a text
is a row of units (white space and the word behind it) whose tokens, groups and
links never cross units.  A worker keeps the units it has met (bounded; it
starts anew beyond the bound).  Texts with white space other than space, tab
and line feed are one unit as a whole: the piece model has pieces that hold
such characters.

Token pairs are linked where their byte ranges overlap.  Between two
neighbouring token ends of either side lies one stretch of bytes inside exactly
one A and one B token, and two overlapping tokens share exactly one such
stretch: a text has one link per distinct token end.

Results: null and empty texts have no tokens, nor have texts whose bytes the
tokens of either side do not spell (say, with a literal U+2581); their counts
are 0 and ``groups_sha256`` is ''.  Repeated rows, repeated and null doc_ids
give one result row each; every copy weighs in the corpus counts.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_safe_lookup
from ..session import scratch_path
from .chunk_bpe import token_bytes
from .common import ID, TEXT, default_tokenizer, load_tokenizer, slices, worker_cache

#: Units a worker keeps, and characters of the longest one kept beyond its slice.
MAX_UNITS = 300_000
#: Pairs in one row of partial counts.
PAIRS_PER_ROW = 50_000
#: Pairs whose counts are sent to every worker (13 bytes each); more are joined by shuffle.
MAX_SENT_PAIRS = 4_000_000
#: Texts whose measures are broadcast where there are more texts than this (those with most copies).
MAX_HOT_TEXTS = 50_000

_UNIT = re.compile(r"\s*\S+|\s+")
#: White space that only whole texts may hold (as Python, Unicode or either library see it).
_ODD_SPACE = re.compile("[\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")

_FIELDS = [("key", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
           ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
           ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
_SCHEMA = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "codes array<int>, counts array<long>")


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece model: byte pieces as their byte, U+2581 as a space."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def align_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of groups, A index and B index of each link) from the ascending token ends of both sides."""
    ends = np.union1d(ends_a, ends_b)
    return np.intersect1d(ends_a, ends_b, assume_unique=True), np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Units with their tokens, groups and links; a link is the code ``a * n_pieces + b``."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        self.a = load_tokenizer(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a, self.bytes_b = token_bytes(self.a), piece_bytes(self.b)
        self.n_pieces = len(self.bytes_b)
        if len(self.bytes_a) * self.n_pieces >= 1 << 31:
            raise ValueError("pairs of these vocabularies do not fit 32-bit codes")
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, self.n_pieces)
        self.names_a = [str(i) for i in range(len(self.bytes_a))]
        self.names_b = [str(i) for i in range(self.n_pieces)]
        # units are safe to cut only if no piece goes on past white space
        names = [self.b.id_to_piece(i) for i in range(self.n_pieces) if not self.b.is_byte(i)]
        self.cuts = not any(re.search("[^▁]▁|[\n\t ]", p) for p in names)
        self.space = self.b.piece_to_id("▁")
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((1 << 14, 4), np.int64)    # n_a, n_b, n_groups, spelt
        self.ends = np.zeros(1 << 14, np.int64)            # ends[k]: end of unit k's codes
        self.codes = np.zeros(1 << 16, np.int32)
        self.n_codes = 0

    @property
    def full(self) -> bool:
        return len(self.at) > MAX_UNITS or self.n_codes > 20 * MAX_UNITS

    def units(self, text: str) -> list[str]:
        whole = " " + text
        return [whole] if not self.cuts or _ODD_SPACE.search(text) else _UNIT.findall(whole)

    def _pieces(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; the model itself puts a space in front of what it is given."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        out = []
        for u, ids in zip(units, found):
            if u[0] != " ":
                ids = ids[1:] if ids and ids[0] == self.space else []
            elif u == " ":
                ids = [self.space]
            out.append(ids)
        return out

    def _learn(self, units: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self._pieces(units)
        spelt = []
        for u, x, y in zip(units, ids_a, ids_b):
            raw = u.encode("utf-8", "surrogatepass")
            spelt.append(b"".join(map(self.bytes_a.__getitem__, x)) == raw
                         and b"".join(map(self.bytes_b.__getitem__, y)) == raw)
        good = [k for k, ok in enumerate(spelt) if ok]
        flat_a = np.fromiter(chain.from_iterable(ids_a[k] for k in good), np.int64)
        flat_b = np.fromiter(chain.from_iterable(ids_b[k] for k in good), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts, at_a, at_b = align_ends(ends_a, ends_b)
        codes = (flat_a[at_a] * self.n_pieces + flat_b[at_b]).astype(np.int32)
        # tokens of either side up to each group's end, and the text units' ends in groups and links
        to_a, to_b = (np.searchsorted(e, cuts, "right").tolist() for e in (ends_a, ends_b))
        n_a = np.fromiter((len(ids_a[k]) for k in good), np.int64, len(good))
        n_b = np.fromiter((len(ids_b[k]) for k in good), np.int64, len(good))
        stops = ends_a[np.cumsum(n_a) - 1] if good else np.zeros(0, np.int64)
        groups_to = np.searchsorted(cuts, stops, "right")
        link_ends = np.union1d(ends_a, ends_b)
        links_to = np.searchsorted(link_ends, stops, "right")
        text_a, text_b = [self.names_a[i] for i in flat_a.tolist()], [self.names_b[i] for i in flat_b.tolist()]
        named, i, j = [], 0, 0
        for p, q in zip(to_a, to_b):
            named.append(f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        first, n = len(self.at), len(units)
        while first + n + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.numbers = np.concatenate((self.numbers, np.zeros_like(self.numbers)))
        while self.n_codes + len(codes) > len(self.codes):
            self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
        self.codes[self.n_codes:self.n_codes + len(codes)] = codes
        n_groups = np.diff(groups_to, prepend=0)
        rows = first + np.array(good, np.int64)
        self.numbers[first:first + n] = 0
        if good:
            self.numbers[rows] = np.stack((n_a, n_b, n_groups, np.ones_like(n_a)), axis=1)
        link_counts = np.zeros(n, np.int64)
        link_counts[good] = np.diff(links_to, prepend=0)
        self.ends[first + 1:first + n + 1] = self.n_codes + np.cumsum(link_counts)
        self.n_codes += len(codes)
        strings, g0 = [""] * n, 0
        for k, g1 in zip(good, groups_to.tolist()):
            strings[k] = ";".join(named[g0:g1])
            g0 = g1
        self.groups += strings
        self.at.update(zip(units, range(first, first + n)))

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts in a row, units of each text)."""
        split = [self.units(t) for t in texts]
        new = list(dict.fromkeys(chain.from_iterable(split)).keys() - self.at.keys())
        for k in range(0, len(new), 20_000):
            self._learn(new[k:k + 20_000])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum())), counts

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the units' links in a row, links of each unit)."""
        size = self.ends[units + 1] - self.ends[units]
        shift = np.repeat(self.ends[units] - (np.cumsum(size) - size), size)
        return self.codes[shift + np.arange(len(shift))], size


def _per_text(aligner: Aligner, texts: list[str], units: np.ndarray, counts: np.ndarray):
    """Numbers, group hashes and (codes, their counts, offsets) of each text; unspelt texts have none."""
    starts = np.cumsum(counts) - counts
    numbers = np.add.reduceat(aligner.numbers[units], starts, axis=0)
    spelt = numbers[:, 3] == counts
    named = [aligner.groups[k] for k in units.tolist()]
    hashes = [hashlib.sha256(";".join(named[s:s + n]).encode()).hexdigest() if ok else ""
              for s, n, ok in zip(starts.tolist(), counts.tolist(), spelt.tolist())]
    kept = units[np.repeat(spelt, counts)]
    codes, size = aligner.links_of(kept)
    n_units = np.where(spelt, counts, 0)
    text_of = np.repeat(np.repeat(np.arange(len(texts)), n_units), size)
    n_links = np.bincount(text_of, minlength=len(texts))
    marked = np.sort((text_of << 32) | codes)
    first = np.flatnonzero(np.diff(marked, prepend=-1))
    times = np.diff(first, append=len(marked))
    offsets = np.searchsorted(marked[first] >> 32, np.arange(len(texts) + 1))
    numbers = np.where(spelt[:, None], numbers, 0)
    return numbers, n_links, hashes, (marked[first] & 0xFFFFFFFF).astype(np.int32), times, offsets, kept, n_units


def _align(batches: Iterator[pa.RecordBatch], byte_bpe: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """A row for each text; then rows without a key that hold the task's pair counts, weighted by copies."""
    aligner = worker_cache(("aligner", byte_bpe, pieces), lambda: Aligner(byte_bpe, pieces))
    schema = pa.schema(_FIELDS)
    weight = np.zeros(0, np.int64)                 # occurrences of each unit in this task, copies counted

    def totals() -> Iterator[pa.RecordBatch]:
        met = np.flatnonzero(weight)
        codes, size = aligner.links_of(met)
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], np.repeat(weight[met], size)[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        sums = np.add.reduceat(times, first) if len(first) else times
        for k in range(0, len(first), PAIRS_PER_ROW):
            none = [[None]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip([*none, [codes[first[k:k + PAIRS_PER_ROW]]],
                                                      [sums[k:k + PAIRS_PER_ROW]]], schema)], schema=schema)

    for part, texts in slices(batches):
        if aligner.full:
            yield from totals()
            weight = np.zeros(0, np.int64)
            aligner._reset()
        units, counts = aligner.look_up(texts)
        numbers, n_links, hashes, codes, times, offsets, kept, n_units = _per_text(aligner, texts, units, counts)
        copies = part.column("copies").to_numpy()
        weight = np.concatenate((weight, np.zeros(len(aligner.at) - len(weight), np.int64)))
        weight += np.bincount(kept, np.repeat(copies, n_units), len(weight)).astype(np.int64)
        offsets = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("key").cast(pa.binary()), pa.array(copies), *(pa.array(numbers[:, k]) for k in range(3)),
             pa.array(n_links), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(codes)),
             pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))], schema=schema)
    yield from totals()


def align_texts(docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(aligned texts, pair counts): the general form of the operator, both read back from the shared folder.

    ``aligned`` has one row per distinct non-empty text: ``key`` (sha-256 of the text), copies, n_a, n_b,
    n_groups, n_links, groups_sha256, codes and counts (its distinct links ``a * pieces + b`` and how often).
    ``pairs`` has (code, b, total): how many links of the corpus, copies counted, hold the pair.
    """
    byte_bpe = byte_bpe or default_tokenizer("byte_bpe_50k.json")
    pieces = pieces or default_tokenizer("piece_bpe_32k.model")
    spark, n_pieces = docs.sparkSession, _piece_count(pieces)
    distinct = (docs.select(F.col(TEXT).alias("text")).where("text <> ''")
                .groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
                .select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key")))
    path = scratch_path(spark, "aligned-texts")
    distinct.mapInArrow(lambda b: _align(b, byte_bpe, pieces), _SCHEMA).write.parquet(path)
    rows = spark.read.schema(_SCHEMA).parquet(path)
    pairs = (rows.where("key IS NULL").select(F.explode(F.arrays_zip("codes", "counts")).alias("p"))
             .groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("total"))
             .select("code", F.pmod("code", F.lit(n_pieces)).alias("b"), "total"))
    out = scratch_path(spark, "pair-counts")
    pairs.write.parquet(out)
    return rows.where("key IS NOT NULL"), spark.read.schema("code int, b int, total long").parquet(out)


def _piece_count(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def score_links(aligned: DataFrame, pairs: DataFrame, max_sent: int = MAX_SENT_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) of every aligned text, by the corpus-wide counts of its links.

    At most ``max_sent`` pairs (counted first) are sent to every worker as sorted arrays; more are
    joined by shuffle, frequent pairs broadcast.  The best count of each B id is a row per piece: bounded.
    """
    spark = aligned.sparkSession
    best = pairs.groupBy("b").agg(F.max("total").alias("most"))
    table = pairs.join(F.broadcast(best), "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    n = pairs.count()
    if n > max_sent:
        links = (aligned.select("key", F.explode(F.arrays_zip("codes", "counts")).alias("p"))
                 .select("key", F.col("p.codes").alias("code"), F.col("p.counts").alias("times")))
        found = skew_safe_lookup(links, table, "code", "total", n, pairs.agg(F.sum("total")).first()[0],
                                 max_rows=max(1, max_sent // 4))
        return found.groupBy("key").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    got = table.toArrow()
    order = np.argsort(got.column("code").to_numpy(), kind="stable")
    sent = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy()[order] for c in ("code", "total", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total, is_best = sent.value
        for b in batches:
            lists, times = b.column("codes"), b.column("counts").flatten().to_numpy()
            at = np.searchsorted(code, lists.flatten().to_numpy())
            ends = np.cumsum([0, *(lists.value_lengths().to_numpy())])
            sums = [np.concatenate(([0], np.cumsum(x)))[ends] for x in (times * is_best[at], times * total[at])]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(np.diff(s)) for s in sums)],
                                             ["key", "n_best", "count_sum"])

    return aligned.select("key", "codes", "counts").mapInArrow(run, "key binary, n_best long, count_sum long")


def alignments(docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None,
               max_sent: int = MAX_SENT_PAIRS, max_hot: int = MAX_HOT_TEXTS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module)."""
    aligned, pairs = align_texts(docs, byte_bpe, pieces)
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = (aligned.select("key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                .join(score_links(aligned, pairs, max_sent), "key", "left").na.fill(0, counts))
    rows = docs.select(F.col(ID).alias("doc_id"), F.when(F.col(TEXT) != "", F.unhex(F.sha2(F.col(TEXT), 256))).alias("key"))
    # a text with many copies is one key: those with most copies are broadcast, a bounded number
    size = aligned.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).first()
    least = (size["rows"] or 0) / max_hot if size["n"] > max_hot else 1
    hot = measures.where(F.col("copies") >= least).select("key", F.struct(*counts, "groups_sha256").alias("hot"))
    rows = rows.join(F.broadcast(hot), "key", "left")
    if size["n"] > max_hot:
        cold = measures.where(F.col("copies") < least).select("key", F.struct(*counts, "groups_sha256").alias("cold"))
        rest = rows.where("hot IS NULL AND key IS NOT NULL").drop("hot").join(cold, "key", "left").withColumnRenamed("cold", "hot")
        rows = rows.where("hot IS NOT NULL OR key IS NULL").unionByName(rest)
    return rows.select("doc_id", *(F.coalesce(f"hot.{c}", F.lit(0)).cast("long").alias(c) for c in counts),
                       F.coalesce("hot.groups_sha256", F.lit("")).alias("groups_sha256"))
