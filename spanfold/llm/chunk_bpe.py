"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts every text where its low bits are
zero, so a passage that several documents share is cut alike in each.  A chunk
met before is not encoded again (a worker process keeps what it met, across
tasks; bounded by bytes, it starts anew beyond the bound).  The ids at a join of two chunks are then repaired: the
text around the join is encoded again between two boundaries that hold in any
context (a single space or line feed between visible characters always starts a
new pre-token), one boundary further out on each side; the outer word on either
side must come out as the chunk had it.  If not, the stretch is widened and
encoded again until both sides agree exactly (at the latest when it is the whole
text).  Decoding joins the tokens' bytes.

A chunk not met before is cut at the same boundaries into units, whose ids in a
row are its ids: a worker keeps the units it has met, too, and asks the library
only for new ones, many in a line.  Joins are always encoded by the library.

Cases: null is an empty text (no ids); repeated texts are chunks met before;
texts without a boundary are encoded as a whole; the end-of-text string in a
text becomes its special id, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, default_tokenizer, load_tokenizer, slices, worker_cache
from .word_ids import MAX_IDS, MAX_WORDS, WordIds

CACHE_BYTES = 128 << 20
WINDOW = 16
#: A space or line feed alone between visible characters (ASCII, or of two bytes from U+00C0 on).
_BREAK = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf]))[ \n](?=[!-~\xc3-\xdf])")
#: A unit behind a boundary and before another one: alone and in a line of such units it has the same ids.
_INNER = re.compile(rb"[ \n](?=[!-~\xc3-\xdf]).*(?:[!-~]|[\xc3-\xdf][\x80-\xbf])", re.DOTALL)
_BYTE = np.arange(256)
_SEEN = (_BYTE >= 0x21) & (_BYTE <= 0x7E)
_LEAD, _TAIL, _SPACE = (_BYTE >= 0xC3) & (_BYTE <= 0xDF), (_BYTE & 0xC0) == 0x80, (_BYTE == 0x20) | (_BYTE == 0x0A)


def _gear() -> np.ndarray:
    """256 fixed pseudo-random 32-bit values."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: sum of gear[data[i - k]] * 2**k over the last 16 bytes (mod 2**32), by doubling."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint32(step))
        step *= 2
    return h


def cut_points(raw: bytes, hashes: np.ndarray, bits: int, least: int) -> list[int]:
    """Chunk ends of one text (the last is its length)."""
    n = len(raw)
    mask = np.uint32(((1 << bits) - 1) << 12)          # bits that all 16 bytes reach
    cuts, last = [], 0
    for i in (np.flatnonzero((hashes[WINDOW:] & mask) == 0) + WINDOW + 1).tolist():
        if i - last >= least and n - i >= least and raw[i] & 0xC0 != 0x80:
            cuts.append(i)
            last = i
    cuts.append(n)
    return cuts


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where the units of several parts in a row begin: the parts' own starts and ``_BREAK`` within them."""
    at = np.flatnonzero(_SPACE[data])
    ends = np.append(starts[1:], len(data))
    part = np.searchsorted(starts, at, "right") - 1
    at = at[(at > starts[part]) & (at + 1 < ends[part])]
    before, after = data[at - 1], data[at + 1]
    seen = _SEEN[before] | (_TAIL[before] & _LEAD[data[np.maximum(at - 2, 0)]])
    return np.union1d(starts, at[seen & (_SEEN[after] | _LEAD[after])])


class UnitIds(WordIds):
    """Ids of parts by their units; keeps and bounds the units met as ``WordIds`` does its words."""

    def __init__(self, tokenizer, size_of: np.ndarray):
        self.tokenizer, self.size_of = tokenizer, size_of
        self._reset()

    def _learn(self, units: list[bytes]) -> None:
        inner, whole = [], []
        for u in units:
            (inner if _INNER.fullmatch(u) else whole).append(u)
        self._one_by_one(whole)
        self._in_lines(inner)

    def _in_lines(self, units: list[bytes], line: int = 500) -> None:
        for k in range(0, len(units), 40 * line):
            lines = [units[j:j + line] for j in range(k, min(len(units), k + 40 * line), line)]
            found = self.tokenizer.encode_batch_fast([b"".join(x).decode("utf-8", "surrogatepass") for x in lines],
                                                     add_special_tokens=False)
            for some, e in zip(lines, found):
                ids = np.array(e.ids, np.uint32)
                reached = np.cumsum(self.size_of[ids])
                ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
                last = np.searchsorted(reached, ends)
                if np.array_equal(reached[last], ends):
                    self._keep(some, ids, last + 1)
                else:
                    self._one_by_one(some)

    def parts(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of every part (none of them empty)."""
        if not parts:
            return []
        if len(self.at) > MAX_WORDS or self.n_ids > MAX_IDS:
            self._thin()
        joined = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts)])
        units = unit_starts(np.frombuffer(joined, np.uint8), starts[:-1])
        bounds = np.append(units, len(joined))
        offsets = pa.py_buffer(bounds.astype(np.int64))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        at = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = [distinct[i] for i in new]
            self._learn(fresh)
            at[new] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        place = found.indices.to_numpy()
        if len(self.at) > len(self.met):
            self.met = np.concatenate((self.met, np.zeros(len(self.at), np.int64)))
        self.met[at] += np.bincount(place, minlength=len(at))
        ids, sizes = self._ids_of(at[place])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(units, starts[:-1])].tolist()
        return [ids[a:b].copy() for a, b in zip(ends, [*ends[1:], len(ids)])]     # no view keeps the others


class ChunkEncoder:
    def __init__(self, path: str, bits: int = 10, least: int = 256):
        self.tokenizer = load_tokenizer(path)
        self.bits, self.least = bits, least
        self.bytes_of = token_bytes(self.tokenizer)
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.units = UnitIds(self.tokenizer, self.size_of)
        self.cache: dict[bytes, np.ndarray] = {}
        self.cached = 0
        self.encoded_bytes = self.reused_bytes = self.repairs = self.widened = 0

    def _library(self, parts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in parts],
                                               add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        chunks, fresh = [], {}
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        joined = np.frombuffer(b"".join(raws), np.uint8)
        hashes = rolling_hash(joined) if len(joined) else np.zeros(0, np.uint32)
        at = 0
        for raw in raws:
            cuts = cut_points(raw, hashes[at:at + len(raw)], self.bits, self.least) if raw else []
            at += len(raw)
            parts = [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
            for p in parts:
                if p in self.cache or p in fresh:
                    self.reused_bytes += len(p)
                else:
                    fresh[p] = None
                    self.encoded_bytes += len(p)
            chunks.append((cuts, parts))
        new = list(fresh)
        for p, ids in zip(new, self.units.parts(new)):
            self.cache[p] = ids
            self.cached += len(p) * 3 + 200
        out: list[np.ndarray | None] = [None] * len(raws)
        todo = []
        for k, (cuts, parts) in enumerate(chunks):
            if len(parts) < 2:
                out[k] = self.cache[parts[0]] if parts else np.zeros(0, np.uint32)
            else:
                todo.append(k)
        reach = dict.fromkeys(todo, 1)
        while todo:
            spans = {k: stretches(raws[k], chunks[k][0], reach[k]) for k in todo}
            again = self._library([raws[k][s[0]:s[3]] for k in todo for s in spans[k]])
            used, rest = 0, []
            for k in todo:
                own = again[used:used + len(spans[k])]
                used += len(own)
                self.repairs += len(own)
                out[k] = self._repaired(chunks[k], spans[k], own, len(raws[k]))
                if out[k] is None:
                    reach[k] *= 4
                    self.widened += 1
                    rest.append(k)
            todo = rest
        return out

    def _repaired(self, chunk: tuple, spans: list, again: list[np.ndarray], size: int) -> np.ndarray | None:
        """Chunk ids with the stretches replaced; None where a stretch's outer words do not agree."""
        cuts, parts = chunk
        ids = np.concatenate([self.cache[p] for p in parts])
        ends = np.cumsum(self.size_of[ids])             # chunk ids' ends in the text
        out, done = [], 0
        for (outer, a, b, last), got in zip(spans, again):
            ours = outer + np.cumsum(self.size_of[got])
            lo, hi = (np.searchsorted(ends, x, "right") for x in (outer, last))
            if (lo and ends[lo - 1] != outer) or (hi and ends[hi - 1] != last) or (outer and not lo):
                return None
            if a > outer:
                i, j = np.searchsorted(ours, a, "right"), np.searchsorted(ends, a, "right")
                if not np.array_equal(got[:i], ids[lo:j]) or i == 0 or ours[i - 1] != a:
                    return None
            if last > b:
                i, j = np.searchsorted(ours, b, "right"), np.searchsorted(ends, b, "right")
                if not np.array_equal(got[i:], ids[j:hi]) or i == 0 or ours[i - 1] != b:
                    return None
            out += [ids[done:lo], got]
            done = hi
        out.append(ids[done:])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size_of[ids]
        at = np.arange(int(size.sum())) + np.repeat(self.start_of[ids] - (np.cumsum(size) - size), size)
        return self.flat[at].tobytes()


def stretches(raw: bytes, cuts: list[int], words: int) -> list[list[int]]:
    """For each join [outer start, start, end, outer end]; overlapping ones are one.

    ``start`` to ``end`` is encoded again; the ``words`` boundaries further out
    on each side must agree.  At a text's end outer and inner are the same.
    """
    out: list[list[int]] = []
    for join in cuts[:-1]:
        left, far = [], 64 * words
        while len(left) < words + 1 and (far < 128 * words * 4096):
            lo = max(0, join - far)
            # the characters around a boundary must lie before the join
            left = [m.start() + lo for m in _BREAK.finditer(raw[lo:join])]
            if lo == 0:
                break
            far *= 8
        right, far = [], 64 * words
        while len(right) < words + 1:
            hi = min(len(raw), join + far)
            right = [m.start() + join for m in _BREAK.finditer(raw[join:hi])]
            if hi == len(raw):
                break
            far *= 8
        a = left[-1] if left else 0
        outer = left[-1 - words] if len(left) > words else 0
        b = right[0] if right else len(raw)
        last = right[words] if len(right) > words else len(raw)
        if not left:
            outer = a
        if not right:
            last = b
        if out and outer < out[-1][3]:
            out[-1][2:] = [b, last]
        else:
            out.append([outer, a, b, last])
    return out


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, by the library's printable stand-ins for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(names[c] for c in token)
    return out


def encode(docs: DataFrame, tokenizer: str | None = None, bits: int = 10, least: int = 256) -> DataFrame:
    """(doc_id, tokens, text_out): the ids of every document and their decoding."""
    return _run(docs, tokenizer, bits, least, "tokens array<int>, text_out binary",
                lambda enc, ids: (ids.astype(np.int32), enc.decode(ids)))


def digests(docs: DataFrame, tokenizer: str | None = None, bits: int = 10, least: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return _run(docs, tokenizer, bits, least, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                lambda enc, ids: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                                  hashlib.sha256(enc.decode(ids)).hexdigest()))


def _run(docs: DataFrame, tokenizer: str | None, bits: int, least: int, fields: str, result) -> DataFrame:
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")
    kinds = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    named = [f.strip().split() for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_cache(("chunks", path, bits, least), lambda: ChunkEncoder(path, bits, least))
        for part, texts in slices(batches):
            rows = list(zip(*(result(enc, ids) for ids in enc.encode(texts))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, kinds[k]) for c, (_, k) in zip(rows, named))],
                ["doc_id", *(n for n, _ in named)])

    kind = docs.schema[ID].dataType.simpleString()
    rows = docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}")
