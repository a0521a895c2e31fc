"""Token ids of texts with the word-level BPE file, one library call for many new words.

The tokenizer's normalizer and pre-tokenizer never look across white space, so
the ids of a text are those of its white-space separated words in a row.  A
worker keeps the ids of the words it has met (bounded; beyond the bound it
starts anew with those met more than once) and asks the library only for new ones.  New words of letters are
sent many at a time, in a line: each ends with exactly one word-end token.  A
word of letters before closing marks has the ids of both (a change from
letters to marks starts a new pre-token) where its letters are still letters
after the normalizer: it turns some into a letter and a combining mark, which
joins the marks behind it.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, load_tokenizer, worker_cache

MAX_WORDS = 500_000
MAX_IDS = 6_000_000
MARKS = b".,!?;:"
_OLD = unicodedata.ucd_3_2_0


def _letters(norm: str) -> bool:
    norm = "".join(c.lower() for c in unicodedata.normalize("NFC", norm))
    return norm.isalpha() and all(_OLD.category(c)[0] == "L" for c in norm)


#: Latin, Greek and Cyrillic letters that stay letters one by one (nothing among them composes).
_PLAIN = re.compile("[a-zA-Z" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x530)) if _letters(c)) + "]+")


def letters_only(stem: bytes) -> bool:
    """Whether the normalizer's form of the stem is all letters, whatever Unicode version the library knows."""
    if stem.isascii():
        return stem.isalpha()
    text = stem.decode("utf-8", "surrogatepass")
    return bool(_PLAIN.fullmatch(text)) or _letters(text)


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.is_end[i] = token.endswith("</w>")
        self._reset()

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """The worker process's own instance: later tasks find the words of earlier ones."""
        return worker_cache(("word ids", path), lambda: cls(path))

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)      # ends[k]: end of word k's ids
        self.n_ids = 0
        self.met = np.zeros(1 << 16, np.int64)       # how often each word was met

    def _thin(self) -> None:
        """Starts anew with the words met more than once (with none if these are too many, too)."""
        often = np.flatnonzero(self.met > 1)
        ids, sizes = self._ids_of(often)
        keep = np.zeros(len(self.at), bool)
        keep[often] = True
        words = [w for w, kept in zip(self.at, keep.tolist()) if kept]     # in the order of their numbers
        self._reset()
        if len(words) <= MAX_WORDS // 2 and len(ids) <= MAX_IDS // 2:
            self._keep(words, ids, np.cumsum(sizes))
        give_back()

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        first = len(self.at)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.ends[first + 1:first + 1 + len(words)] = self.n_ids + ends
        self.n_ids += len(ids)
        self.at.update(zip(words, range(first, first + len(words))))

    def _one_by_one(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 10_000):
            some = words[k:k + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(some, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), np.cumsum(sizes))

    def _in_lines(self, words: list[bytes], line: int = 500) -> None:
        for k in range(0, len(words), 40 * line):
            lines = [words[j:j + line] for j in range(k, min(len(words), k + 40 * line), line)]
            found = self.tokenizer.encode_batch_fast([b" ".join(x).decode("utf-8") for x in lines],
                                                     add_special_tokens=False)
            for some, e in zip(lines, found):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.is_end[ids]) + 1
                if len(ends) == len(some):
                    self._keep(some, ids, ends)
                else:                                # some word's lower case is more than letters
                    self._one_by_one(some)

    def _learn(self, words: set[bytes]) -> None:
        plain, whole, split = set(), [], []
        for w in words:
            if w.isalpha():
                plain.add(w)
                continue
            stem = w.rstrip(MARKS)
            if not stem or not letters_only(stem):
                whole.append(w)
            elif len(stem) == len(w):
                plain.add(w)
            else:
                split.append((w, stem, w[len(stem):]))
                if stem not in self.at:
                    plain.add(stem)
        marks = {m for _, _, m in split if m not in self.at}
        self._one_by_one([*whole, *marks.difference(whole)])
        self._in_lines(list(plain))
        if split:
            a = np.fromiter((self.at[s] for _, s, _ in split), np.int64, len(split))
            b = np.fromiter((self.at[m] for _, _, m in split), np.int64, len(split))
            both = np.stack((a, b), axis=1).ravel()
            ids, sizes = self._ids_of(both)
            self._keep([w for w, _, _ in split], ids, np.cumsum(sizes)[1::2])

    def _ids_of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.ends[k], self.ends[k + 1] - self.ends[k]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.ids[shift + np.arange(len(shift))], size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every whole text (null: none), as 32-bit integers."""
        ids, sizes = self.encode_flat(texts)
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_flat(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text), with ``end_id`` behind each text where given."""
        return self.encode_column(pa.array(texts, pa.string()), end_id)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` of an Arrow column: it is split and its distinct words are found in Arrow."""
        if len(self.at) > MAX_WORDS or self.n_ids > MAX_IDS:
            self._thin()
        texts = pc.fill_null(texts, "")
        # the normalizer lower-cases all but special tokens, and composes first: A-Z stay as they are
        # where a mark of U+0300 to U+037F (lead bytes CC, CD) may compose with them
        raw = texts.cast(pa.binary())
        whole = pc.match_substring(raw, b"<|")
        for lead in (b"\xcc", b"\xcd"):
            whole = pc.or_(whole, pc.match_substring(raw, lead))
        lists = pc.ascii_split_whitespace(pc.if_else(whole, texts, pc.ascii_lower(texts)))
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary()).to_pylist()
        if b"" not in self.at:                       # white space at a text's ends gives empty words: no ids
            self._keep([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = [words[i] for i in new]
            self._learn(set(fresh))
            at[new] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        place = found.indices.to_numpy().astype(np.int64)
        del raw, whole, lists, found
        if len(at):
            times = np.bincount(place, minlength=len(at))
            if len(self.at) > len(self.met):
                self.met = np.concatenate((self.met, np.zeros(len(self.at), np.int64)))
            self.met[at] += times
        k = at[place]
        if end_id is not None:                       # the end id is a word of its own, which no text can hold
            end = b" %d" % end_id
            if end not in self.at:
                self._keep([end], np.array([end_id], np.uint32), np.ones(1, np.int64))
            counts = counts + 1
            with_ends = np.full(int(counts.sum()), self.at[end], np.int64)
            inside = np.ones(len(with_ends), bool)
            inside[np.cumsum(counts) - 1] = False
            with_ends[inside] = k
            k = with_ends
        ids, sizes = self._ids_of(k)
        pa.default_memory_pool().release_unused()    # else the pool keeps what the column's pieces took
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))])
