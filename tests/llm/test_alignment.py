"""Operator 11 against the definition of groups, links and counts, with plain library calls on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanfold.llm import token_alignment
from tests.llm.tables import frame, odd_rows

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD_TEXTS = [" ", "  ", "\n", " \n x", "a", "a ", "a  ", "\ta\t\tb \n\n  c", "x\r\ny\rz", "a b 　 c", "tail\n", "▁x y",
             "<|endoftext|> <s> </s> <unk> <0x0A>", "don't we'll  I'm\n'tis", "東京 は 1,000 円。", "é İstanbul ﬁ ½", "\x00 \x1f a\x0bb",
             "a" * 300 + " " * 40 + "b", "🙂 👩‍👩‍👧 ok", "​ zero ⁠ width﻿"]


def naive_bytes():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(names[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                 for i in ids_b]
        whole = (" " + text).encode()
        return ((ids_a, raw_a), (ids_b, raw_b)) if b"".join(raw_a) == whole == b"".join(raw_b) else None
    return tokens


def in_groups(side, cuts):
    """The side's ids, one list up to each cut."""
    out = [[]]
    for i, _, e in side:
        out[-1].append(str(i))
        if e in cuts:
            out.append([])
    return out[:-1]


def naive(texts):
    """The columns of each text, in order, by spans and nested loops."""
    tokens, out, links_of, total = naive_bytes(), [], [], Counter()
    for text in texts:
        got = tokens(text) if text else None
        if not got:
            out.append([0, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for ids, raws in got:
            ends = np.cumsum([len(r) for r in raws]).tolist()
            spans.append([(i, e - len(r), e) for i, r, e in zip(ids, raws, ends)])
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(ids) for ids in pair)
                  for pair in zip(*(in_groups(side, set(cuts)) for side in spans))]
        links, near = [], 0
        for a, s, e in spans[0]:
            while spans[1][near][2] <= s:
                near += 1
            k = near
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((a, spans[1][k][0]))
                k += 1
        total.update(links)
        links_of.append(links)
        out.append([len(spans[0]), len(spans[1]), len(groups), len(links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()])
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    for row, links in zip(out, links_of):
        row[4:4] = [sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links)]
    return out


@pytest.mark.parametrize("limits", [{}, {"max_sent": 8, "max_hot": 2}])
def test_rows_equal_the_definition(spark, limits):
    rng = random.Random(3)
    drawn = ["".join(rng.choice("ab éß\n\t  .'1東") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = odd_rows() + [(100 + k, t, "en", "a", 1) for k, t in enumerate(ODD_TEXTS + drawn)]
    rows += [(500 + k, "one text with many copies", "en", "hot", 1) for k in range(60)]
    got = token_alignment.alignments(frame(spark, rows), **limits)
    assert got.columns == ["doc_id", *COUNTS]
    want = [(r[0], *w) for r, w in zip(rows, naive([r[1] for r in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_pair_counts_weigh_every_copy(spark):
    texts = ["a b", "a b", "a b", "a c"]
    docs = frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])
    aligned, pairs = token_alignment.align_texts(docs)
    assert {r["copies"] for r in aligned.collect()} == {3, 1}
    assert sorted(r["total"] for r in pairs.collect()) == [1, 3, 4]


def test_units_anew_beyond_the_bound(spark, monkeypatch):
    texts = [f"word{k} other{k}" for k in range(400)]
    a = token_alignment.Aligner(BPE, PIECES)
    monkeypatch.setattr(token_alignment, "MAX_UNITS", 50)
    a.look_up(texts[:100])
    assert a.full
    a._reset()
    units, counts = a.look_up(texts[100:])
    assert counts.tolist() == [2] * 300 and len(a.at) == 600


def test_empty_table(spark):
    assert token_alignment.alignments(frame(spark, [], clash=False)).collect() == []
