"""Decoding, distances and digests against their plain definitions."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from spanfold.llm import quartile_digest, rank_order_langid, semi_crf_pii

WINDOWS = ["call +1 (456) 555-2186 or 4111 1111 1111 1111", "a@b.co, 10.20.30.40", "mail bob at site dot org now", "12 345 6789",
           "x 1.2.3.4 y", "4111-1111-1111-1111 / 0049 30 123456", "plain words only"]


def segmentations(segs, n):
    """Every set of candidate segments of which no two overlap."""
    def grow(at):
        if at >= n:
            yield ()
            return
        yield from grow(at + 1)
        for k, (i, j) in enumerate(segs):
            if i == at:
                for rest in grow(j + 1):
                    yield (k, *rest)
    return grow(0)


@pytest.mark.parametrize("text", WINDOWS)
def test_decoding_equals_the_best_of_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    for _ in range(4):
        model = semi_crf_pii.SemiCrf(rng.normal(size=(len(semi_crf_pii.FEATURES), len(semi_crf_pii.KINDS))))
        tokens, segs, feats = model.lattice(text, 0, len(text))
        if len(segs) > 40:
            segs = segs[:40]
        score = model.scores(feats) - 0.3
        best = max(sum(score[k].max() for k in chosen) for chosen in segmentations(segs, len(tokens))) if segs else 0.0
        found = model.best(text, 0, len(text), margin=0.3)
        place = {(tokens[i][0], tokens[j][1]): k for k, (i, j) in enumerate(model.lattice(text, 0, len(text))[1])}
        mine = sum(score[place[a, b], semi_crf_pii.KINDS.index(y)] for a, b, y in found)
        assert mine >= best - 1e-9 and all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
        if len(model.lattice(text, 0, len(text))[1]) <= 40:
            assert math.isclose(mine, best, abs_tol=1e-9)


def test_likelihood_gradient_sums_over_all_segmentations():
    """One step from zero weights: observed less expected feature counts, the expectation over all segmentations and kinds."""
    text = "a@b.co, 10.20.30.40"
    spans = semi_crf_pii.base_spans(text)
    step = semi_crf_pii.SemiCrf.fit([(text, spans)], rounds=1, rate=1.0, ridge=0.0).weights
    tokens, segs, feats = semi_crf_pii.SemiCrf.lattice(text, 0, len(text))
    kinds = len(semi_crf_pii.KINDS)
    ways = [c for c in segmentations(segs, len(tokens))]
    total = sum(kinds ** len(c) for c in ways)
    grad = np.zeros_like(step)
    for k, f in enumerate(feats):
        share = sum(kinds ** len(c) for c in ways if k in c) / total
        grad[f, :] -= share / kinds
    for a, b, y in spans:
        k = next(k for k, (i, j) in enumerate(segs) if (tokens[i][0], tokens[j][1]) == (a, b))
        grad[feats[k], semi_crf_pii.KINDS.index(y)] += 1
    moved = np.abs(grad) > 1e-6
    assert np.array_equal(np.sign(step[moved]), np.sign(grad[moved]))


def naive_profile(texts, top):
    counts = Counter()
    for t in texts:
        counts.update(naive_grams(t))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], place(x[0])))][:top]


def place(gram):
    """The order of n-grams with equal counts: as numbers of 21 bits a letter."""
    return sum(ord(c) << (21 * (len(gram) - 1 - k)) for k, c in enumerate(gram))


def naive_grams(text):
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    padded = " " + " ".join(folded.split()) + " "
    out = Counter(c for c in padded if c != " ")
    for n in (2, 3):
        out.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return out


def test_language_is_the_least_out_of_place_distance(spark):
    rng = random.Random(2)
    words = {"x": ["abra", "kada", "bra", "sim"], "y": ["zorro", "quix", "ote", "ñandú"], "z": ["abra", "zorro", "lim", "bo"]}
    rows = [(k, " ".join(rng.choice(words[c]) for _ in range(30)), c) for k, c in enumerate("xyz" * 8)]
    top = 40
    model = rank_order_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), top=top)
    profiles = {c: naive_profile([t for _, t, lang in rows if lang == c], top) for c in "xyz"}
    for text in ("abra zorro", "quix ote ñandú!", "lim bo, lim", "kada", "7 abra 7"):
        doc = naive_profile([text], top)
        dist = {c: sum(abs(profiles[c].index(g) - r) if g in profiles[c] else top for r, g in enumerate(doc)) for c in "xyz"}
        best = min(sorted(dist), key=dist.get)
        lang, score = model.predict(text)
        assert lang == best and math.isclose(score, 1 - dist[best] / (top * len(doc)))


def naive_digest(text):
    raw = text.encode()
    counts = [0] * 128
    for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 4))):
        for at in range(len(raw) - j):
            key = raw[at] | raw[at + i] << 8 | raw[at + j] << 16 | k << 24
            key ^= key >> 15
            counts[(key * 0x9E3779B1 % 2 ** 32) >> 25] += 1
    order = sorted(counts)
    q = order[31], order[63], order[95]
    codes = [sum(c > x for x in q) for c in counts]
    packed = bytes(sum(codes[4 * b + n] << 2 * n for n in range(4)) for b in range(32))
    return hashlib.sha256(raw).digest()[0], min(255, round(16 * math.log2(len(raw) + 1) / 2)), codes, packed


def test_digest_and_likeness_by_definition():
    rng = random.Random(7)
    texts = ["", "a", "abc", "äöü ß 東京", "x" * 900] + ["".join(rng.choice("abcde fgh\n") for _ in range(rng.randrange(5, 700)))
                                                   for _ in range(25)]
    for t in texts:
        check, length, _, packed = naive_digest(t)
        assert quartile_digest.digest(t) == (bytes([check, length]) + packed).hex()
    for a, b in itertools.combinations(texts[:12], 2):
        (_, la, ca, _), (_, lb, cb, _) = naive_digest(a), naive_digest(b)
        apart = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(ca, cb)) + min(40, abs(la - lb))
        assert math.isclose(quartile_digest.likeness(quartile_digest.digest(a), quartile_digest.digest(b)),
                            1 - min(300, apart) / 300 if a != b else 1.0)
