"""Operator 12 against exact scores of every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
from spanfold.llm import bit_sliced_search as bs

from tests.llm.tables import frame, odd_rows, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def naive(docs, queries, k):
    tfs = [(d, Counter(naive_terms(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in queries:
        found = []
        for doc, tf in tfs:
            m = 100 - 25 + (25 * tf.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in naive_terms(text) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, score) for r, (_, _, doc, score) in enumerate(found[:k], 1)]
    return out


def corpus(n=300):
    rng = random.Random(8)
    common = words(rng, 30, 60)
    rows = odd_rows() + [(100 + k, words(rng, rng.choice((3, 20, 90)), 900) + (" " + common if k % 3 else ""), "en", "a", 1)
                         for k in range(n)]
    rows += [(2000 + k, "Copies of ONE text, " + common, "en", "hot", 1) for k in range(150)]
    queries = [(1, common), (2, None), (3, ""), (4, "none of these"), (5, "COPIES one w1x w1x w2x"), (5, "a b"), (None, "w7x"),
               (6, words(rng, 40, 900)), (7, "w7x w8x ! w9x"), (8, "東京 äöü ßé s don t")]
    return rows, queries


def test_rows_equal_exact_ranking(spark):
    rows, queries = corpus()
    items = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS key")
    want = sorted(naive([r[:2] for r in rows], queries, 20), key=repr)
    docs = frame(spark, rows)
    index = bs.build_index(docs)
    got = bs.search(index, docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    again = bs.search(index, docs, items, max_sent=3)                    # texts to score joined by shuffle
    assert sorted(map(tuple, again.collect()), key=repr) == want


def test_queries_in_blocks(spark, monkeypatch):
    rows, queries = corpus(60)
    monkeypatch.setattr(bs, "BLOCK_QUERIES", 3)
    got = bs.rank_documents(frame(spark, rows), spark.createDataFrame(queries, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(naive([r[:2] for r in rows], queries, 5), key=repr)


def test_bounds_hold_and_exclude():
    rng = random.Random(4)
    docs = [Counter(bs.terms_of(words(rng, rng.randrange(1, 400), 3000))) for _ in range(400)]
    total = sum(d.total() for d in docs)
    df = Counter(t.encode() if isinstance(t, str) else t for d in docs for t in d)
    queries = bs.Queries([words(rng, 30, 3000) for _ in range(10)], df, len(docs), total)
    exact = np.array([queries.scores(d, list(range(10))) for d in docs]).T
    bounds = np.zeros_like(exact)
    for m in (4096, 8192):
        for lo in range(0, 400, 256):
            block = bs._Block(m)
            for n, d in enumerate(docs[lo:lo + 256]):
                block.add(b"%d" % n, d.total(), bs.Hashes()(d), np.fromiter(d.values(), np.int64))
            r = block.row()
            bounds[:, lo:lo + 256] = queries.bounds(m, np.array(r["lengths"]), r["bits"])
        assert (bounds >= exact).all()
    least = np.sort(exact, axis=1)[:, -20][:, None]
    assert (bounds >= least).sum() < 0.2 * exact.size                    # most documents are never scored


def test_frequencies_and_totals_of_the_index(spark):
    rows, _ = corpus(50)
    index = bs.build_index(frame(spark, rows))
    tfs = [Counter(naive_terms(r[1])) for r in rows]
    want = Counter(t for c in tfs for t in c)
    got = Counter()
    for r in index.where("terms IS NOT NULL").collect():
        got.update({bytes(t).decode(): n for t, n in zip(r["terms"], r["dfs"])})
    assert got == want
    totals = index.where("n_docs IS NOT NULL").collect()
    assert sum(r["n_docs"] for r in totals) == sum(bool(c) for c in tfs)
    assert sum(r["n_terms"] for r in totals) == sum(c.total() for c in tfs)


def test_empty_tables(spark):
    docs, items = frame(spark, odd_rows()), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert bs.rank_documents(frame(spark, [], clash=False), items).collect() == []
    assert bs.rank_documents(docs, items.limit(0)).collect() == []
