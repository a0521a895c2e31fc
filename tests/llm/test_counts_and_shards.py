"""Line frequency, sharding, language ID."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import pytest
from spanfold.llm import minimax_shards, quality_lines, rank_order_langid

from tests.llm.tables import SCHEMA, frame, odd_rows, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measure(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_base_counts_by_definition(spark):
    rows = odd_rows() + [(20, "a b c a b c a b c d\na b c\n a b c\n\n#$<x>|", "en", "a", 1)]
    out = quality_lines.judge(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((r[0], *slow_measure(r[1])) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_common_lines_go_but_their_first_text_stays(spark):
    rng = random.Random(3)
    menu = "Home | About | Contact 2024 " + words(rng, 40, 5000)
    rows = []
    for i in range(60):
        body = words(rng, 120, 5000) if i % 3 else words(rng, 20, 5000)
        rows.append((i, f"{menu.upper() if i % 2 else menu}\n{body}", "en", "hot" if i < 40 else "cold", 1))
    rows += [(100 + i, rows[1][1], "en", "hot", 1) for i in range(30)]           # copies count once
    limits = dict(min_docs=25, max_share=0.3)
    out = {r.doc_id: r for r in quality_lines.judge(spark.createDataFrame(rows, SCHEMA), **limits).collect()}
    assert out[0].kept and out[0].n_removed_lines == 0                            # first holder in "hot"
    assert all(out[i].n_removed_lines == 1 for i in range(1, 40))
    assert all(out[i].n_removed_lines == 0 for i in range(40, 60))               # 20 documents: under the limit
    assert all(out[i].kept == (i % 3 != 0) for i in range(1, 40))                # 20 words left: depleted
    cleaned = {r.doc_id: r for r in quality_lines.clean(frame(spark, rows), **limits).collect()}
    assert cleaned[1].text == rows[1][1].split("\n")[1] and cleaned[1].n_chars == len(cleaned[1].text)
    assert 3 not in cleaned and cleaned[41].text == rows[41][1]


def test_a_long_line_goes_from_a_large_host_by_its_count(spark):
    import corpus_pipeline
    rng = random.Random(29)
    notice = words(rng, 12, 5000)
    pair = "read more\nread more\nread more\nread more\nread more"           # ten words, but two in a line
    rows = [(i, words(rng, 60, 5000) + (f"\n{notice}" if i < 300 else "") + (f"\n{pair}" if 300 <= i < 340 else ""),
             "en", "hot" if i < 7000 else f"s{i % 5}", 1) for i in range(21_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert sum(notice in t for t in out.values()) == 1 and notice in out[0]       # 4.3 % of the host
    assert all(out[i] == rows[i][1] for i in range(300, 21_000))
    assert len(out) == len(rows)


def test_clean_keeps_rows_and_columns(spark):
    docs = frame(spark, odd_rows())
    out = quality_lines.clean(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "1", "5", "7", "8", "None"])
    assert quality_lines.judge(docs.limit(0)).count() == 0 and quality_lines.clean(docs.limit(0)).count() == 0


# --- sharding -------------------------------------------------------------------------

def slow_cuts(sizes, k):
    def greedy(cap):
        out, used, n = [], 0, 0
        for s in sizes:
            if used + s > cap:
                n, used = n + 1, 0
            out.append(n)
            used += s
        return out

    lo, hi = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(mid)[-1] < k:
            hi = mid
        else:
            lo = mid + 1
    return greedy(lo)


@pytest.mark.parametrize("buckets", [8, 1 << 16])
def test_cuts_are_the_smallest_capacity(spark, buckets):
    rng = random.Random(buckets)
    for k, sizes in ((40, [rng.randrange(16, 900) for _ in range(700)]), (7, [5000] + [16] * 300 + [4000, 100]),
                     (40, [20] * 10), (3, [1 << 40, 1 << 41, 1 << 20, 77])):
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        got = minimax_shards.minimax_cuts(spark.createDataFrame(ends, "cum long"), k, at, max(sizes), buckets)
        assert [sum(c < e for c in got) for (e,) in ends] == slow_cuts(sizes, k)


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in minimax_shards.shard(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    groups = sorted(first, key=first.get)
    sizes = [sum(len(t.encode()) + 16 for t in texts.values() if t == g) for g in groups]
    shard = dict(zip(groups, slow_cuts(sizes, 40)))
    assert {d: r.shard for d, r in out.items()} == {d: shard[t] for d, t in texts.items()}
    for d, r in out.items():
        assert r.size == len(texts[d].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[d].encode())
    for s in range(40):
        slots = sorted(r.slot for r in out.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_rows(spark):
    rows = odd_rows()
    out = minimax_shards.shard(frame(spark, rows), shards=4).collect()
    assert len(out) == len(rows)
    of = {}
    for r in out:
        of.setdefault(r.text_crc32, set()).add(r.shard)
        assert 0 <= r.shard < 4
    assert all(len(s) == 1 for s in of.values())
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert minimax_shards.shard(frame(spark, rows).limit(0)).count() == 0


# --- language ID ------------------------------------------------------------------------

def test_gram_counts_by_definition():
    for text in ("Ab, ab!", "a", "...a", "é É  x1y", "ab" * 50 + "?"):
        norm = " " + re.sub(r"[^a-zé]+", " ", text.lower()).strip() + " "
        if not text[0].isalpha():
            norm = norm if norm.startswith(" ") else " " + norm
        want = Counter(norm[i:i + n] for n in (1, 2, 3) for i in range(len(norm) - n + 1))
        del want[" "]
        grams, counts = rank_order_langid.gram_counts(text)
        back = {}
        for g, c in zip(grams.tolist(), counts.tolist()):
            s = ""
            while g:
                s = chr(g & 0x1FFFFF) + s
                g >>= 21
            back[s] = c
        assert back == dict(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = rank_order_langid.identify(docs).collect()
    assert len(out) == len(lang)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.95 * len(test)


def test_language_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    out = rank_order_langid.identify(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    assert rank_order_langid.identify(docs.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, None, None)], SCHEMA)
    assert rank_order_langid.identify(unlabelled).first().lang_pred == "und"


def test_profiles_and_least_scores_use_every_labelled_row(spark):
    """Grams found in one of many rows are in the profile, and the rows of a low score weigh in at their share."""
    rows = [(k, "ab" if k % 300 else "z" + "qwxvu"[k // 300], "xx") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = rank_order_langid.learn(docs)
    a, z = ord("a"), ord("z")
    rank = dict(zip(profiles.grams.tolist(), profiles.ranks[0].tolist()))
    assert rank[a] < rank[z] < profiles.top and len(rank) == 7 + 2 + 5 * 5
    own = [r["score"] for r in rank_order_langid.predict(docs, profiles).where("lang = lang_pred").collect()]
    low, mid = np.percentile(np.round(own, 6), [1, 50])
    got = rank_order_langid.least_scores(docs, profiles)
    assert abs(got["xx"] - (low - max(0.05, mid - low))) < 1e-9
