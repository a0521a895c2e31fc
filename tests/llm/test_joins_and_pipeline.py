"""PartEnum join, components and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F
from spanfold.llm import components, partenum, rank_order_langid, semi_crf_pii

from tests.llm.tables import SCHEMA, frame, odd_rows, words

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def slow_components(rows):
    """[(doc_id, set size, component)] by testing every pair."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j > i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def got_components(spark, rows):
    return sorted((tuple(r) for r in partenum.near_duplicates(frame(spark, rows)).collect()), key=repr)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 5, 6, 9, 12, 14, 18, 19, 33, 57, 140, 900):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            n = len(a)
            best = None
            for gone in range(n + 1):                  # the pair that is just similar enough
                more = int(rng.integers(0, n + 1))
                if 100 * (n - gone) >= 80 * (n + more):
                    best = (gone, more)
            gone, more = best or (0, 0)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64))))
            for share in (0.0, 0.3, 0.9, 1.0):         # whatever is called hot
                hot = np.unique(rng.permutation(np.union1d(a, b))[:int(share * (n + more))])
                assert set(partenum.signatures(a, hot).tolist()) & set(partenum.signatures(b, hot).tolist())


def test_components_by_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(12):                                  # families of copies, some edited step by step
        text = words(rng, rng.choice([5, 8, 12, 20, 40, 90, 300]), 3000).split()
        for k in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(text), "en", "a", 1))
            if rng.random() < 0.6:
                text = list(text)
                text[rng.randrange(len(text))] = f"new{len(rows)}"
    passage = words(rng, 60, 3000)
    rows += [(500 + i, f"{words(rng, 40, 3000)} {passage} {words(rng, 60, 3000)}", "en", "a", 1) for i in range(60)]
    rows += [(700 + i, f"{' '.join(passage.split()[:59])} z{i}", "en", "a", 1) for i in range(40)]
    rng.shuffle(rows)
    assert got_components(spark, rows) == slow_components(rows)


def test_components_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got_components(spark, rows) == slow_components(rows)


def test_components_of_odd_rows(spark):
    rows = odd_rows()
    assert got_components(spark, rows) == slow_components(rows)
    assert partenum.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    docs = frame(spark, rows)
    kept = partenum.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "2", "3", "4", "14", "5", "6", "9", "11", "12", "13", "15"] + ["None"] * (
            (None, len(shingles(rows[5][1])), None) in slow_components(rows)))


def test_keep_first_with_null_and_repeated_ids(spark):
    rng = random.Random(19)
    a, b, c, d, e, f = (words(rng, 90, 5000) for _ in range(6))
    rows = [(None, a), (None, b), (None, b + " end"), (None, c), (3, c), (3, c), (7, d), (7, e), (8, e), (5, e),
            (9, f), (9, f), (None, None), (None, ""), (11, None), (11, None)]
    docs = frame(spark, [(*r, "en", "a", 1) for r in rows])
    out = partenum.keep_first(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    of_b = [x for x in got if x in rows[1:3]]
    assert len(of_b) == 1                                    # one row of a component without ids
    assert sorted(got, key=repr) == sorted(
        [(None, a), *of_b, (3, c), (7, d), (5, e), (9, f), (None, None), (None, ""), (11, None), (11, None)], key=repr)
    one = partenum.keep_first(docs.where("doc_id = 3 or text is null or (doc_id is null and text like '%" + c + "%')"))
    assert sorted((r.doc_id or 0, r.text) for r in one.where("text is not null").collect()) == [(3, c)]


def test_star_contraction(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    rng = random.Random(3)
    clean = [(i, words(rng, 150, 4000) + f" reach p{i}.q@mail{i % 9}.example.org now", "en", f"s{i % 3}", 1) for i in range(60)]
    rows = clean + [(100, "1234 5678 " * 60, "en", "s1", 1), (101, None, "en", "s1", 1), (102, "too short", "en", "s1", 1),
                    (103, clean[7][1], "en", "s0", 1), (104, clean[8][1] + " one more word", "en", "s2", 1)]
    docs = frame(spark, rows, clash=False).selectExpr("*", "'x' AS kept")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        ids = {r.doc_id for r in docs.collect()}
        assert set(range(60)) <= ids, name
        if name == "language":
            assert not ids & {100, 101}
        if name == "quality":
            assert 102 not in ids
        if name == "near_duplicates":
            assert not ids & {103, 104}
    assert not any("@" in r.text for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(range(60))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_on_odd_rows_by_definition(spark, tmp_path):
    """Clashing names, nulls, empty and very long texts, ties and repeated rows through all stages."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer
    rng = random.Random(31)
    rows = [(i, words(rng, 120, 3000) + f" call +1 (456) 555-21{10 + i} now", "en", f"s{i % 2}", 1) for i in range(20, 60)]
    rows += [rows[0], (None, rows[1][1], "en", "s1", 1), (77, rows[2][1], None, None, None)] + odd_rows()
    docs, seen = frame(spark, rows), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == frame(spark, rows[:1]).columns, name
            assert len(seen[name][1]) <= len(before) and all(r.n_words == "other" for r in seen[name][1])
    for name in ("language", "near_duplicates"):
        was, now = seen[name]
        assert {(r.doc_id, r.text) for r in now} <= {(r.doc_id, r.text) for r in was}
    assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in seen["language"][1])
    was, now = seen["near_duplicates"]
    parts = {}                                       # by brute force: one row of each component
    for k, _, component in slow_components([(k, r.text) for k, r in enumerate(was)]):
        parts.setdefault(component, []).append(was[k].text)
    assert len(now) == len(parts) and all(sum(r.text in texts for r in now) >= 1 for texts in parts.values())
    assert sorted((r.doc_id for r in seen["personal_data"][1]), key=repr) == sorted((r.doc_id for r in now), key=repr)
    assert not any("555-21" in r.text for r in seen["personal_data"][1])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["personal_data"][1])
    assert sum(r.length for r in seen["packing"][1]) == total


def test_language_stage_rejects_unlearnt_languages_and_letter_junk(spark):
    import corpus_pipeline
    rng = random.Random(23)
    junk = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
        "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
        "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "zxq " * 300,
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(300))]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    docs = real.unionByName(spark.createDataFrame(
        [(10_000_000 + i, t, None, "a", len(t)) for i, t in enumerate(junk)], SCHEMA))
    ids = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()}
    assert not {i for i in ids if i >= 10_000_000}
    assert len(ids) >= 0.99 * real.count()


def test_pipeline_runs_over_the_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()} and len(out) > 50
