"""Sinks, stored representations and the streaming scorer."""

import pytest

from spanfold.session import scratch_path
from spanfold.sources import io as IO
from spanfold.sources.tables import read_corpus_csv


def test_csv_roundtrip_keeps_text(spark):
    rows = [(1, "a", 'line one\nline "two", with comma'), (2, "b", "  padded  "), (3, None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, TARGET string, text string")
    path = scratch_path(spark, "t-csv")
    IO.write_csv(df, path)
    back = {r.doc_id: (r.TARGET, r.text) for r in read_corpus_csv(spark, path).collect()}
    assert back == {1: ("a", 'line one\nline "two", with comma'), 2: ("b", "  padded  "), 3: (None, "")}


def test_vocabulary_guard(spark):
    path = scratch_path(spark, "t-vocab")
    v1 = spark.createDataFrame([("a",), ("b",)], "term string")
    IO.validate_or_save_vocabulary(v1, path)
    IO.validate_or_save_vocabulary(v1, path)                      # same terms: fine
    v2 = spark.createDataFrame([("a",), ("c",)], "term string")
    IO.validate_or_save_vocabulary(v2, path, shape_only=True)     # same size: fine in shape mode
    with pytest.raises(AssertionError):
        IO.validate_or_save_vocabulary(v2, path)


def test_splits_share_a_vocabulary(spark):
    path = scratch_path(spark, "t-rep")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "term string, feature_idx int")
    targets = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, TARGET string")
    weights = spark.createDataFrame([(1, "a", 0.5)], "doc_id bigint, term string, weight double")
    for split in ("train", "test"):
        IO.save_representation(path, weights, targets, vocab, split=split)
    rows = {tuple(r) for r in IO.read_representation(spark, path, "test").collect()}
    assert rows == {(1, "a", 0.5, "x"), (2, None, None, "y")}     # a document without terms stays
    assert spark.read.parquet(f"{path}/vocabulary").columns == ["term", "feature_idx"]
    other = spark.createDataFrame([("a", 0), ("c", 1)], "term string, feature_idx int")
    with pytest.raises(AssertionError):
        IO.save_representation(path, weights, targets, other, split="dev")
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/dev/weights")                 # refused before anything is written


def test_scale_conf_keeps_partitions_small():
    from spanfold.session import scale_conf
    size = 100 * 10 ** 12
    n = int(scale_conf(size, executors=1000)["spark.sql.shuffle.partitions"])
    assert size / n <= 256 * 1024 ** 2
    assert int(scale_conf(1, executors=10)["spark.sql.shuffle.partitions"]) == 80


def test_stream_scores_equal_batch_transform(spark):
    from spanfold.functions.text import CLEANER
    from spanfold.operators.tagging import ShapeTagger
    from spanfold.operators.vectorizer import NerVectorizer, builtin_token_filter
    from spanfold.streaming.scorer import read_scores, score_stream
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = NerVectorizer(tagger=ShapeTagger(), preprocessor=CLEANER, token_filter=builtin_token_filter).fit(docs)
    src = scratch_path(spark, "t-src")
    docs.repartition(3, "doc_id").write.parquet(src)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    score_stream(spark, model, src, docs.schema, sink, ckpt)
    got = {(r.doc_id, r.term): round(r.weight, 9) for r in read_scores(spark, sink).collect()}
    exp = {(r.doc_id, r.term): round(r.weight, 9) for r in model.transform(docs).collect()}
    assert got == exp


def test_stored_weights_stay_in_place(spark, tmp_path):
    """Reading a representation back shuffles distinct terms and ids only, and keeps documents without weights."""
    path = str(tmp_path / "kept")
    weights = spark.createDataFrame([(1, "a", .5), (1, "b", .5), (2, "a", 1.)], "doc_id long, term string, weight double")
    targets = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "z")], "doc_id long, TARGET string")
    IO.save_representation(path, weights, targets, weights.select("term").distinct())
    df = IO.read_representation(spark, path)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [
        (1, "a", .5, "x"), (1, "b", .5, "x"), (2, "a", 1., None), (3, None, None, "y"), (None, None, None, "z")]))
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(9, "a", 1.)], "doc_id long, term string, weight double").write.mode("append").parquet(f"{path}/weights")
    with pytest.raises(AssertionError):
        IO.read_representation(spark, path)


def test_a_large_table_arrives_in_as_many_files_as_it_is_read(spark, monkeypatch):
    """Batches of several files, no shuffle of the texts into four; the scores are those of the batch query."""
    import glob

    from spanfold.plans import q_data, q_vectors
    real, seen = q_data.score_stream, {}

    def score(spark, model, src, schema, sink, ckpt, **kw):
        seen.update(files=len(glob.glob(f"{src.removeprefix('file:')}/*.parquet")), **kw)
        real(spark, model, src, schema, sink, ckpt, **kw)
        seen["batches"] = len(glob.glob(f"{sink.removeprefix('file:')}/batch_id=*"))
    docs = spark.createDataFrame([(d, f"Paris river stone {'word' + str(d % 5)} NATO") for d in range(45)], "doc_id long, text string").repartition(9)
    monkeypatch.setattr(q_data, "score_stream", score)
    for q in (q_data, q_vectors):
        monkeypatch.setattr(q, "documents", lambda spark, sf: docs)
    got = {(r["doc_id"], r["term"], r["weight"]) for r in q_data.stream_score_documents(spark, "").collect()}
    assert seen == {"files": 9, "max_files_per_trigger": 3, "batches": 3}
    assert got == {(r["doc_id"], r["term"], r["weight"]) for r in q_vectors.tfw2_double_weights(spark, "").collect()}
