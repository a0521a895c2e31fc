"""Data preparation, statistics, joins, metrics, models and streaming queries.

SRC-*, SNK-*, FLT-1, SMP-*, SRT-3, STA-1/2/3/5, JN-*, SET-*, MET-*, MOD-*, and
the streaming scorer.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import explode_rows
from ..functions.tokens import STOPWORDS, whitespace_tokens, word_tokens
from ..operators import metrics as M
from ..operators import models as ML
from ..operators.ranking import exact_rank
from ..operators.sampling import seeded_shuffle, stratified_sample, train_test_split
from ..operators.vectorizer import standard_vectorizer
from ..session import checkpoint, scratch_path
from ..sources import io as IO
from ..sources.tables import SPLIT_SCHEMA, SourceSpec, first_rows, read_corpus_csv, table
from ..streaming.scorer import read_scores, score_stream
from . import duck as D
from .common import SPLIT_SEED, SQL_SPLIT, documents, entity_vectorizer, sql_weights
from .registry import r6, register

SHUFFLE_SEED = 19178
MODEL_SEED = 12890


def corpus(spark, sf) -> DataFrame:
    """Canonical labelled split table: (doc_id, TARGET, text); the class is the language."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("TARGET"), "text")


def split_corpus(spark, sf) -> DataFrame:
    return train_test_split(corpus(spark, sf), 0.2, SPLIT_SEED)


# --- SRC / SNK ---------------------------------------------------------------------
@register("src1_read_corpus_csv", "SELECT doc_id, lang AS TARGET, text FROM documents")
def src1_read_corpus_csv(spark, sf):
    path = scratch_path(spark, "split-csv")
    IO.write_csv(corpus(spark, sf), path)                       # SNK-1
    return read_corpus_csv(spark, path)                         # SRC-1


@register("src2_first_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def src2_first_rows(spark, sf):
    return first_rows(documents(spark, sf), 100)


@register("src3_latin1_csv", r"""SELECT doc_id, lang AS TARGET, regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') AS text
FROM documents""")
def src3_latin1_csv(spark, sf):
    """Texts with accents and umlauts as ISO-8859-1 bytes (characters it lacks become '?')."""
    path = scratch_path(spark, "latin1-csv")
    IO.write_csv(corpus(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\x00-\xFF]", "?")), path,
                 encoding="ISO-8859-1")
    return read_corpus_csv(spark, path, SPLIT_SCHEMA, encoding="ISO-8859-1")


@register("snk1_partitioned_csv", f"""WITH {SQL_SPLIT}
SELECT doc_id, lang AS TARGET, text, split FROM documents JOIN sp USING (doc_id) WHERE split = 'test'""")
def snk1_partitioned_csv(spark, sf):
    """A corpus stored by split; reading one split opens only its folder."""
    path = scratch_path(spark, "partitioned-csv")
    IO.write_csv(split_corpus(spark, sf), path, partition_by=("split",))
    schema = T.StructType([*SPLIT_SCHEMA.fields, T.StructField("split", T.StringType())])
    return read_corpus_csv(spark, path, schema).where("split = 'test'")


@register("src4_source_spec",
          "SELECT p_partkey AS doc_id, p_brand AS TARGET, p_name || ' \n' || p_type AS text FROM part")
def src4_source_spec(spark, sf):
    spec = SourceSpec("part", ("p_name", "p_type"), "p_brand", id_col="p_partkey")
    return spec.canonical(table(spark, sf, "part"))


STD_SQL = f"""w0 AS (SELECT doc_id, unnest({D.word_tokens('text')}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS cnt FROM w0 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df FROM c GROUP BY term),
vk AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n),
w AS (SELECT doc_id, term, cnt * idf AS w FROM c JOIN vk USING (term)),
std AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w)"""


@register("src5_load_representation", f"""WITH {STD_SQL}
SELECT doc_id, term, weight, lang AS TARGET FROM documents LEFT JOIN std USING (doc_id)""")
def src5_load_representation(spark, sf):
    docs = corpus(spark, sf)
    m = standard_vectorizer().fit(docs)
    weights = m.transform(docs).select("doc_id", "term", r6("weight").alias("weight"))
    path = scratch_path(spark, "representation")
    IO.save_representation(path, weights, docs, m.vocabulary)  # SNK-2, SNK-3
    return IO.read_representation(spark, path)                  # SRC-5


@register("snk3_vocabulary_guard", f"WITH {STD_SQL} SELECT DISTINCT term FROM c")
def snk3_vocabulary_guard(spark, sf):
    """First call stores the vocabulary, the second must find the same terms."""
    docs = documents(spark, sf)
    vocab = standard_vectorizer().fit(docs).vocabulary
    path = scratch_path(spark, "vocabulary")
    IO.validate_or_save_vocabulary(vocab, path)
    return IO.validate_or_save_vocabulary(vocab, path).select("term")


# --- FLT-1 ---------------------------------------------------------------------------
UNDECIDED = "Can't Decide"


@register("flt1_drop_undecided", """SELECT d.doc_id,
  CASE l.quality WHEN 1 THEN 'Relevant' WHEN 0 THEN 'Can''t Decide' END AS TARGET
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE (CASE l.quality WHEN 1 THEN 'Relevant' WHEN 0 THEN 'Can''t Decide' END) IS DISTINCT FROM 'Can''t Decide'""")
def flt1_drop_undecided(spark, sf):
    """Unlabelled documents have a null TARGET and are kept (null-safe test)."""
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    t = F.when(F.col("quality") == 1, F.lit("Relevant")).when(F.col("quality") == 0, F.lit(UNDECIDED))
    j = d.join(lab, "doc_id", "left").select("doc_id", t.alias("TARGET"))
    return j.where(~F.col("TARGET").eqNullSafe(F.lit(UNDECIDED)))


# --- SMP / SRT -------------------------------------------------------------------------
@register("smp1_stratified_sample", f"""SELECT doc_id, TARGET FROM (
  SELECT doc_id, lang AS TARGET, row_number() OVER (PARTITION BY lang
    ORDER BY md5(doc_id::VARCHAR || '-{SPLIT_SEED}'), doc_id) AS rn FROM documents) WHERE rn <= 15""")
def smp1_stratified_sample(spark, sf):
    return stratified_sample(corpus(spark, sf), "TARGET", 15, SPLIT_SEED).select("doc_id", "TARGET")


@register("smp2_train_test_split", f"WITH {SQL_SPLIT} SELECT doc_id, split FROM sp")
def smp2_train_test_split(spark, sf):
    return split_corpus(spark, sf).select("doc_id", "split")


@register("smp3_seeded_shuffle", f"""SELECT doc_id,
  row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-{SHUFFLE_SEED}'), doc_id) - 1 AS shuffle_pos FROM documents""")
def smp3_seeded_shuffle(spark, sf):
    return seeded_shuffle(documents(spark, sf).select("doc_id"), SHUFFLE_SEED)


@register("srt3_sorted_vocabulary", f"""WITH {STD_SQL}
SELECT term, row_number() OVER (ORDER BY term) - 1 AS pos FROM (SELECT DISTINCT term FROM c)""")
def srt3_sorted_vocabulary(spark, sf):
    vocab = standard_vectorizer().fit(documents(spark, sf)).vocabulary.select("term")
    return exact_rank(vocab, ["term"], name="pos").withColumn("pos", F.col("pos") - 1)


# --- STA / JN / SET ---------------------------------------------------------------------
@register("sta1_num_documents", "SELECT count(*) AS n_documents FROM documents")
def sta1_num_documents(spark, sf):
    s = split_corpus(spark, sf)
    both = s.where("split = 'train'").unionByName(s.where("split = 'test'"))   # JN-2
    return both.agg(F.count(F.lit(1)).alias("n_documents"))


@register("sta2_categories", f"""WITH {SQL_SPLIT}
SELECT count(DISTINCT lang) AS n_categories, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories
FROM documents JOIN sp USING (doc_id) WHERE split = 'train'""")
def sta2_categories(spark, sf):
    train = split_corpus(spark, sf).where("split = 'train'")
    cats = train.select("TARGET").distinct()                                  # SET-2
    return cats.agg(F.count(F.lit(1)).alias("n_categories"),
                    F.array_join(F.array_sort(F.collect_list("TARGET")), ",").alias("categories"))


@register("set2_distinct_categories", "SELECT DISTINCT lang AS TARGET FROM documents")
def set2_distinct_categories(spark, sf):
    return corpus(spark, sf).select("TARGET").distinct()


@register("sta3_category_distribution", "SELECT lang AS TARGET, count(*) AS n FROM documents GROUP BY lang")
def sta3_category_distribution(spark, sf):
    s = split_corpus(spark, sf)
    return s.groupBy("TARGET").agg(F.count(F.lit(1)).alias("n"))


@register("jn7_category_counts", f"""WITH {SQL_SPLIT}
SELECT lang AS TARGET, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test, count(*) AS n_total
FROM documents JOIN sp USING (doc_id) GROUP BY lang""")
def jn7_category_counts(spark, sf):
    s = split_corpus(spark, sf)
    return s.groupBy("TARGET").agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        F.count(F.lit(1)).alias("n_total"))


SQL_SPLIT_WORDS = f"""{SQL_SPLIT},
ww AS (SELECT DISTINCT sp.split, unnest({D.word_tokens('d.text')}) AS term
       FROM documents d JOIN sp USING (doc_id)),
tr AS (SELECT term FROM ww WHERE split = 'train'),
te AS (SELECT term FROM ww WHERE split = 'test')"""


@register("set1_vocabulary_difference", f"""WITH {SQL_SPLIT_WORDS}
SELECT term, 'train_only' AS side FROM (SELECT term FROM tr EXCEPT ALL SELECT term FROM te)
UNION ALL SELECT term, 'test_only' FROM (SELECT term FROM te EXCEPT ALL SELECT term FROM tr)""")
def set1_vocabulary_difference(spark, sf):
    s = split_corpus(spark, sf)
    v = standard_vectorizer()
    vocab = {}
    for part in ("train", "test"):
        vocab[part] = v.fit(s.where(F.col("split") == part).select("doc_id", "text")).vocabulary.select("term")
    a = vocab["train"].exceptAll(vocab["test"]).withColumn("side", F.lit("train_only"))
    b = vocab["test"].exceptAll(vocab["train"]).withColumn("side", F.lit("test_only"))
    return a.unionByName(b)


@register("sta5_representation_profile", f"""WITH {SQL_SPLIT},
w0 AS (SELECT doc_id, unnest({D.word_tokens('text')}) AS term FROM documents)
SELECT split, count(DISTINCT doc_id) AS n_rows, count(DISTINCT term) AS n_columns
FROM w0 JOIN sp USING (doc_id) GROUP BY split""")
def sta5_representation_profile(spark, sf):
    s = split_corpus(spark, sf)
    v = standard_vectorizer()
    out = None
    for part in ("train", "test"):
        docs = s.where(F.col("split") == part).select("doc_id", "text")
        c = v.pipeline.counts(v.tagged(docs))
        row = c.agg(F.countDistinct("doc_id").alias("n_rows"), F.countDistinct("term").alias("n_columns")
                    ).select(F.lit(part).alias("split"), "n_rows", "n_columns")
        out = row if out is None else out.unionByName(row)
    return out


@register("jn4_stopword_anti_join", f"""SELECT doc_id, pos, token FROM (
  SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {D.tokens('lower(text)')} AS t FROM documents))
WHERE NOT list_contains({D.STOP_LIST}, token)""")
def jn4_stopword_anti_join(spark, sf):
    """Stop words as a table: left anti join, the (bounded) stop table broadcast."""
    d = documents(spark, sf).select("doc_id", whitespace_tokens(F.lower("text")).alias("t"))
    rows = d.select("doc_id", F.posexplode_outer("t").alias("pos", "token")).where("pos IS NOT NULL")
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "token string")
    return rows.join(F.broadcast(stop), "token", "left_anti").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


# --- metrics inputs ---------------------------------------------------------------------
# fixed values: marker words of the keyword language guess
MARKERS = {"de": ("der", "die", "und", "das"), "en": ("the", "and", "of", "is"),
           "es": ("el", "los", "las", "que"), "fr": ("le", "la", "les", "des")}
CLASSES = tuple(sorted(MARKERS))


def keyword_scores(spark, sf) -> DataFrame:
    """(doc_id, truth, cls, score): marker-word counts per class."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("truth"),
                                             word_tokens(F.col("text")).alias("w"))
    per = F.array(*[F.struct(F.lit(c).alias("cls"), F.size(F.filter("w", lambda x: x.isin(*MARKERS[c])))
                             .cast("double").alias("score")) for c in CLASSES])
    return explode_rows(d, per, "s", "doc_id", "truth").select("doc_id", "truth", "s.cls", "s.score")


def keyword_predictions(spark, sf) -> DataFrame:
    """(doc_id, truth, prediction): the class with most markers, ties to the smallest name."""
    s = keyword_scores(spark, sf)
    idx = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("cls"))
    best = s.groupBy("doc_id", "truth").agg(F.max_by(F.col("cls"), F.struct(F.col("score"), -idx))
                                            .alias("prediction"))
    return best


SQL_KEYWORD = f"""kw AS (SELECT doc_id, lang AS truth, {D.word_tokens('text')} AS w FROM documents),
ks AS (SELECT doc_id, truth, unnest([{', '.join(D.q(c) for c in CLASSES)}]) AS cls,
       unnest([{', '.join(f"len(list_filter(w, lambda x: x IN ({', '.join(D.q(m) for m in MARKERS[c])})))::DOUBLE" for c in CLASSES)}]) AS score
       FROM kw),
kp AS (SELECT doc_id, truth, cls AS prediction FROM (
       SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) AS r FROM ks) WHERE r = 1)"""

SQL_BINARY = """bn AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars::DOUBLE AS score,
       CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS prediction
       FROM labels l JOIN documents d USING (doc_id))"""


def binary_frame(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(d, "doc_id")
    return j.select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("score"),
                    F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction"))


@register("src6_read_predictions", f"WITH {SQL_KEYWORD} SELECT doc_id, prediction FROM kp")
def src6_read_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    IO.write_csv(keyword_predictions(spark, sf).select("doc_id", "prediction"), path)
    return IO.read_predictions(spark, path)


@register("jn5_align_truth_predictions_scores", f"""WITH {SQL_KEYWORD}
SELECT kp.doc_id, kp.truth, kp.prediction, ks.cls, ks.score FROM kp JOIN ks USING (doc_id)""")
def jn5_align_truth_predictions_scores(spark, sf):
    p = keyword_predictions(spark, sf)
    s = keyword_scores(spark, sf).select("doc_id", "cls", "score")
    return p.join(s, "doc_id").select("doc_id", "truth", "prediction", "cls", "score")


@register("met1_binary_precision", f"""WITH {SQL_BINARY}
SELECT round(coalesce(sum(CASE WHEN prediction = 1 AND quality = 1 THEN 1 ELSE 0 END)::DOUBLE
  / nullif(sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END), 0), 0), 6) AS precision FROM bn""")
def met1_binary_precision(spark, sf):
    out = M.binary_precision(binary_frame(spark, sf), "quality", "prediction", 1)
    return out.select(r6("precision").alias("precision"))


@register("met2_macro_precision", f"""WITH {SQL_KEYWORD},
cl AS (SELECT truth AS cls FROM kp UNION SELECT prediction FROM kp),
pc AS (SELECT prediction AS cls, count(*) AS pp, sum(CASE WHEN truth = prediction THEN 1 ELSE 0 END) AS tp
       FROM kp GROUP BY prediction)
SELECT round(avg(coalesce(tp::DOUBLE / nullif(pp, 0), 0)), 6) AS macro_precision FROM cl LEFT JOIN pc USING (cls)""")
def met2_macro_precision(spark, sf):
    out = M.macro_precision(keyword_predictions(spark, sf), "truth", "prediction")
    return out.select(r6("macro_precision").alias("macro_precision"))


def _sql_auc(src: str, truth: str, by: str = "") -> str:
    """Tie-aware AUC from average ranks (Mann-Whitney U)."""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}(sum(CASE WHEN {truth} THEN rk END) - count(*) FILTER (WHERE {truth})
         * (count(*) FILTER (WHERE {truth}) + 1) / 2.0)
       / (count(*) FILTER (WHERE {truth}) * count(*) FILTER (WHERE NOT {truth})) AS roc_auc
FROM (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER ({part}ORDER BY score RANGE BETWEEN
       CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS rk FROM {src}) {grp}"""


@register("met3_roc_auc", f"WITH {SQL_BINARY} SELECT round(roc_auc, 6) AS roc_auc FROM ({_sql_auc('bn', 'quality = 1')})")
def met3_roc_auc(spark, sf):
    out = M.roc_auc(binary_frame(spark, sf), "quality", "score", positive=1)
    return out.select(r6("roc_auc").alias("roc_auc"))


@register("met4_macro_ovr_auc", f"""WITH {SQL_KEYWORD}
SELECT round(avg(roc_auc), 6) AS macro_roc_auc FROM (
  {_sql_auc('(SELECT *, truth = cls AS is_pos FROM ks)', 'is_pos', 'cls')})""")
def met4_macro_ovr_auc(spark, sf):
    out = M.macro_ovr_auc(keyword_scores(spark, sf), "truth", "cls", "score")
    return out.select(r6("macro_roc_auc").alias("macro_roc_auc"))


@register("met5_roc_curve", f"""WITH {SQL_BINARY},
g AS (SELECT score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM bn GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c""")
def met5_roc_curve(spark, sf):
    out = M.roc_curve(binary_frame(spark, sf), "quality", "score", positive=1)
    return out.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("met5_macro_roc_curve", f"""WITH {SQL_KEYWORD},
g AS (SELECT cls, score, sum(CASE WHEN truth = cls THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN truth = cls THEN 0 ELSE 1 END) AS neg FROM ks GROUP BY cls, score),
c AS (SELECT cls, sum(pos) OVER (PARTITION BY cls ORDER BY score DESC) AS tp,
             sum(neg) OVER (PARTITION BY cls ORDER BY score DESC) AS fp,
             sum(pos) OVER (PARTITION BY cls) AS p, sum(neg) OVER (PARTITION BY cls) AS n FROM g),
pts0 AS (SELECT cls, fp / n AS fpr, tp / p AS tpr FROM c UNION ALL SELECT DISTINCT cls, 0.0, 0.0 FROM ks),
pts AS (SELECT cls, fpr, min(tpr) AS tpr_min, max(tpr) AS tpr_max FROM pts0 GROUP BY cls, fpr),
q AS (SELECT cl.cls, xs.x FROM (SELECT DISTINCT cls FROM pts) cl, (SELECT DISTINCT fpr AS x FROM pts) xs),
lo AS (SELECT q.cls, q.x, p.fpr AS x0, p.tpr_max AS y0 FROM q ASOF JOIN pts p ON q.cls = p.cls AND q.x >= p.fpr),
ev AS (SELECT lo.cls, lo.x, CASE WHEN lo.x0 = lo.x THEN lo.y0
              ELSE lo.y0 + (lo.x - lo.x0) * (h.tpr_min - lo.y0) / (h.fpr - lo.x0) END AS y
       FROM lo ASOF LEFT JOIN pts h ON lo.cls = h.cls AND lo.x < h.fpr)
SELECT round(x, 6) AS fpr, round(avg(y), 6) AS tpr FROM ev GROUP BY x""")
def met5_macro_roc_curve(spark, sf):
    """MET-5, multi-class: the macro one-vs-rest ROC curve of the keyword guess."""
    out = M.macro_roc_curve(keyword_scores(spark, sf), "truth", "cls", "score")
    return out.select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("met6_average_precision", f"""WITH {SQL_BINARY},
g AS (SELECT score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM bn GROUP BY score),
c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS p FROM g)
SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM c""")
def met6_average_precision(spark, sf):
    out = M.average_precision(binary_frame(spark, sf), "quality", "score", positive=1)
    return out.select(r6("average_precision").alias("average_precision"))


@register("met7_metric_grid", f"""WITH {SQL_BINARY},
a1 AS ({_sql_auc('bn', 'quality = 1')}),
a2 AS ({_sql_auc('bn', 'toxic = 1')})
SELECT 'documents-length' AS row,
  (SELECT round(roc_auc, 6) FROM a1) AS "quality-roc",
  (SELECT round(coalesce(sum(CASE WHEN prediction = 1 AND quality = 1 THEN 1 ELSE 0 END)::DOUBLE
     / nullif(sum(prediction), 0), 0), 6) FROM bn) AS "quality-pr",
  (SELECT round(roc_auc, 6) FROM a2) AS "toxic-roc",
  (SELECT round(coalesce(sum(CASE WHEN prediction = 1 AND toxic = 1 THEN 1 ELSE 0 END)::DOUBLE
     / nullif(sum(prediction), 0), 0), 6) FROM bn) AS "toxic-pr\"""")
def met7_metric_grid(spark, sf):
    """Long metrics pivoted to one row per (data, classifier), written and read back (SNK-4)."""
    b = binary_frame(spark, sf)
    long = None
    for target in ("quality", "toxic"):
        roc = M.roc_auc(b, target, "score", positive=1).select(
            F.lit(f"{target}-roc").alias("col"), F.col("roc_auc").alias("value"))
        pr = M.binary_precision(b, target, "prediction", 1).select(
            F.lit(f"{target}-pr").alias("col"), F.col("precision").alias("value"))
        part = roc.unionByName(pr)
        long = part if long is None else long.unionByName(part)
    long = long.select(F.lit("documents-length").alias("row"), "col", r6("value").alias("value"))
    grid = M.metric_grid(long, "row", "col", "value")
    path = scratch_path(spark, "metrics")
    IO.save_metrics(grid, path)
    schema = "row string, `quality-pr` double, `quality-roc` double, `toxic-pr` double, `toxic-roc` double"
    return spark.read.schema(schema).option("header", True).csv(path)


# --- MOD ------------------------------------------------------------------------------------
def embeddings_split(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    s = train_test_split(e, 0.2, SPLIT_SEED)
    return s.where("split = 'train'"), s.where("split = 'test'")


SQL_EMB_SPLIT = f"""s0 AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '-{SPLIT_SEED}'), vec_id) AS rn,
       count(*) OVER () AS n_all FROM embeddings),
sp AS (SELECT vec_id, CASE WHEN rn <= ceil(0.2 * n_all) THEN 'test' ELSE 'train' END AS split FROM s0),
ex AS (SELECT vec_id, split, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x
       FROM embeddings JOIN sp USING (vec_id)),
st AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS std FROM ex WHERE split = 'train' GROUP BY i),
z AS (SELECT vec_id, split, label, i, (x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS z
      FROM ex JOIN st USING (i))"""


@register("mod1_standardize", """WITH ex AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
  unnest(embedding)::DOUBLE AS x FROM embeddings),
st AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS std FROM ex GROUP BY i)
SELECT vec_id, i, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS z FROM ex JOIN st USING (i)""")
def mod1_standardize(spark, sf):
    e = table(spark, sf, "embeddings")
    stats = ML.column_stats(e)
    z = ML.standardize_long(e, stats, "vec_id")
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), r6("z").alias("z"))


@register("mod6_balanced_class_weights", """SELECT label, round(sum(n) OVER () / (count(*) OVER () * n), 6)
  AS class_weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def mod6_balanced_class_weights(spark, sf):
    w = ML.balanced_weights(table(spark, sf, "embeddings"), "label")
    return w.select("label", r6("class_weight").alias("class_weight"))


KNN = ML.KnnParams(k=50, p=1, weights="distance")


def _scaled_split(spark, sf):
    train, test = embeddings_split(spark, sf)
    stats = ML.fit_scaler(train)
    return ML.standardize(train, stats), ML.standardize(test, stats)


@register("mod2_knn", f"""WITH {SQL_EMB_SPLIT},
tr AS (SELECT vec_id, label, list(z ORDER BY i) AS v FROM z WHERE split = 'train' GROUP BY vec_id, label),
te AS (SELECT vec_id, list(z ORDER BY i) AS v FROM z WHERE split = 'test' GROUP BY vec_id),
dd AS (SELECT te.vec_id AS q, tr.vec_id AS t, tr.label,
       list_sum(list_transform(list_zip(te.v, tr.v), lambda p: abs(p[1] - p[2]))) AS dist FROM te, tr),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS r FROM dd) WHERE r <= {KNN.k}),
wt AS (SELECT q, label, CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q) = 1
         THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END AS w FROM nn),
vt AS (SELECT q, label, sum(w) AS v FROM wt GROUP BY q, label)
SELECT q AS doc_id, label AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, label) AS r FROM vt) WHERE r = 1""")
def mod2_knn(spark, sf):
    train, test = _scaled_split(spark, sf)
    preds, _ = ML.knn(train, test, KNN, key="doc_id")
    return preds


SQL_EMB_REPORT = f"""WITH s0 AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '-{SPLIT_SEED}'), vec_id) AS rn,
       count(*) OVER () AS n_all FROM embeddings),
lab AS (SELECT vec_id AS doc_id, label, CASE WHEN rn <= ceil(0.2 * n_all) THEN 'test' ELSE 'train' END AS split
        FROM embeddings JOIN s0 USING (vec_id)),
k AS (SELECT count(DISTINCT label) AS n FROM lab WHERE split = 'train')
SELECT doc_id, label, n AS n_scores, TRUE AS well_formed, TRUE AS known, TRUE AS learnt FROM lab, k WHERE split = 'test'"""


def _embedding_model(name: str, kind: str, params: dict, prepare=None):
    """Per test row: class scores well formed, class known, and whether the model learnt its train rows: right on more of
    them than twice the largest class's share (the test labels of ``embeddings`` cannot be told from the vectors)."""
    def q(spark, sf):
        train, test = _scaled_split(spark, sf)
        if prepare:
            train, test = prepare(train), prepare(test)
        weight_col, column = None, "probability"
        if kind == "svc":
            w = ML.balanced_weights(train, "label")
            train, weight_col, column = train.join(F.broadcast(w), "label"), "class_weight", "rawPrediction"   # a row per class
        model = ML.fit_classifier(kind, train, params, weight_col=weight_col)
        out = checkpoint(model.transform(test.withColumn("_fv", ML.as_vector(test, "features"))).select(
            "doc_id", "label", "prediction", vector_to_array(column).alias("s")))
        total = F.aggregate("s", F.lit(0.0), lambda x, y: x + y)
        formed = F.abs(total - 1) < 1e-6 if kind != "svc" else F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x))
        sizes = train.groupBy("label").count()
        largest = sizes.agg((F.max("count") / F.sum("count")).alias("largest"))
        right = model.transform(train.withColumn("_fv", ML.as_vector(train, "features"))).agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))
        known = sizes.select(F.col("label").cast("double").alias("prediction"), F.lit(True).alias("known"))
        return out.join(F.broadcast(known), "prediction", "left").join(F.broadcast(right)).join(F.broadcast(largest)).select(
            "doc_id", "label", F.size("s").cast("long").alias("n_scores"), formed.alias("well_formed"),
            F.coalesce("known", F.lit(False)).alias("known"),
            (F.col("right") > F.least(F.lit(0.9), 2 * F.col("largest"))).alias("learnt"))
    q.__name__ = name
    register(name, SQL_EMB_REPORT)(q)


def _fourier(df):
    return ML.random_fourier_features(df, len(df.select("features").first()[0]))


_embedding_model("mod3_random_forest", "rf", {"n_estimators": 50, "max_features": "sqrt", "random_state": MODEL_SEED})
_embedding_model("mod4_logistic_regression", "log", {"C": 0.01, "random_state": MODEL_SEED})
_embedding_model("mod5_linear_svc", "svc", {"C": 0.01})
_embedding_model("mod5_rbf_svc", "svc", {"C": 0.1}, _fourier)


# --- streaming -------------------------------------------------------------------------------
@register("stream_score_documents", sql_weights("double"))
def stream_score_documents(spark, sf):
    """Fit on the table, then score the same documents arriving as a file stream."""
    docs = documents(spark, sf)
    model = entity_vectorizer("double").fit(docs)
    src = scratch_path(spark, "stream-src")
    files = docs.rdd.getNumPartitions()
    # four batches; a large table arrives in the files it is read in, so that a batch keeps every core busy
    (docs if files > 4 else docs.repartition(4, "doc_id")).write.parquet(src)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    score_stream(spark, model, src, docs.schema, sink, ckpt, max_files_per_trigger=max(1, math.ceil(files / 4)))
    return read_scores(spark, sink).select("doc_id", "term", r6("weight").alias("weight"))
