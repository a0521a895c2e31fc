"""One registered query for each operator, over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bit_sliced_search, chunk_bpe, license_automaton, minimax_shards, partenum, quality_lines, quartile_digest,
               rank_order_langid, semi_crf_pii, sum_of_squares, token_alignment, token_files, toxic_passages)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_left")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minimax_shards.shard(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digests(documents(spark, sf_dir))


def op4_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semi_crf_pii.detect(documents(spark, sf_dir))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_order_langid.identify(documents(spark, sf_dir))


def op6_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_automaton.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.compare_edits(documents(spark, sf_dir))


def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(documents(spark, sf_dir))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_of_squares.pack(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op11_exact_text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(documents(spark, sf_dir))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic_passages.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_words", "n_passages", "evidence")


QUERIES = {f.__name__: f for f in (
    op1_line_frequency, op2_minimax_shards, op3_chunk_bpe, op4_semi_crf_pii, op5_rank_order_langid,
    op6_license_automaton, op7_quartile_digest, op8_partenum_join, op9_sum_of_squares, op10_token_files,
    op11_exact_text_alignment, op12_bit_sliced_search, op13_toxic_passages)}

_LETTERS = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) > 2),
x AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM u),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
m AS (SELECT doc_id, host, text, line,
        {_WORDS.format("regexp_replace(" + _LETTERS.format("line") + ", '[0-9]', '0', 'g')")} AS w
      FROM l),
k AS (SELECT * FROM m WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k GROUP BY doc_id),
n AS (SELECT doc_id, host, text, array_to_string(w, ' ') AS h, sum(len(w)) AS w FROM k GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT coalesce(text, '')) AS n FROM d GROUP BY host),
t AS (SELECT host, h, text, min(doc_id) AS doc FROM n GROUP BY host, h, text),
c AS (SELECT host, h, count(*) AS n, arg_min(text, doc) AS first FROM t GROUP BY host, h HAVING count(*) >= 20),
b AS (SELECT c.* FROM c JOIN hosts USING (host) WHERE c.n > 0.05 * hosts.n),
gone AS (SELECT n.doc_id, count(*) AS n, sum(n.w) AS w FROM n JOIN b USING (host, h) WHERE n.text <> b.first GROUP BY n.doc_id),
f AS (SELECT d.doc_id, len(d.w) AS n_words, list_sum(list_transform(d.w, lambda x: length(x))) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        coalesce(gone.n, 0) AS n_removed_lines, len(d.w) - coalesce(gone.w, 0) AS n_left
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_lines > 0 AND (n_left < 50 OR n_left < 0.5 * n_words)) AS kept,
  n_removed_lines::BIGINT AS n_removed_lines, n_left::BIGINT AS n_left FROM g"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LETTERS.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b AS a, a AS b FROM links),
r AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, e.b FROM r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(_LETTERS.format("coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
total AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM t),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS.format(_LETTERS.format("text"))}) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
k AS (SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM w JOIN df USING (term), total),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS score
      FROM tf JOIN k USING (term), total GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM o WHERE rank <= 20"""

ORACLES = {"op1_line_frequency": OP1_SQL, "op8_partenum_join": OP8_SQL, "op12_bit_sliced_search": OP12_SQL}
