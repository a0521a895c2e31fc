"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, equal texts."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 12) for _ in range(4000))
    plain = words(rng, 80)
    rows = [
        (1, plain, "en", "a", 1), (1, plain, "en", "a", 1),          # a repeated row
        (2, None, "en", "a", 0), (3, "", "de", None, 0), (4, " \n\t ", None, "b", 4),
        (None, "no id here but some words follow " + plain, "en", "b", 9),
        (5, long, "en", "a", len(long)), (6, "aaaa" * 30_000, None, None, None),
        (7, plain, "en", "b", 1), (8, plain + " tail", "en", "b", 1),
        (9, "a b", "en", "a", 3), (10, "a b", "en", "a", 3), (11, "äöü ßé 東京 語", "de", "c", 9),
        (12, "<|endoftext|> x <|startoftext|> ý 'S don't", "en", "c", 1),
        (13, "1.2.3.4 +1 (456) 555-2186 a@b.co 4111 1111 1111 1111, " + "9" * 5000, "en", "c", 1),
        (14, " \x0b\x0c\r\n.,;", "fr", "c", 1), (15, "x" * 70_000 + "@" * 300, "fr", "c", 1),
    ]
    return rows


def frame(spark, rows, clash=True):
    """The rows as documents, with extra columns whose names clash with results and helpers."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("kept", "n_words", "shard", "slot", "score", "lang_pred", "spans", "cid", "part", "tokens",
                     "component_id", "n", "host", "text_crc32", "key", "start", "h", "place", "share", "guest"):
            df = df.selectExpr("*", f"'other' AS {name}")
    return df


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)
