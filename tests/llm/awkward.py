"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 4000 + "x" * 5000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "en", "a"),
    (2, "the quick  brown fox\tjumps over the lazy dog near the quiet river bank today.", None, "a"),
    (3, None, "en", "b"),
    (4, "", "de", None),
    (5, " \n\t ", "de", "b"),
    (6, "!!! ... 12345 +++", "fr", "b"),
    (7, LONG, "en", "c"),
    (8, LONG, "en", "c"),
    (9, "Wörter über Straßen und 日本語テキスト \U0001f600 é", "de", "c"),
    (None, "a row without an id", "en", "d"),
    (None, None, None, None),
    (10, "Same text, other row.", "en", "d"),
    (11, "Same text,  other row.", "en", "d"),
    (12, "nul\x00byte and \\ backslash ### <tag>", "en", "d"),
]
#: Names that operators use for what they add.
CLASHES = ("n_words", "digest", "node", "bands", "hits", "spans", "score", "lang_pred", "ids", "kept", "anchor", "base", "text_hash", "shard", "n")


def documents(spark, rows=None):
    own = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, source string")
    return own.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def empty(spark):
    return documents(spark, [])


def texts(rows=ROWS):
    return [(i, t or "") for i, t, _, _ in rows]
