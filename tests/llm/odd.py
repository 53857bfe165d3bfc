"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, " \t\n ", "fr", None, 4),
    (6, "short", "fr", None, 5),
    (None, "no id at all", "de", "b", 12),
    (None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG + " tail", "en", "c", len(LONG) + 5),
    (9, "x" * 200_000, "en", "c", 200_000),
    (10, "Éa été <|endoftext|>   　 ok\r\n\r\n😀 \x0b end  ", "fr", "c", 40),
    (11, "ONE Two three four five six seven", "en", "b", 33),
]
#: Names that the operators use themselves.
CLASHES = ["size", "class", "set_id", "component_id", "token", "key", "part", "border", "piece", "length", "rank", "bucket", "copies", "_copies", "taken", "score", "keep", "host", "path", "rule", "verdict", "frame", "file", "start", "_view_text", "id", "v", "bin", "root", "gone", "row"]


def documents(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.select("*", *(F.lit(None).cast("double").alias(c) for c in CLASHES))


def none(spark):
    return documents(spark, [])
