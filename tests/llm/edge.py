"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with internal ones."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 997} and{k % 13}." for k in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch from the edge of the quiet forest and wait " * 4
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, PROSE, "en", "a", 10), (2, PROSE.upper(), "en", "a", 10), (3, PROSE + "one more word", None, "a", 10), (4, "", "en", None, 0), (5, None, "en", "b", None), (6, " \t\n ", "de", "b", 3),
    (7, "a b", "de", "b", 3), (8, "a  b", "de", "b", 4), (9, "ab", "de", "b", 2), (10, LONG, "en", "a", 1), (11, "Ünïcödé # $ % — ok!\nline\nline\n", "fr", "c", 1), (12, "x y z w", "fr", "c", 1),
    (13, "x\x1cy\x85z\xa0w", "fr", "c", 1), (14, "X Y Z W", "fr", "c", 1),
]
REPEATED = [*ROWS, ROWS[0], ROWS[0], ROWS[3], (None, "no id here", "en", "a", 1), (None, "no id here", "en", "a", 1), (None, None, None, None, None)]


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("rk", "row", "digest", "n", "key", "rep", "label", "kept", "piece", "length", "block", "word", "x0", "g0"):
            df = df.withColumn(c, F.lit("clash"))
    return df
