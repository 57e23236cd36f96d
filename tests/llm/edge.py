"""Awkward rows that every operator has to take."""

from pyspark.sql import functions as F

CLASH = ["id", "n", "key", "word", "row", "a", "b", "tile", "host", "length", "rank", "digest", "size", "fold", "part", "root"]


def clashing(df):
    """The frame with further columns whose names the operators use inside."""
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def documents(spark):
    long_text = " ".join(f"word{k % 977} und{k % 31}" for k in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood"
    rows = [
        (1, prose, "en", "s"), (2, prose, "en", "s"), (2, prose, "en", "s"), (3, None, "en", None), (4, "", None, "s"),
        (5, " \n\t ", "de", "s"), (6, long_text, "de", "t"), (7, "x" * 200_000, None, "t"), (None, prose, "en", "s"),
        (None, None, None, None), (8, "one two", "fr", "s"), (9, "One TWO", "fr", "s"), (10, "12 34 !?", "fr", "u"),
        (11, "<|endoftext|>  a \n b", "en", "u"), (12, "naïve café ☃   end", "fr", "u"),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def none(spark):
    return documents(spark).limit(0)
