"""Tables with everything that operators have to bear."""

from pyspark.sql import functions as F

CLASH = ["h", "n", "words", "tid", "sid", "w", "k1", "token", "rep", "__id", "score", "keep", "start", "known"]
LONG = "very long text " * 8000


def odd(spark, more=()):
    """Null ids and texts, empty and long texts, repeated rows, an id with two texts, and columns of clashing names."""
    rows = [(None, "a text without an id 12@x.org", "en", "src1"), (1, None, "en", None), (2, "", None, "src2"), (3, "   \n \n", "de", "src3"), (4, LONG, "fr", "src15"), (5, "Same line here.\nAnother line.", "en", "src1"), (5, "Same line here.\nAnother line.", "en", "src1"), (6, "Same line here.\nA third one.", "en", "src1"), (6, "other text of an id", "es", "src16"), *more]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH))


def empty(spark):
    return odd(spark).limit(0)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
