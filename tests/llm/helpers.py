"""Small tables with everything awkward in them."""

LONG = "a long one goes on and on " * 4000
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "src0", 10),
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "src0", 10),
    (2, None, None, None, None),
    (None, "no id but words enough to have some shingles in the text", "en", "src1", 3),
    (None, None, None, None, None),
    (3, "", "de", "src2", 0),
    (4, " \n\t ", "", "", 3),
    (5, LONG, "xx", "src3", len(LONG)),
    (6, "Ünïcödé 日本語 🙂 Привет мир " * 20, "ja", "src4", 5),
]
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def awkward(spark):
    """Repeated rows, nulls in every column, empty and very long texts."""
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, *names):
    """The awkward table with extra columns of the given names."""
    from pyspark.sql import functions as F

    return awkward(spark).withColumns({n: F.lit("clash") for n in names})
