"""Documents with the odd cases that every operator must take."""

from pyspark.sql import types as T

LONG = "word " * 3000 + "end"
BASE = "the quick brown fox jumps over the lazy dog while nobody is looking at it"
ROWS = [
    (1, f"{BASE}\nsecond line of the first text", "en", "a", 0),
    (2, f"  {BASE.upper()}\t\nanother line", "en", "a", 0),
    (3, BASE, "en", "a", 0),
    (4, BASE, "en", "a", 0),
    (5, "", "en", None, 0),
    (6, None, None, None, None),
    (7, LONG, "de", "b", 0),
    (8, "\n\n \t\n", "de", "b", 0),
    (9, "déjà vu ### 12345 🙂 naïve", "fr", "b", 0),
    (10, "a\nb\r\nc", "fr", "b", 0),
    (11, LONG, "de", "b", 0),
    (12, "one", "de", "b", 0),
    (12, "one", "de", "b", 0),
    (None, "a text without an id", "de", "b", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra=()):
    """The rows, with extra null columns of the given names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"cast(null as string) as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def schema_of(ddl):
    return T._parse_datatype_string(ddl)
