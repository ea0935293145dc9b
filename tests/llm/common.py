"""Small tables with the cases every operator must stand."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
LONG = "alpha beta gamma delta " * 5000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, 0.5, "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1, None, None),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1, None, None),
    (3, None, "en", None, None, None, None),
    (4, "", None, "b", 0, None, None),
    (5, " \t\n", "de", "b", 3, None, None),
    (None, "ein kleines Haus steht dort drüben am Fluss", "de", "b", 1, None, None),
    (6, LONG, "en", "a", 1, None, None),
    (7, "x" * 5000, None, "c", 1, None, None),
    (8, "12 34 !! ??", "de", "c", 1, None, None),
    (9, "one", "en", "c", 1, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("v", T.StringType())])
    return spark.createDataFrame([(i, v, "s", "v") for i, v in rows], schema)
