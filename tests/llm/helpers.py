"""Rows that every operator must answer: nulls, empty and long texts, ties, repeats, odd columns."""

import random

from pyspark.sql import types as T

#: An extra column named as an operator's inner columns or results.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("component_id", T.StringType()),
])


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(vocabulary) for _ in range(n))


def odd_rows():
    long = words(6000, 5, 3000)
    same = words(90, 1)
    near = same.split()
    near[40] = "changed"
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, same), (6, same), (7, " ".join(near)), (8, long), (9, "é中文 naïve ΣΑΣ Straße  x y \x85z 12a"),
        (None, same), (None, None), (5, same), (11, "a" * 3000), (12, "ab" * 900 + words(80, 9)), (13, long + " " + words(150, 77)), (14, words(150, 77)), (15, "The THE the\r\ntwo  spaces"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "n", "s", "c") for i, t in rows], SCHEMA)
