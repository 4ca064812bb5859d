"""Small awkward tables for the operator tests."""

import random

from pyspark.sql import types as T

CLASHING = ["id", "n", "size", "component", "words", "target", "row", "bucket", "hash", "score", "kept", "_kept", "_hit", "_k", "_n", "total"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])


def words(seed, n, pool=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def texts():
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    long_ = words(2, 60_000)
    return [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (3, " ".join(words(3, 120))),
        (4, None), (5, ""), (6, " \t\n "), (7, "two words"), (8, "two words"), (9, "TWO\twords"),
        (10, " ".join(long_)), (11, " ".join(long_[:59_000] + words(4, 1000))),
        (12, " ".join(words(5, 60) + base[:60])), (13, "é\U0001f600 ß " * 30), (13, "é\U0001f600 ß " * 30),
        (None, " ".join(base)), (None, None), (14, "\n".join(["same line here"] * 40 + ["x | y # z"])), (15, "a" * 5000), (16, "a" * 4000 + " end"),
        (17, " ".join(words(6, 200)) + "  double   spaces \n\n and\r\nbreaks "),
    ]


def documents(spark, extra=True):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 3 else f"s{k % 3}", None, *(["x"] * len(CLASHING)))
            for k, (i, t) in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(df):
    return df.where("false")
