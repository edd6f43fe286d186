"""Codes keep the order of values, for every kind of column."""

import datetime

import pytest

from segtable.functions.order_key import code, zorder

VALUES = {
    "long": [None, -(2**63), -5, -1, 0, 1, 7, 2**40, 2**63 - 1],
    "double": [None, float("-inf"), -1e300, -2.5, -1.0, -1e-300, 0.0, 1e-300, 0.5, 1.0, 1.5, 2.0, 1e300, float("inf")],
    "string": [None, "", "a", "ab", "b", "z", "é"],
    "date": [None, datetime.date(1900, 1, 1), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)],
    "boolean": [None, False, True],
}


@pytest.mark.parametrize("kind", VALUES)
def test_order(spark, kind):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES[kind])], f"k int, v {kind}")
    words = zorder([code(F.col("v"), df.schema["v"].dataType)])
    got = [r.k for r in df.select("k", *[w.alias(f"w{i}") for i, w in enumerate(words)]).orderBy(*[f"w{i}" for i in range(len(words))], "k").collect()]
    assert got == list(range(len(VALUES[kind])))


def test_interleaving(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    words = zorder([code(F.col(c), T.LongType()) for c in "xy"])
    got = [(r.x, r.y) for r in df.select("x", "y", *[w.alias(f"w{i}") for i, w in enumerate(words)]).orderBy(*[f"w{i}" for i in range(len(words))]).collect()]
    spread = lambda n: sum((n >> i & 1) << (2 * i) for i in range(8))
    assert got == sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: spread(p[0]) * 2 + spread(p[1]))
