"""Cosines of counts without vectors over the words of both sides."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import similarity


def test_cosines_are_those_of_the_vectors(spark):
    draw = random.Random(2)
    side = lambda: draw.choices([*"abcdefg", "é"], k=draw.randrange(0, 12))
    df = spark.createDataFrame([(side(), side()) for _ in range(300)] + [([], ["a"]), (None, ["a"])], "a array<string>, b array<string>").repartition(3)
    v = similarity.feature_vectors(F.col("a"), F.col("b"), "freq")
    got = df.select("a", similarity.count_cosine("a", "b").alias("got"), similarity.vector_cosine(v["x"], v["y"]).alias("want")).collect()
    assert len(got) == 302 and all(r.got == pytest.approx(r.want or 0.0) for r in got)


def test_query_makes_no_vectors(spark):
    plan = queries.QUERIES["t15_m10_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "array_union" not in plan and "count_cosine" in plan
