"""Plans that read or shuffle what they need once."""

import re

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import similarity, text
from lectern.operators import rouge, select

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cosine_of_pairs_without_a_join_on_words(spark):
    tokens = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "a"), ("q", "c"), ("r", "d")], "item string, w string")
    counted = spark.createDataFrame([("p", "a", 2), ("p", "b", 1), ("q", "a", 1), ("q", "c", 1), ("r", "d", 1)], "item string, w string, n long")
    idf = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "w string, idf double")
    pairs = spark.createDataFrame([("p", "q", 1), ("p", "q", 2), ("p", "r", 3), ("p", "none", 4), ("none", "none", 5), ("p", "p", 6)], "x string, y string, k int").repartition(3)
    for words in (tokens, counted):
        out = similarity.idf_cosine(pairs, words, idf)
        got = {r.k: r.cosine for r in out.collect()}
        want = 2 / (8**0.5 * 10**0.5)
        assert got == {1: pytest.approx(want), 2: pytest.approx(want), 3: 0.0, 4: 0.0, 5: 0.0, 6: pytest.approx(1.0)}
        assert not re.search(r"hashpartitioning\((x|y)#\d+, w#", plan(out))


def test_words_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (None,)], "t array<string>").select("t", text.word_counts(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c or []] for r in rows] == [[("a", 1), ("b", 2)], [], [("x", 1)], []]


def test_preferences_and_extracts_read_the_scores_once(spark):
    once = plan(queries._scored(spark, SF)).count("Scan ExistingRDD")
    for name in ("r8_r11_preferences", "r9_r10_preferences"):
        assert plan(queries.QUERIES[name](spark, SF)).count("Scan ExistingRDD") == once
    assert "FileScan" not in plan(queries.QUERIES["v1_v2_precision_recall"](spark, SF))


def test_preferences_equal_single_ones(spark):
    c = spark.createDataFrame([("c", 1, 1, 1.0), ("c", 2, 1, 2.0), ("d", 3, 1, 3.0)], "cluster string, did long, sno int, score double")
    values = spark.createDataFrame([(1, 4), (2, 8)], "did long, value long")
    out = select.preferences(c, {"v": values}, [("up", "v", 1, False), ("down", "v", -1, True)])
    for name, sign, norm in (("up", 1, False), ("down", -1, True)):
        single = {r.did: r.score for r in select.prefer(c, values, sign, norm).collect()}
        assert {r.did: r[name] for r in out.collect()} == single
    assert {r.did: r.down for r in out.collect()} == {1: 1.0, 2: 1.0, 3: 3.0}


def test_basic_elements_of_no_model_are_not_shuffled(spark):
    """99 of 100 elements of each peer are its own: only counts and the one that a model has go through the exchange."""
    peers = spark.range(20).select((F.col("id") % 2).alias("eval"), F.col("id").alias("peer"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    peers = peers.select("eval", "peer", F.when(F.col("k") == 0, "both").otherwise(F.concat_ws("|", "peer", "k")).alias("be"))
    models = spark.createDataFrame([(0, 7, "both"), (0, 7, "other"), (0, 8, None), (1, 9, "both")], "eval long, model long, be string")
    out = rouge.basic_elements(peers, models)
    got = {r.peer: (r.hits, r.n_peer, r.n_model) for r in out.collect()}
    assert got == {i: (1, 100, 1 if i % 2 else 2) for i in range(20)}
    moved = [r for r in re.findall(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[partial_count", plan(out)) if "be#" in r and "peer#" in r]
    assert moved and "LeftSemi" in plan(out)
