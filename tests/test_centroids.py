"""Centroid values and the greedy choice made where a cluster's row is read, against the joins."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.similarity import idf_table
from lectern.operators import centroids, features, select
from lectern.plans import summarizer

KIND = "cluster string, did long, sno int, text string"


def made(spark, docs=60, seed=3):
    draw = random.Random(seed)
    words = [*"abcdefgh", "é", "ß", "日本", *(f"w{i}" for i in range(150))]
    text = lambda: " ".join(draw.choices(words, k=draw.randrange(0, 25))) if draw.random() > 0.1 else "..."
    rows = [(f"c{d % 7}", d, s, text()) for d in range(docs) for s in range(1, draw.randrange(2, 9))]
    return spark.createDataFrame([*rows, ("c0", 0, 1, "a a w1")], KIND)  # a second row of one number


def by_joins(s):
    words = features.counted_words(s).cache()
    return {(r.did, r.sno): r.value for r in features.centroid(s, idf_table(words), words).collect()}


@pytest.mark.parametrize("most", [1 << 24, 1])
def test_values_are_those_of_the_joins(spark, monkeypatch, most):
    monkeypatch.setattr(centroids, "WORDS", most)
    s = made(spark)
    new = centroids.with_centroid(s)
    if most == 1:  # words that do not fit are left to the joins
        assert new is None
    else:
        want, got = by_joins(s), new.collect()
        assert len(got) == s.count() and max(want.values()) == 1
        assert all(abs(want[r.did, r.sno] - r.Centroid) < 1e-12 for r in got)
    scores = summarizer.Summarizer().scores(s)
    assert {(r.did, r.sno) for r in scores.collect()} == {(r.did, r.sno) for r in s.collect()}


def test_what_takes_joins_is_left_to_them(spark, monkeypatch):
    rows = [("a", 1, 1, "x y"), ("b", 2, 1, "x z")]
    assert centroids.with_centroid(spark.createDataFrame(rows, KIND)).count() == 2
    assert centroids.with_centroid(spark.createDataFrame([*rows, ("b", 1, 2, "x")], KIND)) is None
    assert centroids.with_centroid(spark.createDataFrame([*rows, ("b", None, 2, "x")], KIND)) is None
    assert centroids.with_centroid(spark.createDataFrame([], KIND)).count() == 0
    monkeypatch.setattr(centroids, "CHARS", 100)
    assert centroids.with_centroid(spark.createDataFrame([*rows, ("b", 2, 2, "x " * 50)], KIND)) is None


def test_scores_shuffle_no_table_of_words(spark):
    """The texts go to their clusters, and nothing but that is dealt after it: no join is left in the plan of the scores."""
    plan = summarizer.Summarizer().scores(made(spark))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_chosen_texts_come_along(spark):
    s = made(spark).where("not (did = 0 and sno = 1)")
    plain = summarizer.Summarizer(options={"percent": 40})
    joined = select.summary_text(plain.extract(s), s)
    assert sorted(map(tuple, plain.summary(s).collect())) == sorted(map(tuple, joined.collect()))
    assert "Join" not in plain.summary(s)._jdf.queryExecution().toString()


@pytest.mark.parametrize("choose", [select.without_redundancy, select.drop_repeats, lambda c: select.without_redundancy(c, words=True)])
def test_no_sets_are_checkpointed_for_clusters_within_a_block(spark, monkeypatch, choose):
    monkeypatch.setattr(select, "checkpointed", lambda df: pytest.fail("checkpointed"))
    c = made(spark).withColumn("score", (F.col("did") + F.col("sno")) / 10)
    out = choose(c).collect()
    assert 0 < len(out) <= c.count()


def test_texts_that_are_not_chosen_are_not_written(spark, monkeypatch):
    """What the choice writes are the chosen rows with their texts, and no other."""
    kept = []
    monkeypatch.setattr(select, "written", lambda df, name: kept.append(df.cache()) or kept[-1])
    s = made(spark)
    summary = summarizer.Summarizer(options={"percent": 20}).summary(s).collect()
    assert kept[0].where("text is not null").count() < s.count() / 2
    assert sum(len(r.summary.split("\n")) for r in summary) == kept[0].count()
