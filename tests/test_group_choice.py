"""Clusters within a block are chosen from in one task, larger ones in joins, with the same result."""

import pytest
from pyspark.sql import functions as F
from test_redundancy import SENT, random_sentences

from lectern.functions import similarity
from lectern.operators import features, products, redundancy, select


@pytest.mark.parametrize("how", ["cosine", "overlap", "bigram"])
def test_small_and_large_clusters_are_chosen_from_alike(spark, monkeypatch, how):
    df = spark.createDataFrame(random_sentences(5) + [("c", 1, 1, "", 0.5), ("d", 1, 1, None, 0.5)], SENT).repartition(3)
    rows = lambda out: sorted((r.cluster, r.did, r.sno, r["rank"]) for r in out.collect())
    found = []
    for block in (50, 10_000, 1):
        monkeypatch.setattr(products, "BLOCK", block)
        found.append(rows(select.without_redundancy(df, 70, similarity=how, threshold=0.5)))
    assert found[0] == found[1] == found[2] and len({r[0] for r in found[0]}) >= 3
    for threshold in (0.0, 1.5):
        monkeypatch.setattr(products, "BLOCK", 10_000)
        one = rows(select.without_redundancy(df, 70, similarity=how, threshold=threshold))
        monkeypatch.setattr(products, "BLOCK", 1)
        assert one == rows(select.without_redundancy(df, 70, similarity=how, threshold=threshold))


def test_pass_of_relevance_is_the_same_in_a_task_and_in_a_join(spark, monkeypatch):
    df = spark.createDataFrame(random_sentences(6), SENT).repartition(3)
    found = []
    for block in (10_000, 1):
        monkeypatch.setattr(products, "BLOCK", block)
        found.append(sorted((r.cluster, r.did, r.sno, round(r.score, 9)) for r in select.mmr(df).collect()))
    assert found[0] == found[1] and len(found[0]) == 120


def test_pairs_above_are_the_same_in_a_task_and_in_joins(spark, monkeypatch):
    df = spark.createDataFrame(random_sentences(8), SENT)
    words = df.select("cluster", (F.col("did") * 100 + F.col("sno")).alias("id"), F.array_distinct(F.split("text", " ")).alias("w")).where("text <> ''")
    unit = words.select(F.col("cluster").alias("graph"), "id", F.explode("w").alias("w"), (1 / F.sqrt(F.size("w"))).alias("v"))
    rows = lambda: sorted((r.graph, r.a, r.b, round(r.cosine, 9)) for r in redundancy.pairs_above(unit, 0.4321).collect())
    found = []
    for block in (10_000, 1):
        monkeypatch.setattr(products, "BLOCK", block)
        found.append(rows())
    assert found[0] == found[1] and found[0]
    monkeypatch.setattr(products, "BLOCK", 10_000)
    monkeypatch.setattr(redundancy, "candidates", lambda *a, **k: pytest.fail("joined"))
    assert rows() == found[0]


def test_no_pairs_are_joined_for_clusters_within_a_block(spark, monkeypatch):
    monkeypatch.setattr(select, "similar_sets", lambda *a, **k: pytest.fail("joined"))
    df = spark.createDataFrame(random_sentences(7), SENT)
    assert select.drop_repeats(df, 0.5).count() > 0
    assert redundancy.BY_COUNTS.keys() == {"cosine", "overlap"}


def test_words_are_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    """A table of words is dealt into as many parts as its rows ask for, whatever the number of shuffle partitions, with the same values."""
    df = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 7).alias("cluster"), (F.col("id") / 3).cast("long").alias("did"), (F.col("id") % 3).cast("int").alias("sno"), F.concat_ws(" ", F.lit("the"), F.col("id"), F.col("id") % 11, F.lit("the")).alias("text"))
    words = features.counted_words(df).cache()
    assert words.where("first").count() == words.select("did", "w").distinct().count()
    plain = {r.w: (r.df, r.idf) for r in similarity.idf_table(words.drop("first")).collect()}
    values = {(r.did, r.sno): r.value for r in features.centroid_values(words, similarity.idf_table(words)).collect()}
    monkeypatch.setattr(similarity, "PART", 20)
    idf = similarity.idf_table(words)
    assert {r.w: (r.df, r.idf) for r in idf.collect()} == plain
    assert {(r.did, r.sno): r.value for r in features.centroid_values(words, idf).collect()} == pytest.approx(values)
    assert similarity.dealt(words, words.count(), "w").rdd.getNumPartitions() == -(-words.count() // 20)
