import pytest

from lectern.operators import evaluation as E
from lectern.operators import ngram_graph as N
from lectern.operators import pointer as P

KEY = "cluster string, did long, sno int"


def test_extracts(spark):
    a = spark.createDataFrame([("c", 1, 1, 10), ("c", 1, 2, 5), ("c", 1, 2, 5), ("d", 1, 1, 1)], KEY + ", wcnt int")
    b = spark.createDataFrame([("c", 1, 1, 10), ("c", 2, 1, 5), ("c", 2, 2, 5)], KEY + ", wcnt int")
    got = {r.cluster: (r.precision, r.recall) for r in E.extract_scores(a, b).collect()}
    assert got == {"c": (pytest.approx(1 / 2), pytest.approx(1 / 3)), "d": (0, 0)}
    weighted = E.extract_scores(a, b, "wcnt").where("cluster = 'c'").first()
    assert (weighted.precision, weighted.recall) == (pytest.approx(10 / 15), pytest.approx(10 / 20))
    swapped = {r.cluster: (r.recall, r.precision) for r in E.extract_scores(b, a).collect()}
    assert swapped == got


def test_kappa(spark):
    rows = [(i, "a", c) for i, c in enumerate([1, 1, 0, 0])] + [(i, "b", c) for i, c in enumerate([1, 0, 0, 0])]
    got = E.kappa(spark.createDataFrame(rows, "item int, judge string, category int")).first()
    pe = (3 / 8) ** 2 + (5 / 8) ** 2
    assert got.pa == pytest.approx(0.75) and got.pe == pytest.approx(pe) and got.kappa == pytest.approx((0.75 - pe) / (1 - pe))
    same = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "item int, judge string, category int")
    assert E.kappa(same).first().kappa is None


def test_utilities(spark):
    rows = [("c", 1, s, "a", float(u)) for s, u in ((1, 10), (2, 5), (3, 0))] + [("c", 1, s, "b", float(u)) for s, u in ((1, 4), (2, 8), (3, 4))] + [("c", 1, s, "k", 0.0) for s in (1, 2, 3)]
    judged = spark.createDataFrame(rows, KEY + ", judge string, util double")
    extract = spark.createDataFrame([("c", 1, 1)], KEY)
    assert E.relative_utility(extract, judged).first().utility == pytest.approx((1 + 4 / 8 + 0) / 3)
    sizes = spark.createDataFrame([("c", 1)], "cluster string, size int")
    each = {(r.judge, r.other): r.utility for r in E.judge_utility(judged, sizes).collect()}
    assert each["a", "b"] == 0.5 and each["b", "a"] == 0.5 and each["a", "k"] == 0
    got = E.normalized_utility(extract, judged).first()
    assert got.random == pytest.approx((5 / 10 + 16 / 3 / 8 + 0) / 3)
    units = spark.createDataFrame([("x", 1), ("y", 3)], "w string, freq int")
    words = spark.createDataFrame([("i", "x"), ("i", "y"), ("i", "q")], "item string, w string")
    idf = spark.createDataFrame([("y", 2.0)], "w string, idf double")
    import math

    assert E.model_unit_utility(units, words, idf).first().util == pytest.approx(10 * 2 * math.log(3) / (2 * math.log(3) + 5))


def test_rank_correlations(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0)], "did int, score double")
    b = spark.createDataFrame([(1, 9.0), (2, 5.0), (4, 1.0)], "did int, score double")
    import numpy as np

    assert E.pearson(a, b).first().pearson == pytest.approx(np.corrcoef([3, 2, 2, 0], [9, 5, 0, 1])[0, 1])
    assert E.spearman(a, b).first().spearman == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 4, 3])[0, 1])
    flat = spark.createDataFrame([(1, 1.0), (2, 1.0)], "did int, score double")
    assert E.pearson(flat, flat).first().pearson == 0


def test_relations(spark):
    schema = "sdid string, ssent int, tdid string, tsent int, type string, judge string"
    a = spark.createDataFrame([("x", 1, "y", 1, "s", "a"), ("x", 1, "y", 1, "t", "a"), ("x", 2, "y", 2, "s", "a"), ("x", 3, "y", 3, "s", "a")], schema)
    b = spark.createDataFrame([("x", 1, "y", 1, "t", "b"), ("x", 2, "y", 2, "s", "b"), ("y", 3, "x", 3, "s", "b")], schema)
    got = E.relation_agreement(a, b).first()
    assert (got.pairs, got.full, got.partial, got.single) == (4, 1, 1, 2)
    assert [tuple(r) for r in E.reversed_pairs(a, b).collect()] == [("x", 3, "y", 3)]
    merged = E.merge_relations(a, b, a)
    assert merged.count() == 7 and E.filter_relations(merged, least=2).count() == 5
    ends = spark.createDataFrame([("x", 2), ("y", 2)], "did string, sno int")
    assert E.filter_relations(merged, ends, ["s"]).count() == 2
    chosen = spark.createDataFrame([("c", "x", 1), ("c", "y", 1), ("c", "x", 2), ("e", "y", 2)], "cluster string, did string, sno int")
    linked = {r.cluster: (r.sentences, r.pairs, r.connected) for r in E.connectivity(chosen, merged).collect()}
    assert linked == {"c": (3, 3, 1), "e": (1, 0, 0)}


def test_decoder_and_places(spark):
    df = spark.createDataFrame([("c", [1, 2, 2, 0], [2, 3]), ("d", [], [])], "cluster string, answer array<int>, pred array<int>")
    assert {r.cluster: (r.precision, r.recall) for r in E.decoder_scores(df).collect()} == {"c": (0.5, 0.5), "d": (0, 0)}
    assert P.greedy_choice([{0: 0.1, 1: 0.5, 2: 0.4}, {0: 0.3, 1: 0.6, 2: 0.1}, {1: 1.0}]) == [1]
    assert P.greedy_choice([{1: 0.5, 2: 0.4}, {1: 0.6, 2: 0.1}, {1: 1.0}]) == [1, 2]
    padded = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    from pyspark.sql import functions as F

    assert padded.select(P.padded(F.col("v"), 5, F.lit(0)).alias("a"), P.padded(F.col("v"), 2, F.lit(0)).alias("b")).first() == ([1, 2, 3, 0, 0], [1, 2])
    rows = P.minibatches(spark.range(100).repartition(7), "id", 32).collect()
    assert all(r.batch == r.id // 32 for r in rows)


def test_pointer_chooses_each_sentence_once(spark):
    docs = spark.createDataFrame([("c", d, [[1, 2], [3], []], [0.1, 0.2]) for d in (1, 2)], "cluster string, doc long, sentences array<array<int>>, node array<double>")
    rows = P.point(docs, P.Weights.random(10, 2, seed=5), None).collect()
    assert len({r.place for r in rows}) == len(rows) and all(r.place == (r.doc - 1) * 3 + r.sent + 1 for r in rows)


def test_graph_comparison_and_merge(spark):
    edges = spark.createDataFrame([(1, "a", "b", 2.0), (1, "b", "c", 1.0), (2, "a", "b", 1.0)], "doc int, a string, b string, w double")
    pairs = spark.createDataFrame([(1, 2), (1, 1), (1, 9)], "x int, y int")
    got = {(r.x, r.y): r for r in N.compare(edges, edges, pairs).collect()}
    assert (got[1, 2].containment, got[1, 2].size, got[1, 2].value, got[1, 2].nvs) == (1, 0.5, 0.25, 0.5)
    assert got[1, 1].value == 1 and got[1, 9].value == 0
    merged = {(r.a, r.b): r.w for r in N.merge(edges, spark.createDataFrame([(1, "g"), (2, "g")], "doc int, grp string")).collect()}
    assert merged == {("a", "b"): 1.5, ("b", "c"): 0.5}
    links = spark.createDataFrame([(1, 1), (1, 2)], "peer int, model int")
    one = N.summary_scores(edges, edges, links).first()
    assert one.autosummeng == pytest.approx((1 + 0.25) / 2) and one.npower == pytest.approx((5.2905 * one.autosummeng + 3.0053 * one.memog + 0.5866) / 10)
