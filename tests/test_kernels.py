"""Kernels against plain tables, and the smaller operators by hand."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as T
from lectern.operators import evaluation, graph, pointer, select


def tables(a, b):
    """(longest common subsequence, edit distance) by whole tables."""
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            lcs[i][j] = lcs[i - 1][j - 1] + 1 if same else max(lcs[i - 1][j], lcs[i][j - 1])
            cost[i][j] = min(cost[i - 1][j - 1] + (not same), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    return lcs[-1][-1], cost[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_bits_of_rows_are_the_tables(seed):
    rng = random.Random(seed)
    for _ in range(20):
        a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.choice([0, 1, 2, 5, 20, 80]))] for _ in range(2))
        assert (S.lcs_length(a, b), S.edit_distance(a, b)) == tables(a, b)


def test_truncation_by_bytes(spark):
    rows = [("abc",), ("aéz",), ("a€z",), ("\U0001f600x",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    for n in range(6):
        got = [r[0] for r in df.select(T.truncate_bytes(F.col("t"), n)).collect()]
        assert got == [None if t is None else t.encode()[:n].decode(errors="ignore") for (t,) in rows]
    one = spark.createDataFrame([(["one two", "three", "four"],)], "s array<string>")
    assert [one.select(T.truncate_sentences(F.col("s"), n)).first()[0] for n in (3, 7, 8, 12, 13, 99)] == ["one", "one two", "one two t", "one two three", "one two three f", "one two three four"]


def test_stop_words_by_pattern(spark):
    df = spark.createDataFrame([("On THE  hill the end",)], "t string")
    assert df.select(T.cut_stopwords(F.col("t"), ["the", "on"])).first()[0] == "On hill end"


def test_vectors(spark):
    df = spark.createDataFrame([(list("aab"), list("bc")), ([], [])], "a array<string>, b array<string>").coalesce(1)
    idf = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(0.5))
    v = lambda how, weights=None: df.select(S.feature_vectors(F.col("a"), F.col("b"), how, weights).alias("v"))
    assert [(r.v.x, r.v.y) for r in v("binary").collect()] == [([1, 1, 0], [0, 1, 1]), ([], [])]
    assert [(r.v.x, r.v.y) for r in v("freq").collect()] == [([2, 1, 0], [0, 1, 1]), ([], [])]
    assert v("tfidf", idf).first().v.asDict() == {"x": [4, 0.5, 0], "y": [0, 0.5, 0]}
    got = [r[0] for r in v("freq").select(S.vector_cosine(F.col("v.x"), F.col("v.y"))).collect()]
    assert got == [pytest.approx(1 / np.sqrt(10)), 0]
    with pytest.raises(ValueError):
        S.feature_vectors(F.col("a"), F.col("b"), "tfidf")


def test_watched_walk_stops_by_one_node():
    w = np.array([[0, 1, 1], [0, 0, 1], [0, 0, 0.0]])
    rank, last = np.full(3, 1 / 3), None
    while True:  # the first node has most out-links
        new = np.full(3, 0.15 / 3) + 0.85 * rank[2] / 3
        new[1] += 0.85 * rank[0] / 2
        new[2] += 0.85 * (rank[0] / 2 + rank[1])
        if abs(new[0] - rank[0]) < 1e-3:
            break
        rank, last = new, rank
    assert last is not None and np.allclose(graph.walk_watched(w, np.full(3, 1 / 3)), rank)


def test_chosen_sentences_rank_first(spark):
    df = spark.createDataFrame([("c", 1, 1, 0.5), ("c", 1, 2, 20000.0), ("c", 2, 1, 1.0), ("d", 3, 1, 2.0)], "cluster string, did int, sno int, score double")
    got = {(r.did, r.sno): r.score for r in select.chosen_bonus(df, df.where("did = 2 or did = 3")).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 20000.0, (2, 1): 30001.0, (3, 1): 10002.0}


def test_spearman_over_many_parts(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 200, 2000), rng.normal(size=2000)
    a = spark.createDataFrame(pd.DataFrame({"did": np.arange(2000), "score": x})).repartition(7)
    b = spark.createDataFrame(pd.DataFrame({"did": np.arange(1, 2001), "score": y})).repartition(5)
    got = evaluation.spearman(a, b).first()
    both = pd.DataFrame({"x": pd.Series(x).rank(ascending=False)}).join(pd.DataFrame({"y": pd.Series(y, index=np.arange(1, 2001)).rank(ascending=False)}), how="outer").fillna(2001)
    assert got["items"] == 2001 and got.spearman == pytest.approx(both.x.corr(both.y), abs=1e-9)


def test_weights_are_loaded_as_they_were_saved(tmp_path):
    made = pointer.Weights.random(20, 4, hidden=3, seed=1)
    made.save(str(tmp_path / "w.npz"))
    got = pointer.Weights.load(str(tmp_path / "w.npz"))
    assert all(np.array_equal(getattr(got, n), getattr(made, n)) for n in ("embed", "sentence", "document", "decoder", "attend_memory", "attend_state", "attend"))
    np.savez(tmp_path / "bad.npz", **{n: getattr(made, n) for n in ("embed", "sentence", "document", "attend_memory", "attend_state", "attend")}, decoder=np.zeros((4, 2, 3)))
    with pytest.raises(ValueError, match="decoder"):
        pointer.Weights.load(str(tmp_path / "bad.npz"))


def test_documents_encoded_at_once_are_those_encoded_apart():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    w = pointer.Weights.random(30, 2, hidden=4, seed=3)
    docs = [[rng.integers(0, 30, n).tolist() for n in rng.integers(0, 9, k)] for k in (3, 0, 1, 7, 40)]
    nodes = [[0.1 * i, 1.0 - i] for i in range(len(docs))]
    got = pointer.encode_many(pa.array(docs, pa.list_(pa.list_(pa.int32()))), pa.array(nodes), w)
    want = np.concatenate([pointer.encode(d, np.array(n), w) for d, n in zip(docs, nodes)])
    assert got.shape == want.shape and np.allclose(got, want, rtol=0, atol=1e-12)
