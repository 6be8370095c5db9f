import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import rouge as R


@pytest.fixture
def tables(spark):
    peers = spark.createDataFrame([(1, "p", "the cat sat on the mat"), (1, "m1", "a cat sat"), (2, "p", "x")], "eval int, peer string, text string")
    models = spark.createDataFrame([(1, "m1", "the cat was on the mat"), (1, "m2", "a cat sat"), (2, "m1", "x")], "eval int, model string, text string")
    return peers, models


def by_key(df):
    return {(r.eval, r.peer): r for r in df.collect()}


def test_counts_modes_and_jackknife(tables):
    pooled = by_key(R.score(*tables, ("1",)))
    assert (pooled[1, "p"].hits, pooled[1, "p"].n_model, pooled[1, "p"].n_peer) == (7, 9, 12)
    best = by_key(R.score(*tables, ("1",), "B"))
    assert best[1, "p"].r == pytest.approx(5 / 6)
    assert pooled[2, "p"].f == 1
    assert (1, "m1") in by_key(R.over_models(R.pair_counts(*tables, "1", jackknife=True)))
    assert by_key(R.over_models(R.pair_counts(*tables, "1", jackknife=True)))[1, "m1"].n_model == 3
    assert by_key(R.score(*tables, ("2",)))[2, "p"].f == 0


def test_alpha_and_averages(spark, tables):
    recall = by_key(R.score(*tables, ("1",), alpha=1.0))
    assert recall[1, "p"].f == pytest.approx(recall[1, "p"].p) or recall[1, "p"].f == pytest.approx(recall[1, "p"].r)
    scores = R.score(*tables, ("1",)).where("peer = 'p'")
    mean, pooled = R.average(scores, 0).first(), R.average(scores, 1).first()
    assert mean.r == pytest.approx((7 / 9 + 1) / 2) and pooled.r == pytest.approx(8 / 10)
    assert R.average(scores, 2).first().hits == 8
    ci = R.bootstrap(scores, 300).first()
    assert 7 / 9 <= ci.low <= ci["mean"] <= ci.high <= 1 and ci["mean"] == pytest.approx((7 / 9 + 1) / 2, abs=0.03)


def test_sequences(spark):
    words = lambda s: [x.split() for x in s.split("\n")]
    assert R.union_lcs([(words("w1 w2 w3 w4 w5"), words("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")), (words("a b c"), words("x\ny"))]) == [4, 0]
    assert R.union_lcs([(words("a b c"), words("a b c"))], 2.0) == [9]
    assert [np.flatnonzero(x).tolist() for x in R._union_places([(list("abc"), [list("cab")])], 1.0)] == [[0, 1]]
    same = spark.createDataFrame([(1, "p", "one two three\nfour five")], "eval int, peer string, text string")
    model = same.withColumnRenamed("peer", "model")
    assert R.sequence_score(same, model).first().f == pytest.approx(1)
    weighted = R.sequence_score(same.where("eval = 1"), model, weight=1.2).first()
    assert 0.5 < weighted.f <= 1
    none = R.sequence_score(spark.createDataFrame([(1, "p", "")], "eval int, peer string, text string"), model).first()
    assert (none.r, none.p, none.f) == (0, 0, 0)


def test_basic_elements(spark):
    peers = spark.createDataFrame([(1, "p", "a|b"), (1, "p", "a|b"), (1, "p", None)], "eval int, peer string, be string")
    models = spark.createDataFrame([(1, "m", "a|b"), (1, "m", "c|d")], "eval int, model string, be string")
    got = R.basic_elements(peers, models).first()
    assert (got.hits, got.n_peer, got.n_model) == (1, 2, 2)


def plain_places(a, b, power):
    """Cell by cell: ties go up."""
    best, run = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            k = run[i][j]
            best[i + 1][j + 1] = best[i][j] + (k + 1) ** power - k**power if x == y else max(best[i][j + 1], best[i + 1][j])
            run[i + 1][j + 1] = k + 1 if x == y else 0
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


@pytest.mark.parametrize("power", [1.0, 1.2])
def test_tables_of_many_pairs_are_those_of_each(power, monkeypatch):
    rng = random.Random(3)
    word = lambda n: [rng.choice("abcdefghijkl"[: rng.randint(2, 12)]) for _ in range(rng.randint(0, n))]
    pairs = [(word(12), [word(15) for _ in range(rng.randint(0, 4))]) for _ in range(300)]
    want = [set().union(*(plain_places(a, b, power) for b in others)) for a, others in pairs]
    for cells, long in ((8_000_000, 20_000), (300, 20_000), (300, 40), (300, 0)):
        monkeypatch.setattr(R, "TABLE_CELLS", cells)
        monkeypatch.setattr(R, "LONG_CELLS", long)
        assert [set(np.flatnonzero(x).tolist()) for x in R._union_places(pairs, power)] == want


def test_options(spark):
    peers = spark.createDataFrame([(1, "p", "The running dogs\nwere happily walking")], "eval int, peer string, text string")
    models = spark.createDataFrame([(1, "m", "a dog runs and walked")], "eval int, model string, text string")
    hits = lambda **o: R.pair_counts(peers, models, "1", options=R.Options(**o)).first()
    assert hits().hits == 0 and hits(stem=True).hits == 3 and hits(stem=True, exceptions=(("were", "run"),)).hits == 3
    assert hits(stopwords=("the", "and")).n_peer == 5 and hits(words=3).n_peer == 3 and hits(words=3).n_model == 3
    cut = hits(bytes=20)
    assert cut.n_peer == 4  # 16 bytes of the first line and four of the second


def test_results_are_printed_and_read_back(spark):
    from lectern.sources import writers

    rows = [("7", "ROUGE-1", k, m, m - 0.01, m + 0.01) for k, m in zip("FRP", (0.3, 0.25, 0.375))]
    text = writers.results_text(spark.createDataFrame(rows, "peer string, metric string, kind string, mean double, low double, high double"))
    body = text.first().value
    assert body.split("\n")[1] == "7 ROUGE-1 Average_R: 0.25000 (95%-conf.int. 0.24000 - 0.26000)" and [x.split()[2][8] for x in body.split("\n")[1:]] == list("RPF")
    back = writers.parse_results(text.select(R.F.explode(R.F.split("value", "\n")).alias("value"))).collect()
    assert sorted((r.kind, r.value) for r in back) == [("F", 0.3), ("P", 0.375), ("R", 0.25)]


def test_unit_counts_follow_from_token_counts(spark):
    rows = spark.createDataFrame([(["t"] * n,) for n in range(9)] + [(None,)], "ts array<string>")
    for metric in ("1", "2", "4", "S0", "S4", "SU4", "S-1", "SU-1"):
        wrong = rows.select(R.gram_count(F.col("ts"), metric).alias("n"), F.size(R.grams_of(F.col("ts"), metric)).alias("m"), F.size("ts").alias("k")).where("n <> m and k >= 0")
        assert wrong.collect() == [], metric


@pytest.mark.parametrize("power", [1.0, 1.2])
def test_many_peers_at_once_are_scored_as_pairs(power, monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["x", "y"] * 6
    text = lambda lines, most: [rng.choices(words, k=rng.randrange(most)) for _ in range(rng.randrange(lines))]
    models = [text(4, 20) for _ in range(6)] + [[rng.choices(words, k=150)], []]
    peers = [text(6, 30) for _ in range(25)] + [[], [rng.choices(words[:12], k=300), []], [["none"]]]
    kind = pa.list_(pa.list_(pa.string()))
    want = np.array([R.union_lcs([(m, p) for m in models], power) for p in peers])
    for cells in (R.TABLE_CELLS, 2_000):
        monkeypatch.setattr(R, "TABLE_CELLS", cells)
        assert np.allclose(R._covered(pa.array(peers, kind), pa.array(models, kind), power), want, rtol=0, atol=1e-9)
