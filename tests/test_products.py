"""Products in blocks against all pairs, and that what is shuffled are items, not pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, products


def random_entries(seed, n=40):
    rng = random.Random(seed)
    out = []
    for g in "ab":
        for i in range(n if g == "a" else 3):
            for w in {f"w{int(rng.paretovariate(0.5)) % 50}" for _ in range(rng.randrange(0, 9))} | ({"all"} if i % 2 else set()):
                out.append((g, i * 7 - 20, w, rng.random() + 0.1, rng.random() + 0.1, 1.0))
    return out


@pytest.mark.parametrize("block", [None, 4])
def test_blocks_equal_all_pairs(spark, block):
    rows = random_entries(block or 0)
    got = {(r[0], r.src, r.dst): r for r in products.product_edges(spark.createDataFrame(rows, "graph string, id long, w string, x double, y double, z double").repartition(5), block=block).collect()}
    of = {}
    for g, i, w, x, y, _ in rows:
        of.setdefault((g, i), {})[w] = (x, y)
    want = {(g, a, b): sum(x * of[g, b][w][1] for w, (x, _) in of[g, a].items() if w in of[g, b]) for g, a in of for h, b in of if g == h and a != b}
    want = {k: v for k, v in want.items() if v > 0}
    assert got.keys() == want.keys() and len(got) > 300
    for (g, a, b), v in want.items():
        r = got[g, a, b]
        assert r.value == pytest.approx(v) and r.src_x == pytest.approx(sum(x for x, _ in of[g, a].values())) and r.src_z == len(of[g, a]) and r.dst_x == pytest.approx(sum(x for x, _ in of[g, b].values()))


def test_words_of_many_items_and_slices(monkeypatch):
    monkeypatch.setattr(products, "COLUMNS", 2)
    monkeypatch.setattr(products, "PRODUCTS", 3)
    rng = np.random.default_rng(3)
    x, y = (rng.random((12, 7)) * (rng.random((12, 7)) < d) for d in (0.9, 0.6))
    entry = lambda m: (*(a := np.nonzero(m)), m[a])
    for listed in (0, 50, 1000):
        monkeypatch.setattr(products, "LISTED", listed)
        assert np.allclose(products._sums(7, entry(x), entry(y), 12, 12), x @ y.T)


def test_pairs_are_not_shuffled(spark):
    """Sentences that all share a word: a shuffle of pairs would move 90,000 of them, the items are 300."""
    tokens = spark.range(300).select(F.lit("g").alias("graph"), "id", F.explode(F.array(F.lit("all"), F.col("id").cast("string"))).alias("w"))
    idf = tokens.groupBy("w").agg(F.lit(1.0).alias("idf"))
    for edges in (graph.similarity_edges(tokens, idf), graph.generation_edges(tokens)):
        assert edges.count() == 300 * 299
        plan = edges._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"hashpartitioning\(([^)]*)", plan)
        assert keys and not any(re.search(r"\b(src|dst|a|b)#", k) for k in keys), keys
