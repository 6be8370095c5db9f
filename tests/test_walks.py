"""Joined walks against the dense ones on small graphs, and on a graph with 100,000 nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, walks


def small(spark, seed, n=12, links=40, uniform=False):
    rng = np.random.default_rng(seed)
    w = np.zeros((n, n))
    for _ in range(links):
        w[rng.integers(n), rng.integers(n)] += rng.integers(1, 5)
    w[3] = 0  # a node without links out
    prior = np.ones(n) / n if uniform else (p := rng.random(n) + 0.05) / p.sum()
    edges = [(int(i), int(j), float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
    edges += [(99, 1, 5.0), (1, 99, 5.0), (0, 1, -1.0), (0, 2, 0.0)]  # unknown ids and no weight
    return w, prior, spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([(i, float(p) * 7) for i, p in enumerate(prior)], "id long, prior double")


@pytest.mark.parametrize("cumulative", [False, True])
def test_divrank_equals_the_dense_walk(spark, cumulative):
    w, prior, edges, nodes = small(spark, 1)
    got = {r.id: r["rank"] for r in walks.divrank(edges, nodes, 0.15, 0.25, tolerance=None, iterations=3, cumulative=cumulative).collect()}
    want = graph.walk_divrank(w, prior, 0.15, 0.25, tolerance=-1.0, most=3, cumulative=cumulative)
    assert np.allclose([got[i] for i in range(len(w))], want, atol=1e-9)


def test_divrank_stops_by_tolerance_and_takes_empty_tables(spark):
    w, prior, edges, nodes = small(spark, 2)
    got = {r.id: r["rank"] for r in walks.divrank(edges, nodes, tolerance=0.2).collect()}
    assert np.allclose([got[i] for i in range(len(w))], graph.walk_divrank(w, prior, tolerance=0.2), atol=1e-9)
    assert walks.divrank(edges.limit(0), nodes.limit(0)).collect() == []
    assert walks.grasshopper(edges.limit(0), nodes.limit(0)).collect() == []


def test_grasshopper_equals_the_dense_order(spark):
    w, prior, edges, nodes = small(spark, 3, n=9)
    got = [r.id for r in walks.grasshopper(edges, nodes, trust=0.5, top=3, tolerance=1e-4).orderBy("place").collect()]
    assert got == graph.order_grasshopper(w, prior, trust=0.5, top=3)


def test_grasshopper_without_edges_goes_by_the_prior(spark):
    nodes = spark.createDataFrame([(5, 1.0), (6, 4.0), (7, 2.0)], "id long, prior double")
    none = spark.createDataFrame([], "src long, dst long, w double")
    got = [r.id for r in walks.grasshopper(none, nodes, trust=0.5, top=9, tolerance=1e-2).orderBy("place").collect()]
    assert got == [5 + i for i in graph.order_grasshopper(np.zeros((3, 3)), np.array([1, 4, 2]) / 7, trust=0.5)]


def test_a_large_graph_with_a_hub(spark):
    n = 100_000
    ids = spark.range(n)
    ring = ids.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("w"))
    hub = ids.where("id % 3 = 1").select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(2.0).alias("w"))
    nodes = ids.withColumn("prior", F.lit(1.0))
    ranks = walks.divrank(ring.union(hub), nodes, tolerance=None, iterations=2)
    row = ranks.agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("total"), F.max_by("id", "rank").alias("first")).first()
    assert (row.n, row.first) == (n, 0) and abs(row.total - 1) < 1e-9
    assert [r.id for r in walks.grasshopper(ring.union(hub), nodes, trust=0.5, top=1, tolerance=1e-2).collect()] == [0]


def test_links_stay_where_they_are_in_a_step(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(6) if a != b], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, 1.0) for i in range(6)], "id long, prior double")
    links, state, n = walks._prepared(edges, nodes)
    plan = walks._into(links, state, "r", n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
