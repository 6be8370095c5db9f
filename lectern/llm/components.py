"""Connected components of an edge table by alternating large and small stars.

Each round joins every node's smallest neighbour back to its edges, so edges turn
into stars around the smallest node of each component in a number of rounds that
grows with the logarithm of the component's size (Kiveris et al., 2014). Each
round is written down; nothing but one count and one sum per round reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """large: every neighbour above u is linked to the smallest of u and its neighbours; else every one not above it.

    A hub's edges, which may be most of all, meet a broadcast row of its smallest neighbour.
    """
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("c"))
    side = near.where("b > a") if large else near
    linked = meet(side, least, ["a"], "c", total).select(F.greatest("b", "m").alias("u"), F.least("b", "m").alias("v"))
    if not large:
        linked = linked.union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of longs); component is the smallest node that it reaches.

    Rows with a null end are ignored, as are loops and repeated edges; an empty
    table gives an empty one.
    """
    u, v = edges.columns[:2]
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = written(_star(_star(now, large=True, total=2 * state[0]), large=False, total=state[0]), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
