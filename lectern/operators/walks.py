"""Reinforced and absorbing walks on one graph of any size, as joined steps over its edges.

``edges`` is (src, dst, w), ``nodes`` (id, prior), as for ``graph.pagerank``; the
walks equal the dense ones of ``graph`` on small graphs. No n x n matrix exists
anywhere: a step joins a state table of one row a node with the edges, and only
sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, normalized_edges

#: Nodes whose state, a row of a few numbers each, is broadcast to the edges; of more, edges are shuffled in each step.
BROADCAST_NODES = 1_000_000


def _prepared(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(links, state, n): edges between known nodes over their source's sum, those into one node together; nodes with prior r and whether they have links out."""
    sums = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("prior").alias("total")).first()
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = checkpointed(normalized_edges(inside).repartition("dst"))
    share = F.col("prior") / sums.total if sums.total else F.lit(1.0) / max(sums.n, 1)
    out = links.select(F.col("src").alias("id")).distinct().withColumn("__out", F.lit(True))
    state = nodes.select("id", share.alias("r")).join(out, "id", "left").select("id", "r", F.col("__out").isNull().alias("sink"))
    return links, state, sums.n


def _sent(values: DataFrame, n: int) -> DataFrame:
    """A table of at most ``n`` nodes, to be joined with links: broadcast if that is a small number, so that links stay where they are."""
    return F.broadcast(values) if n <= BROADCAST_NODES else values


def _into(links: DataFrame, values: DataFrame, value: str, n: int) -> DataFrame:
    """(id, got): the sum of p * value over links into a node, from (id, value) of ``n`` nodes."""
    return links.join(_sent(values.select(F.col("id").alias("src"), value), n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col(value)).alias("got"))


def _along(links: DataFrame, values: DataFrame, value: str, n: int) -> DataFrame:
    """(id, ahead): the sum of p * value of the nodes that a node's links lead to."""
    return links.join(_sent(values.select(F.col("id").alias("dst"), value), n), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("p") * F.col(value)).alias("ahead"))


def divrank(
    edges: DataFrame, nodes: DataFrame, teleport: float = 0.1, alpha: float = 0.25, tolerance: float | None = 1e-3, iterations: int = 1000, cumulative: bool = False
) -> DataFrame:
    """(id, rank): a vertex-reinforced walk, whose steps go to nodes by how much these were visited.

    With probability 1 - alpha a node keeps to itself, else it follows a link (a
    node without links: the prior); each way is weighted by the visits of where
    it leads, and a row's weights are divided by their sum anew in each step.
    Visits are the last ranks, or with ``cumulative`` the sum of all so far. With
    probability ``teleport`` the walk jumps by the prior. Stops after
    ``iterations``, or once ranks move by less than ``tolerance`` in sum (None:
    never before).

    A step is two joins of the state with the edges: one brings the visits ahead
    to each source (the row sums), one carries rank over row sum to the targets.
    Edges to or from ids that ``nodes`` lacks, and those of no weight, are
    ignored; an empty table of nodes gives an empty result.
    """
    links, state, n = _prepared(edges, nodes)
    now = checkpointed(state.withColumns({"rank": F.lit(1.0 / max(n, 1)), "visits": F.lit(1.0 / max(n, 1))}))
    for _ in range(iterations if n else 0):
        everywhere = F.broadcast(now.agg(F.sum(F.col("r") * F.col("visits")).alias("everywhere")))  # one row
        rows = now.join(_along(links, now, "visits", n), "id", "left").join(everywhere)
        row = alpha * F.when(F.col("sink"), F.col("everywhere")).otherwise(F.coalesce("ahead", F.lit(0.0))) + (1 - alpha) * F.col("visits")
        rated = rows.select("id", "r", "sink", "rank", "visits", F.when(row > 0, F.col("rank") / row).otherwise(0.0).alias("ratio"), F.when(row > 0, 0.0).otherwise(F.col("rank")).alias("stuck"))
        spread = F.broadcast(rated.agg(F.sum(F.when(F.col("sink"), F.col("ratio")).otherwise(0.0)).alias("sinks"), F.sum("stuck").alias("stuck_all")))  # one row
        met = rated.join(_into(links, rated, "ratio", n), "id", "left").join(spread)
        kept = F.col("visits") * (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("r") * F.col("sinks")) + (1 - alpha) * F.col("ratio")) + F.col("r") * F.col("stuck_all")
        new = (1 - teleport) * kept + teleport * F.col("r")
        after = met.select("id", "r", "sink", F.col("rank").alias("old"), new.alias("rank"), (F.col("visits") + new if cumulative else new).alias("visits"))
        after = checkpointed(after)  # each step reads the state several times, so lineage over steps would multiply
        moved = after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] if tolerance is not None else None
        now = after.drop("old")
        if moved is not None and moved < tolerance:
            break
    return now.select("id", "rank")


def _series(links: DataFrame, start: DataFrame, sinks: DataFrame | None, columns: list[str], trust: float, tolerance: float, n: int) -> DataFrame:
    """(id, columns): start + trust * start R + trust**2 * start R**2 + ... for each column of start (id, r, columns).

    R's rows are the links' shares, or the prior of a node without links. What
    is left after k steps is trust**k of the start's sum at most, so the number
    of steps is known beforehand and no step asks the driver.
    """
    needed, left = 1, trust
    while left > tolerance * (1 - trust):
        needed, left = needed + 1, left * trust
    now = checkpointed(start.select("id", "r", *(F.col(c).alias(f"d_{c}") for c in columns), *columns))
    for _ in range(needed):
        carried = now.select(F.col("id").alias("src"), *(f"d_{c}" for c in columns))
        got = links.join(_sent(carried, n), "src").groupBy(F.col("dst").alias("id")).agg(*(F.sum(F.col("p") * F.col(f"d_{c}")).alias(f"g_{c}") for c in columns))
        met = now.join(got, "id", "left")
        if sinks is not None:
            met = met.join(F.broadcast(now.join(sinks, "id", "left_semi").agg(*(F.coalesce(F.sum(f"d_{c}"), F.lit(0.0)).alias(f"l_{c}") for c in columns))))  # one row
        jump = (lambda c: F.col("r") * F.col(f"l_{c}")) if sinks is not None else (lambda c: F.lit(0.0))
        new = {c: trust * (F.coalesce(f"g_{c}", F.lit(0.0)) + jump(c)) for c in columns}
        now = checkpointed(met.select("id", "r", *(new[c].alias(f"d_{c}") for c in columns), *((F.col(c) + new[c]).alias(c) for c in columns)))
    return now.select("id", *columns)


def _best(values: DataFrame, value: Column) -> tuple[int, float] | None:
    row = values.select("id", F.round(value, 12).alias("v")).orderBy(F.desc("v"), "id").first()
    return (row.id, row.v) if row else None


def grasshopper(edges: DataFrame, nodes: DataFrame, trust: float = 0.75, top: int = 10, tolerance: float = 1e-9) -> DataFrame:
    """(id, place): the first ``top`` nodes of an absorbing walk, from 1.

    The first is the favourite of the walk that follows links with probability
    ``trust`` and else jumps by the prior. Each picked node absorbs, and the
    next is the one with most expected visits before absorption (ties, to twelve
    digits: the smallest id).

    Expected visits are s (I - Q)^-1 for a start s everywhere alike. Q is trust
    times the links among the nodes that are left plus a jump that is the same
    from all of them, so (Sherman and Morrison) two series over the links alone
    give them: x from s and y from the prior; they shrink by ``trust`` a step
    however large the graph is and however rarely the jump meets a picked node.
    A further pick takes a row and a column out of the inverse, for which one
    series from the picked node corrects x and y. Each pick thus costs about
    log(tolerance) / log(trust) joined steps, and no matrix is made.
    """
    links, state, n = _prepared(edges, nodes)
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    if not n or top < 1:
        return spark.createDataFrame([], f"id {kind}, place int")
    state = checkpointed(state)
    sinks = state.where("sink").select("id")
    sinks = sinks if sinks.head(1) else None
    # With nothing absorbed, x and y are rows of (I - trust R)^-1 over all nodes; the favourite's rank is (1 - trust) y.
    xy = _series(links, state.select("id", "r", F.lit(1.0 / n).alias("x"), F.col("r").alias("y")), sinks, ["x", "y"], trust, tolerance, n)
    picked: list[int] = []
    while len(picked) < min(top, n):
        if picked:
            sums = xy.agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
            jump = (1 - trust) * sums.x / (1 - (1 - trust) * sums.y)
            best = _best(xy, F.col("x") + jump * F.col("y"))
        else:
            best = _best(xy, (1 - trust) * F.col("y"))
        if best is None:
            break
        picked.append(best[0])
        if len(picked) == min(top, n):
            break
        gone = F.col("id") == F.lit(best[0])
        before = state.where(~F.col("id").isin(picked[:-1])) if len(picked) > 1 else state  # at most ``top`` ids
        alive = links.where(~F.col("src").isin(picked[:-1]) & ~F.col("dst").isin(picked[:-1])) if len(picked) > 1 else links
        z = _series(alive, before.select("id", "r", F.when(gone, 1.0).otherwise(0.0).alias("z")), sinks, ["z"], trust, tolerance, n)
        at = xy.join(z, "id").where(gone).first()
        xy = checkpointed(xy.join(z, "id").where(~gone).select("id", (F.col("x") - at.x / at.z * F.col("z")).alias("x"), (F.col("y") - at.y / at.z * F.col("z")).alias("y")))
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(picked)], f"id {kind}, place int")
