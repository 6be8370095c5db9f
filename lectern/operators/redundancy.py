"""Similarity above a threshold, and the greedy choice without redundancy, for groups of any size.

Passing over what is too similar to something better is the lexicographically
first independent set of the graph of similar pairs. Pairs come from a join on
prefixes of rare words, the choice from rounds of joins over the pairs; no group
of more than ``products.BLOCK`` items is ever held in one row or one task. Groups
of so many or fewer are compared, and chosen from, within one task each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import products
from .graph import checkpointed

#: Slack for rounding in bounds; pairs are compared exactly after it.
SLACK = 1e-9


def prefixes(unit: DataFrame, least: float, group: str = "graph", item: str = "id") -> DataFrame:
    """Of unit vectors (group, item, w, v) the entries that a pair of cosine ``least`` or more must meet in.

    Words are in order of how many of the group's vectors have them, rare ones
    first (ties by word). A vector's prefix ends where what follows is shorter
    than ``least``: two vectors that share no word of both prefixes share words
    only behind one of the two prefixes, so their product is below ``least``.
    """
    df = unit.groupBy(group, "w").agg(F.count(F.lit(1)).alias("__df"))
    order = Window.partitionBy(group, item).orderBy("__df", "w")
    behind = F.sum(F.col("v") * F.col("v")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return unit.join(df, [group, "w"]).withColumn("__rest", behind).where(F.col("__rest") >= (least - SLACK) ** 2).drop("__df", "__rest")


def candidates(unit: DataFrame, least: float, group: str = "graph", item: str = "id") -> DataFrame:
    """(group, a, b) with a < b: the pairs that share a word of both prefixes."""
    short = prefixes(unit, least, group, item).select(group, item, "w")
    a, b = short.withColumnRenamed(item, "a"), short.withColumnRenamed(item, "b")
    return a.join(b, [group, "w"]).where(F.col("a") < F.col("b")).select(group, "a", "b").distinct()


def _joined_pairs(unit: DataFrame, least: float, group: str, item: str) -> DataFrame:
    """``pairs_above`` by joins, for groups of any size."""
    met = candidates(unit, least, group, item)
    left = unit.select(group, F.col(item).alias("a"), "w", F.col("v").alias("va"))
    right = unit.select(group, F.col(item).alias("b"), "w", F.col("v").alias("vb"))
    dots = met.join(left, [group, "a"]).join(right, [group, "b", "w"]).groupBy(group, "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("cosine"))
    return dots.where(F.col("cosine") >= least)


def _pairs_in_group(table: pa.Table, least: float, group: str, item: str) -> pa.Table:
    """The pairs of a group of vectors (group, item, ws, vs)."""
    table = table.sort_by(item).combine_chunks()
    ws, vs = (pa.concat_arrays(table[c].chunks) for c in ("ws", "vs"))
    a, b = np.nonzero(np.triu((cosines := products.product_matrix(ws, vs, vs)) >= least, 1))
    return pa.table({group: table[group].take(pa.array(a)), "a": table[item].take(pa.array(a)), "b": table[item].take(pa.array(b)), "cosine": pa.array(cosines[a, b])})


def pairs_above(unit: DataFrame, least: float, group: str = "graph", item: str = "id") -> DataFrame:
    """(group, a, b, cosine) with a < b: every pair of unit vectors (group, item, w, v) of cosine ``least`` > 0 or more, and no other.

    A vector is one row, and groups of at most ``products.BLOCK`` vectors are
    compared in one task each. In larger ones candidates meet in their prefixes
    alone; their cosines are sums over the words that they share. Null words and
    zero vectors belong to no pair.
    """
    if least <= 0:
        raise ValueError("least must be over 0: without a threshold every shared word makes a pair")
    whole = unit.where("v > 0 and w is not null").repartition(group).groupBy(group, item).agg(F.collect_list(F.struct("w", "v")).alias("s"))
    rows = checkpointed(whole.select(group, item, F.col("s.w").alias("ws"), F.col("s.v").alias("vs"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("size")))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    small, large = rows.where(F.col("size") <= products.BLOCK).drop("size"), rows.where(F.col("size") > products.BLOCK)
    out = small.groupBy(group).applyInArrow(lambda t: _pairs_in_group(t, least, group, item), f"`{group}` {kind(group)}, a {kind(item)}, b {kind(item)}, cosine double")
    if large.isEmpty():
        return out
    entries = large.select(group, item, F.explode(F.arrays_zip("ws", "vs")).alias("e")).select(group, item, F.col("e.ws").alias("w"), F.col("e.vs").alias("v"))
    return out.unionByName(_joined_pairs(entries, least, group, item))


def similar_sets(sets: DataFrame, alike: Column, least: float, group: str = "cluster", item: str = "rank", words: str = "w") -> DataFrame:
    """(group, a, b) with a < b: sets of words whose similarity is ``least`` or more.

    ``alike`` compares the columns ``wa`` and ``wb`` and must not be above the
    cosine of the sets (Jaccard overlaps are not), so pairs below it can be left
    out before sets are compared.
    """
    entries = sets.select(group, item, F.explode(words).alias("w"), (1 / F.sqrt(F.size(words))).alias("v"))
    met = candidates(entries, least, group, item)
    side = lambda x: sets.select(group, F.col(item).alias(x), F.col(words).alias("w" + x))
    return met.join(side("a"), [group, "a"]).join(side("b"), [group, "b"]).where(alike >= least).select(group, "a", "b")


#: The similarities of two sets by the numbers of their common words and of each one's, as arrays.
BY_COUNTS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda common, a, b: common / np.sqrt(np.maximum(a * b, 1)),
    "overlap": lambda common, a, b: common / np.maximum(a + b - common, 1),
}


def set_similarities(w: pa.Array, alike: str) -> np.ndarray:
    """The similarities of all pairs of sets, rows of distinct words; 0 from a set to itself."""
    common = products.product_matrix(w, *([pa.ListArray.from_arrays(w.offsets, pa.array(np.ones(len(w.values))))] * 2))
    size = np.diff(w.offsets.to_numpy()).astype(float)
    return BY_COUNTS[alike](common, size[:, None], size[None, :])


def _in_order(table: pa.Table, order: str) -> tuple[pa.Table, pa.Array]:
    """A group's rows in order, and their words."""
    table = table.sort_by(order).combine_chunks()
    w = table["w"].combine_chunks() if table["w"].num_chunks != 1 else table["w"].chunk(0)
    return table, pa.ListArray.from_arrays(pa.array(w.offsets.to_numpy() - w.offsets[0].as_py(), pa.int32()), w.flatten())


def picked_in_group(table: pa.Table, alike: str, least: float, by_words: bool, block: int) -> pa.Table:
    """Of a group's rows (place, n, target, size, w, ...) those that are chosen in order, with ``rank``, until one does not fit.

    One as similar as ``least`` to a chosen one is passed over. A row of a group
    of more than ``block`` comes back alone, with rank 0.
    """
    table, w = _in_order(table, "place")
    if table["size"][0].as_py() > block:
        chosen, ranks = [0], [0]
    else:
        similar, n, target = set_similarities(w, alike) >= least, table["n"].to_pylist(), table["target"][0].as_py()
        chosen, used = [], 0
        for k in range(len(table)):
            after = used + (n[k] or 0)  # a missing text has no number of words, and fits
            near = None in (n[k], target) or after <= target or used == 0 or abs(after - target) < abs(used - target)
            if not (near if by_words else len(chosen) < target):
                break
            if not similar[k, chosen].any():
                chosen.append(k)
                used = after
        ranks = np.arange(1, len(chosen) + 1)
    return table.drop_columns(["w", "place", "size", "target"]).take(pa.array(chosen, pa.int64())).add_column(5, "rank", pa.array(ranks, pa.int32()))


def most_before_in_group(table: pa.Table, alike: str) -> pa.Table:
    """A group's rows (rank, w, ...) with ``sim``, the largest similarity to a row of lower rank, 0 without one, instead of w."""
    table, w = _in_order(table, "rank")
    most = np.tril(set_similarities(w, alike), -1).max(axis=1, initial=0.0)
    return table.drop_columns(["w"]).append_column("sim", pa.array(most))


def passed_over(pairs: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, b): what is left out when items are taken in order and none that pairs with a taken one.

    ``pairs`` is (group, a, b) with a before b. In each round every item whose
    better partners are all decided is taken, and its partners go; pairs of
    decided items are dropped. The rounds are as many as the longest chain of
    decisions that hang on one another, and each is written down.
    """
    left, gone = checkpointed(pairs.select(group, "a", "b")), None
    while left.head(1):
        taken = left.select(group, "a").distinct().join(left.select(group, F.col("b").alias("a")), [group, "a"], "left_anti")
        out = checkpointed(left.join(taken, [group, "a"], "left_semi").select(group, "b").distinct())
        gone = out if gone is None else gone.unionByName(out)
        rest = left.join(out, [group, "b"], "left_anti").join(out.withColumnRenamed("b", "a"), [group, "a"], "left_anti")
        left = checkpointed(rest)
    return left.select(group, "b") if gone is None else gone
