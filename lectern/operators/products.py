"""Sums of products over shared words, for all pairs of a graph's items, in blocks.

A join on words lists every word that two items share, and a sum by pair shuffles
that list, which is far longer than the pairs. Here an item's words travel once, as
one row, to the task that pairs it. A graph of more than ``BLOCK`` items is cut into
blocks and each pair of blocks is a group of its own, so a group's memory is bounded
and a graph of any size is dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a graph that are paired in one group with as many others.
BLOCK = 1024
#: A word that so many pairs share, or fewer, is listed pair by pair; others are columns of a matrix.
LISTED = 64
#: Listed products and columns of a matrix that are in memory at once.
PRODUCTS, COLUMNS = 2_000_000, 2048
VALUES = ("value", "src_x", "src_z", "dst_x")


def vectors(entries: DataFrame, item: str = "id", graph: str = "graph") -> DataFrame:
    """(graph, id, ws, xs, ys, sx, sz): one row an item of entries (graph, item, w, x, y, z), dealt by graph, with the sums of x and z."""
    each = F.array_sort(F.collect_list(F.struct("w", "x", "y")))
    rows = entries.repartition(graph).groupBy(graph, item).agg(each.alias("s"), F.sum("x").alias("sx"), F.sum("z" if "z" in entries.columns else F.lit(0.0)).alias("sz"))
    return rows.select(F.col(graph).alias(graph), F.col(item).alias("id"), F.col("s.w").alias("ws"), F.col("s.x").alias("xs"), F.col("s.y").alias("ys"), "sx", "sz")


def _sums(words: int, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], rows: int, columns: int) -> np.ndarray:
    """rows x columns: sums of products over equal words of entries (item, word, value), words numbered from 0."""
    out = np.zeros(rows * columns)
    nl, nr = np.bincount(left[1], minlength=words), np.bincount(right[1], minlength=words)
    met = nl * nr
    rare, often = (met > 0) & (met <= LISTED), np.flatnonzero(met > LISTED)
    order = np.argsort(right[1], kind="stable")
    begin = np.concatenate([[0], np.cumsum(nr)])
    mine = np.flatnonzero(rare[left[1]])
    ends = np.cumsum(nr[left[1][mine]])
    start = 0
    while start < len(mine):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
        some = mine[start:stop]
        times = nr[left[1][some]]
        a = np.repeat(some, times)
        b = order[np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[left[1][some]], times)]
        out += np.bincount(left[0][a] * columns + right[0][b], left[2][a] * right[2][b], minlength=rows * columns)
        start = stop
    out = out.reshape(rows, columns)
    place = np.full(words, -1)
    place[often] = np.arange(len(often))

    def matrix(side: tuple[np.ndarray, ...], first: int, items: int) -> np.ndarray:
        at = place[side[1]] - first
        keep = (place[side[1]] >= 0) & (at >= 0) & (at < COLUMNS)
        m = np.zeros((items, min(COLUMNS, len(often) - first)))
        m[side[0][keep], at[keep]] = side[2][keep]
        return m

    for first in range(0, len(often), COLUMNS):
        out += matrix(left, first, rows) @ matrix(right, first, columns).T
    return out


def _flat(ws: pa.Array, *values: pa.Array) -> tuple[np.ndarray, np.ndarray, int, list[np.ndarray]]:
    """(item, word, how many words, values) of rows of lists."""
    counts = np.diff(ws.offsets.to_numpy())
    flat = ws.flatten().dictionary_encode()
    return np.repeat(np.arange(len(ws)), counts), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary), [v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in values]


def product_matrix(ws: pa.Array, xs: pa.Array, ys: pa.Array) -> np.ndarray:
    """The sums of x * y of all ordered pairs of rows of lists, 0 from a row to itself."""
    item, word, words, (x, y) = _flat(ws, xs, ys)
    out = _sums(words, (item, word, x), (item, word, y), len(ws), len(ws))
    np.fill_diagonal(out, 0.0)
    return out


def _pairs_of(table: pa.Table, graph: str) -> pa.Table:
    """All pairs of a group of ``product_edges``."""
    table = table.combine_chunks()
    name, i, j = (table[c][0] for c in (graph, "i", "j"))
    ids, block, sx, sz = (table[c].to_numpy() for c in ("id", "block", "sx", "sz"))
    item, word, words, (x, y) = _flat(*(table[c].chunk(0) for c in ("ws", "xs", "ys")))
    one, other = np.flatnonzero(block == i.as_py()), np.flatnonzero(block == j.as_py())
    place = np.zeros(len(ids), dtype=np.int64)
    place[one], place[other] = np.arange(len(one)), np.arange(len(other))
    sides = []
    for left, right in ((one, other), (other, one))[: 1 if i.as_py() == j.as_py() else 2]:
        a, b = np.isin(item, left), np.isin(item, right)
        m = _sums(words, (place[item[a]], word[a], x[a]), (place[item[b]], word[b], y[b]), len(left), len(right))
        if i.as_py() == j.as_py():
            np.fill_diagonal(m, 0.0)
        src, dst = np.nonzero(m)
        sides.append((ids[left[src]], ids[right[dst]], m[src, dst], sx[left[src]], sz[left[src]], sx[right[dst]]))
    src, dst, *values = (np.concatenate(c) for c in zip(*sides))
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(src), dtype=np.int32)), pa.array([name.as_py()], table.schema.field(graph).type)).dictionary_decode()
    return pa.table({graph: names, "src": pa.array(src), "dst": pa.array(dst)} | {c: pa.array(v) for c, v in zip(VALUES, values)})


def product_edges(entries: DataFrame, item: str = "id", graph: str = "graph", block: int | None = None) -> DataFrame:
    """(graph, src, dst, value, src_x, src_z, dst_x): for all ordered pairs of different items of a graph the sum of src's x times dst's y over their common words, where it is not 0.

    ``entries`` is (graph, item, w, x, y), one row a word of an item, ids any
    longs. src_x and dst_x are the sums of the two items' x, src_z that of z, a
    further column of doubles (0 without one), so no join on pairs has to add them.
    """
    size = block or BLOCK
    rows = vectors(entries, item, graph)
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(graph)) / size).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    small = dealt.where("blocks = 1").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")
    large = dealt.where("blocks > 1").select("*", with_).select(*dealt.columns, F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    kind = entries.schema[graph].dataType.simpleString()
    columns = [graph, "i", "j", "id", "block", "ws", "xs", "ys", "sx", "sz"]
    run = lambda df: df.select(*columns).groupBy(graph, "i", "j").applyInArrow(lambda t: _pairs_of(t, graph), f"{graph} {kind}, src long, dst long, " + ", ".join(f"{c} double" for c in VALUES))
    return run(small).unionByName(run(large.repartition(graph, "i", "j")))


def walk_products(entries: DataFrame, nodes: DataFrame, walk: Callable[[np.ndarray, np.ndarray], np.ndarray], item: str = "id", graph: str = "graph") -> DataFrame:
    """(graph, id, rank): ``graph.per_graph`` over ``product_edges`` of the entries, whose edges never leave the task that walks them."""

    def run(key: tuple, of_nodes: pd.DataFrame, of_items: pd.DataFrame) -> pd.DataFrame:
        of_nodes = of_nodes.sort_values("id")
        if of_nodes.empty:
            return pd.DataFrame({graph: [], "id": [], "rank": []})
        ids = of_nodes["id"].to_numpy()
        known = of_items[of_items["id"].isin(ids)].sort_values("id")
        at = np.searchsorted(ids, known["id"].to_numpy())
        w = np.zeros((len(ids), len(ids)))
        if len(known):
            lists = [pa.array(known[c], pa.list_(t)) for c, t in (("ws", pa.string()), ("xs", pa.float64()), ("ys", pa.float64()))]
            w[np.ix_(at, at)] = np.maximum(product_matrix(*lists), 0.0)
        prior = of_nodes["prior"].to_numpy(float)
        prior = prior / prior.sum() if prior.sum() > 0 else np.full(len(ids), 1.0 / len(ids))
        return pd.DataFrame({graph: key[0], "id": ids, "rank": walk(w, prior)})

    kind = nodes.schema[graph].dataType.simpleString()
    return nodes.select(graph, "id", "prior").groupBy(graph).cogroup(vectors(entries, item, graph).groupBy(graph)).applyInPandas(run, f"{graph} {kind}, id long, rank double")
