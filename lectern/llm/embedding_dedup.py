"""Near-duplicate embeddings by cross-polytope hashing.

Each table rotates the unit vectors by three rounds of random signs and a fast
Hadamard transform, and hashes them to the nearest of the axis directions of
each of ``PARTS`` such rotations. A vector lies in its own bucket and also looks
into those that its runner-up directions name (multiprobe). What meets in a
bucket is compared in double precision; pairs at the threshold or above are
links. Vectors with the same components are one class from the start.

A bucket is split into cells of at most about ``CELL`` x ``CELL`` vectors, each a
group of its own, so a bucket of any size is compared whole and by many tasks.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, mix, slices, written
from .components import components

COSINE = 0.93
TABLES, PARTS, PROBES = 8, 2, 2
CELL = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, divided by its root."""
    n = x.shape[1]
    width = 1
    while width < n:
        y = x.reshape(len(x), n // (2 * width), 2, width)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


def _signs(table: int, part: int, turn: int, n: int) -> np.ndarray:
    seed = np.uint64(table * 1_000_003 + part * 10_007 + turn * 101 + 17)
    return np.where(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(seed[None] if seed.ndim else np.array([seed]))) >> np.uint64(63), 1.0, -1.0)


def buckets(unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, probes): each row's bucket in a table, and ``PROBES`` more that it looks into.

    A probe replaces, in one part, the nearest direction by its runner-up; the
    parts with the least loss come first.
    """
    n = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), n))
    padded[:, : unit.shape[1]] = unit
    best, second, loss = [], [], []
    rows = np.arange(len(unit))
    for part in range(PARTS):
        y = padded
        for turn in range(3):
            y = hadamard(y * _signs(table, part, turn, n))
        size = np.abs(y)
        first = size.argmax(axis=1)
        top = size[rows, first]
        size[rows, first] = -1
        runner = size.argmax(axis=1)
        best.append(2 * first + (y[rows, first] > 0))
        second.append(2 * runner + (y[rows, runner] > 0))
        loss.append(top - size[rows, runner])
    own = np.zeros(len(unit), dtype=np.int64)
    for b in best:
        own = own * (2 * n) + b
    order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
    probes = []
    for k in range(min(PROBES, PARTS)):
        other = np.zeros(len(unit), dtype=np.int64)
        for part in range(PARTS):
            other = other * (2 * n) + np.where(order[:, k] == part, second[part], best[part])
        probes.append(other)
    return own, np.stack(probes, axis=1)


def _classed(batches):
    """Rows with a key of the components' bytes; null, empty, zero and not finite vectors have none."""
    for batch in slices(batches, 4096):
        keys, vectors = [], []
        for v in batch.column(2).to_pylist():
            x = np.array(v if v is not None and all(c is not None for c in v) else [], dtype=np.float64) + 0.0
            fine = len(x) and np.isfinite(x).all() and x.any()
            keys.append(xxhash.xxh3_128_digest(x.tobytes()) if fine else None)
            vectors.append(x.tobytes() if fine else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec", "label", "key", "x"])


def unit_vector(raw: bytes) -> np.ndarray:
    """The vector over its length, scaled first so that no square overflows or vanishes."""
    x = np.frombuffer(raw, dtype=np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _hashed(batches):
    """Each class with its buckets: for every table its own one, then its probes."""
    for batch in slices(batches, 1024):
        raws = batch.column(3).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            by_size.setdefault(len(raw), []).append(i)
        for here in by_size.values():
            units = _units([raws[i] for i in here])
            found = [np.concatenate([own[:, None], probes], axis=1) for own, probes in (buckets(units, t) for t in range(TABLES))]
            at = pa.array(here)
            columns = [batch.column(i).take(at) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([units.shape[1]] * len(here), pa.int32()), pa.array(list(np.concatenate(found, axis=1)), pa.list_(pa.int64()))], names=["node", "label", "n", "x", "size", "buckets"]
            )


def _units(raws: list[bytes]) -> np.ndarray:
    """Unit vectors of rows of equal length."""
    x = np.frombuffer(b"".join(raws), dtype=np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cell:
    """Vectors of a bucket of one table: rows that look in (of one part of the bucket) and rows that are shown (of another, or the same)."""

    def __init__(self, table: int, bucket: int, looks: np.ndarray, shown: np.ndarray, node: np.ndarray, n: np.ndarray, units: np.ndarray, found: np.ndarray) -> None:
        self.table, self.bucket, self.looks, self.shown = table, bucket, np.flatnonzero(looks), np.flatnonzero(shown)
        self.node, self.n, self.units = node, n, units
        by_table = found.reshape(len(node), TABLES, -1)
        self.own, self.probes = by_table[:, :, 0], by_table[:, :, 1:]

    def _near(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place that looks, place that is shown) at the threshold or above."""
        cosine = self.units[i] @ self.units[self.shown].T
        a, b = np.nonzero(cosine >= COSINE - 1e-9)
        close = np.flatnonzero(cosine[a, b] < COSINE + 1e-9)  # a product of matrices adds up in another order
        fine = np.ones(len(a), dtype=bool)
        fine[close] = (self.units[i[a[close]]] * self.units[self.shown[b[close]]]).sum(axis=1) >= COSINE
        return i[a[fine]], self.shown[b[fine]]

    def _first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet here first, so that each pair of vectors counts in one cell alone."""
        own, probes, t = self.own, self.probes, self.table
        home = own[i, t] == own[j, t]  # both at home: the larger node looks; else a probe looks, and the smaller of two such buckets counts
        keep = np.where(home, self.node[i] > self.node[j], ~((probes[j, t] == own[i, t, None]).any(axis=1) & (own[i, t] < self.bucket)))
        for s in range(t):
            keep &= (own[i, s] != own[j, s]) & (probes[i, s] != own[j, s, None]).all(axis=1) & (probes[j, s] != own[i, s, None]).all(axis=1)
        return keep

    def links(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """For each row how many vectors it is linked with here first, and links that connect what those links connect."""
        others, component, joined = np.zeros(len(self.node), dtype=np.int64), np.arange(len(self.node)), []
        for start in range(0, len(self.looks), 128):
            i, j = self._near(self.looks[start : start + 128])
            keep = self._first(i, j)
            i, j = i[keep], j[keep]
            np.add.at(others, i, self.n[j])
            np.add.at(others, j, self.n[i])
            edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for root in np.unique(component[j[a:b]]):
                    if root != component[i[a]]:
                        other = j[a:b][component[j[a:b]] == root][0]
                        joined.append((int(self.node[i[a]]), int(self.node[other])))
                        component[component == root] = component[i[a]]
        return others, joined


def _compare(batches):
    """Of all cells, rows (u, v, null) that link and rows (u, null, others) that count; rows come sorted by cell, and a cell may span batches."""
    names = ["u", "v", "others"]

    def done(columns: list, a: int, b: int) -> list[tuple]:
        keys, looks, shown, node, n, raws, found = columns
        cell = Cell(int(keys[a, 2]), int(keys[a, 3]), looks[a:b], shown[a:b], node[a:b], n[a:b], _units(raws[a:b]), np.stack(found[a:b]))
        others, joined = cell.links()
        return [(max(u, v), min(u, v), None) for u, v in joined] + [(int(cell.node[k]), None, int(others[k])) for k in np.flatnonzero(others)]

    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [
            np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1),
            *(batch.column(i).to_numpy(zero_copy_only=False) for i in (6, 7, 8, 9)), batch.column(10).to_pylist(), [x.values.to_numpy() for x in batch.column(11)],
        ]
        if held is not None:
            now = [a + b if isinstance(a, list) else np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        keys = now[0]
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]).tolist()
        out = [row for a, b in pairwise(edges) if b - a > 1 for row in done(now, a, b)]
        held = [c[edges[-1] :] for c in now]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=names)
    if held is not None and len(held[0]) > 1 and (out := done(held, 0, len(held[0]))):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=names)


def compared(classes: DataFrame) -> DataFrame:
    """(u, v, others) from classes (node, label, n, x): links that connect all that are linked, and counts of linked vectors to be summed.

    Each pair is counted in the first table and bucket in which it meets; a cell
    gives back at most a count and a link for each of its rows.
    """
    schema = "node long, label long, n long, x binary, size int, buckets array<long>"
    hashed = written(classes.select("node", F.col("label").cast("long").alias("label"), "n", "x").mapInArrow(_hashed, schema), "buckets")
    place = ["label", "size", "tab", "bucket"]
    per_table = 1 + min(PROBES, PARTS)
    each = hashed.select("node", "label", "size", F.posexplode("buckets").alias("at", "bucket"))
    placed = each.select("node", "label", "size", F.floor(F.col("at") / per_table).cast("int").alias("tab"), "bucket", (F.col("at") % per_table == 0).alias("home"))
    sizes = placed.groupBy(*place).agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("home"), 1)).alias("homes")).where("c > 1 and homes > 0").drop("homes")
    total = hashed.count() * TABLES * per_table
    parts = F.ceil(F.col("c") / CELL).cast("int")
    rows = meet(placed, sizes.withColumn("parts", parts), place, "c", total).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # rows of each part look into each part: a row goes along its line of the grid, a home row down its column too
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same = F.col("part") == F.col("other")
    looks = dealt.select(*place, F.col("part").alias("r"), F.col("other").alias("c"), F.lit(True).alias("looks"), (F.col("home") & same).alias("shown"), "node")
    shown = dealt.where(F.col("home") & ~same).select(*place, F.col("other").alias("r"), F.col("part").alias("c"), F.lit(False).alias("looks"), F.lit(True).alias("shown"), "node")
    cells = looks.unionByName(shown).join(hashed.select("node", "n", "x", "buckets"), "node").select(*place, "r", "c", "looks", "shown", "node", "n", "x", "buckets")
    return cells.repartition(*place, "r", "c").sortWithinPartitions(*place, "r", "c").mapInArrow(_compare, "u long, v long, others long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: key, n_links, component_id, kept.

    Vectors are compared where their labels are equal and not null, and linked
    from a cosine of ``COSINE`` on. Vectors that are null, empty, zero or hold
    nulls or non-finite components link with nothing, nor do vectors of
    different lengths. Copies link with each other and with the same others.
    component_id is the smallest key reachable (nulls last), kept says whether it
    is the row's own. Rows that repeat a key are vectors of their own. Other
    columns are not read.
    """
    source = vectors.select(F.col(key).cast("long").alias("vec"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = written(source.mapInArrow(_classed, "vec long, label long, key binary, x binary"), "vectors")
    fine = rows.where("key is not null and label is not null")
    classes = written(
        fine.groupBy("label", "key").agg(F.min("vec").alias("first"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    found = written(compared(classes), "links")
    component = components(found.where("v is not null").select("u", "v"))
    others = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("others").alias("others"))
    placed = classes.drop("x").join(others, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "component").select(
        F.col("label").alias("l"), F.col("key").alias("k"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"
    )
    out = rows.drop("x").join(known, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    own = F.coalesce("component_id", "vec")
    return out.select(F.col("vec").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec").eqNullSafe(own).alias("kept"))
