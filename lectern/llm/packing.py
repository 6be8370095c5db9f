"""Best-fit decreasing packing of documents into sequences.

Lengths are whole numbers up to the capacity, so what best-fit decreasing does
depends only on how many pieces there are of each length. Those counts (at most
``capacity`` numbers) go to the driver; there a segment tree over remaining
capacities finds the tightest open sequence for each length in logarithmic time,
taking runs of equal pieces and equal sequences in one step. The plan is a small
table of runs, each piece finds its place in it by its rank among the pieces of
its length, and the ids of the pieces never move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encoder

END = 2


class Tightest:
    """A segment tree over the capacities 0..capacity that counts the open sequences with each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += count
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``rank`` .. of one length: ``each`` in turn go into every sequence from ``sequence`` on, the first at ``offset``."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs in order of (length, rank), and the number of sequences.

    The same sequences as taking the pieces one by one, longest first: once a
    piece of length l is in the tightest sequence, with r left, that sequence
    stays the tightest for l as long as r >= l, so it takes r // l pieces in turn.
    """
    tree = Tightest(capacity)
    free: dict[int, list[list[int]]] = defaultdict(list)  # by remaining capacity: [first sequence, how many]
    made, runs = 0, []

    def open_again(left: int, first: int, many: int) -> None:
        if left and many:
            free[left].append([first, many])
            tree.add(left, many)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.find(length)
            if left is None:
                left, first, many = capacity, made, -(-todo // (capacity // length))
                made += many
            else:
                first, many = free[left].pop()
                tree.add(left, -many)
            each = left // length
            full = min(many, todo // each)
            if full:
                runs.append(Run(length, rank, first, each, capacity - left))
                open_again(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            rest = 0
            if full < many and todo:
                rest = min(todo, each)
                runs.append(Run(length, rank, first + full, each, capacity - left))
                open_again(left - rest * length, first + full, 1)
                rank, todo = rank + rest, todo - rest
            open_again(left, first + full + bool(rest), many - full - bool(rest))
    return sorted(runs, key=lambda r: (r.length, r.rank)), made


_PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, rank long"


def _cut(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "rank")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for k, v in (("doc_id", doc), ("piece", piece), ("start", a), ("length", b - a), ("ids", ids[a:b].tobytes()), ("task", task), ("rank", seen[b - a])):
                        out[k].append(v)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("task", pa.int32()), ("rank", pa.int64()))],
                names=list(out),
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (binary, little-endian uint32), ids_crc32, sequence_id, offset.

    A document is its ids and the id ``end``; a null or empty text is that id
    alone. A longer document is cut into pieces of ``capacity`` ids, of which the
    first may be shorter. Pieces that fill a sequence have one each, with a
    negative number; the others are packed by best-fit decreasing over all of
    them and numbered from 0. Repeated rows and null keys are documents of their
    own. Other columns are not read.

    The pieces are written once, with their rank among the pieces of the same
    length in their task. Ranks over the corpus follow from prefix sums of the
    tasks' counts, joined by (task, length).
    """
    spark = docs.sparkSession
    pieces = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(tokenizer, capacity, end), _PIECES), "pieces")
    by_task = pieces.where(F.col("length") < capacity).groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under ``capacity`` rows
    runs, _ = best_fit_decreasing(counts, capacity)
    by_length: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_length[run.length].append(run)
    table = [(n, [(r.rank, r.sequence, r.each, r.offset) for r in rs]) for n, rs in by_length.items()]
    plan = spark.createDataFrame(table, "length int, runs array<struct<rank:long,sequence:long,each:int,offset:int>>")

    summed = pieces.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "task", "rank")
    whole = summed.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (-1 - (F.shiftleft(F.col("task").cast("long"), 36) + F.col("rank"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    ranked = summed.where(F.col("length") < capacity).join(offsets.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan's size depends on ``capacity`` alone: at most that many rows, and runs by the lengths, not by the pieces
    found = ranked.join(F.broadcast(plan), "length").withColumn("run", F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1))
    step = F.col("rank") - F.col("run.rank")
    placed = found.select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (F.col("run.sequence") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + (step % F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )
    return whole.unionByName(placed).withColumn("length", F.col("length").cast("long"))
