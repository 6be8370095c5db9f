"""Ranked lexical search over a tiered index: postings of high impact first, lower ones only where they may matter.

Documents are indexed in segments. A segment's postings lie in tiers, one column
for each, so a search that needs upper tiers alone reads no byte of the others. A
posting's tier follows from its impact among all of its term's: an upper tier
holds the term's best share. For each tier a term has a residual bound, the
largest impact below it. A search adds up what the upper tiers say, which bounds
every document's score from below, and with the residuals of the terms not seen
from above. Where ten documents reach more than any unseen one could, the item is
proven, and only documents whose upper bound reaches the tenth are scored in full.
Items without that proof fall through to the next tier, at last to all postings,
so every answer is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, made, numbered, slices, written

TOP = 10
#: Documents of a segment (at most 65,536).
SEGMENT = 1024
#: An upper tier holds the best buckets of a term's postings up to this share of them; and up to ``LEAST`` in any case.
SHARES = (1 / 64, 1 / 8)
LEAST = 1000
#: Impacts are below a million; the shares are cut at so many steps of it.
BUCKETS, BUCKET = 64, 15_625
#: Items that one index serves, items and terms that are multiplied at a time, and cells of a matrix.
BLOCK_ITEMS, ITEMS, TERMS, CELLS = 10_000, 256, 4096, 1 << 22

#: Term bytes stay (A-Z in lower case); all others of the first 128 are separators.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PIECE = 1 << 20


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text as UTF-8, in order, some at a time."""
    data = (text or "").encode("utf-8", "replace").translate(_FOLD)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass
class Queries:
    """A block of items: how often each holds each term."""

    ids: list[object]
    terms: list[Counter[int]]
    number: dict[bytes, int]

    @staticmethod
    def of(rows: list) -> Queries:
        number: dict[bytes, int] = {}
        terms = [Counter(number.setdefault(t, len(number)) for some in terms_of(text) for t in some) for _, text in rows]
        return Queries([r[0] for r in rows], terms, number)

    def blocks(self, only: list[int]) -> Iterator[tuple[list[int], np.ndarray]]:
        """The items ``only`` in groups of few terms: (items, terms)."""
        now: list[int] = []
        seen: set[int] = set()
        for i in only:
            if now and (len(now) >= ITEMS or len(seen | self.terms[i].keys()) > TERMS):
                yield now, np.array(sorted(seen), dtype=np.int64)
                now, seen = [], set()
            now.append(i)
            seen |= self.terms[i].keys()
        if now:
            yield now, np.array(sorted(seen), dtype=np.int64)


def _packed(term: np.ndarray, local: np.ndarray, value: np.ndarray) -> bytes:
    """Postings sorted by term as bytes."""
    terms, sizes = np.unique(term, return_counts=True)
    head = np.array([len(terms), len(term)], dtype=np.int32)
    return b"".join(x.tobytes() for x in (head, terms.astype(np.int32), sizes.astype(np.int32), value.astype(np.int32), local.astype(np.uint16)))


def _unpacked(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, local, value) of each posting."""
    k, n = np.frombuffer(data, np.int32, 2)
    terms, sizes = np.frombuffer(data, np.int32, k, 8), np.frombuffer(data, np.int32, k, 8 + 4 * k)
    value, local = np.frombuffer(data, np.int32, n, 8 + 8 * k), np.frombuffer(data, np.uint16, n, 8 + 8 * k + 4 * n)
    return np.repeat(terms, sizes), local, value


def _forward(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Segments of documents that hold any of the terms: (docs, sizes, postings, n_docs, n_terms).

    n_docs and n_terms count all documents with a term, and their terms; sizes
    are terms for each document, and the value of a posting is its count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        keys, sizes, held = [], [], []
        n_docs = n_terms = 0

        def segment() -> pa.RecordBatch:
            local = np.repeat(np.arange(len(held)), [len(t) for t, _ in held])
            term = np.concatenate([t for t, _ in held]) if held else np.zeros(0, np.int32)
            count = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            row = [[keys], [np.array(sizes, np.int64).tobytes()], [_packed(term[order], local[order], count[order])], [n_docs], [n_terms]]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["docs", "sizes", "postings", "n_docs", "n_terms"])

        for batch in slices(batches, 64):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = 0, []
                for some in terms_of(text):
                    n += len(some)
                    ids = np.fromiter(map(get, some, repeat(-1)), np.int32, len(some))
                    found.append(ids[ids >= 0])
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                term, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                if len(term):
                    keys.append(key)
                    sizes.append(n)
                    held.append((term, count))
                if len(held) == SEGMENT:
                    yield segment()
                    keys, sizes, held, n_docs, n_terms = [], [], [], 0, 0
        if n_docs:
            yield segment()

    plain, _ = numbered(docs)
    return plain.select(F.col("c0").cast("long").alias("doc"), "c1").mapInArrow(run, "docs array<long>, sizes binary, postings binary, n_docs long, n_terms long")


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """Documents for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                df += np.bincount(_unpacked(data.as_buffer())[0], minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in forward.select("postings").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row for each term of the items
        out[r.term] = r.df
    return out


def _impacts(count: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * docs) // terms
    count = count.astype(np.int64)
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def _cuts(forward: DataFrame, size: int, docs: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(tier, term) arrays: the lowest bucket that each upper tier takes, and the largest impact below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, top = np.zeros(size * BUCKETS, np.int64), np.zeros(size * BUCKETS, np.int64)
        for batch in batches:
            for lengths, data in zip(batch.column(0), batch.column(1), strict=True):
                term, local, count = _unpacked(data.as_buffer())
                value = _impacts(count, np.frombuffer(lengths.as_buffer(), np.int64)[local], docs, terms)
                at = term * BUCKETS + value // BUCKET
                seen += np.bincount(at, minlength=len(seen))
                np.maximum.at(top, at, value)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS), pa.array(at % BUCKETS), pa.array(seen[at]), pa.array(top[at])], names=["term", "bucket", "n", "top"])

    summed = forward.select("sizes", "postings").mapInArrow(run, "term long, bucket long, n long, top long").groupBy("term", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    above = Window.partitionBy("term").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = summed.withColumn("upto", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("term")))
    columns = []
    for t, share in enumerate(SHARES):
        takes = F.col("upto") <= F.greatest(F.lit(float(LEAST)), share * F.col("all"))
        columns += [F.coalesce(F.min(F.when(takes, F.col("bucket"))), F.lit(BUCKETS)).alias(f"cut{t}"), F.coalesce(F.max(F.when(~takes, F.col("top"))), F.lit(0)).alias(f"below{t}")]
    cut, below = np.full((len(SHARES), size), BUCKETS, np.int64), np.zeros((len(SHARES), size), np.int64)
    for r in ranked.groupBy("term").agg(*columns).collect():  # one row for each term of the items
        for t in range(len(SHARES)):
            cut[t, r.term], below[t, r.term] = r[f"cut{t}"], r[f"below{t}"]
    return cut, below


def _tiered(forward: DataFrame, cut: np.ndarray, docs: int, terms: int) -> DataFrame:
    """The index: (docs, t0, t1, ...), a column of packed postings for each tier; their value is the impact."""
    names = [f"t{t}" for t in range(len(SHARES) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            term, local, count = _unpacked(batch.column(2)[0].as_buffer())
            value = _impacts(count, np.frombuffer(batch.column(1)[0].as_buffer(), np.int64)[local], docs, terms)
            tier = (value // BUCKET < cut[:, term]).sum(axis=0)
            parts = [pa.array([_packed(*(x[tier == t] for x in (term, local, value)))], pa.binary()) for t in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["docs", *names])

    return forward.select("docs", "sizes", "postings").mapInArrow(run, "docs array<long>, " + ", ".join(f"{n} binary" for n in names))


@dataclass
class Block:
    """Items that are scored together over one segment: which terms they have, and what these weigh."""

    items: list[int]
    column: np.ndarray
    weight: np.ndarray
    residual: list[np.ndarray]

    def matrices(self, tiers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(locals, impacts by local and term) of documents that have a posting in the tiers, some documents at a time."""
        kept = []
        for term, local, value in tiers:
            at = self.column[term]
            mine = at >= 0
            kept.append((local[mine].astype(np.int64), at[mine], value[mine]))
        local, at, value = (np.concatenate(x) for x in zip(*kept, strict=True))
        some, place = np.unique(local, return_inverse=True)
        step = max(1, CELLS // self.weight.shape[0])
        for start in range(0, len(some), step):
            inside = (place >= start) & (place < start + step)
            out = np.zeros((min(step, len(some) - start), self.weight.shape[0]))
            out[place[inside] - start, at[inside]] = value[inside]
            yield some[start : start + step], out if self.weight.dtype == np.float64 else out.astype(np.int64).astype(object)


def _blocks(queries: Queries, only: list[int], weights: np.ndarray, below: np.ndarray) -> list[Block]:
    """Integer sums stay exact in doubles: where an item's could reach 2**53, its block is kept in Python's own integers."""
    out = []
    for items, terms in queries.blocks(only):
        column = np.full(len(queries.number), -1, np.int64)
        column[terms] = np.arange(len(terms))
        count = np.zeros((len(terms), len(items)))
        for j, i in enumerate(items):
            for t, n in queries.terms[i].items():
                count[column[t], j] = n
        weight = count * weights[terms][:, None]
        if weight.sum(axis=0).max() * 1_000_000 >= 2.0**53:
            weight = weight.astype(np.int64).astype(object)
        out.append(Block(items, column, weight, [weight * b[terms][:, None] for b in below]))
    return out


def _lower_bounds(index: DataFrame, blocks: list[Block], depth: int) -> dict[int, int]:
    """For each item the tenth largest sum over the tiers up to ``depth``; 0 if fewer documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in slices(batches, 1):
            tiers = [_unpacked(batch.column(t)[0].as_buffer()) for t in range(depth + 1)]
            for block in blocks:
                for _, impacts in block.matrices(tiers, depth):
                    sums = impacts @ block.weight
                    for j, i in enumerate(block.items):
                        some = np.concatenate([best.get(i, sums[:0, j]), sums[:, j]])
                        best[i] = np.sort(some)[-TOP:]
        rows = [(i, int(s)) for i, some in best.items() for s in some if s > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["item", "score"])

    found = index.select(*(f"t{t}" for t in range(depth + 1))).mapInArrow(run, "item long, score long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= TOP)
    tenth = ranked.groupBy("item").agg(F.min("score").alias("score"), F.max("r").alias("r")).where(F.col("r") == TOP)
    return {r["item"]: r["score"] for r in tenth.collect()}  # at most one row for each item


def _exact(index: DataFrame, groups: list[tuple[int, list[Block]]], tenth: dict[int, int]) -> DataFrame:
    """(item, doc, score): the best ten documents of each item from each task. ``groups``: blocks by the tier whose bounds prove them."""
    last = len(SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}

        def offer(items: list[int], keys: np.ndarray, null: np.ndarray, sums: np.ndarray, bound: np.ndarray) -> None:
            for j, i in enumerate(items):
                rows = np.flatnonzero((bound[:, j] >= tenth.get(i, 0)) & (sums[:, j] > 0))
                if len(rows) > TOP:
                    score = sums[rows, j]
                    rows = rows[score >= np.partition(score, len(rows) - TOP)[len(rows) - TOP]]
                if len(rows):
                    some = [(-int(sums[r, j]), bool(null[r]), int(keys[r])) for r in rows]
                    best[i] = sorted(best.get(i, []) + some)[:TOP]

        for batch in slices(batches, 1):
            docs = batch.column(0)[0].values
            keys, null = docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
            tiers = [_unpacked(batch.column(t + 1)[0].as_buffer()) for t in range(last + 1)]
            for depth, blocks in groups:
                for block in blocks:
                    if depth == last:
                        for local, impacts in block.matrices(tiers, last):
                            sums = impacts @ block.weight
                            offer(block.items, keys[local], null[local], sums, sums)
                        continue
                    for local, impacts in block.matrices(tiers[: depth + 1], depth):
                        residual = block.residual[depth]
                        bound = impacts @ block.weight + residual.sum(axis=0) - (impacts > 0).astype(residual.dtype) @ residual
                        rows = np.flatnonzero((bound >= np.array([tenth.get(i, 0) for i in block.items])).any(axis=1))
                        if not len(rows):
                            continue
                        place = np.full(len(docs), -1, np.int64)
                        place[local[rows]] = np.arange(len(rows))
                        whole = np.zeros((len(rows), block.weight.shape[0]), dtype=impacts.dtype)
                        for term, where, value in tiers:
                            mine = (place[where] >= 0) & (block.column[term] >= 0)
                            whole[place[where[mine]], block.column[term[mine]]] = value[mine]
                        offer(block.items, keys[local[rows]], null[local[rows]], whole @ block.weight, bound[rows])
        rows = [(i, None if null else key, -score) for i, some in best.items() for score, null, key in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def _search(docs: DataFrame, rows: list, kind: str) -> DataFrame:
    spark, queries = docs.sparkSession, Queries.of(rows)
    size = len(queries.number)
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, depth int")
    if not size:
        return empty
    mark = made()
    forward = written(_forward(docs, queries.number), "forward")
    total = forward.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not total.terms:
        return empty
    df = _frequencies(forward, size)
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.float64)
    cut, below = _cuts(forward, size, total.docs, total.terms)
    index = written(_tiered(forward, cut, total.docs, total.terms), "index")
    drop_scratch(spark, mark, mark + 1)  # the index has all that the segments had
    left, tenth, groups, depth_of = [i for i, t in enumerate(queries.terms) if t], {}, [], {}
    for depth in range(len(SHARES)):
        if not left:
            break
        blocks = _blocks(queries, left, weights, below)
        tenth |= _lower_bounds(index, blocks, depth)
        unseen = {i: int(block.residual[depth][:, j].sum()) for block in blocks for j, i in enumerate(block.items)}
        proven = [i for i in left if unseen[i] < tenth.get(i, 1)]
        groups.append((depth, _blocks(queries, proven, weights, below)))
        depth_of |= dict.fromkeys(proven, depth)
        left = [i for i in left if i not in depth_of]
    groups.append((len(SHARES), _blocks(queries, left, weights, below)))
    found = _exact(index, [g for g in groups if g[1]], tenth)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    names = spark.createDataFrame([(i, k, depth_of.get(i, len(SHARES))) for i, k in enumerate(queries.ids)], f"item long, item_id {kind}, depth int")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score", "depth")  # the items of this block


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score, depth): the ten best documents of each item, exactly; depth is the lowest tier that its proof needed.

    Terms are runs of letters and digits, and of all characters above the first
    128, with A-Z in lower case. A document's score sums its impacts times the
    terms' weights over the item's terms, repeats included; all in integers but
    the weight's logarithm. Equal scores are in order of key, null last.

    Documents with null or empty texts have no terms and are not counted. Items
    without terms, or whose terms no document has, give no rows; rows that
    repeat an item's id are items of their own, and so are rows that repeat a
    document. Other columns are not read; empty tables give no rows.

    The items are the query set: they are read at the driver in blocks of
    ``BLOCK_ITEMS``, and each block has an index of all documents for its terms.
    Documents' texts are read once for each block. Tasks pass on ten rows for
    each item, and the driver gets counts by term and bounds by item.
    """
    plain, _ = numbered(items.select(item, item_text))
    kind, rows, out = plain.schema["c0"].dataType.simpleString(), plain.toLocalIterator(), None
    while block := list(islice(rows, BLOCK_ITEMS)):
        found = _search(docs.select(key, text), block, kind)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, depth int") if out is None else out
