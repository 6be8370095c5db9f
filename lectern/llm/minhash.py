"""Near-duplicate documents by BagMinHash signatures of five-word shingles.

A document is the multiset of its shingles. Each shingle owns Poisson processes,
one for each dyadic block of weights [0,1), [1,2), [2,4), ...; a block's process
has the block's length as its rate, and a point counts where its weight level
lies under the shingle's count. Every point falls on one of ``REGISTERS``
registers, and a register keeps its earliest point: two documents share it with
the probability of their weighted Jaccard similarity, without bias (Ertl, 2018).
Points are made in order of time and only as far as the registers still change.

Bands of registers bring candidates together, and the multisets of each
candidate pair are compared exactly. Documents with the same words are one class
from the start, so a group of copies is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, chained, meet, mix, numbered, slices, text_of, word_hashes, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a text and their counts; a text of fewer words has one shingle of all of them."""
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    width = min(SHINGLE, len(words))
    return np.unique(chained(words, range(width), len(words) - width + 1), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of ``REGISTERS`` values for each multiset (shingle hashes, counts); no multiset may be empty.

    A value holds the time and the identity of its point, so equal values mean
    the same point of the same process.
    """
    full = np.uint64((1 << 64) - 1)
    out = np.full((len(sets), REGISTERS), full, dtype=np.uint64)
    seeds, tops, rates, lows, owner = [], [], [], [], []
    for k, (hashes, counts) in enumerate(sets):
        low = 0
        while True:  # the blocks [0,1), [1,2), [2,4), ... that reach under the counts
            here = counts > low
            if not here.any():
                break
            length = max(1, low)
            seeds.append(mix(hashes[here] ^ np.uint64(0xA0761D6478BD642F + low)))
            tops.append(counts[here].astype(np.float64))
            n = int(here.sum())
            rates.append(np.full(n, float(length)))
            lows.append(np.full(n, float(low)))
            owner.append(np.full(n, k))
            low += length
    if not seeds:
        return out
    seed, top, rate, low, owner = map(np.concatenate, (seeds, tops, rates, lows, owner))
    time, points = np.zeros(len(seed)), np.zeros(len(seed), dtype=np.uint64)
    mass = np.bincount(owner, weights=np.minimum(rate, top - low), minlength=len(sets))
    limit = REGISTERS * (np.log(REGISTERS) + 4) / np.maximum(mass, 1e-9)
    flat, alive, waiting = out.reshape(-1), np.arange(len(seed)), np.zeros(0, dtype=np.int64)
    while True:
        while len(alive):
            drawn = mix(seed[alive] + np.uint64(0x9E3779B97F4A7C15) * (points[alive] + np.uint64(1)))
            at = time[alive] - np.log(_uniform(drawn)) / rate[alive]
            soon = at <= limit[owner[alive]]
            waiting = np.concatenate([waiting, alive[~soon]])
            alive, drawn, at = alive[soon], drawn[soon], at[soon]
            time[alive] = at
            points[alive] += np.uint64(1)
            under = low[alive] + rate[alive] * _uniform(mix(drawn ^ np.uint64(0x8BB84B93962EACC9))) < top[alive]
            chosen = mix(drawn[under] ^ np.uint64(0x2D358DCCAA6C78A5))
            place = owner[alive[under]] * REGISTERS + (chosen % np.uint64(REGISTERS)).astype(np.int64)
            stamp = at[under].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(flat, place, (stamp << np.uint64(32)) | (chosen >> np.uint64(32)))
        empty = (out == full).any(axis=1)
        if not empty.any():
            return out
        limit[empty] *= 2  # a register without a point: each process goes on from where it stopped
        again = empty[owner[waiting]]
        alive, waiting = waiting[again], waiting[~again]


def _bands(signature: np.ndarray) -> np.ndarray:
    """Rows of ``BANDS`` hashes, each of its band's registers and number."""
    split = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), split.shape[:2]).copy()
    for i in range(ROWS):
        out = mix((out + split[:, :, i]) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _key(words: np.ndarray, text: str) -> bytes | None:
    """The same for texts with the same words; texts without words have one by their characters, blank texts none."""
    if len(words):
        return xxhash.xxh3_128_digest(words.tobytes())
    return xxhash.xxh3_128_digest(b"text" + text.encode("utf-8", "surrogatepass")) if text.strip() else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in slices(batches, 32):
        texts = [t or "" for t in batch.column(3).to_pylist()]
        words = [word_hashes(t, cache) for t in texts]
        with_words = [i for i, w in enumerate(words) if len(w)]
        bands: list = [None] * len(texts)
        if with_words:
            for i, b in zip(with_words, _bands(signatures([shingles(words[i]) for i in with_words])), strict=True):
                bands[i] = b
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([_key(w, t) for w, t in zip(words, texts, strict=True)], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["row", "doc", "th", "key", "bands"],
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each multiset as a set of 64-bit hashes of (shingle, occurrence)."""
    cache = WordHash()
    for batch in slices(batches, 64):
        out = []
        for text in batch.column(1).to_pylist():
            hashes, counts = shingles(word_hashes(text, cache))
            each = np.repeat(hashes, counts)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(np.unique(mix(each + np.uint64(0x9E3779B97F4A7C15) * nth.astype(np.uint64))).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), batch.column(2)], names=["node", "elements", "bands"])


def _verified(pairs: DataFrame, elements: DataFrame, total: int) -> DataFrame:
    """The pairs (u, v), at most ``total``, whose weighted Jaccard similarity is at least ``SIMILARITY``.

    v may be in most pairs: its elements then go to as many parts as hold
    ``CELL_MEMBERS`` pairs each.
    """
    counts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", F.ceil(F.col("c") / CELL_MEMBERS).cast("int"))
    placed = meet(pairs, counts, ["v"], "c", total).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).drop("parts")
    side = lambda c: elements.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}"), F.size("elements").alias(f"n{c}"))
    pivot = side("v").join(counts.select("v", "parts"), "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = placed.join(side("u"), "u").join(pivot, ["v", "part"]).where(F.least("nu", "nv") >= SIMILARITY * F.greatest("nu", "nv"))
    shared = F.size(F.array_intersect("eu", "ev"))
    return both.where(shared >= SIMILARITY * (F.col("nu") + F.col("nv") - shared)).select("u", "v")


def compare_cell(bands: np.ndarray, band: int, elements: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (places of two members) that connect the components of a cell as all its links of ``left`` with ``right`` would.

    Pairs in one component are not compared, nor are pairs that an earlier band
    brings together, for that band's bucket compares them. A member is held
    against all others at once: its elements are marked, and the marks under each
    other member's elements are summed.
    """
    sizes = np.array([len(e) for e in elements])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.unique(np.concatenate(elements), return_inverse=True)[1].reshape(-1)
    marked = np.zeros(codes.max() + 1, dtype=bool)
    component, out = component.copy(), []
    both = bool((left & right).any())
    for i in np.flatnonzero(left):
        other = right & (component != component[i])
        other &= (np.minimum(sizes, sizes[i]) >= SIMILARITY * np.maximum(sizes, sizes[i]))
        if both:
            other[: i + 1] = False
        at = np.flatnonzero(other)
        if len(at):
            at = at[~(bands[at, :band] == bands[i, :band]).any(axis=1)]
        if not len(at):
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        if len(at) * 4 < len(sizes):
            shared = np.array([int(marked[codes[starts[j] : starts[j] + sizes[j]]].sum()) for j in at])
        else:
            shared = np.add.reduceat(marked[codes], starts)[at]
        marked[own] = False
        for j in at[shared >= SIMILARITY * (sizes[i] + sizes[at] - shared)]:
            if component[j] != component[i]:
                out.append((int(i), int(j)))
                component[component == component[j]] = component[i]
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all cells; rows come sorted by cell, and a cell may span batches."""
    names = ["bucket", "r", "c", "band", "part", "node", "component", "bands", "elements"]

    def done(rows: list[tuple]) -> list[tuple[int, int]]:
        _, r, c, band = rows[0][:4]
        part = np.array([x[4] for x in rows])
        found = compare_cell(np.array([x[7] for x in rows]), band, [x[8] for x in rows], np.array([x[6] for x in rows]), part == r, part == c)
        return [(max(rows[i][5], rows[j][5]), min(rows[i][5], rows[j][5])) for i, j in found]

    cell: tuple | None = None
    rows: list[tuple] = []
    for batch in slices(batches, 1024):
        links: list[tuple[int, int]] = []
        simple = [batch.column(names.index(n)).to_pylist() for n in names[:7]]
        arrays = [batch.column(i) for i in (7, 8)]
        for k, values in enumerate(zip(*simple, strict=True)):
            if values[:3] != cell:
                if len(rows) > 1:
                    links += done(rows)
                cell, rows = values[:3], []
            rows.append((*values, arrays[0][k].values.to_numpy(), arrays[1][k].values.to_numpy()))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])
    if len(rows) > 1 and (links := done(rows)):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])


#: A cell compares at most about so many members, with so many elements, with as many others.
CELL_MEMBERS, CELL_ELEMENTS = 1024, 2_000_000


def _links(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes as all verified pairs within the buckets of ``members`` (bucket, band, node).

    First every member is held against one pivot of its bucket; this connects
    most groups. Buckets of three or more that still have members in several
    components are then compared whole, each pair once, in cells of bounded size.
    Cells give back only links that connect something: fewer than they have
    members.
    """
    total = members.count()
    pivots = members.groupBy("bucket").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n"))
    pairs = meet(members, pivots, ["bucket"], "n", total).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    links = written(_verified(pairs, elements, total), "links")
    placed = members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = elements.select("node", F.size("elements").alias("size"))
    several = placed.join(size, "node").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = F.greatest(F.ceil(F.col("n") / CELL_MEMBERS), F.ceil(F.col("size") / CELL_ELEMENTS)).cast("int")
    open_ = several.where("n > 2 and low <> high").select("bucket", "n", parts.alias("parts"))
    dealt = meet(placed, open_, ["bucket"], "n", total).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select("bucket", F.least("part", "other").alias("r"), F.greatest("part", "other").alias("c"), "band", "part", "node", "component")
    full = cells.join(elements, "node").select("bucket", "r", "c", "band", "part", "node", "component", "bands", "elements")
    more = full.repartition("bucket", "r", "c").sortWithinPartitions("bucket", "r", "c", "node").mapInArrow(_cells, "u long, v long")
    return links.union(written(more, "more-links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: row, doc, th (hash of the text), class_id, n_class (rows in it), kept.

    A class holds what links of similarity >= 0.8 connect; class_id is its
    smallest key (nulls last) and exactly one row of it, one with that key, is
    kept. Words are white-space tokens in lower case without punctuation at
    their ends. Texts without words are grouped if they are equal; blank and null
    texts are in no group: each is a class by itself under its own key. Rows
    that repeat another row are copies of it. Other columns are not read.
    """
    whole = text_of(text)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc"), F.xxhash64(whole).alias("th"), whole.alias("text"))
    rows = written(source.mapInArrow(_sign, "row long, doc long, th long, key binary, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc").alias("doc"), "th", "row")).alias("first")
    copies = rows.where("key is not null").groupBy("key").agg(first, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    classes = written(copies.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = written(meet(banded, shared, ["bucket"], "c", BANDS * classes.count()), "members")
    needed = members.select("node").distinct().join(classes.select("node", F.col("first.doc").alias("d"), F.col("first.th").alias("t"), "bands"), "node")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole).alias("th"), whole.alias("text"))
    found = texts.join(needed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("node", "text", "bands")
    elements = written(found.mapInArrow(_elements, "node long, elements array<long>, bands array<long>").dropDuplicates(["node"]), "elements")

    component = components(_links(members, elements))
    joined = classes.select("node", "key", "first", "n").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = joined.groupBy("component").agg(F.min("first").alias("head"), F.sum("n").alias("n_class"))
    heads = joined.join(grouped, "component").select("key", "head", "n_class", "n")
    plain = rows.drop("bands")
    known = meet(plain.where("key is not null"), heads, ["key"], "n", rows.count())
    out = known.unionByName(plain.where("key is null"), allowMissingColumns=True)
    return out.select(
        "row", "doc", "th",
        F.when(F.col("head").isNull(), F.col("doc")).otherwise(F.col("head.doc")).alias("class_id"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
        F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``, all columns as they were, whatever their names."""
    found = near_duplicates(docs, key, text).select("doc", "th", "kept")
    lost = written(found.where(~F.col("kept")).select("doc", "th"), "lost")
    kept = found.where("kept").select(F.col("doc").alias("d"), F.col("th").alias("t"))
    repeated = written(lost.join(kept, lost["doc"].eqNullSafe(kept["d"]) & (lost["th"] == kept["t"]), "left_semi").distinct(), "repeated")
    rows, names = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    marked = rows.withColumn("own", F.xxhash64(text_of(at[text])))
    same = lambda other: F.col(at[key]).cast("long").eqNullSafe(other["doc"]) & (F.col("own") == other["th"])
    once = marked.join(lost, same(lost), "left_anti")
    if not repeated.isEmpty():  # rows that repeat a kept row's key and text: one of each stays
        once = once.unionByName(marked.join(repeated, same(repeated), "left_semi").dropDuplicates([at[key], "own"]))
    return once.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
