"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; positions that the mask leaves
out may differ. Hashes of all masked windows of the benchmark are a table, and
the hashes of the documents' windows are joined against it; item and document
are laid side by side around each hit and compared word by word, so substituted
words are tolerated wherever they stand. No overlap is missed: a stretch of n
words with at most n // 5 others holds five consecutive words with at most one
other, and the masks hit all of these; items of under five words must be there
as they are, and have one mask of all their words.

Documents are read once, whatever the size of the benchmark: a bit filter of
bounded size over the benchmark's seeds tells which hashes of a document can be
in the join, and only those and the word hashes of their documents go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, chained, mix, numbered, slices, text_of, word_hashes, written

#: Positions that count (1) and that may differ (0).
MASKS = ("1111", "10111", "11011", "11101")
#: Items of fewer words than this have one mask of all their words.
TOLERANT = 5
#: An overlap has at least so many words (or the whole item) of which at least SAME_PERCENT are the same in place.
LEAST_WORDS = 13
SAME_PERCENT = 80
#: So many seeds at least lie in every overlap of LEAST_WORDS or more words, wherever the other words stand
#: (an overlap of 26 or more words holds one of 13 to 25; for those all placements are enumerated in the tests).
LEAST_SEEDS = 6
#: The filter has at most so many bits (16 MB); it is probed up to PROBES times for each hash.
FILTER_BITS = 1 << 27
PROBES = 3
#: Seeds, and words of items, up to which the benchmark's tables are broadcast; larger ones are joined in SALTS parts of each key.
BROADCAST_ROWS = 500_000
SALTS = 16


def masks_of(n_words: int) -> tuple[str, ...]:
    """The masks of an item."""
    return ("1" * n_words,) if n_words < TOLERANT else MASKS


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the words under a mask."""
    return chained(words, [i for i, c in enumerate(mask) if c == "1"], max(0, len(words) - len(mask) + 1))


def _probes(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (probe + 1) % (1 << 64))) & np.uint64(bits - 1)


def _hashed_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in slices(batches, 256):
        words = [word_hashes(t, cache).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])


def hashed_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, words): items with words, by their words' hashes; those with the same words are one, under the smallest id."""
    slim = benchmark.select(F.col(item).cast("long").alias("item_id"), text_of(text).alias("text"))
    hashed = slim.mapInArrow(_hashed_items, "item_id long, words array<long>").where(F.size("words") > 0)
    return written(hashed.groupBy("words").agg(F.min("item_id").alias("item_id")).select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes = words.values.to_numpy().view(np.uint64)
            for mask in masks_of(len(hashes)):
                found = seeds_of(hashes, mask)
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array([item] * size, pa.int64()), pa.array(np.arange(size, dtype=np.int32)), pa.array([len(hashes)] * size, pa.int32()), pa.array([mask] * size, pa.string())],
                    names=["h", "item", "place", "n", "mask"],
                )


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, item, place, n, mask): all seeds of the items, each with its place and its item's number of words."""
    return written(items.select("item", "words").mapInArrow(_item_seeds, "h long, item long, place int, n int, mask string"), "seeds")


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A bit filter (as 64-bit words) of all seeds, of at most ``FILTER_BITS`` bits; words that are not zero reach the driver."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (64 * count).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_probes(hashes, bits, p) for p in range(PROBES)]))
            one = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(one.view(np.int64))], names=["at", "one"])

    table = seeds.select("h").mapInArrow(places, "at long, one long").groupBy("at").agg(F.bit_or("one").alias("ones")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[table["at"].to_numpy()] = table["ones"].to_numpy()
    return out.view(np.uint64)


def passing(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """The places of hashes that may be among the filter's."""
    at = np.arange(len(hashes))
    for p in range(PROBES):
        place = _probes(hashes[at], len(filter_) << 6, p)
        at = at[(filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _hits(filter_, masks: list[str], least: int):
    """Documents with at least ``least`` possible seeds: their words' hashes, and the seeds' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in slices(batches, 128):
            words = [word_hashes(t, cache) for t in batch.column(3).to_pylist()]
            sizes = np.array([len(w) for w in words])
            flat = np.concatenate(words)
            owner, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
            docs, places, hashes = [], [], []
            for mask in masks:
                found = seeds_of(flat, mask)
                at = passing(found, filter_.value)
                at = at[at + len(mask) <= ends[owner[at]]]  # a window that runs into the next document is none
                docs.append(owner[at])
                places.append(at - (ends - sizes)[owner[at]])
                hashes.append(found[at])
            doc, place, seed = np.concatenate(docs), np.concatenate(places).astype(np.int32), np.concatenate(hashes).view(np.int64)
            many = np.bincount(doc, minlength=len(words))
            keep = np.flatnonzero(many >= least)
            if len(keep):
                order = np.argsort(doc, kind="stable")
                edges = np.concatenate([[0], np.cumsum(many)])
                part = [order[edges[i] : edges[i + 1]] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(pa.array(keep)) for i in (0, 1, 2)), pa.array([words[i].view(np.int64) for i in keep], pa.list_(pa.int64())),
                        pa.array([place[p] for p in part], pa.list_(pa.int32())), pa.array([seed[p] for p in part], pa.list_(pa.int64())),
                    ],
                    names=["row", "key", "th", "words", "places", "seeds"],
                )

    return run


def best_overlap(same: np.ndarray, percent: int = SAME_PERCENT) -> tuple[int, int]:
    """(start, end) of the longest stretch of which at least ``percent`` are true; the first of equals."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    low = np.minimum.accumulate(score)
    high = np.maximum.accumulate(score[::-1])[::-1]
    start = end = best = at = 0
    for j in range(len(score)):  # for each start, the furthest end whose score is not below it
        if j and low[j] == low[j - 1]:
            continue
        while at + 1 < len(score) and high[at + 1] >= score[j]:
            at += 1
        if at - j > best:
            start, end, best = j, at, at - j
    return start, end


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest stretch, then those of what is left before and after it, of at least ``least`` words, in order."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if b - a >= least:
            start, end = best_overlap(same[a:b])
            if end - start >= least:
                out.append((a + start, a + end))
                todo += [(a, a + start), (a + end, b)]
    return sorted(out)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of a document with an item laid beside it: rows (row, item_id, shift, n, from, item words, document words)."""
    names = ["row", "item_id", "doc_start", "item_start", "n_words", "n_same"]
    for batch in slices(batches, 1024):
        out: list[tuple] = []
        simple = [batch.column(i).to_pylist() for i in range(5)]
        for k, (row, item, shift, n, begin) in enumerate(zip(*simple, strict=True)):
            same = batch.column(5)[k].values.to_numpy() == batch.column(6)[k].values.to_numpy()
            for a, b in stretches(same, min(LEAST_WORDS, n)):
                out.append((row, item, begin + a + shift, begin + a, b - a, int(same[a:b].sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], names=names)


def _meet(many: DataFrame, few: DataFrame, on: str, small: bool) -> DataFrame:
    """Join on a column that may be hot in ``many`` (which has a column row): broadcast if small, else each key in SALTS parts."""
    if small:
        return many.join(F.broadcast(few), on)  # its size was counted
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"]).drop("salt")


_OVERLAPS = "row long, item_id long, doc_start long, item_start long, n_words long, n_same long"


def overlaps(rows: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, th, item_id, doc_start, item_start, n_words, n_same) from rows (key long, th, text): every overlap with every item.

    The benchmark's items, seeds and filter are made first; then the documents
    are read once, hits are joined, and what lies on one diagonal with enough
    seeds is compared.
    """
    spark = rows.sparkSession
    items = hashed_items(benchmark, item, item_text)
    seeds = item_seeds(items)
    masks = [r["mask"] for r in seeds.select("mask").distinct().collect()]  # seven at most
    count, short = seeds.agg(F.count(F.lit(1)), F.coalesce(F.min("n"), F.lit(0)) < LEAST_WORDS).first()
    empty = spark.createDataFrame([], "key long, th binary, item_id long, doc_start int, item_start int, n_words int, n_same int")
    if not count:
        return empty
    shared = spark.sparkContext.broadcast(seed_filter(seeds, count))
    numbered_rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", "th", "text")
    hits = written(
        numbered_rows.mapInArrow(_hits(shared, sorted(masks), 1 if short else LEAST_SEEDS), "row long, key long, th binary, words array<long>, places array<int>, seeds array<long>"), "hits"
    )
    shared.destroy()
    small = count <= BROADCAST_ROWS
    each = hits.select("row", F.explode(F.arrays_zip("places", "seeds")).alias("x")).select("row", F.col("x.places").alias("at"), F.col("x.seeds").alias("h"))
    met = _meet(each, seeds.select("h", "item", "place", "n"), "h", small)
    lines = met.groupBy("row", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    likely = lines.where((F.col("c") >= LEAST_SEEDS) | (F.col("n") < LEAST_WORDS)).drop("c")
    begin, stop = F.greatest(F.lit(0), -F.col("shift")), F.least("n", F.size("words") - F.col("shift"))
    beside = _meet(likely, items.select("item", "item_id", F.col("words").alias("own")), "item", small).join(hits.select("row", "words"), "row")
    side = lambda words, at: F.slice(words, at + 1, F.col("stop") - F.col("begin"))
    laid = beside.withColumns({"begin": begin, "stop": stop}).select(
        "row", "item_id", F.col("shift").cast("long"), "n", "begin", side(F.col("own"), F.col("begin")).alias("own"), side(F.col("words"), F.col("begin") + F.col("shift")).alias("words")
    )
    found = laid.mapInArrow(_verified, _OVERLAPS)
    return found.join(hits.select("row", "key", "th"), "row").select("key", "th", "item_id", *(F.col(c).cast("int").alias(c) for c in ("doc_start", "item_start", "n_words", "n_same")))


def _text_hash(text: str):
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text_of(text)))


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each overlap of a document with an item: key, item_id, doc_start, item_start, n_words, n_same (in words).

    Laid side by side at one shift, item and document share at least 13 words, or
    the whole of a shorter item, of which 80 % are the same in place; the longest
    such stretch is a row, then those of what is left on either side of it. Words
    are white-space tokens in lower case without punctuation at their ends. Items
    with the same words are one, under the smallest id; items without words match
    nothing; null and empty texts hold nothing. Rows that repeat a key are
    documents of their own. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.lit(None).cast("binary").alias("th"), text_of(text).alias("text"))
    return overlaps(rows, benchmark, item, item_text).drop("th").withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, all columns as they were, whatever their names.

    Whether a document goes depends on its text alone, so texts meet the
    contaminated ones by a hash of 128 bits, which Spark broadcasts if they are few.
    """
    rows, names = numbered(docs)
    own = f"c{names.index(text)}"
    slim = rows.select(F.lit(None).cast("long").alias("key"), _text_hash(own).alias("th"), text_of(own).alias("text"))
    bad = written(overlaps(slim, benchmark, item, item_text).select("th").distinct(), "contaminated")
    kept = rows.withColumn("th", _text_hash(own)).join(bad, "th", "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
