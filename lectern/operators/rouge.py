"""ROUGE: n-grams, skip bigrams, basic elements, longest common subsequences.

``peers`` is (eval, peer, text), ``models`` (eval, model, text). Counting metrics
are native joins on (eval, gram); the sequence metrics are tables of dynamic
programs over many pairs of sentences at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import Porter, drop_stopwords, ngrams, rouge_tokens, skip_bigrams, truncate_sentences, uniform
from .graph import checkpointed


#: Distinct units of the models that are broadcast: 16 MB of hashes.
BROADCAST_UNITS = 2_000_000


@dataclass(frozen=True)
class Options:
    """What happens to a text before its units are counted.

    stem: Porter stems of tokens of over three characters, an exception's base
    first. words, chars (bytes): a limit; sentences are lines.
    """

    stem: bool = False
    exceptions: tuple[tuple[str, str], ...] = ()
    stopwords: tuple[str, ...] = ()
    words: int | None = None
    bytes: int | None = None


def stemmed(tokens: Column, exceptions: dict[str, str] | None = None) -> Column:
    """Each token's stem."""

    class Stems(dict):
        def __missing__(self, word: str) -> str:
            self[word] = (exceptions or {}).get(word) or Porter.stem(word) if len(word) > 3 else word
            return self[word]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = Stems()
            yield batch.map(lambda ws: None if ws is None else [known[w] for w in ws])

    return run(tokens)


def prepared(text: Column, options: Options | None = None) -> Column:
    """The tokens of a text under the options."""
    o = options or Options()
    if o.words is not None:
        text = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, o.words), " ")
    if o.bytes is not None:
        text = truncate_sentences(F.split(text, "\n"), o.bytes)
    tokens = rouge_tokens(text)
    if o.stopwords:
        tokens = drop_stopwords(tokens, F.array(*map(F.lit, o.stopwords)))
    return stemmed(tokens, dict(o.exceptions)) if o.stem else tokens


def precision_recall_f(hits: Column, peer: Column, model: Column, alpha: float = 0.5) -> tuple[Column, Column, Column]:
    r = F.when(model > 0, hits / model).otherwise(0.0)
    p = F.when(peer > 0, hits / peer).otherwise(0.0)
    below = (1 - alpha) * p + alpha * r
    return r, p, F.when(below > 0, r * p / below).otherwise(0.0)


def grams_of(tokens: Column, metric: str) -> Column:
    """The units that a metric counts: "1".."9" n-grams, "S4" / "SU4" skip bigrams (negative gap: any)."""
    if metric.startswith("S"):
        return skip_bigrams(tokens, int(metric.lstrip("SU")), metric.startswith("SU"))
    return ngrams(tokens, int(metric))


def gram_count(tokens: Column, metric: str) -> Column:
    """How many units ``grams_of`` makes, from the number of tokens alone; a null array has -1."""
    n = F.size(tokens)
    if metric.startswith("S"):
        gap, after = int(metric.lstrip("SU")), F.greatest(n - 1, F.lit(0))
        reach = after if gap < 0 else F.least(after, F.lit(gap + 1))
        found = reach * after - (reach * (reach - 1) / 2).cast("int")
        found = found + n if metric.startswith("SU") else found
    else:
        found = F.greatest(n - int(metric) + 1, F.lit(0))
    return F.when(n < 0, n).otherwise(found)


#: Rows of a slice of texts whose units are made together.
SLICE = 256
#: Bits of the filter of the models' units: 16 MB at most.
FILTER_BITS = 1 << 27
_PROBES = (0, 32)


def _shapes(metric: str, longest: int) -> list[tuple[int, ...]]:
    """The units that ``grams_of`` makes from each token, as places of their tokens behind it; the longest last."""
    if not metric.startswith("S"):
        return [tuple(range(int(metric)))]
    gap = int(metric.lstrip("SU"))
    last = longest - 1 if gap < 0 else min(gap + 1, longest - 1)
    return [(0,)] * metric.startswith("SU") + [(0, k) for k in range(1, last + 1)]


def _unit_hashes(texts: pa.ListArray, salts: np.ndarray, metric: str) -> Iterator[tuple[pa.Array, tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]:
    """For each shape of units: all tokens, the shape, and of each unit its first token's place, its text's row and a hash with the row's salt."""
    tokens = texts.flatten()
    if not len(tokens):
        return
    coded = tokens.dictionary_encode()
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(owner))
    at = np.arange(len(owner))
    for shape in _shapes(metric, int(sizes.max())):
        at = at[left[at] > shape[-1]]
        h = salts[owner[at]]
        for k in shape:
            h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield tokens, shape, at, owner[at], h ^ (h >> np.uint64(32))


def _salts(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _bits(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (hashes >> np.uint64(probe)) & np.uint64(bits - 1)


def unit_filter(models: DataFrame, metric: str) -> np.ndarray:
    """A bit filter (as 64-bit words) of the units of ``models`` (salt, ts), of at most ``FILTER_BITS`` bits; words that are not zero reach the driver."""
    units = models.agg(F.sum(gram_count(F.col("ts"), metric).cast("long"))).first()[0] or 0
    bits = min(FILTER_BITS, max(1 << 16, 1 << (32 * max(units, 0)).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for *_, h in _unit_hashes(batch.column(1), _salts(batch.column(0)), metric):
                at = np.unique(np.concatenate([_bits(h, bits, p) for p in _PROBES]))
                one = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(one.view(np.int64))], names=["at", "one"])

    table = models.select("salt", "ts").mapInArrow(places, "at long, one long").groupBy("at").agg(F.bit_or("one").alias("ones")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[table["at"].to_numpy()] = table["ones"].to_numpy()
    return out.view(np.uint64)


def _possible(shared, metric: str):
    """Of each text (salt, ts, eval, peer, n_peer) a row without a unit, and one for each place of a unit that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, grams = [np.arange(batch.num_rows)], [pa.nulls(batch.num_rows, pa.string())]
            for tokens, shape, at, owner, h in _unit_hashes(batch.column(1), _salts(batch.column(0)), metric):
                keep = np.arange(len(h))
                for p in _PROBES:
                    bit = _bits(h[keep], len(shared.value) << 6, p)
                    keep = keep[(shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                rows.append(owner[keep])
                grams.append(pc.binary_join_element_wise(*(tokens.take(pa.array(at[keep] + k)) for k in shape), " ").cast(pa.string()))
            own = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in (2, 3, 4)), pa.concat_arrays(grams)], names=["eval", "peer", "n_peer", "g"])

    return run


def pair_counts(peers: DataFrame, models: DataFrame, metric: str, jackknife: bool = False, options: Options | None = None) -> DataFrame:
    """(eval, peer, model, hits, n_peer, n_model): clipped hits of each peer with each model.

    jackknife leaves out the model with the peer's own name. Only units that a
    model of the same evaluation has can hit. Peers are dealt, so that a file of
    one row group has many tasks, and their units go as hashes past a bit filter
    of the models'; what passes becomes text, is counted and written once (with
    the number of each peer's units), and meets the models' units themselves.
    """
    tokens = lambda df, who: df.select("eval", who, prepared(F.col("text"), options).alias("ts"))
    salted = lambda df: df.withColumn("salt", F.xxhash64(F.col("eval").cast("string")))
    m = tokens(models, "model")
    each = m.select("eval", "model", gram_count(F.col("ts"), metric).alias("n_model"), F.explode_outer(grams_of(F.col("ts"), metric)).alias("g"))
    mine = each.where("g is not null").groupBy("eval", "model", "g").agg(F.count(F.lit(1)).alias("d"))
    shared = peers.sparkSession.sparkContext.broadcast(unit_filter(salted(m), metric))
    p = salted(tokens(peers.repartition("eval", "peer"), "peer")).select("salt", "ts", "eval", "peer", gram_count(F.col("ts"), metric).alias("n_peer"))
    schema = StructType([*p.select("eval", "peer", "n_peer").schema.fields, StructField("g", StringType())])
    units = checkpointed(p.mapInArrow(_possible(shared, metric), schema).groupBy("eval", "peer", "g").agg(F.max("n_peer").alias("n_peer"), F.count(F.lit(1)).alias("c")))
    hits = units.where("g is not null").join(mine, ["eval", "g"]).groupBy("eval", "peer", "model").agg(F.sum(F.least("c", "d")).alias("hits"))
    pairs = units.where("g is null").select("eval", "peer", "n_peer").join(each.groupBy("eval", "model").agg(F.max("n_model").alias("n_model")), "eval")
    if jackknife:
        pairs = pairs.where("peer <> model")
    out = pairs.join(hits, ["eval", "peer", "model"], "left")
    return out.select("eval", "peer", "model", F.coalesce("hits", F.lit(0)).alias("hits"), F.greatest("n_peer", F.lit(0)).alias("n_peer"), F.greatest("n_model", F.lit(0)).alias("n_model"))


def over_models(pairs: DataFrame, mode: str = "A", alpha: float = 0.5) -> DataFrame:
    """(eval, peer, hits, n_peer, n_model, r, p, f): A pools all models, B takes the model of the best recall (then its name)."""
    if mode == "A":
        one = pairs.groupBy("eval", "peer").agg(F.sum("hits").alias("hits"), F.sum("n_peer").alias("n_peer"), F.sum("n_model").alias("n_model"))
    else:
        r = F.when(F.col("n_model") > 0, F.col("hits") / F.col("n_model")).otherwise(0.0)
        best = F.min(F.struct((-F.round(r, 9)).alias("k"), "model", "hits", "n_peer", "n_model")).alias("b")
        one = pairs.groupBy("eval", "peer").agg(best).select("eval", "peer", "b.hits", "b.n_peer", "b.n_model")
    r, p, f = precision_recall_f(F.col("hits"), F.col("n_peer"), F.col("n_model"), alpha)
    return one.select("eval", "peer", "hits", "n_peer", "n_model", r.alias("r"), p.alias("p"), f.alias("f"))


def score(peers: DataFrame, models: DataFrame, metrics: tuple[str, ...] = ("1",), mode: str = "A", alpha: float = 0.5, jackknife: bool = False, options: Options | None = None) -> DataFrame:
    """(metric, eval, peer, hits, n_peer, n_model, r, p, f) for several counting metrics."""
    out: DataFrame | None = None
    for metric in metrics:
        one = over_models(pair_counts(peers, models, metric, jackknife, options), mode, alpha).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no metrics")
    return out


def average(scores: DataFrame, how: int = 0, by: tuple[str, ...] = ("metric", "peer"), alpha: float = 0.5) -> DataFrame:
    """Means over evaluations (0), scores of pooled counts (1), or pooled counts alone (2)."""
    if how == 0:
        return scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("r", "p", "f")))
    pooled = scores.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("hits", "n_peer", "n_model")))
    if how == 2:
        return pooled
    r, p, f = precision_recall_f(F.col("hits"), F.col("n_peer"), F.col("n_model"), alpha)
    return pooled.select(*by, r.alias("r"), p.alias("p"), f.alias("f"))


def bootstrap(scores: DataFrame, resamples: int = 1000, confidence: float = 0.95, value: str = "r", by: tuple[str, ...] = ("metric", "peer"), seed: int = 0) -> DataFrame:
    """(..., mean, low, high): the mean of resampled means and their percentiles.

    Each evaluation enters a resample as often as a Poisson variable of mean 1,
    drawn by a hash of (evaluation, resample), says: the bootstrap without a
    second pass, whose draws do not depend on partitions.
    """
    draws = scores.select(*by, "eval", F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("s"))
    u = uniform(F.col("eval"), F.col("s"), F.lit(seed))
    limits = [0.36787944117, 0.73575888234, 0.9196986029, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975079]
    times = sum((F.when(u >= x, 1).otherwise(0) for x in limits), F.lit(0))
    means = draws.withColumn("k", times).groupBy(*by, "s").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("m"))  # a resample without rows has no mean
    side = (1 - confidence) / 2
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(side)).alias("low"), F.percentile("m", F.lit(1 - side)).alias("high"))


def basic_elements(peers: DataFrame, models: DataFrame, alpha: float = 0.5) -> DataFrame:
    """ROUGE-BE from keyed elements: peers (eval, peer, be), models (eval, model, be); pooled over models.

    Only elements that a model of the same evaluation has can hit, so the others
    are counted where they are read and never shuffled, as in ``pair_counts``.
    """
    p, each = peers.where("be is not null"), models.where("be is not null")
    m = each.groupBy("eval", "model", "be").agg(F.count(F.lit(1)).alias("d"))
    known = m.select("eval", "be").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_UNITS else known
    met = p.join(known, ["eval", "be"], "left_semi").groupBy("eval", "peer", "be").agg(F.count(F.lit(1)).alias("c"))
    hits = met.join(m, ["eval", "be"]).groupBy("eval", "peer", "model").agg(F.sum(F.least("c", "d")).alias("hits"))
    size = p.groupBy("eval", "peer").agg(F.count(F.lit(1)).alias("n_peer")).join(each.groupBy("eval", "model").agg(F.count(F.lit(1)).alias("n_model")), "eval")
    return over_models(size.join(hits, ["eval", "peer", "model"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))), "A", alpha)


#: A table of one pair has a byte for each cell; pairs go through together up to so many cells.
TABLE_CELLS = 8_000_000
#: A pair of more cells is a table by itself, made row by row.
LONG_CELLS = 20_000


def _places(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, power: float) -> np.ndarray:
    """Which places of each row of ``a`` lie on a (weighted) longest common subsequence with its row of ``b``; ties go up.

    Rows are token numbers, padded to one width with numbers that equal nothing.
    Runs of neighbouring places weigh by their length to the power.
    """
    many, m = a.shape
    n = b.shape[1]
    gain = np.diff(np.arange(min(m, n) + 2, dtype=float) ** power)
    turn = np.zeros((m, n, many), dtype=np.uint8)  # 0: both step back, 1: up, 2: left
    best, run = np.zeros((n + 1, many)), np.zeros((n + 1, many), dtype=np.int32)
    for i in range(m):
        corner, corner_run = best[0].copy(), run[0].copy()
        for j in range(n):
            same = a[:, i] == b[:, j]
            up, left = best[j + 1], best[j]
            new = np.where(same, corner + gain[corner_run], np.maximum(up, left))
            turn[i, j] = np.where(same, 0, np.where(up >= left, 1, 2))
            new_run = np.where(same, corner_run + 1, 0)
            corner, corner_run = up.copy(), run[j + 1].copy()
            best[j + 1], run[j + 1] = new, new_run
    out, rows = np.zeros((many, m), dtype=bool), np.arange(many)
    i, j = la.copy(), lb.copy()
    while len(rows := rows[(i[rows] > 0) & (j[rows] > 0)]):
        step = turn[i[rows] - 1, j[rows] - 1, rows]
        both = rows[step == 0]
        out[both, i[both] - 1] = True
        i[rows[step != 2]] -= 1
        j[rows[step != 1]] -= 1
    return out


def _places_long(a: np.ndarray, b: np.ndarray, power: float) -> np.ndarray:
    """As ``_places`` for one pair, a row of the table at a time."""
    m, n = len(a), len(b)
    gain = np.diff(np.arange(min(m, n) + 2, dtype=float) ** power)
    turn = np.zeros((m, n), dtype=np.uint8)
    best, run = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int32)
    for i in range(m):
        same = b == a[i]
        at = np.flatnonzero(same)
        new, new_run = best.copy(), np.zeros(n + 1, dtype=np.int32)
        new[at + 1], new_run[at + 1] = best[at] + gain[run[at]], run[at] + 1
        edges = [0, *(at + 1).tolist(), n + 1]  # a match is what it is; after it the largest so far counts
        for start, stop in pairwise(edges):
            np.maximum.accumulate(new[start:stop], out=new[start:stop])
        turn[i] = np.where(same, 0, np.where(best[1:] >= new[:-1], 1, 2))
        best, run = new, new_run
    out, i, j = np.zeros(m, dtype=bool), m, n
    while i and j:
        step = turn[i - 1, j - 1]
        out[i - 1] |= step == 0
        i, j = i - (step != 2), j - (step != 1)
    return out


def _collapsed(words: list[str], shared: set[str], code: dict[str, int], other: int) -> tuple[list[int], list[int]]:
    """Numbers of the words, with one number for each run of words that the other side lacks, and the words' places (-1 for a run).

    Rows and columns of a table that match nothing are copies of the first of
    them, and a path goes straight through copies, so one of a run is enough.
    """
    numbers, places = [], []
    for i, w in enumerate(words):
        if w in shared:
            numbers.append(code.setdefault(w, len(code)))
            places.append(i)
        elif not numbers or numbers[-1] != other:
            numbers.append(other)
            places.append(-1)
    return numbers, places


def _union_places(pairs: list[tuple[list[str], list[list[str]]]], power: float) -> list[np.ndarray]:
    """For each (sentence, other text) the places of the sentence on a subsequence with any of the other's sentences."""
    out = [np.zeros(len(sentence), dtype=bool) for sentence, _ in pairs]
    code: dict[str, int] = {}
    jobs = []
    for k, (sentence, others) in enumerate(pairs):
        words = set(sentence)
        for o in others:
            if shared := words.intersection(o):
                mine, at = _collapsed(sentence, shared, code, -1)
                theirs, _ = _collapsed(o, shared, code, -2)
                if len(mine) * len(theirs) > LONG_CELLS:
                    found = _places_long(np.array(mine), np.array(theirs), power)
                    out[k][[p for p, f in zip(at, found.tolist(), strict=True) if f]] = True
                else:
                    jobs.append((k, mine, theirs, at))
    jobs.sort(key=lambda x: (len(x[1]), len(x[2])))
    start = 0
    while start < len(jobs):
        stop, m, n = start, 0, 0
        while stop < len(jobs):  # as many as fit in one table
            wide, high = max(n, len(jobs[stop][2])), max(m, len(jobs[stop][1]))
            if stop > start and (stop + 1 - start) * wide * high > TABLE_CELLS:
                break
            stop, m, n = stop + 1, high, wide
        part = jobs[start:stop]
        a, b = np.full((len(part), m), -1), np.full((len(part), n), -2)
        for r, (_, x, y, _) in enumerate(part):
            a[r, : len(x)], b[r, : len(y)] = x, y
        found = _places(a, b, np.array([len(x[1]) for x in part]), np.array([len(x[2]) for x in part]), power)
        for r, (k, _, _, at) in enumerate(part):
            out[k][[at[i] for i in np.flatnonzero(found[r]).tolist()]] = True
        start = stop
    return out


def union_lcs(pairs: list[tuple[list[list[str]], list[list[str]]]], power: float = 1.0) -> list[float]:
    """For each (model, peer): over the model's sentences, what the union of their subsequences with all peer sentences covers.

    A token counts as often as both texts have it. With a power over 1, runs of
    neighbouring places weigh by their length to that power.
    """
    found = iter(_union_places([(sentence, peer) for model, peer in pairs for sentence in model], power))
    totals = []
    for model, peer in pairs:
        left_model, left_peer = (Counter(t for sentence in side for t in sentence) for side in (model, peer))
        total = 0.0
        for sentence in model:
            run, last = 0, None
            for x in np.flatnonzero(next(found)).tolist():
                t = sentence[x]
                if left_model[t] > 0 and left_peer[t] > 0:
                    left_model[t] -= 1
                    left_peer[t] -= 1
                    run = run + 1 if last is not None and x == last + 1 else 1
                    total += run**power - (run - 1) ** power
                    last = x
                else:
                    run, last = 0, None
        totals.append(total)
    return totals


#: Characters of peers that are looked at side by side.
PEER_CHARACTERS = 2_000_000
#: Models that meet a peer in one row.
MODELS = 64
#: Bytes of models' texts that are broadcast.
BROADCAST_BYTES = 16 << 20


def _runs(keep: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of columns if one stays of each run of columns that match nothing, and where each row's begin and how many it has.

    Columns that match nothing are copies of the one before, and a path goes
    straight through copies, so one of a run is enough. Rows where nothing
    matches have none.
    """
    lead = np.ones(len(keep), dtype=bool)
    lead[1:] = keep[1:] | keep[:-1] | (row[1:] != row[:-1])
    some = np.zeros(int(row[-1]) + 1 if len(row) else 0, dtype=bool)
    some[row[keep]] = True
    left = np.flatnonzero(lead & some[row]) if len(row) else np.zeros(0, dtype=np.int64)
    sizes = np.bincount(row[left], minlength=len(some))
    rows = np.flatnonzero(sizes)
    return left, np.cumsum(sizes[rows]) - sizes[rows], sizes[rows]


def _parts(sizes: np.ndarray, wide: int) -> Iterator[np.ndarray]:
    """Rows in descending order of their sizes, as many at once as have ``TABLE_CELLS`` cells of ``wide``."""
    order = np.argsort(-sizes, kind="stable")
    start = 0
    while start < len(order):
        many = max(1, TABLE_CELLS // (max(wide, 1) * int(sizes[order[start]])))
        yield order[start : start + many]
        start += many


def _alive(sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of the rows (longest first) have a column 0, 1, ... n - 1."""
    return len(sizes) - np.searchsorted(sizes[::-1], np.arange(n), side="right")


def _top_bit(x: np.ndarray) -> np.ndarray:
    """One more than the place of the highest bit; 0 of 0."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(shift)
    return np.bitwise_count(x).astype(np.int64)


def _bit_places(match: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, found: np.ndarray) -> None:
    """Marks in ``found`` (owners, places) what lies on a longest common subsequence with any row of an owner; ties go up.

    ``match`` (words of 64 bits, columns) has the places that each column equals.
    A column of the table is the bits of its differences (Hyyro, 2004); up a
    column a path goes to the nearest place that matches or differs.
    """
    words, m = len(match), found.shape[1]
    one, zero = np.uint64(1), np.uint64(0)
    for part in _parts(sizes, 2 * words):
        first, size = starts[part], sizes[part]
        n = int(size[0])
        alive = _alive(size, n)
        table = np.zeros((n, words, len(part)), dtype=np.uint64)  # 0: a difference
        now = np.full((words, len(part)), ~zero)
        for j in range(n):
            k = alive[j]
            met = match[:, first[:k] + j]
            carry = np.zeros(k, dtype=np.uint64)
            for v in range(words):
                row = now[v, :k]
                both = row & met[v]
                added = row + both
                total = added + carry
                carry = ((added < row) | (total < added)).astype(np.uint64)
                table[j, v, :k] = now[v, :k] = total | (row & ~met[v])
        at = np.full(len(part), m, dtype=np.int64)  # rows above a path's place
        for j in range(n - 1, -1, -1):
            k = alive[j]
            met = match[:, first[:k] + j]
            up = np.zeros(k, dtype=np.int64)
            for v in range(words):  # the highest word with a bit below ``at`` counts
                below = np.clip(at[:k] - 64 * v, 0, 64)
                mask = np.where(below == 64, ~zero, (one << (below % 64).astype(np.uint64)) - one)
                top = _top_bit((met[v] | ~table[j, v, :k]) & mask)
                up = np.where(top > 0, top + 64 * v, up)
            place = np.maximum(up - 1, 0)
            hit = (up > 0) & ((met[place // 64, np.arange(k)] >> (place % 64).astype(np.uint64) & one) > 0)
            found[owner[part[:k]][hit], place[hit]] = True
            at[:k] = up - hit


def _run_places(codes: np.ndarray, sentence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, found: np.ndarray, power: float) -> None:
    """As ``_bit_places`` for the words of ``sentence`` and weighted longest common subsequences.

    Runs of neighbouring places weigh by their length to the power. The table
    goes column by column, for many rows at once.
    """
    m = len(sentence)
    gain = np.diff(np.arange(m + 2, dtype=float) ** power)
    for part in _parts(sizes, m):
        first, size = starts[part], sizes[part]
        n = int(size[0])
        alive = _alive(size, n)
        turn = np.zeros((n, m, len(part)), dtype=np.uint8)  # 0: both step back, 1: up, 2: left
        best, run = np.zeros((m + 1, len(part))), np.zeros((m + 1, len(part)), dtype=np.int32)
        for j in range(n):
            k = alive[j]
            same = codes[first[:k] + j] == sentence[:, None]
            old, old_run = best[:, :k].copy(), run[:, :k]
            matched = old[:-1] + gain[old_run[:-1]]
            new_run = np.where(same, old_run[:-1] + 1, 0)
            now = np.where(same, matched, old[1:])
            above = best[0, :k]
            for i in range(m):
                row = now[i]
                up = ~same[i] & (above >= row)
                turn[j, i, :k] = np.where(same[i], 0, np.where(up, 1, 2))
                above = np.where(up, above, row)
                best[i + 1, :k] = above
            run[1:, :k] = new_run
        i, j = np.full(len(part), m), size.copy()
        rows = np.arange(len(part))
        while len(rows := rows[(i[rows] > 0) & (j[rows] > 0)]):
            step = turn[j[rows] - 1, i[rows] - 1, rows]
            both = rows[step == 0]
            found[owner[part[both]], i[both] - 1] = True
            i[rows[step != 2]] -= 1
            j[rows[step != 1]] -= 1


def _found_places(sentence: np.ndarray, codes: np.ndarray, row: np.ndarray, owner: np.ndarray, owners: int, many: int, power: float) -> np.ndarray:
    """(owners, places): the places of a sentence on a subsequence with any row of each owner.

    ``codes`` are the numbers, under ``many``, of the words of all rows, ``row`` their rows, ``owner`` the rows' owners.
    """
    found, has = np.zeros((owners, len(sentence)), dtype=bool), np.zeros(many, dtype=bool)
    has[sentence] = True
    left, starts, sizes = _runs(has[codes], row)
    if not len(left):
        return found
    owner = owner[row[left[starts]]]
    if power == 1:
        bits = np.zeros((-(-len(sentence) // 64), many), dtype=np.uint64)
        for i, c in enumerate(sentence.tolist()):
            bits[i // 64, c] |= np.uint64(1 << i % 64)
        _bit_places(bits[:, codes[left]], starts, sizes, owner, found)
        return found
    there = np.zeros(many, dtype=bool)
    there[codes[left]] = True
    mine, _, _ = _runs(there[sentence], np.zeros(len(sentence), dtype=np.int64))
    part = np.zeros((owners, len(mine)), dtype=bool)
    _run_places(codes[left], sentence[mine], starts, sizes, owner, part, power)
    found[:, mine] = part
    return found


def _covered(peers: pa.Array, models: pa.Array, power: float) -> np.ndarray:
    """(peers, models): ``union_lcs`` of each peer with each model, from lists of lists of words."""
    sizes = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, own = peers.flatten(), models.flatten()
    words = lines.flatten()
    known = pa.concat_arrays([own.flatten(), words]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    mine, codes = known[: len(known) - len(words)], known[len(known) - len(words) :]
    other = int(mine.max()) + 1 if len(mine) else 0  # models' words have the first numbers
    codes = np.minimum(codes, other)
    row = np.repeat(np.arange(len(lines)), sizes(lines))
    owner = np.repeat(np.arange(len(peers)), sizes(peers))
    counts = np.bincount(owner[row] * (other + 1) + codes, minlength=len(peers) * (other + 1)).reshape(len(peers), other + 1)
    ends, gain = np.cumsum(sizes(own)), [r**power - (r - 1) ** power if r else 0.0 for r in range(len(mine) + 1)]
    gain, out, at = np.array(gain), np.zeros((len(peers), len(models))), 0
    for k, many in enumerate(sizes(models).tolist()):
        used: dict[int, np.ndarray] = {}
        for end in ends[at : at + many].tolist():
            sentence = mine[end - int(sizes(own.slice(at, 1))[0]) : end]
            at += 1
            found = _found_places(sentence, codes, row, owner, len(peers), other + 1, power)
            run, last = np.zeros(len(peers), dtype=np.int64), np.full(len(peers), -2)
            for x in np.flatnonzero(found.any(axis=0)).tolist():
                t = int(sentence[x])
                before = used.setdefault(t, np.zeros(len(peers), dtype=np.int64))
                take = found[:, x] & (before < counts[:, t])
                before += take
                run = np.where(last == x - 1, run, 0) + 1
                last = np.where(take, x, last)
                out[:, k] += np.where(take, gain[run], 0.0)
    return out


def sequence_score(peers: DataFrame, models: DataFrame, weight: float | None = None, mode: str = "A", alpha: float = 0.5) -> DataFrame:
    """ROUGE-L, or ROUGE-W with a weight, of texts whose sentences are lines: (eval, peer, r, p, f).

    A peer meets the models of its evaluation in rows of about ``MODELS`` of them, and
    peers of one evaluation that are in one batch go through the tables together.
    """
    power = weight or 1.0
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    made = f"eval {kind(peers, 'eval')}, peer {kind(peers, 'peer')}, model {kind(models, 'model')}, hits double, n_peer long, n_model long"

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each = batch["ms"][0:1].flatten().flatten()  # the models' names and texts
        total = lambda texts: pa.array([sum(map(len, t)) for t in texts.to_pylist()], pa.int64())
        n_model, n_peer = total(each[1]), total(batch["ps"])
        hits = _covered(batch["ps"], each[1], power)
        left, right = pa.array(np.repeat(np.arange(batch.num_rows), len(each[0]))), pa.array(np.tile(np.arange(len(each[0])), batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch["eval"].take(left), batch["peer"].take(left), each[0].take(right), pa.array(hits.ravel()), n_peer.take(left), n_model.take(right)], ["eval", "peer", "model", "hits", "n_peer", "n_model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, block in enumerate(zip(batch["eval"].to_pylist(), batch["block"].to_pylist())):
                groups.setdefault(block, []).append(i)
            sizes = batch["n"].to_pylist()
            for rows in groups.values():
                part, held = [], 0
                for i in rows:
                    if part and held + sizes[i] > PEER_CHARACTERS:
                        yield from scored(batch.take(pa.array(part)))
                        part, held = [], 0
                    part.append(i)
                    held += sizes[i]
                yield from scored(batch.take(pa.array(part)))

    lines = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), rouge_tokens)
    size = models.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = models.groupBy("eval").agg(F.ceil(F.count(F.lit(1)) / MODELS).alias("blocks"))
    dealt = models.join(few, "eval").select("eval", F.pmod(F.xxhash64("model"), "blocks").alias("block"), F.struct("model", lines(F.col("text")).alias("ms")).alias("m"))
    groups = dealt.groupBy("eval", "block").agg(F.collect_list("m").alias("ms"))
    texts = peers.select("eval", "peer", F.coalesce("text", F.lit("")).alias("text"))
    if size <= BROADCAST_BYTES:
        pairs = texts.repartition("eval", "peer").join(F.broadcast(groups), "eval")  # evaluations may be few and large
    else:
        pairs = texts.join(groups, "eval").repartition("eval", "peer", "block")
    each = pairs.select("eval", "peer", "block", F.length("text").alias("n"), lines(F.col("text")).alias("ps"), "ms").mapInArrow(run, made)
    if weight is None:
        return over_models(each, mode, alpha).select("eval", "peer", "r", "p", "f")
    pooled = each.groupBy("eval", "peer").agg(*(F.sum(c).alias(c) for c in ("hits", "n_peer", "n_model")))
    back = lambda n: F.when(F.col(n) > 0, F.pow(F.col("hits") / F.pow(F.col(n).cast("double"), F.lit(power)), F.lit(1 / power))).otherwise(0.0)
    r, p = back("n_model"), back("n_peer")
    below = (1 - alpha) * p + alpha * r
    return pooled.select("eval", "peer", r.alias("r"), p.alias("p"), F.when(below > 0, r * p / below).otherwise(0.0).alias("f"))
