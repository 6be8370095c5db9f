"""Pointer-network inference in numpy: documents are encoded many at once, and a cluster's sentences are decoded in one group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 11
#: Documents that are encoded side by side.
ENCODED = 1024


@dataclass(frozen=True)
class Weights:
    """Matrices of the network; ``random`` makes some for tests, ``load`` reads trained ones from a file of named arrays (.npz)."""

    embed: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    decoder: np.ndarray
    attend_memory: np.ndarray
    attend_state: np.ndarray
    attend: np.ndarray

    @staticmethod
    def random(vocabulary: int, nodes: int, hidden: int = 8, seed: int = 0) -> Weights:
        rng = np.random.default_rng(seed)
        m = lambda *s: rng.normal(0, 0.3, s)
        return Weights(m(vocabulary, hidden), m(3, 2 * hidden + 1, hidden), m(3, 2 * hidden + nodes + 1, hidden), m(4, 2 * hidden + 1, hidden), m(hidden, hidden), m(hidden, hidden), m(hidden))


    def save(self, path: str) -> None:
        np.savez(path, **{f.name: getattr(self, f.name) for f in fields(self)})

    @staticmethod
    def load(path: str) -> Weights:
        """The arrays of a file by their names; a missing one, or one whose sizes do not fit the others', is an error."""
        with np.load(path, allow_pickle=False) as file:
            w = Weights(**{f.name: file[f.name].astype(float) for f in fields(Weights)})
        hidden = w.embed.shape[1]
        nodes = w.document.shape[1] - 2 * hidden - 1
        want = {"sentence": (3, 2 * hidden + 1, hidden), "document": (3, 2 * hidden + nodes + 1, hidden), "decoder": (4, 2 * hidden + 1, hidden), "attend_memory": (hidden, hidden), "attend_state": (hidden, hidden), "attend": (hidden,)}
        wrong = [n for n, size in want.items() if getattr(w, n).shape != size]
        if wrong or nodes < 0:
            raise ValueError(f"sizes do not fit: {', '.join(wrong) or 'document'}")
        return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(inputs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """States of a gated recurrent unit; w has the gates' matrices for (state, input, 1)."""
    state, out = np.zeros(w.shape[2]), []
    for x in inputs:
        z = np.concatenate([state, x, [1.0]])
        update, reset = _sigmoid(z @ w[0]), _sigmoid(z @ w[1])
        new = np.tanh(np.concatenate([state * reset, x, [1.0]]) @ w[2])
        state = (1 - update) * state + update * new
        out.append(state)
    return np.array(out).reshape(len(out), w.shape[2])


def encode(sentences: list[list[int]], node: np.ndarray, w: Weights) -> np.ndarray:
    """A vector for each sentence of a document: mean-pooled words with the document's node vector, then across sentences."""
    pooled = [np.concatenate([gru(w.embed[s], w.sentence).mean(0) if len(s) else np.zeros(w.sentence.shape[2]), node]) for s in sentences]
    return gru(np.array(pooled), w.document) if pooled else np.zeros((0, w.document.shape[2]))


def scores(memory: np.ndarray, state: np.ndarray, w: Weights) -> np.ndarray:
    x = np.tanh(memory @ w.attend_memory + state @ w.attend_state) @ w.attend
    e = np.exp(x - x.max())
    return e / e.sum()


def decode(memory: np.ndarray, w: Weights, steps: int | None = MOST_STEPS) -> list[int]:
    """Greedy choice without repetition; place 0 is the stop slot and ends the list."""
    memory = np.concatenate([np.zeros((1, memory.shape[1])), memory])
    hidden = w.decoder.shape[2]
    h, c, x, out = np.zeros(hidden), np.zeros(hidden), memory.mean(0), []
    while steps is None or len(out) < steps:
        z = np.concatenate([h, x, [1.0]])
        i, f, o = (_sigmoid(z @ w.decoder[k]) for k in range(3))
        c = f * c + i * np.tanh(z @ w.decoder[3])
        h = o * np.tanh(c)
        p = scores(memory, h, w)
        p[out] = -1
        best = int(np.argmax(p))
        if best == 0 or p[best] < 0:
            break
        out.append(best)
        x = memory[best]
    return out


def greedy_choice(steps: list[dict[int, float]], most: int | None = MOST_STEPS) -> list[int]:
    """The decoder's rule on given scores: best place of each step that was not chosen before, until 0 or ``most``."""
    out: list[int] = []
    for row in steps:
        left = {k: v for k, v in row.items() if k not in out}
        if not left or (most is not None and len(out) >= most):
            break
        best = min(left, key=lambda k: (-left[k], k))
        if best == 0:
            break
        out.append(best)
    return out


def _gru_many(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, w: np.ndarray, table: np.ndarray, every: bool) -> np.ndarray:
    """``gru`` of many sequences side by side: inputs are rows of ``table``, and a sequence's are rows[start : start + size].

    every: all states, in the places of ``rows``; else the mean state of each
    sequence (0 of an empty one). Sequences are sorted by size, so a step is made
    for those that are not at their end, and what an input adds to the gates is
    made once for each row of the table.
    """
    hidden = w.shape[2]
    given = np.concatenate([table @ w[k][hidden:-1] + w[k][-1] for k in range(3)], axis=1)
    gates, last = np.concatenate([w[0][:hidden], w[1][:hidden]], axis=1), w[2][:hidden]
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    state = np.zeros((len(order), hidden))
    out = np.zeros((len(rows), hidden)) if every else np.zeros_like(state)
    alive = len(order)
    for t in range(int(size[0]) if len(size) else 0):
        while size[alive - 1] <= t:
            alive -= 1
        at = first[:alive] + t
        x, now = given[rows[at]], state[:alive]
        both = _sigmoid(now @ gates + x[:, : 2 * hidden])
        update, reset = both[:, :hidden], both[:, hidden:]
        new = np.tanh((now * reset) @ last + x[:, 2 * hidden :])
        state[:alive] = (1 - update) * now + update * new
        if every:
            out[at] = state[:alive]
        else:
            out[:alive] += state[:alive]
    if every:
        return out
    means = np.zeros_like(out)
    means[order] = out / np.maximum(size, 1)[:, None]
    return means


def encode_many(sentences: pa.Array, nodes: pa.Array, w: Weights) -> np.ndarray:
    """``encode`` of many documents: the sentences' vectors, document after document, from lists of lists of words and of numbers."""
    words = sentences.flatten()  # a list for each sentence
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pooled = _gru_many(codes, np.cumsum(sizes) - sizes, sizes, w.sentence, w.embed, False)
    each = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    node = nodes.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(each), -1)
    inputs = np.concatenate([pooled, np.repeat(node, each, axis=0)], axis=1)
    return _gru_many(np.arange(len(inputs)), np.cumsum(each) - each, each, w.document, inputs, True)


def point(documents: DataFrame, weights: Weights, steps: int | None = MOST_STEPS) -> DataFrame:
    """(cluster, rank, place, doc, sent) from (cluster, doc, sentences array<array<int>>, node array<float>).

    A place counts sentences over the cluster's documents, 0 is the stop slot.
    Documents are encoded where they are read, many at once; what meets in a
    task for each cluster is the vectors of its sentences.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ENCODED):
                batch = whole.slice(start, ENCODED)
                memory = encode_many(batch["sentences"], batch["node"], weights)
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch["sentences"]), 0).to_numpy(zero_copy_only=False))]) * memory.shape[1]
                flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memory.ravel()))
                yield pa.RecordBatch.from_arrays([batch["cluster"], batch["doc"], flat], ["cluster", "doc", "memory"])

    def run(cluster: pa.Table) -> pa.Table:
        cluster = cluster.sort_by("doc").combine_chunks()
        vectors, hidden = cluster["memory"].combine_chunks(), weights.document.shape[2]
        memory = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, hidden)
        ends = np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False) // hidden)
        chosen = np.array(decode(memory, weights, steps) if len(memory) else [], dtype=np.int64)
        row = np.searchsorted(ends, chosen - 1, side="right")
        before = np.concatenate([[0], ends])[row]
        return pa.table(
            {
                "cluster": pa.array([cluster["cluster"][0].as_py()] * len(chosen), pa.string()),
                "rank": pa.array(np.arange(1, len(chosen) + 1), pa.int32()),
                "place": pa.array(chosen, pa.int32()),
                "doc": cluster["doc"].take(pa.array(row)).cast(pa.int64()),
                "sent": pa.array(chosen - 1 - before, pa.int32()),
            }
        )

    rows = documents.select("cluster", F.col("doc").cast("long").alias("doc"), "sentences", "node")
    vectors = rows.mapInArrow(encoded, "cluster string, doc long, memory array<double>")
    return vectors.groupBy("cluster").applyInArrow(run, "cluster string, rank int, place int, doc long, sent int")


def place_of(doc_index: Column, sent: Column, most_sentences: int) -> Column:
    """The label of a padded corpus: document index * most sentences + sentence + 1, the stop slot first."""
    return doc_index * most_sentences + sent + 1


def padded(values: Column, size: int, filler: Column) -> Column:
    """An array cut or filled up to a size."""
    return F.concat(F.slice(values, 1, size), F.array_repeat(filler, F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def minibatches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` rows in the given order.

    Ranks come from the counts of range partitions, so no task orders the whole table.
    """
    sorted_ = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = sorted_.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    placed = sorted_.withColumn("p", part).join(before.select("p", "before"), "p")
    return placed.withColumn("batch", F.floor((F.col("before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))) / size).cast("long")).drop("p", "before", "__id")
