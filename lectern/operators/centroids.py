"""Sentences with their centroid values, a cluster in one row.

Texts are shuffled once, to their clusters, and written there. All else runs
where a row is read: words are counted by document for idf, and a cluster's
centroid and its sentences' sums are made in one go, so no table of words of
sentences or clusters is shuffled or written. What all tasks hold is how many
documents have each word that lies in two or more; a word that is not in that
table lies in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..llm.common import slices, written
from .features import MIN_TFIDF, WORDS_PER_DOCUMENT

#: Characters of the largest cluster that is one row, and of a part of the table of clusters; a sentence counts as so many more.
CHARS, SENTENCE = 1 << 24, 64
#: Words of two documents or more that all tasks may hold, 16 bytes each.
WORDS = 8_000_000
#: Clusters whose words are in numpy at once.
CLUSTERS = 256


def gathered(sentences: DataFrame) -> DataFrame | None:
    """(cluster, s): a cluster's rows of ``sentences`` as one array, written; None if a cluster is too large for a row."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)) + SENTENCE).alias("size")
    largest, total = sentences.groupBy("cluster").agg(size).agg(F.max("size"), F.sum("size")).first()
    if (largest or 0) > CHARS:
        return None
    parts = max(ceil((total or 0) / CHARS), sentences.sparkSession.sparkContext.defaultParallelism)
    return written(sentences.repartition(parts, "cluster").groupBy("cluster").agg(F.collect_list(F.struct(*sentences.columns)).alias("s")), "clusters")


def _apart(clusters: DataFrame) -> bool:
    """Whether each document lies in one cluster, and no key is missing."""
    missing = F.col("cluster").isNull() | F.exists("s", lambda x: x["did"].isNull() | x["sno"].isNull())
    docs = clusters.select(F.explode(F.array_distinct(F.transform("s", lambda x: x["did"]))).alias("did"), missing.alias("missing"))
    return docs.groupBy("did").agg(F.count(F.lit(1)).alias("c"), F.max("missing").alias("m")).where("c > 1 or m").isEmpty()


def _tokens(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): each token's row and number among the distinct words."""
    each = words.flatten()
    coded = each.flatten().dictionary_encode()
    return np.repeat(np.arange(len(each)), pc.list_value_length(each).to_numpy()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, df) of clusters (dids, words of each sentence): documents with the word; those with any word under null."""
    for batch in slices(batches, CLUSTERS):
        row, code, words = _tokens(batch.column(1))
        if not len(code):
            continue
        key = np.unique(_codes(batch.column(0).flatten())[row] * len(words) + code)
        w, df = np.unique(key % len(words), return_counts=True)
        docs = len(np.unique(key // len(words)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.take(pa.array(w)), pa.nulls(1, words.type)]), pa.array(np.append(df, docs).astype(np.int64))], names=["w", "df"])


def document_counts(clusters: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """How many documents have words, and for each word of two or more of them its hash, in order, and how many have it.

    None if there are more than ``WORDS`` of them, or if two of all words share a
    hash: then a hash would not tell which word it is.
    """
    counted = _with_words(clusters, "dids", "words").mapInArrow(_documents, "w string, df long").groupBy("w").agg(F.sum("df").alias("df"))
    table = written(counted.select("df", F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("h")), "documents")
    docs, many = table.agg(F.max(F.when(F.col("h").isNull(), F.col("df"))), F.count(F.when(F.col("h").isNotNull() & (F.col("df") > 1), 1))).first()
    if many > WORDS or not table.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return None
    known = table.where("h is not null and df > 1").toArrow()
    order = np.argsort(h := known["h"].to_numpy())
    return docs or 0, h[order], known["df"].to_numpy()[order]


def _with_words(clusters: DataFrame, *columns: str) -> DataFrame:
    made = {
        "dids": F.transform("s", lambda x: x["did"]),
        "snos": F.transform("s", lambda x: x["sno"]),
        "words": F.transform("s", lambda x: F.coalesce(split_words(x["text"]), F.array().cast("array<string>"))),
    }
    return clusters.select(*(made[c].alias(c) if c in made else c for c in columns))


def sentence_values(dids: pa.Array, snos: pa.Array, words: pa.Array, docs: int, known: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The values of all sentences of clusters, rows of lists; ``docs``, ``known`` and ``df`` are those of ``document_counts``."""
    row, code, names = _tokens(words)
    cluster = np.repeat(np.arange(len(dids)), pc.list_value_length(dids).to_numpy())
    if not len(code):
        return np.zeros(len(cluster))
    width, doc = len(names), _codes(dids.flatten())
    pairs, at, n = np.unique(cluster[row] * width + code, return_inverse=True, return_counts=True)
    c, w = pairs // width, pairs % width
    there = np.unique(cluster[row] * (doc.max() + 1) + doc[row]) // (doc.max() + 1)
    own = np.bincount(there, minlength=len(dids))[c]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in names.to_pylist()), dtype=np.uint64, count=width).view(np.int64)
    have = np.ones(width)
    if len(known):
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        have = np.where(known[place] == hashes, df[place], 1)
    tfidf = n / own * np.log(docs / have)[w]
    order = np.lexsort((np.argsort(pc.sort_indices(names).to_numpy())[w], -np.rint(tfidf * 1e9), c))
    rank = np.empty(len(c), dtype=np.int64)
    rank[order] = np.arange(len(c)) - np.searchsorted(c, c)  # c is in order, and stays so
    weight = np.where((tfidf > MIN_TFIDF) | (rank < WORDS_PER_DOCUMENT * own), tfidf, 0.0)
    number = _codes(snos.flatten())
    _, same = np.unique((cluster * (doc.max() + 1) + doc) * (number.max() + 1) + number, return_inverse=True)  # sentences of one number are one
    summed = np.bincount(same[row], weight[at], minlength=same.max() + 1)[same]
    top = np.zeros(len(dids))
    np.maximum.at(top, cluster, summed)
    return np.divide(summed, top[cluster], out=np.zeros(len(cluster)), where=top[cluster] > 0)


def with_centroid(sentences: DataFrame, name: str = "Centroid") -> DataFrame | None:
    """``sentences`` with ``features.centroid`` under an idf of their own documents as a further column.

    None if that takes joins: a cluster has over ``CHARS`` characters, a document
    lies in two clusters, a key is null, or there are too many words.
    """
    clusters = gathered(sentences)
    if clusters is None or not _apart(clusters) or (counts := document_counts(clusters)) is None:
        return None
    docs, known, df = counts
    held = sentences.sparkSession.sparkContext.broadcast((known, df))

    @F.arrow_udf("array<double>")
    def values(dids: pa.Array, snos: pa.Array, words: pa.Array) -> pa.Array:
        parts = [sentence_values(*(x.slice(k, CLUSTERS) for x in (dids, snos, words)), docs, *held.value) for k in range(0, len(dids), CLUSTERS)]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.list_value_length(dids).to_numpy())].astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *parts])))

    each = _with_words(clusters, "s", "dids", "snos", "words").select("s", values("dids", "snos", "words").alias("v"))
    return each.select(F.explode(F.arrays_zip("s", "v")).alias("x")).select(*(F.col("x.s")[c].alias(c) for c in sentences.columns), F.col("x.v").alias(name))
