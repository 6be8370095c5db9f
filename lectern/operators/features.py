"""Sentence features. Each takes sentences (cluster, did, sno, text) and gives (did, sno, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.similarity import COMMON, UNKNOWN_IDF, binary_cosine, common_words, dealt, idf_cosine, overlap
from ..functions.text import bound, split_words, truncate_words, word_counts
from ..llm.common import slices, written

MIN_TFIDF, WORDS_PER_DOCUMENT = 3.0, 8


def tokens(sentences: DataFrame) -> DataFrame:
    """(cluster, did, sno, w): one row for each token."""
    return sentences.select("cluster", "did", "sno", F.explode(split_words(F.col("text"))).alias("w"))


def sentence_words(sentences: DataFrame) -> DataFrame:
    """(cluster, did, sno, w, n): each sentence's distinct words, counted within its row: nothing is shuffled or hashed."""
    return sentences.select("cluster", "did", "sno", F.inline(word_counts(split_words(F.col("text")))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``counted_words`` from documents (did, cluster, sno, words of each sentence)."""
    names = ["cluster", "did", "sno", "w", "n", "first", "lead"]
    for batch in slices(batches, 256):
        dids, clusters, numbers, each = batch.column(0), batch.column(1).flatten(), batch.column(2).flatten(), batch.column(3).flatten()
        words = each.flatten()
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(dids)), pc.list_value_length(batch.column(3)).to_numpy())
        code = lambda x: pc.fill_null(x.dictionary_encode().indices, -1).to_numpy()
        _, at, same = np.unique(np.stack([doc, code(clusters), code(numbers)], axis=1), axis=0, return_index=True, return_inverse=True)  # sentences of one number are one
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place, width = np.argsort(order), len(order)
        key, n = np.unique(np.repeat(same.ravel(), pc.list_value_length(each).to_numpy()) * width + place[coded.indices.to_numpy()], return_counts=True)
        sentence, w = at[key // width], key % width
        number = pc.fill_null(numbers, -1).to_numpy()[sentence]
        o = np.lexsort((number, w, doc[sentence]))
        sentence, w, n, number, d = sentence[o], w[o], n[o], number[o], doc[sentence[o]]
        first = np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]
        run, one = np.cumsum(first) - 1, number == 1
        lead = np.bincount(run[one], weights=n[one], minlength=run[-1] + 1)[run].astype(np.int64)
        sentence = pa.array(sentence)
        yield pa.RecordBatch.from_arrays(
            [clusters.take(sentence), dids.take(pa.array(d)), numbers.take(sentence), coded.dictionary.take(pa.array(order[w])), pa.array(n.astype(np.int64)), pa.array(first), pa.array(lead, mask=lead == 0)],
            names=names,
        )


def counted_words(sentences: DataFrame) -> DataFrame:
    """(cluster, did, sno, w, n, first, lead): each sentence's distinct words with their counts.

    ``first`` marks one row for each word of a document, ``lead`` is the word's
    count in the document's first sentence (null: none). Texts meet by document
    and are counted there, so they are shuffled once, documents with a word are
    counted by ``first`` alone, and no join brings the first sentence. Several
    features read this table: write it once.
    """
    kind = {f.name: f.dataType for f in sentences.schema.fields}
    schema = StructType([*(StructField(c, kind[c]) for c in ("cluster", "did", "sno")), StructField("w", StringType()), StructField("n", LongType()), StructField("first", BooleanType()), StructField("lead", LongType())])
    docs = sentences.groupBy("did").agg(F.collect_list(F.struct("cluster", "sno", "text")).alias("s"))
    words = F.transform("s", lambda x: F.coalesce(split_words(x["text"]), F.array().cast("array<string>")))
    return docs.select("did", "s.cluster", "s.sno", words.alias("words")).mapInArrow(_counted, schema)


def position(sno: Column) -> Column:
    return F.when(sno > 0, F.sqrt(1.0 / sno)).otherwise(0.0)


def length(text: Column) -> Column:
    return F.size(split_words(text))


def centroid_words(words: DataFrame, idf: DataFrame, unknown: float = UNKNOWN_IDF, rows: int | None = None) -> DataFrame:
    """(cluster, w, tf, tfidf): the words of each cluster's centroid, from ``counted_words``.

    tf is the mean count in the cluster's documents. A word stays if its weight
    is over ``MIN_TFIDF`` or it is among the first 8 for each document, by
    rounded weight, ties by word. Tables are dealt into parts of a bounded number
    of ``rows``, those of ``words``, so hash tables here and below do not grow with
    the input; weights are made after the last exchange.
    """
    rows = words.count() if rows is None else rows
    docs = words.select("cluster", "did").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"))
    counted = dealt(words.select("cluster", "w", "n"), rows, "cluster", "w").groupBy("cluster", "w").agg(F.sum("n").alias("n"))
    known = dealt(counted, rows, "w").join(dealt(idf.select("w", "idf"), rows, "w").hint("shuffle_hash"), "w", "left").select("cluster", "w", "n", "idf")
    placed = dealt(known, rows, "cluster").join(dealt(docs, rows, "cluster").hint("shuffle_hash"), "cluster")
    tf = F.col("n") / F.col("docs")
    weighted = placed.select("cluster", "docs", "w", tf.alias("tf"), (tf * F.coalesce("idf", F.lit(unknown))).alias("tfidf"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("tfidf", 9)), "w"))
    return weighted.withColumn("rank", rank).where((F.col("tfidf") > MIN_TFIDF) | (F.col("rank") <= WORDS_PER_DOCUMENT * F.col("docs"))).select("cluster", "w", "tf", "tfidf")


def centroid_values(words: DataFrame, idf: DataFrame) -> DataFrame:
    """(did, sno, value) of the sentences with a word of the centroid; all others' value is 0."""
    rows = words.count()
    kept = dealt(centroid_words(words, idf, rows=rows).select("cluster", "w", "tfidf"), rows, "cluster", "w")
    met = dealt(words.select("cluster", "did", "sno", "w", "n"), rows, "cluster", "w").join(kept.hint("shuffle_hash"), ["cluster", "w"])
    summed = met.groupBy("cluster", "did", "sno").agg(F.sum(F.col("tfidf") * F.col("n")).alias("s"))
    top = F.max("s").over(Window.partitionBy("cluster"))
    return summed.withColumn("top", top).select("did", "sno", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(0.0).alias("value"))


def centroid(sentences: DataFrame, idf: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Sum of the centroid weights of a sentence's tokens over the largest such sum in its cluster."""
    values = centroid_values(counted_words(sentences) if words is None else words, idf)
    return sentences.select("did", "sno").join(values, ["did", "sno"], "left").select("did", "sno", F.coalesce("value", F.lit(0.0)).alias("value"))


def similarity_with_first(sentences: DataFrame, idf: DataFrame, words: DataFrame | None = None, unknown: float = UNKNOWN_IDF) -> DataFrame:
    """The idf cosine with the first sentence of the same document.

    A word adds to the dot product and the norm by itself, from its row in
    ``counted_words``. Rows of common words stay where they were read and meet a
    broadcast idf; only those of rare words are dealt by word.
    """
    words = written(counted_words(sentences), "words") if words is None else words
    rows, common = words.count(), F.broadcast(common_words(words))
    known = written(idf.select("w", "idf"), "idf") if rows > COMMON else idf.select("w", "idf")
    slim = words.select("did", "sno", "w", "n", "lead")
    often = slim.join(F.broadcast(known.join(common, "w")), "w")
    rare = dealt(slim.join(F.broadcast(known.join(common, "w").select("w")), "w", "left_anti"), rows, "w")
    seldom = rare.join(dealt(known.join(common, "w", "left_anti"), rows, "w").hint("shuffle_hash"), "w", "left")
    v = F.col("n") * F.coalesce("idf", F.lit(unknown))
    added = lambda df: df.select("did", "sno", (v * F.col("lead") * F.coalesce("idf", F.lit(unknown))).alias("dot"), (v * v).alias("norm"))
    sums = added(often).unionByName(added(seldom)).groupBy("did", "sno").agg(F.sum("dot").alias("dot"), F.sum("norm").alias("norm"))
    whole = sums.withColumn("first", F.max(F.when(F.col("sno") == 1, F.col("norm"))).over(Window.partitionBy("did")))
    value = F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(F.col("norm") * F.col("first"))).otherwise(0.0)
    return sentences.select("did", "sno").join(whole.select("did", "sno", value.alias("value")), ["did", "sno"], "left").select("did", "sno", F.coalesce("value", F.lit(0.0)).alias("value"))


def is_longest(sentences: DataFrame) -> DataFrame:
    """1 for the first of the longest sentences of a document, else 0."""
    order = Window.partitionBy("did").orderBy(F.desc("n"), "sno")
    return sentences.select("did", "sno", length(F.col("text")).alias("n")).select("did", "sno", (F.row_number().over(order) == 1).cast("int").alias("value"))


def query_features(sentences: DataFrame, queries: DataFrame) -> DataFrame:
    """(did, sno, cosine, overlap): plain cosine and word overlap with the cluster's query (cluster, query)."""
    both = sentences.join(queries.select("cluster", split_words(F.col("query")).alias("q")), "cluster", "left")
    words, query = split_words(F.col("text")), F.coalesce("q", F.array().cast("array<string>"))
    return both.select("did", "sno", binary_cosine(words, query).alias("cosine"), overlap(words, query).alias("overlap"))


def query_cosine(sentences: DataFrame, queries: DataFrame, idf: DataFrame) -> DataFrame:
    """The idf cosine with the cluster's query (cluster, query)."""
    item = F.concat_ws("#", F.col("did"), F.col("sno"))
    asked = queries.select(F.concat(F.lit("q:"), "cluster").alias("item"), F.inline(word_counts(split_words(F.col("query")))))
    words = sentence_words(sentences).select(item.alias("item"), "w", "n").unionByName(asked)
    pairs = sentences.select("did", "sno", item.alias("x"), F.concat(F.lit("q:"), "cluster").alias("y"))
    return idf_cosine(pairs, words, idf).select("did", "sno", F.col("cosine").alias("value"))


def phrase_match(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """Sum of the weights of the cluster's phrases (cluster, phrase, weight) that occur in a sentence, in any case."""
    found = sentences.join(phrases, "cluster", "left").where(F.contains(F.lower("text"), F.lower("phrase")))
    summed = found.groupBy("did", "sno").agg(F.sum("weight").alias("value"))
    return sentences.select("did", "sno").join(summed, ["did", "sno"], "left").select("did", "sno", F.coalesce("value", F.lit(0.0)).alias("value"))


def parse_keywords(queries: DataFrame) -> DataFrame:
    """(cluster, phrase, weight) from keywords written as phrase;weight;phrase;weight."""
    parts = F.split("keywords", ";")
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.trim(F.get(parts, i * 2)).alias("phrase"), F.get(parts, i * 2 + 1).cast("double").alias("weight")))
    return queries.where(F.size(parts) >= 2).select("cluster", F.explode(pair).alias("p")).select("cluster", "p.phrase", "p.weight")


def skeleton(sentences: DataFrame) -> DataFrame:
    """The template of a feature: two values from the number of the sentence and of its document's name."""
    return sentences.select("did", "sno", (F.col("sno") / 10).alias("by_number"), F.length(F.col("did").cast("string")).alias("by_name"))


def combine(*features: tuple[str, DataFrame]) -> DataFrame:
    """(did, sno, one column for each feature): a full outer join; of equal names the later source wins."""
    last = dict(features)
    out: DataFrame | None = None
    for name, df in last.items():
        one = df.select("did", "sno", F.col("value").cast("double").alias(name))
        out = one if out is None else out.join(one, ["did", "sno"], "full")
    if out is None:
        raise ValueError("no features")
    return out


def long_to_wide(features: DataFrame, names: list[str]) -> DataFrame:
    """(did, sno, name, value) to one column for each of the names."""
    return features.groupBy("did", "sno").pivot("name", names).agg(F.last("value", ignorenulls=True))


def wide_to_long(features: DataFrame) -> DataFrame:
    names = [c for c in features.columns if c not in ("did", "sno")]
    return features.unpivot(["did", "sno"], names, "name", "value").where("value is not null")


def lead_words(sentences: DataFrame, n: int) -> DataFrame:
    """The first n tokens of each document."""
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sno", split_words(F.col("text")).alias("w")))), lambda s: s["w"]))
    return sentences.groupBy("did").agg(truncate_words(words, n).alias("words"))
