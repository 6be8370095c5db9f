"""Quality classifier with hierarchical empirical Bayes.

Three levels of evidence: a document classifier, the document's path within its
host, and the host. The classifier is fitted on a bounded sample of labelled
rows: logistic regressions on the shape of a text (for quality) and on the
strongest words (for toxicity), whose weights are themselves shrunk toward the
global rate. Its probabilities are summed by host and path over all documents.
Prior strengths come from the variance between hosts, and between paths within
hosts, by the method of moments, so sparse sites stay near their parent. A
document's posterior adds the shift of the log odds by its path's other documents
to its own evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import meet, numbered, slices, text_of, written

#: The classifier is fitted on at most so many labelled rows (those of the smallest hashes), and weighs at most so many words.
SAMPLE_ROWS = 8000
EVIDENCE_WORDS = 50_000
#: Described rows of the sample for each file.
FILE_ROWS = 500
#: Documents below this posterior are rejected.
THRESHOLD = 0.5
#: Strength of the prior of a word's rate, and least documents that must have the word.
WORD_PRIOR, WORD_DOCUMENTS = 10.0, 4
#: A site with more than one in so many of all documents is large: at most so many can be.
HOT_SITES = 1000
_EDGE = 1e-6


def shape(text: str) -> list[float]:
    """Shares of characters, words and lines that tell prose from tables, lists, spam and noise."""
    words = text.split()
    n, k = len(text) or 1, len(words) or 1
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)
    count = np.bincount(codes, minlength=129)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum() + count[128], count[48:58].sum()
    space, stops = count[9:14].sum() + count[32], count[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum()
    often = max(Counter(words).values(), default=0)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return [
        np.log(n), upper / n, lower / n, digit / n, space / n, stops / n, (n - upper - lower - digit - space - stops) / n,
        count[124] / k, count[33] / k, count[46] / k, count[44] / k, n / k, len(set(words)) / k, repeats / k, often / k,
        len(lines) / k, 1 - len(set(lines)) / len(lines), np.log(k),
    ]


_ENDS = ".,;:!?\"'()[]{}*#$%&|-_/\\<>=+~`"


def word_set(text: str) -> set[str]:
    """The distinct words of a text, in lower case, without punctuation at their ends."""
    return {x.strip(_ENDS) for x in set(text.lower().split())}


@dataclass
class Logistic:
    """A regularised logistic regression on standardised columns and their squares."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Logistic:
        x = np.concatenate([x, x**2], axis=1)
        mean, deviation = x.mean(0), x.std(0) + 1e-9
        z = np.concatenate([np.ones((len(x), 1)), (x - mean) / deviation], axis=1)
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) / len(y) + ridge * w
            curvature = (z.T * (p * (1 - p) + 1e-6)) @ z / len(y) + ridge * np.eye(len(w))
            w = w - np.linalg.solve(curvature, gradient)
        return Logistic(mean, deviation, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = (np.concatenate([x, x**2], axis=1) - self.mean) / self.deviation
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.clip(x, -20, 20) @ self.weights[1:], -30, 30)))


def strongest(words: Iterable[str], evidence: dict[str, float]) -> list[float]:
    """The three largest gains among a text's words, and how many words have one."""
    gains = sorted((evidence[w] for w in words if w in evidence), reverse=True)
    return [*(gains + [0.0] * 3)[:3], float(min(len(gains), 10))]


@dataclass
class Classifier:
    """Probabilities that a text is of good quality and that it is toxic; without labels of both kinds, 1 and 0."""

    good: Logistic | None = None
    toxic: Logistic | None = None
    evidence: dict[str, float] = field(default_factory=dict)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        good, bad = np.ones(len(texts)), np.zeros(len(texts))
        if texts and self.good:
            good = self.good(np.array([shape(t) for t in texts]))
        if texts and self.toxic:
            bad = self.toxic(np.array([strongest(word_set(t), self.evidence) for t in texts]))
        return good, bad


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become their shapes and distinct words."""
    for batch in slices(batches, 64):
        texts = batch.column(3).to_pylist()
        shapes, words = [shape(t) for t in texts], [sorted(word_set(t) - {""}) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shapes, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))], names=["kh", "quality", "toxic", "shape", "words"])


def word_gains(described: DataFrame) -> DataFrame:
    """(word, g0, g1, g): what a word adds to the log odds of toxicity, by the documents of an odd hash, an even one, and all.

    Rates are shrunk toward the global one; a word of too few documents or of a
    small gain has null. The ``EVIDENCE_WORDS`` largest gains are kept.
    """
    half = F.pmod("kh", F.lit(2))
    rates = described.agg(*(F.avg(F.when(which, F.col("toxic"))).alias(f"r{i}") for i, which in enumerate((half == 1, half == 0, F.lit(True))))).first()
    each = described.select(half.alias("half"), "toxic", F.explode("words").alias("word"))
    counted = each.groupBy("word").agg(
        *(F.sum(F.when(F.col("half") == h, x).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c, x in (("n", F.lit(1)), ("a", F.col("toxic"))))
    )

    def gain(a: Column, n: Column, rate: float | None) -> Column:
        if rate is None or not 0 < rate < 1:
            return F.lit(None).cast("double")
        p = (a + WORD_PRIOR * rate) / (n + WORD_PRIOR)
        more = F.log(p / (1 - p)) - float(np.log(rate / (1 - rate)))
        return F.when((n >= WORD_DOCUMENTS) & (a > 0) & (more > 1.0), more)

    n0, n1, a0, a1 = (F.col(c) for c in ("n0", "n1", "a0", "a1"))
    gains = [gain(a1, n1, rates[0]).alias("g0"), gain(a0, n0, rates[1]).alias("g1"), gain(a0 + a1, n0 + n1, rates[2]).alias("g")]
    top = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in ("g0", "g1", "g")))
    return counted.select("word", *gains).where(F.coalesce("g0", "g1", "g").isNotNull()).orderBy(top.desc(), "word").limit(EVIDENCE_WORDS)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``sample_rows`` labelled documents, chosen by the hash of their key.

    Labels with a null are not used; of several labels of a key the worse counts,
    of several texts of a key the one of the smallest hash. Texts stay on the
    executors: the driver gets a few numbers of each sampled document, and words
    that are evidence.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = known.groupBy(F.col(key).alias("key")).agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    sample = one.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("th"))
    # bounded by ``sample_rows``, as ``sample`` is; so are the rows of ``described``, which need few files
    labelled = rows.select("key", "th").join(F.broadcast(sample), "key").groupBy("key", "quality", "toxic").agg(F.min("th").alias("th"))
    texts = rows.join(F.broadcast(labelled), ["key", "th"]).select(F.xxhash64("key").alias("kh"), "quality", "toxic", "text")
    described = written(texts.mapInArrow(_described, "kh long, quality double, toxic double, shape array<double>, words array<string>").dropDuplicates(["kh"]).coalesce(-(-sample_rows // FILE_ROWS)), "described")
    gains = word_gains(described).toArrow().to_pydict()
    by_half = [{w: g for w, g in zip(gains["word"], gains[c], strict=True) if g is not None} for c in ("g0", "g1", "g")]
    shared = docs.sparkSession.sparkContext.broadcast(by_half[:2])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            # words are weighed on one half and the regression is fitted on the other, both ways round
            x = [strongest(words, shared.value[k % 2]) for k, words in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x, pa.list_(pa.float64()))], names=["kh", "quality", "toxic", "shape", "gains"])

    table = described.mapInArrow(weighed, "kh long, quality double, toxic double, shape array<double>, gains array<double>").toArrow().sort_by("kh")
    shared.destroy()
    quality, toxic = table["quality"].to_numpy(), table["toxic"].to_numpy()
    square = lambda c, width: table[c].combine_chunks().values.to_numpy().reshape(-1, width)
    good = Logistic.fit(square("shape", len(shape(""))), quality) if len(set(quality)) == 2 else None
    bad = Logistic.fit(square("gains", 4), toxic) if len(set(toxic)) == 2 else None
    return Classifier(good, bad, by_half[2])


def _scored(frame: DataFrame, model: Broadcast[Classifier], text: str, keep_text: bool = False) -> DataFrame:
    """``frame``, without its text unless it is to be kept, and good and toxic from the whole text."""
    at = frame.columns.index(text)
    fields = [f for f in frame.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField("good", T.DoubleType()), T.StructField("toxic", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            good, toxic = model.value([t or "" for t in batch.column(at).to_pylist()])
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], names=schema.names)

    return frame.mapInArrow(run, schema)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))


def _logit(p: Column) -> Column:
    return F.log(_clip(p) / (1 - _clip(p)))


def _evidence() -> Column:
    """The probability that the text is good and not toxic."""
    return _clip(F.col("good") * (1 - F.col("toxic")))


@dataclass(frozen=True)
class Prior:
    """The global mean, and the weights of the global mean in a host's and of the host's mean in a path's, in documents."""

    mean: float
    host: float
    path: float
    documents: int


def site_sums(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, n, s, hn, hs): documents and sums of their evidence by path and by host, from columns host, path, good, toxic.

    Only sums over all sites reach the driver.
    """
    e = _evidence()
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    t = hosts.agg(
        F.sum("hn"), F.sum("hs"), F.sum("hq"), F.count(F.lit(1)), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum("paths"), F.sum("between")
    ).first()
    n, s, q, many, by_host, many_paths, by_path = (float(x or 0) for x in t)
    mean = s / n if n else 0.5

    def strength(within: float, between: float, groups: float) -> float:
        """The weight of the parent, in documents: variance within groups over variance between them."""
        spread = between / max(n, 1) - max(groups, 0) / max(n, 1) * within
        return min(1e9, max(1.0, within / spread)) if spread > 0 else 1e9

    host_strength = strength(max(q - by_host, 0) / max(n, 1), by_host - n * mean * mean, many - 1)
    path_strength = strength(max(q - by_path, 0) / max(n, 1), by_path - by_host, many_paths - many)
    sites = paths.select("host", "path", "n", "s").join(hosts.select("host", "hn", "hs"), "host")
    return sites, Prior(mean, host_strength, path_strength, int(n))


def with_posterior(scored: DataFrame, prior: Prior) -> DataFrame:
    """site, the posterior mean of the path by its other documents, and posterior, the document's own; from good, toxic, n, s, hn, hs.

    A document's own evidence is taken out of its site's sums, for it is added
    to the site's shift of the log odds.
    """
    e = _evidence()
    host = (F.col("hs") - e + prior.host * prior.mean) / (F.col("hn") - 1 + prior.host)
    site = (F.col("s") - e + prior.path * host) / (F.col("n") - 1 + prior.path)
    placed = scored.withColumn("site", site)
    odds = _logit(_evidence()) + _logit(F.col("site")) - _logit(F.lit(prior.mean))
    return placed.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def _site(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str, host: str, path: str, keep_text: bool) -> tuple[DataFrame, list[str]]:
    """Rows of ``docs`` by numbered columns, with good, toxic, site and posterior; and the columns' names."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    rows, names = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    where = [_site(at[host]).alias("host"), _site(at[path]).alias("path")]
    sites, prior = site_sums(_scored(rows.select(F.col(at[text]), *where), model, at[text]))
    picked = [c for c in rows.columns if keep_text or c in (at[key], at[text])]
    placed, both = rows.select(*picked, *where), ["host", "path"]
    met = meet(placed, sites.withColumn("c", F.col("n")), both, "c", prior.documents, HOT_SITES).drop(*both)
    return with_posterior(_scored(met, model, at[text], keep_text), prior), names


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: key, p_good, p_toxic (by the text), p_site (of its path's other documents), posterior, keep.

    A document is kept from a posterior of ``THRESHOLD`` on. Null texts are
    empty; null hosts and paths are a host and a path of their own; repeated rows
    get the same values. Without labels of both kinds the classifier knows
    nothing and everything is kept. Texts are scored whole, twice: once to sum
    sites, once to judge. Rows of large sites meet a broadcast row of their sums;
    texts of the others move only where the table of sites is too large for
    Spark to broadcast. ``source`` and ``lang`` stand in for host and path, for
    documents have no address.
    """
    out, names = _judged(docs.select(key, text, host, path), labels, key, text, host, path, False)
    return out.select(
        F.col("c0").alias(names[0]), F.col("good").alias("p_good"), F.col("toxic").alias("p_toxic"), F.col("site").alias("p_site"), "posterior", (F.col("posterior") >= THRESHOLD).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were, whatever their names."""
    out, names = _judged(docs, labels, key, text, host, path, True)
    return out.where(F.col("posterior") >= THRESHOLD).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
