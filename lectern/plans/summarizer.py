"""The summarizer: features, a classifier and a reranker composed into one lazy plan.

Features, classifiers and rerankers are plain functions in registries, so a
pipeline takes new ones by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import idf_table
from ..llm.common import written
from ..operators import centroids, classify, features, select

Feature = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]

FEATURES: dict[str, Feature] = {
    "Centroid": lambda s, extra: features.centroid_values(extra["words"], extra["idf"]),
    "SimWithFirst": lambda s, extra: features.similarity_with_first(s, extra["idf"], extra["words"]),
    "IsLongestSentence": lambda s, extra: features.is_longest(s),
    "QueryCosine": lambda s, extra: features.query_cosine(s, extra["queries"], extra["idf"]),
    "QueryCosineNoIDF": lambda s, extra: features.query_features(s, extra["queries"]).select("did", "sno", F.col("cosine").alias("value")),
    "QueryWordOverlap": lambda s, extra: features.query_features(s, extra["queries"]).select("did", "sno", F.col("overlap").alias("value")),
    "QueryPhraseMatch": lambda s, extra: features.phrase_match(s, extra["phrases"]),
}
#: Features that read the table of counted words, which is written once for all of them; 0 where they have no row.
WORD_FEATURES = {"Centroid", "SimWithFirst"}
#: Features that a sentence has by itself: columns, not joins.
ROW_FEATURES: dict[str, Callable[[], Column]] = {"Position": lambda: features.position(F.col("sno")), "Length": lambda: features.length(F.col("text"))}
CLASSIFIERS: dict[str, Callable[[], Column]] = {"default": classify.linear, "lead": classify.lead, "random": classify.random_score}
RERANKERS: dict[str, Callable[..., DataFrame]] = {
    "identity": select.top_sentences,
    "words": select.by_words,
    "default": select.without_redundancy,
    "novelty": lambda c, **k: select.without_redundancy(select.novelty(c), **k),
    "mmr": lambda c, **k: select.top_sentences(select.mmr(c, percent=k.get("percent", 20)), **k),
    "permutation": lambda c, **k: select.permutation(c, **k),
}


def register_feature(name: str, function: Feature) -> None:
    ROW_FEATURES.pop(name, None)
    WORD_FEATURES.discard(name)
    FEATURES[name] = function


def register_row_feature(name: str, make: Callable[[], Column]) -> None:
    FEATURES.pop(name, None)
    WORD_FEATURES.discard(name)
    ROW_FEATURES[name] = make


def register_classifier(name: str, make: Callable[[], Column]) -> None:
    CLASSIFIERS[name] = make


def register_reranker(name: str, function: Callable[..., DataFrame]) -> None:
    RERANKERS[name] = function


@dataclass
class Summarizer:
    """What to compute.

    ``extra`` has the tables that features need: idf (w, idf), queries (cluster,
    query), phrases; words, if ``features.counted_words`` of the sentences is
    written already. Without an idf table that of the sentences' documents is taken.
    """

    features: tuple[str, ...] = ("Centroid", "Position", "Length")
    classifier: str = "default"
    reranker: str = "default"
    options: dict[str, object] = field(default_factory=lambda: {"percent": classify.PERCENT})
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self, sentences: DataFrame) -> dict[str, DataFrame]:
        """``extra`` with the words, written once, and idf if features need them and they are not given."""
        extra = dict(self.extra)
        own_idf = "idf" not in extra and not {"Centroid", "SimWithFirst", "QueryCosine"}.isdisjoint(self.features)
        if "words" not in extra and (own_idf or not WORD_FEATURES.isdisjoint(self.features)):
            extra["words"] = written(features.counted_words(sentences), "words")
        if own_idf:
            extra["idf"] = idf_table(extra["words"])
        return extra

    def by_cluster(self) -> bool:
        """Whether the centroid is the only feature that reads words or idf, and both are the sentences' own: then no table of them is made."""
        readers = WORD_FEATURES | {"QueryCosine"}
        return "Centroid" in WORD_FEATURES and readers.intersection(self.features) == {"Centroid"} and not {"idf", "words"} & self.extra.keys()

    def scores(self, sentences: DataFrame) -> DataFrame:
        """Sentences with their features and score."""
        own = [n for n in dict.fromkeys((*self.features, "Length")) if n in ROW_FEATURES]
        whole = centroids.with_centroid(sentences) if self.by_cluster() else None
        out = (sentences if whole is None else whole).withColumns({n: ROW_FEATURES[n]().cast("double") for n in own})
        extra = self.tables(sentences) if whole is None else self.extra
        joined = [(n, FEATURES[n](sentences, extra)) for n in self.features if n not in out.columns]
        if joined:
            out = out.join(features.combine(*joined), ["did", "sno"], "left").fillna(0.0, [n for n, _ in joined if n in WORD_FEATURES])
        return out.withColumn("score", CLASSIFIERS[self.classifier]())

    def chosen(self, sentences: DataFrame, **more: object) -> DataFrame:
        return select.extract_order(RERANKERS[self.reranker](self.scores(sentences), **self.options, **more))

    def extract(self, sentences: DataFrame) -> DataFrame:
        """(cluster, did, sno, ord): the chosen sentences in the order of their documents."""
        return self.chosen(sentences).select("cluster", "did", "sno", "ord")

    def summary(self, sentences: DataFrame) -> DataFrame:
        """(cluster, summary). A reranker that hands on the texts of what it chooses spares a join with all texts."""
        chosen = self.chosen(sentences, **{"text": True} if RERANKERS[self.reranker] is select.without_redundancy else {})
        return select.summary_lines(chosen) if "text" in chosen.columns else select.summary_text(chosen, sentences)


def sweep(candidates: DataFrame, lams: list[float], minis: list[float], budget: int = 665) -> DataFrame:
    """Kept sentences of the redundancy filter for every pair of settings, as one job."""
    spark = candidates.sparkSession
    params = spark.createDataFrame([(float(a), float(b)) for a in lams for b in minis], "lam double, mini double")
    return select.threshold_filter(candidates, params, budget)
