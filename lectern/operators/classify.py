"""Linear classifiers: one score for each sentence from its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uniform

#: The defaults: Centroid and Position count alike, sentences of under 9 words score 0.
WEIGHTS = {"Centroid": 1.0, "Position": 1.0}
LENGTH_CUTOFF = 9
REDUNDANCY = ("cosine", 0.7)
PERCENT = 20


def linear(weights: dict[str, float] | None = None, cutoff: int = LENGTH_CUTOFF, length: str = "Length", discard_missing: bool = True) -> Column:
    """Weighted sum of features, 0 for a sentence shorter than ``cutoff``.

    A missing length is discarded too; with ``discard_missing=False`` a missing
    or zero length keeps its score, as older tools do.
    """
    total = sum((F.coalesce(F.col(name), F.lit(0.0)) * w for name, w in (weights or WEIGHTS).items()), F.lit(0.0))
    short = F.coalesce(F.col(length), F.lit(0)) < cutoff
    if not discard_missing:
        short = short & (F.coalesce(F.col(length), F.lit(0)) > 0)
    return F.when(short, 0.0).otherwise(total)


def lead(cutoff: int = LENGTH_CUTOFF) -> Column:
    """1 / sno, 0 for a sentence shorter than ``cutoff``."""
    return F.when(F.col("Length") < cutoff, 0.0).otherwise(1.0 / F.col("sno"))


def random_score(seed: int = 0) -> Column:
    """A score in [0, 1) that depends on (did, sno) and the seed alone."""
    return uniform(F.col("did"), F.col("sno"), F.lit(seed))


def score(features: DataFrame, classifier: Column) -> DataFrame:
    return features.withColumn("score", classifier)
