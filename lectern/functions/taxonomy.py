"""Distances of words over a taxonomy: information content and the Jiang-Conrath distance.

The taxonomy is a table (child, parent) of any acyclic graph, counts are a table
(concept, n), and words name their concepts in a table (word, concept); none is
shipped. Content goes up by iterated joins, and common ancestors come from a join
on ancestors, so nothing is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpointed


def ancestors(links: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(concept, ancestor): every concept with itself and all that lie above it, by as many joins as the taxonomy has levels.

    Links with a null end and loops are ignored; in a ring all are ancestors of one another.
    """
    up = checkpointed(links.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct())
    every = up.select(F.col("child").alias("concept")).union(up.select("parent"))
    every = every.union(concepts.select("concept").where("concept is not null")) if concepts is not None else every
    known = checkpointed(every.distinct().withColumn("ancestor", F.col("concept")))
    new = known
    while True:
        found = new.join(up.withColumnRenamed("child", "ancestor"), "ancestor").select("concept", F.col("parent").alias("ancestor")).distinct()
        new = checkpointed(found.join(known, ["concept", "ancestor"], "left_anti"))
        if not new.head(1):
            return known
        known = checkpointed(known.unionByName(new))


def information_content(above: DataFrame, counts: DataFrame, smooth: float = 1.0) -> DataFrame:
    """(concept, n, ic): a concept's count with all below it, each counted once, and -ln of its share.

    ``above`` is from ``ancestors``; every concept counts ``smooth`` more than
    its own n, so none is infinite. The share is of all counts.
    """
    own = counts.where("concept is not null").groupBy("concept").agg(F.sum("n").alias("n"))
    plain = above.select("concept").distinct().join(own, "concept", "left").select("concept", (F.coalesce("n", F.lit(0)) + smooth).alias("n"))
    total = plain.agg(F.sum("n").alias("total"))
    rolled = above.join(plain, "concept").groupBy(F.col("ancestor").alias("concept")).agg(F.sum("n").alias("n"))
    return rolled.join(F.broadcast(total)).select("concept", "n", (-F.log(F.col("n") / F.col("total"))).alias("ic"))  # one row


def jiang_conrath(pairs: DataFrame, above: DataFrame, content: DataFrame, keys: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``pairs`` of concepts with ``common`` (the common ancestor of most content; ties: the smallest) and ``distance``.

    distance = ic(a) + ic(b) - 2 ic(common); null where the concepts have no
    common ancestor or are unknown. Only ancestors of the pairs' own concepts meet.
    """
    a, b = keys
    known = above.join(content.select(F.col("concept").alias("ancestor"), F.col("ic").alias("up")), "ancestor")
    distinct = pairs.select(a, b).distinct()
    left = distinct.join(known.withColumnRenamed("concept", a), a)
    met = left.join(known.select(F.col("concept").alias(b), "ancestor"), [b, "ancestor"])
    best = met.groupBy(a, b).agg(F.min(F.struct((-F.col("up")).alias("k"), "ancestor")).alias("best"))
    ic = lambda key, name: content.select(F.col("concept").alias(key), F.col("ic").alias(name))
    rated = best.join(ic(a, "__a"), a).join(ic(b, "__b"), b)
    distance = F.col("__a") + F.col("__b") + 2 * F.col("best.k")
    return pairs.join(rated.select(a, b, F.col("best.ancestor").alias("common"), distance.alias("distance")), [a, b], "left")


def word_similarity(pairs: DataFrame, senses: DataFrame, above: DataFrame, content: DataFrame) -> DataFrame:
    """(x, y, similarity): 1 / (1 + distance) of the closest senses (word, concept) of two words; 0 without any, 1 for equal words."""
    sense = lambda key, name: senses.select(F.col("word").alias(key), F.col("concept").alias(name)).distinct()
    concepts = pairs.select("x", "y").distinct().join(sense("x", "a"), "x").join(sense("y", "b"), "y")
    nearest = jiang_conrath(concepts, above, content).groupBy("x", "y").agg(F.min("distance").alias("distance"))
    value = F.when(F.col("x") == F.col("y"), 1.0).when(F.col("distance").isNull(), 0.0).otherwise(1 / (1 + F.greatest("distance", F.lit(0.0))))
    return pairs.join(nearest, ["x", "y"], "left").withColumn("similarity", value).drop("distance")
