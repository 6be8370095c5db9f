"""Evaluation of extracts, judges, rankings and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def extract_scores(a: DataFrame, b: DataFrame, weight: str | None = None) -> DataFrame:
    """(cluster, precision, recall) of the extract ``a`` against ``b``, sets of (cluster, did, sno); weighted by a column of both if named."""
    key = ["cluster", "did", "sno"]
    value = F.col(weight) if weight else F.lit(1)
    total = lambda df, name: df.groupBy(*key).agg(F.max(value).alias("v")).groupBy("cluster").agg(F.sum("v").alias(name))
    both = total(a.join(b.select(*key), key, "left_semi"), "common")
    out = total(a, "na").join(total(b, "nb"), "cluster", "full").join(both, "cluster", "left")
    share = lambda n: F.when(F.col(n) > 0, F.coalesce("common", F.lit(0)) / F.col(n)).otherwise(0.0)
    return out.select("cluster", share("na").alias("precision"), share("nb").alias("recall"))


def judge_table(items: DataFrame, judges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item, judge, category): 1 for what a judge chose (item, judge), 0 for the other items. ``judges`` is a short list."""
    every = items.select("item").distinct().join(judges.select("judge").distinct(), how="cross")  # every item by every judge is the result
    marked = chosen.select("item", "judge").distinct().withColumn("category", F.lit(1))
    return every.join(marked, ["item", "judge"], "left").withColumn("category", F.coalesce("category", F.lit(0)))


def kappa(table: DataFrame) -> DataFrame:
    """(pa, pe, kappa) of judges over items (item, judge, category), every item judged by as many; kappa is null where pe is 1."""
    counts = table.groupBy("item", "category").agg(F.count(F.lit(1)).alias("c"))
    item = counts.groupBy("item").agg(F.sum("c").alias("k"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    pa = item.agg(F.avg(F.when(F.col("k") > 1, F.col("agree") / (F.col("k") * (F.col("k") - 1)))).alias("pa"))
    share = table.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    pe = share.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    return pa.join(pe).select("pa", "pe", F.when(F.col("pe") < 1, (F.col("pa") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))  # one row each


def _best(judgements: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, judge, best): the largest utility that an extract of the cluster's size can have."""
    rank = F.row_number().over(Window.partitionBy("cluster", "judge").orderBy(F.desc("util"), "did", "sno"))
    return judgements.withColumn("rank", rank).join(sizes, "cluster").where(F.col("rank") <= F.col("size")).groupBy("cluster", "judge").agg(F.sum("util").alias("best"))


def relative_utility(extract: DataFrame, judgements: DataFrame) -> DataFrame:
    """(cluster, utility): mean over judges of the extract's utility over the best of its size."""
    sizes = extract.select("cluster", "did", "sno").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    got = extract.select("cluster", "did", "sno").distinct().join(judgements, ["cluster", "did", "sno"]).groupBy("cluster", "judge").agg(F.sum("util").alias("got"))
    per = _best(judgements, sizes).join(got, ["cluster", "judge"], "left")
    return per.groupBy("cluster").agg(F.avg(F.when(F.col("best") > 0, F.coalesce("got", F.lit(0)) / F.col("best")).otherwise(0.0)).alias("utility"))


def judge_utility(judgements: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, judge, other, utility): what the best extract of one judge is worth to another, over that one's best."""
    rank = F.row_number().over(Window.partitionBy("cluster", "judge").orderBy(F.desc("util"), "did", "sno"))
    choice = judgements.withColumn("rank", rank).join(sizes, "cluster").where(F.col("rank") <= F.col("size")).select("cluster", "judge", "did", "sno")
    other = judgements.select("cluster", F.col("judge").alias("other"), "did", "sno", "util")
    got = choice.join(other, ["cluster", "did", "sno"]).where("judge <> other").groupBy("cluster", "judge", "other").agg(F.sum("util").alias("got"))
    best = _best(judgements, sizes).withColumnRenamed("judge", "other")
    return got.join(best, ["cluster", "other"]).select("cluster", "judge", "other", F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(0.0).alias("utility"))


def normalized_utility(extract: DataFrame, judgements: DataFrame) -> DataFrame:
    """(cluster, utility, random, judges, normalized): (utility - random) / (judges - random), null where the judges do no better than chance."""
    sizes = extract.select("cluster", "did", "sno").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    means = judgements.groupBy("cluster", "judge").agg(F.avg("util").alias("mean"))
    chance = means.join(sizes, "cluster").join(_best(judgements, sizes), ["cluster", "judge"])
    random = chance.groupBy("cluster").agg(F.avg(F.when(F.col("best") > 0, F.col("mean") * F.col("size") / F.col("best")).otherwise(0.0)).alias("random"))
    agreed = judge_utility(judgements, sizes).groupBy("cluster").agg(F.avg("utility").alias("judges"))
    out = relative_utility(extract, judgements).join(random, "cluster").join(agreed, "cluster")
    return out.withColumn("normalized", F.when(F.round("judges", 9) > F.round("random", 9), (F.col("utility") - F.col("random")) / (F.col("judges") - F.col("random"))))


def model_unit_utility(units: DataFrame, words: DataFrame, idf: DataFrame, unknown: float = 5.0) -> DataFrame:
    """(item, util) on a scale to 10: idf * ln(frequency) of a sentence's words that occur in the model units, over that and the idf of the others.

    ``units`` (w, freq) are the model's words, ``words`` (item, w) the sentence's.
    """
    one = words.distinct().join(units, "w", "left").join(idf.select("w", "idf"), "w", "left").withColumn("idf", F.coalesce("idf", F.lit(unknown)))
    gain = F.when(F.col("freq") > 0, F.col("idf") * F.log("freq")).otherwise(0.0)
    miss = F.when(F.col("freq").isNull(), F.col("idf")).otherwise(0.0)
    summed = one.groupBy("item").agg(F.sum(gain).alias("same"), F.sum(miss).alias("other"))
    return summed.select("item", F.when(F.col("same") + F.col("other") > 0, 10 * F.col("same") / (F.col("same") + F.col("other"))).otherwise(0.0).alias("util"))


def pearson(a: DataFrame, b: DataFrame, key: str = "did", value: str = "score") -> DataFrame:
    """(items, pearson) of two score lists; an item that one of them lacks scores 0 there."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full").na.fill(0.0, ["x", "y"])
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("y")
    top = F.sum(F.col("x") * F.col("y")) - sx * sy / n
    below = F.sqrt((F.sum(F.col("x") * F.col("x")) - sx * sx / n) * (F.sum(F.col("y") * F.col("y")) - sy * sy / n))
    return both.agg(n.alias("items"), F.when(below > 0, top / below).otherwise(0.0).alias("pearson"))


def _average_rank(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Ranks by falling value, ties with the mean of theirs, from the counts of equal values.

    Distinct values are dealt by range and written down, so that each part's
    place among the parts is known; a part's rank starts where the sums of the
    parts before it end, and no task sees all values.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    parts = checkpointed(counts.repartitionByRange(F.desc(value)).select(value, "c", F.spark_partition_id().alias("part")))
    sums = parts.groupBy("part").agg(F.sum("c").alias("s"))
    begin = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))  # one row for each part
    within = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.join(begin, "part").select(F.col(value), (F.col("begin") + within + (F.col("c") + 1) / 2).alias(name))
    return df.join(ranked, value).select(key, name)


def spearman(a: DataFrame, b: DataFrame, key: str = "did", value: str = "score") -> DataFrame:
    """(items, spearman) with tie-averaged ranks; an item that one list lacks ranks after all of that list's items."""
    ra, rb = _average_rank(a, key, value, "ra"), _average_rank(b, key, value, "rb")
    sizes = a.agg(F.count(F.lit(1)).alias("na")).join(b.agg(F.count(F.lit(1)).alias("nb")))  # one row each
    both = ra.join(rb, key, "full").join(F.broadcast(sizes)).select(F.coalesce("ra", F.col("na") + 1).alias("x"), F.coalesce("rb", F.col("nb") + 1).alias("y"))
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("y")
    below = F.sqrt((F.sum(F.col("x") * F.col("x")) - sx * sx / n) * (F.sum(F.col("y") * F.col("y")) - sy * sy / n))
    return both.agg(n.alias("items"), F.when(below > 0, (F.sum(F.col("x") * F.col("y")) - sx * sy / n) / below).otherwise(0.0).alias("spearman"))


EDGE = ["sdid", "ssent", "tdid", "tsent"]


def _typed(relations: DataFrame, name: str) -> DataFrame:
    return relations.groupBy(*EDGE).agg(F.array_sort(F.collect_set("type")).alias(name))


def relation_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pairs, full, partial, single): pairs on which two judges name the same types, some same type, or only one names any."""
    both = _typed(a, "x").join(_typed(b, "y"), EDGE, "full")
    full = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    single = F.col("x").isNull() | F.col("y").isNull()
    partial = ~full & ~single & F.arrays_overlap("x", "y")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(F.count(F.lit(1)).alias("pairs"), count(full).alias("full"), count(F.coalesce(partial, F.lit(False))).alias("partial"), count(single).alias("single"))


def reversed_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that ``a`` directs one way and ``b`` only the other way."""
    back = b.select(F.col("tdid").alias("sdid"), F.col("tsent").alias("ssent"), F.col("sdid").alias("tdid"), F.col("ssent").alias("tsent")).distinct()
    return a.select(*EDGE).distinct().join(back, EDGE, "left_semi").join(b.select(*EDGE).distinct(), EDGE, "left_anti")


def merge_relations(*relations: DataFrame) -> DataFrame:
    """All relations as one table, equal rows once."""
    out = relations[0]
    for more in relations[1:]:
        out = out.unionByName(more)
    return out.distinct()


def filter_relations(relations: DataFrame, extract: DataFrame | None = None, types: list[str] | None = None, least: int = 1) -> DataFrame:
    """Relations of the types whose both ends are in the extract (did, sno) and that ``least`` judges gave for the pair."""
    out = relations.where(F.col("type").isin(types)) if types else relations
    if extract is not None:
        ends = extract.select("did", "sno").distinct()
        for did, sno in (("sdid", "ssent"), ("tdid", "tsent")):
            out = out.join(ends.select(F.col("did").alias(did), F.col("sno").alias(sno)), [did, sno], "left_semi")
    strong = out.groupBy(*EDGE).agg(F.count_distinct("judge").alias("n")).where(F.col("n") >= least).select(*EDGE)
    return out.join(strong, EDGE, "left_semi")


def connectivity(extract: DataFrame, relations: DataFrame) -> DataFrame:
    """(cluster, sentences, pairs, connected): unordered pairs of an extract's sentences, and those with a relation either way.

    Connected pairs come from the relations, not from all pairs.
    """
    place = F.concat_ws("#", F.col("did"), F.col("sno"))
    chosen = extract.select("cluster", place.alias("p")).distinct()
    size = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("sentences"))
    ends = relations.select(F.concat_ws("#", "sdid", "ssent").alias("s"), F.concat_ws("#", "tdid", "tsent").alias("t")).where("s <> t")
    pairs = ends.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    met = pairs.join(chosen.withColumnRenamed("p", "a"), "a").join(chosen.withColumnRenamed("p", "b"), ["cluster", "b"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("connected"))
    out = size.join(met, "cluster", "left")
    return out.select("cluster", "sentences", (F.col("sentences") * (F.col("sentences") - 1) / 2).cast("long").alias("pairs"), F.coalesce("connected", F.lit(0)).alias("connected"))


def similarity_as_relation(similarities: DataFrame, relations: DataFrame, threshold: float) -> DataFrame:
    """(similar, related, both, precision, recall) of pairs (x, y, value) at a threshold as a guess of related pairs (x, y)."""
    marked = similarities.join(relations.select("x", "y").distinct().withColumn("rel", F.lit(1)), ["x", "y"], "full")
    similar, related = F.coalesce(F.round("value", 9) >= threshold, F.lit(False)), F.col("rel").isNotNull()
    out = marked.agg(F.count(F.when(similar, 1)).alias("similar"), F.count(F.when(related, 1)).alias("related"), F.count(F.when(similar & related, 1)).alias("both"))
    share = lambda n: F.when(F.col(n) > 0, F.col("both") / F.col(n)).otherwise(0.0)
    return out.select("*", share("similar").alias("precision"), share("related").alias("recall"))


def decoder_scores(decoded: DataFrame) -> DataFrame:
    """(cluster, precision, recall) of predicted ids against answers (cluster, answer, pred: arrays), as sets without 0, denominators at least 1."""
    clean = lambda c: F.array_except(F.array_distinct(c), F.array(F.lit(0)))
    hits = F.size(F.array_intersect(clean(F.col("answer")), clean(F.col("pred"))))
    over = lambda c: hits / F.greatest(F.size(clean(F.col(c))), F.lit(1))
    return decoded.select("cluster", over("pred").alias("precision"), over("answer").alias("recall"))


def column_scores(table: DataFrame, by: Column, values: list[str]) -> DataFrame:
    """Mean of each column by group: rows of a results table turned into one row for each run."""
    return table.groupBy(by).agg(*(F.avg(v).alias(v) for v in values))
