"""Selection of sentences under a budget. Candidates are (cluster, did, sno, text, score).

Order everywhere: score (rounded to 9 digits) descending, then did, sno. The
greedy choice without redundancy is rounds of joins over similar pairs, and what
is not greedy is a window. Only ``threshold_filter``, whose rule weighs each
candidate against all that it keeps, folds over a cluster in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import binary_cosine, overlap
from ..functions.text import digits, split_words, unordered_bigrams
from ..llm.common import written
from . import products
from .graph import checkpointed
from .redundancy import most_before_in_group, passed_over, picked_in_group, similar_sets


#: A fixed value: what a chosen sentence's score gains.
CHOSEN_BONUS = 10000.0


def ordered(cluster: str = "cluster"):
    return Window.partitionBy(cluster).orderBy(F.desc(F.round("score", 9)), "did", "sno")


def top_sentences(candidates: DataFrame, percent: float | None = 20, absolute: int | None = None) -> DataFrame:
    """The best sentences: a share of the cluster rounded up, or a number."""
    ranked = candidates.withColumn("rank", F.row_number().over(ordered()))
    if absolute is not None:
        return ranked.where(F.col("rank") <= absolute)
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    return ranked.withColumn("__size", size).where(F.col("rank") <= F.ceil(F.col("__size") * percent / 100)).drop("__size")


#: What rerankers may compare sentences by: the set of a sentence's distinct tokens that stands for it, and the similarity of two sets.
SETS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "cosine": (lambda w: w, binary_cosine),
    "overlap": (lambda w: w, overlap),
    "bigram": (lambda w: F.array_distinct(unordered_bigrams(w)), overlap),
}


def _independent(ranked: DataFrame, similarity: str, threshold: float) -> DataFrame:
    """(cluster, place) of the sentences that are as similar as ``threshold`` to no better one that is among them.

    Of sentences with equal sets only the first can be, so copies leave before
    sets are compared. Sentences without words are similar to none.
    """
    alike = SETS[similarity][1]
    empty = ranked.where("size(w) = 0").select("cluster", "place")
    if threshold > 1:
        return ranked.select("cluster", "place")
    if threshold <= 0:
        return ranked.where("place = 1").select("cluster", "place")
    sets = checkpointed(ranked.where("size(w) > 0").groupBy("cluster", F.array_sort("w").alias("w")).agg(F.min("place").alias("place")))
    pairs = similar_sets(sets, alike(F.col("wa"), F.col("wb")), threshold, "cluster", "place")
    gone = passed_over(pairs).withColumnRenamed("b", "place")
    return sets.select("cluster", "place").join(gone, ["cluster", "place"], "left_anti").unionByName(empty)


def _fits(by_words: bool) -> Column:
    """Whether a sentence may still be added: to the words, or the number, of those chosen before it."""
    if not by_words:
        return F.col("count") < F.col("target")
    after = F.col("used") + F.col("n")
    return (after <= F.col("target")) | (F.col("used") == 0) | (F.abs(after - F.col("target")) < F.abs(F.col("used") - F.col("target")))


def _until_target(marked: DataFrame, by_words: bool, *more: str) -> DataFrame:
    """The sentences of ``marked`` (place, taken, target, ...) that are taken before the first that does not fit, with their rank."""
    whole = Window.partitionBy("cluster")
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    run = marked.withColumns({"used": F.coalesce(F.sum(F.col("n") * F.col("taken")).over(before), F.lit(0)), "count": F.coalesce(F.sum("taken").over(before), F.lit(0))})
    stop = F.min(F.when(~_fits(by_words), F.col("place"))).over(whole)
    kept = run.withColumn("stop", stop).where((F.col("taken") == 1) & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))))
    return kept.select("cluster", "did", "sno", "score", "n", (F.col("count") + 1).cast("int").alias("rank"), *more)


def _greedy(candidates: DataFrame, target: Column, by_words: bool, similarity: str | None, threshold: float, text: bool = False) -> DataFrame:
    """(cluster, did, sno, score, n, rank): sentences in order until ``target`` is met, without those too similar to a chosen one; with ``text``, theirs too.

    Candidates meet in their cluster once, with their texts: lists of words are
    longer. A cluster of at most ``products.BLOCK`` is chosen from there; of a
    larger one a single row is sent on, which says that joins have to follow.
    """
    words = split_words(F.col("text"))
    one = ("cluster", F.col("did").cast("bigint").alias("did"), F.col("sno").cast("int").alias("sno"), "score", F.size(words).alias("n"))  # before windows, so that no text is shuffled for them
    place, whole = F.row_number().over(ordered()).alias("place"), Window.partitionBy("cluster")
    if similarity is None:
        return _until_target(candidates.select(*one).select("*", place, target.alias("target")).withColumn("taken", F.lit(1)), by_words)
    more, alike = ["text"] * text, "cosine" if similarity == "cosine" else "overlap"
    ranked = candidates.select(*one, "text").select("*", place, F.count(F.lit(1)).over(whole).alias("size"), target.alias("target"))
    fits, sets = F.col("size") <= products.BLOCK, SETS[similarity][0](F.array_distinct(words))
    sent = ranked.where(fits | (F.col("place") == 1)).select("cluster", "did", "sno", "score", "n", "place", "size", "target", *more, F.when(fits, sets).otherwise(F.array().cast("array<string>")).alias("w"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.select("cluster", "did", "sno", "score", "n").schema) + ", rank int" + ", text string" * text
    block = products.BLOCK
    picked = written(sent.groupBy("cluster").applyInArrow(lambda t: picked_in_group(t, alike, threshold, by_words, block), kind), "picked")
    small, large = picked.where("rank > 0"), picked.where("rank = 0")
    if large.isEmpty():
        return small
    ranked = checkpointed(ranked.where(~fits).select("cluster", "did", "sno", "score", "n", "place", "target", *more, sets.alias("w")))
    free = _independent(ranked, similarity, threshold).withColumn("__taken", F.lit(1))
    marked = ranked.drop("w").join(free, ["cluster", "place"], "left").withColumn("taken", F.coalesce("__taken", F.lit(0))).drop("__taken")
    return small.unionByName(_until_target(marked, by_words, *more))


def _target(percent: float | None, absolute: int | None, words: bool) -> Column:
    total = (F.sum("n") if words else F.count(F.lit(1))).over(Window.partitionBy("cluster"))
    return F.lit(absolute) if absolute is not None else F.ceil(total * (percent or 0) / 100)


def by_words(candidates: DataFrame, percent: float | None = 20, absolute: int | None = None) -> DataFrame:
    """Add the best sentence while the words stay within the target; the first that does not fit is added only if it ends nearer; then stop."""
    return _greedy(candidates, _target(percent, absolute, True), True, None, 0.0)


def without_redundancy(candidates: DataFrame, percent: float | None = 20, absolute: int | None = None, words: bool = False, similarity: str = "cosine", threshold: float = 0.7, text: bool = False) -> DataFrame:
    """As ``top_sentences`` or ``by_words``, passing over sentences as similar as ``threshold`` to a chosen one.

    What is chosen is written. A cluster of at most ``products.BLOCK`` sentences
    is chosen from in one task; in larger ones pairs come from a join on rare words and
    the choice from rounds of joins (``redundancy``), so a cluster may be of any size.
    """
    return _greedy(candidates, _target(percent, absolute, words), words, similarity, threshold, text)


def chosen_bonus(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates whose chosen ones (cluster, did, sno) rank above all others: 10000 and all scores over it are added to theirs."""
    keys = ["cluster", "did", "sno"]
    over = F.coalesce(F.sum(F.when(F.col("score") > CHOSEN_BONUS, F.col("score"))).over(Window.partitionBy("cluster")), F.lit(0.0))
    marked = candidates.withColumn("__over", over).join(chosen.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
    return marked.withColumn("score", F.when(F.col("__in"), F.col("score") + CHOSEN_BONUS + F.col("__over")).otherwise(F.col("score"))).drop("__over", "__in")


def novelty(candidates: DataFrame, factor: float = 1.2) -> DataFrame:
    """Raise a sentence's score if it and the one before it in the cluster are both over the cluster's mean."""
    before = F.lag("score", 1, 0.0).over(Window.partitionBy("cluster").orderBy("did", "sno"))
    mean = F.avg("score").over(Window.partitionBy("cluster"))
    marked = candidates.withColumn("__up", (F.round(before, 9) > F.round(mean, 9)) & (F.round("score", 9) > F.round(mean, 9)))
    return marked.withColumn("score", F.when(F.col("__up"), F.col("score") * factor).otherwise(F.col("score"))).drop("__up")


def mmr(candidates: DataFrame, weight: float = 0.7, percent: float = 20) -> DataFrame:
    """Scores after one pass of maximal marginal relevance.

    Scores are divided by the cluster's largest; in rank order each becomes
    weight * score - (1 - weight) * (largest similarity to a higher one), and
    from the (2 * target + 2)nd on it loses 2. The pass looks only at a prefix of
    ranks, so that prefix meets itself, in one task for each cluster whose prefix
    is at most a block and in a join beyond that; ranks are written once.
    """
    top = Window.partitionBy("cluster")
    scaled = candidates.withColumn("__max", F.max("score").over(top)).withColumn("score", F.when(F.col("__max") > 0, F.col("score") / F.col("__max")).otherwise(F.col("score"))).drop("__max")
    ranked = checkpointed(scaled.withColumn("rank", F.row_number().over(ordered())).withColumn("__limit", 2 * F.ceil(F.count(F.lit(1)).over(top) * percent / 100) + 1))
    sets = ranked.where("rank <= __limit").select("cluster", "rank", F.array_distinct(split_words(F.col("text"))).alias("w"), "__limit")
    kind = f"cluster {sets.schema['cluster'].dataType.simpleString()}, rank int, sim double"
    most = sets.where(F.col("__limit") <= products.BLOCK).drop("__limit").groupBy("cluster").applyInArrow(lambda t: most_before_in_group(t, "cosine"), kind)
    prefix = sets.where(F.col("__limit") > products.BLOCK)
    if not prefix.isEmpty():
        a, b = prefix.alias("a"), prefix.alias("b")
        pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("b.rank") < F.col("a.rank")))
        most = most.unionByName(pairs.groupBy(F.col("a.cluster").alias("cluster"), F.col("a.rank").alias("rank")).agg(F.max(binary_cosine(F.col("a.w"), F.col("b.w"))).alias("sim")))
    out = ranked.join(most, ["cluster", "rank"], "left")
    new = F.when(F.col("rank") <= F.col("__limit"), weight * F.col("score") - (1 - weight) * F.coalesce("sim", F.lit(0.0))).otherwise(F.col("score") - 2.0)
    return out.withColumn("score", new).drop("sim", "rank", "__limit")


def word_budget(candidates: DataFrame, budget: int = 75) -> DataFrame:
    """The best sentences as long as the words before them are under the budget (the one that crosses it is in)."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    before = F.sum("n").over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("n", n).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).drop("before")


def prefer(candidates: DataFrame, values: DataFrame, sign: int = 1, normalize: bool = False) -> DataFrame:
    """Add (or take off) a value by document or sentence: source order, time, number of relations.

    ``values`` has the key columns (did, or did and sno) and ``value``; missing
    values are 0. normalize: (value - least) / (largest - least) in the cluster,
    0 where all are equal.
    """
    return preferences(candidates, {"value": values}, [("score", "value", sign, normalize)]).drop("value")


def preferences(candidates: DataFrame, values: dict[str, DataFrame], wanted: list[tuple[str, str, int, bool]]) -> DataFrame:
    """Candidates with a column for each of ``wanted`` (name, which of ``values``, sign, normalize): the score of ``prefer``.

    The candidates are read once, and each table of values is joined once, under its name.
    """
    whole = Window.partitionBy("cluster")
    out = candidates
    for name, table in values.items():
        keys = [c for c in table.columns if c != "value"]
        out = out.join(table.withColumnRenamed("value", name), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("double"))
    ends = {f"__{end}_{v}": function(v).over(whole) for v in dict.fromkeys(v for _, v, _, n in wanted if n) for end, function in (("low", F.min), ("high", F.max))}
    out = out.withColumns(ends) if ends else out

    def added(v: str, normalize: bool) -> Column:
        if not normalize:
            return F.col(v)
        low, high = F.col(f"__low_{v}"), F.col(f"__high_{v}")
        return F.when(high > low, (F.col(v) - low) / (high - low)).otherwise(0.0)

    return out.withColumns({name: F.col("score") + sign * added(v, normalize) for name, v, sign, normalize in wanted}).drop(*ends)


def source_order(meta: DataFrame) -> DataFrame:
    """(did, value): the place of a document's source among the sources by first appearance (did, source, ord)."""
    first = meta.groupBy("source").agg(F.min("ord").alias("first"))
    ranked = first.withColumn("value", F.dense_rank().over(Window.orderBy("first")))  # one row for each source
    return meta.join(ranked, "source").select("did", "value")


def relation_degree(relations: DataFrame) -> DataFrame:
    """(did, sno, value): relations into and out of each sentence."""
    ends = relations.select(F.col("sdid").alias("did"), F.col("ssent").alias("sno")).unionAll(relations.select("tdid", "tsent"))
    return ends.groupBy("did", "sno").agg(F.count(F.lit(1)).alias("value"))


def judged_extract(judgements: DataFrame, size: int = 10, judges: list[str] | None = None) -> DataFrame:
    """The sentences of the largest summed utility (cluster, did, sno, judge, util) of the chosen judges."""
    chosen = judgements.where(F.col("judge").isin(judges)) if judges else judgements
    summed = chosen.groupBy("cluster", "did", "sno").agg(F.sum("util").alias("score"))
    return summed.withColumn("rank", F.row_number().over(ordered())).where(F.col("rank") <= size)


def extract_order(chosen: DataFrame) -> DataFrame:
    """Chosen sentences in order of did (as text) and sno, numbered from 1."""
    order = Window.partitionBy("cluster").orderBy(F.col("did").cast("string"), "sno")
    return chosen.withColumn("ord", F.row_number().over(order))


def summary_text(extract: DataFrame, sentences: DataFrame) -> DataFrame:
    """(cluster, summary): lines of [ord] and the sentence."""
    return summary_lines(extract.select("cluster", "did", "sno", "ord").join(sentences.select("did", "sno", "text"), ["did", "sno"]))


def summary_lines(extract: DataFrame) -> DataFrame:
    """``summary_text`` of an extract that has its texts."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return extract.groupBy("cluster").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["ord"].cast("string"), F.lit("]  "), x["text"])), "\n").alias("summary"))


def prefix_summary(ranked: DataFrame, words: int = 100) -> DataFrame:
    """(cluster, did, sno, rank): sentences by rank while their words sum to at most ``words``."""
    total = F.sum("n").over(Window.partitionBy("cluster").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).where(F.col("total") <= words)


def threshold_filter(candidates: DataFrame, params: DataFrame, budget: int = 665, words: tuple[int, int] = (10, 55)) -> DataFrame:
    """A redundancy filter over candidates in a given order (cluster, ord, text, sal), for each row of params (lam, mini).

    A candidate is dropped if lam * 10 * sal - (1 - lam) * (largest similarity to
    a kept one) is under mini, if its tokens are not within ``words``, or if it
    would take the characters over the budget; later ones may still fit. All
    settings of a sweep are one job. Candidates that no setting can keep are left
    out before clusters are gathered.
    """
    tokens = split_words(F.col("text"))
    item = F.struct("ord", F.col("sal").cast("double").alias("sal"), F.length("text").alias("chars"), F.array_distinct(tokens).alias("w"))
    able = candidates.where(F.size(tokens).between(*words) & (F.length("text") <= budget))  # no other can be kept, whatever is
    rows = able.groupBy("cluster").agg(F.array_sort(F.collect_list(item)).alias("items")).join(F.broadcast(params))  # a handful of settings
    kind = "struct<ord:int,chars:int,w:array<string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(s["out"], lambda c: binary_cosine(c["w"], x["w"]))), F.lit(0.0))
        good = F.round(F.col("lam") * 10 * x["sal"] - (1 - F.col("lam")) * most, 9) >= F.col("mini")
        take = (s["used"] + x["chars"] <= budget) & good  # sets are compared only if there is room
        one = F.struct(x["ord"].cast("int").alias("ord"), x["chars"].alias("chars"), x["w"].alias("w"))
        return F.when(take, F.struct((s["used"] + x["chars"]).alias("used"), F.concat(s["out"], F.array(one)).alias("out"))).otherwise(s)

    kept = rows.select("cluster", "lam", "mini", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("x"))
    return kept.select("cluster", "lam", "mini", "x.ord", "x.chars")


def drop_repeats(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Candidates in rank order without those whose similarity to a kept one is over the threshold."""
    return _greedy(candidates, F.lit(1 << 30), False, "cosine", threshold + 1e-12)


def permutation(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """A seeded random order in each cluster."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(digits(F.col("did"), F.col("sno"), F.lit(seed)), "did", "sno")))
