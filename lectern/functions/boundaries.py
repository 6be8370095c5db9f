"""Sentence boundaries learned from a corpus without labels.

What a full stop means is learned from counts over all texts (after Kiss and
Strunk, 2006): words that are written with a full stop far more often than chance
would have it are abbreviations, words that follow sentence ends more often than
chance are sentence starters, and pairs around a full stop that stay together
more often than chance are collocations. All three are log-likelihood ratios of
grouped counts, and counts of tokens, with the next one where a sentence may end,
are all that they need: texts are read once for them, for all languages together.
Applying them joins such places with distinct pairs, so no task holds the
vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpointed
from .text import bound

#: Fixed values of the published method.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88

#: Tokens are runs without white space.
_TOKEN = r"\S+"
#: What a token looks like that a full stop, ``!`` or ``?`` may close.
_MARKED = r"[.!?][\"')\]},;:]*$"


@dataclass
class Boundaries:
    """abbreviations (by, type, score), starters (by, type, score), collocations (by, first, second, score); ``by`` is the language, or empty."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def _core(token: Column) -> Column:
    """A token in lower case without quotes and brackets at its ends."""
    return F.lower(F.regexp_replace(token, "^[\"'(\\[{]+|[\"')\\]},;:]+$", ""))


def word_rows(texts: DataFrame, key: str = "did", text: str = "text") -> DataFrame:
    """(did, i, token, core, type, dot, end): each token, its lower-case core, the core without a full stop, and how it ends.

    ``dot``: a full stop closes it and does not stand alone; ``end``: ``!`` or ``?`` closes it. Numbers are the type ``##number##``.
    """
    rows = texts.select(F.col(key).alias("did"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0))).alias("i", "token"))
    return rows.select("did", "i", *_typed("token"))


def _typed(token: str, prefix: str = "") -> list[Column]:
    """A token and the core, type, dot and end of ``word_rows``."""

    def of(core: Column) -> Column:
        dot = core.rlike(r"[^.]\.$")
        bare = F.when(dot, F.regexp_replace(core, r"\.$", "")).otherwise(core)
        kind = F.when(bare.rlike(r"^-?[\d.,]*\d$"), "##number##").otherwise(bare)
        return F.struct(core.alias("core"), kind.alias("type"), dot.alias("dot"), core.rlike("[!?]$").alias("end"))

    made = bound(_core(F.col(token)), of)
    return [F.col(token), *(made[c].alias(prefix + c) for c in ("core", "type", "dot", "end"))]


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-300)))


def dunning(count: Column, partner: Column, both: Column, total: Column) -> Column:
    """The log-likelihood ratio of two counts that meet ``both`` times among ``total``."""
    p, p1 = partner / total, both / count
    p2 = F.when(total > count, (partner - both) / (total - count)).otherwise(F.lit(1.0))

    def likelihood(k: Column, n: Column, x: Column) -> Column:
        return k * _log(x) + (n - k) * _log(1 - x)

    return -2 * (likelihood(both, count, p) + likelihood(partner - both, total - count, p) - likelihood(both, count, p1) - likelihood(partner - both, total - count, p2))


def abbreviation_scores(words: DataFrame) -> DataFrame:
    """(type, with_dot, without, score) of every type that a full stop follows.

    The ratio compares how often the full stop follows the type with a full stop
    being almost certain (0.99) and with its share of all tokens. It is scaled by
    the type's length, its inner full stops, and how often it lacks a full stop.
    """
    letters = words.where(F.col("type").rlike(r"\p{L}"))
    counts = letters.groupBy("type").agg(F.sum(F.col("dot").cast("long")).alias("with_dot"), F.sum((~F.col("dot")).cast("long")).alias("without"))
    totals = words.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("dot").cast("long")).alias("dots"))
    rows = counts.where("with_dot > 0").join(F.broadcast(totals))  # one row
    return rows.select("type", "with_dot", "without", _abbreviation().alias("score"))


def _abbreviation() -> Column:
    """The score of ``abbreviation_scores`` from type, with_dot, without, total and dots."""
    n, k = F.col("with_dot") + F.col("without"), F.col("with_dot")
    share = F.col("dots") / F.col("total")
    ratio = -2 * ((k * _log(share) + (n - k) * _log(1 - share)) - (k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01))))
    inner = F.length("type") - F.length(F.regexp_replace("type", r"\.", ""))
    length = F.greatest(F.length("type") - inner, F.lit(1))
    return ratio * F.exp(-length) * (inner + 1) * F.pow(length.cast("double"), -F.col("without"))


def _language(by: str | None) -> Column:
    return F.lit("").alias("by") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("")).alias("by")


def _pairs(tokens: Column) -> Column:
    """(i, token, next) for each token; ``next`` is null unless the token is marked and another one follows."""
    return bound(tokens, lambda ts: F.transform(ts, lambda t, i: F.struct(i.alias("i"), t.alias("token"), F.when(t.rlike(_MARKED), F.get(ts, i + 1)).alias("next"))))


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0))


def _closed(pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``pairs`` with ``abbreviation`` and ``closes``: ``!`` or ``?``, or a full stop after what is no abbreviation."""
    known = abbreviations.select("by", "type", F.lit(True).alias("abbreviation"))
    marked = pairs.join(known, ["by", "type"], "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))
    return marked.withColumn("closes", F.col("end") | (F.col("dot") & ~F.col("abbreviation")))


def learn(texts: DataFrame, key: str = "did", text: str = "text", by: str | None = None) -> Boundaries:
    """Abbreviations, sentence starters and collocations of all texts (did, text); tables of types, whose rows grow with the vocabulary alone.

    by: the column of a text's language; each is learned by itself, null as one more.
    Texts are counted where they are read, and the counts are written once.
    """
    found = texts.select(_language(by), F.inline(_pairs(_tokens(text)))).groupBy("by", "token", "next").agg(F.count(F.lit(1)).alias("n"))
    pairs = checkpointed(found.select("by", "next", "n", *_typed("token")))
    types = pairs.groupBy("by", "type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("with_dot"))
    totals = F.broadcast(pairs.groupBy("by").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots")))  # one row for each language
    dotted = types.where((F.col("with_dot") > 0) & F.col("type").rlike(r"\p{L}")).withColumn("without", F.col("n") - F.col("with_dot")).join(totals, "by")
    abbreviations = checkpointed(dotted.withColumn("score", _abbreviation()).where(F.round("score", 9) >= ABBREVIATION).select("by", "type", "score"))
    ended = _closed(pairs.where(F.col("dot") | F.col("end")).select("by", "n", "type", "dot", "end", *_typed("next", "next_")), abbreviations)

    closing = F.broadcast(ended.where("closes").groupBy("by").agg(F.sum("n").alias("closings")))
    after = ended.where(F.col("closes") & F.col("next_type").rlike(r"^\p{L}")).groupBy("by", F.col("next_type").alias("type")).agg(F.sum("n").alias("both"))
    begun = after.join(types.select("by", "type", "n"), ["by", "type"]).join(closing, "by").join(totals, "by")
    score = dunning(F.col("closings"), F.col("n"), F.col("both"), F.col("total"))
    starters = begun.withColumn("score", score).where((F.round("score", 9) >= STARTER) & (F.col("total") / F.col("closings") > F.col("n") / F.col("both"))).select("by", "type", "score")
    starters = checkpointed(starters)

    around = ended.where(F.col("dot") & F.col("next_type").isNotNull() & F.col("type").rlike(r"^(##number##|.*\p{L}.*)$") & F.col("next_type").rlike(r"^(##number##|.*\p{L}.*)$"))
    twice = around.groupBy("by", F.col("type").alias("first"), F.col("next_type").alias("second")).agg(F.sum("n").alias("both")).where("both > 1")
    known = starters.select("by", F.col("type").alias("second"))
    one, two = (types.select("by", F.col("type").alias(c), F.col("n").alias(n)) for c, n in (("first", "n1"), ("second", "n2")))
    met = twice.join(one, ["by", "first"]).join(two, ["by", "second"]).join(known, ["by", "second"], "left_anti").join(totals, "by")
    held = met.withColumn("score", dunning(F.col("n1"), F.col("n2"), F.col("both"), F.col("total")))
    tight = (F.round("score", 9) >= COLLOCATION) & (F.col("total") / F.col("n1") > F.col("n2") / F.col("both"))
    return Boundaries(abbreviations, starters, checkpointed(held.where(tight).select("by", "first", "second", "score")))


def sentence_ends(texts: DataFrame, learned: Boundaries, key: str = "did", text: str = "text", by: str | None = None) -> DataFrame:
    """(by, did, i): the tokens after which a sentence ends; the last token of a text is none.

    ``!`` and ``?`` end one, and so does a full stop after what is no
    abbreviation, if the pair around it is no collocation. After an abbreviation a
    sentence ends where a sentence starter follows that is written with a capital.
    This is decided once for each distinct pair of tokens.
    """
    places = texts.select(_language(by), F.col(key).alias("did"), F.inline(F.filter(_pairs(_tokens(text)), lambda x: x["next"].isNotNull())))
    distinct = places.select("by", "token", "next").distinct()
    rows = _closed(distinct.select("by", *_typed("token"), *_typed("next", "next_")), learned.abbreviations)
    starter = learned.starters.select("by", F.col("type").alias("next_type"), F.lit(True).alias("starter"))
    pair = learned.collocations.select("by", F.col("first").alias("type"), F.col("second").alias("next_type"), F.lit(True).alias("pair"))
    known = rows.where(F.col("dot") | F.col("end")).join(starter, ["by", "next_type"], "left").join(pair, ["by", "type", "next_type"], "left")
    capital = F.col("next").rlike(r"^[\"'(\[{]*\p{Lu}")
    ends = F.col("end") | (F.col("dot") & F.col("pair").isNull() & (~F.col("abbreviation") | (F.col("starter").isNotNull() & capital)))
    return places.join(known.where(ends).select("by", "token", "next"), ["by", "token", "next"]).select("by", "did", "i")


def split(texts: DataFrame, learned: Boundaries, key: str = "did", text: str = "text", by: str | None = None) -> DataFrame:
    """(did, sno, text): the sentences of each text by the learned table, tokens joined by single spaces.

    Ends of a document are gathered into one array of numbers beside its text,
    and sentences are slices of its tokens. Null and blank texts have none.
    """
    cuts = sentence_ends(texts, learned, key, text, by).groupBy("by", "did").agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    both = texts.select(_language(by), F.col(key).alias("did"), F.col(text).alias("text")).join(cuts, ["by", "did"], "left")

    def sentences(s: Column) -> Column:
        ends = F.concat(F.coalesce(s["cuts"], F.array().cast("array<int>")), F.array(F.size(s["tokens"]) - 1))
        return bound(ends, lambda e: F.transform(e, lambda x, k: F.array_join(F.slice(s["tokens"], F.coalesce(F.get(e, k - 1) + 2, F.lit(1)), x - F.coalesce(F.get(e, k - 1), F.lit(-1))), " ")))

    parts = bound(F.struct(_tokens("text").alias("tokens"), F.col("cuts")), lambda s: F.when(F.size(s["tokens"]) > 0, sentences(s)))
    return both.select("did", F.posexplode(parts).alias("i", "text")).select("did", (F.col("i") + 1).alias("sno"), "text")
