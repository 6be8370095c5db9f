"""Threshold pairs against all pairs, and the choice without redundancy against a fold in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import redundancy, select

SENT = "cluster string, did long, sno int, text string, score double"


def random_sentences(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [rng.choices(words, [60 // (i + 1) + 1 for i in range(30)], k=rng.randrange(0, 9)) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        if text and rng.random() < 0.5:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((rng.choice("ab"), i // 4, i % 4, " ".join(text), round(rng.random(), 1)))
    return rows


def cosine(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def fold(rows, percent, words, least):
    out = []
    for cluster in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == cluster), key=lambda r: (-round(r[4], 9), r[1], r[2]))
        target = math.ceil((sum(len(r[3].split()) for r in mine) if words else len(mine)) * percent / 100)
        used, chosen = 0, []
        for r in mine:
            n, w = len(r[3].split()), set(r[3].split())
            fits = (used + n <= target or used == 0 or abs(used + n - target) < abs(used - target)) if words else len(chosen) < target
            if not fits:
                break
            if least is not None and any(cosine(w, c) >= least for c in chosen):
                continue
            chosen.append(w)
            used += n
            out.append((cluster, r[1], r[2], len(chosen)))
    return sorted(out)


@pytest.mark.parametrize(("percent", "words", "least"), [(40, False, 0.7), (60, True, 0.5), (100, True, None)])
def test_same_choice_as_the_fold(spark, percent, words, least):
    rows = random_sentences(percent)
    df = spark.createDataFrame(rows, SENT).repartition(3)
    out = select.by_words(df, percent) if least is None else select.without_redundancy(df, percent, words=words, threshold=least)
    assert sorted((r.cluster, r.did, r.sno, r["rank"]) for r in out.collect()) == fold(rows, percent, words, least)


def test_pairs_above_equal_all_pairs_and_candidates_are_few(spark):
    rng = random.Random(9)
    vectors = {}
    for i in range(150):
        v = {f"w{int(rng.paretovariate(0.6)) % 200}": rng.random() + 0.1 for _ in range(rng.randrange(1, 9))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / norm for w, x in v.items()}
    unit = spark.createDataFrame([("g", i, w, x) for i, v in vectors.items() for w, x in v.items()], "graph string, id long, w string, v double")
    for least in (0.1, 0.7):
        got = {(r.a, r.b): r.cosine for r in redundancy.pairs_above(unit, least).collect()}
        every = {(a, b): sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) for a in vectors for b in vectors if a < b}
        want = {k: v for k, v in every.items() if v >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert redundancy.candidates(unit, 0.7).count() < 0.5 * sum(v > 0 for v in every.values())
    with pytest.raises(ValueError):
        redundancy.pairs_above(unit, 0.0)


def test_one_cluster_of_100000_sentences(spark):
    """A third of all sentences are equal, one more third differs from another by one word, a chain of decisions runs through the rest."""
    ids = spark.range(100_000)
    text = F.when(F.col("id") % 3 == 0, F.lit("the same words for all")).when(
        F.col("id") % 3 == 1, F.concat_ws(" ", F.concat(F.lit("p"), F.floor(F.col("id") / 6)), F.concat(F.lit("q"), F.floor(F.col("id") / 6)), F.concat(F.lit("r"), F.floor(F.col("id") / 6)), F.concat(F.lit("s"), F.col("id")))
    ).otherwise(F.concat(F.lit("alone"), F.col("id")))
    df = ids.select(F.lit("c").alias("cluster"), F.col("id").alias("did"), F.lit(1).alias("sno"), text.alias("text"), (-F.col("id") / 100_000).alias("score"))
    out = select.drop_repeats(df, 0.5)
    row = out.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("did") % 3 == 0).cast("int")).alias("same"), F.sum((F.col("did") % 3 == 1).cast("int")).alias("pairs")).first()
    assert (row.same, row.pairs, row.n) == (1, 16_667, 1 + 16_667 + 33_333)
