"""Counting metrics on many peers: units are counted where texts are read, once, and only those that a model may have become rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import rouge


def plain(tokens, metric):
    if not metric.startswith("S"):
        n = int(metric)
        return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
    gap = int(metric.lstrip("SU"))
    reach = len(tokens) if gap < 0 else gap + 1
    pairs = [(a, b) for i, a in enumerate(tokens) for b in tokens[i + 1 : i + 1 + reach]]
    return pairs + [(a,) for a in tokens] * metric.startswith("SU")


@pytest.mark.parametrize("metric", ["1", "3", "S4", "SU0", "SU-1"])
def test_hits_are_those_of_plain_counts_and_peers_are_read_once(spark, tmp_path, monkeypatch, metric):
    rng = random.Random(5)
    monkeypatch.setattr(rouge, "SLICE", 7)  # slices begin inside batches
    words = lambda n, letters: [rng.choice(letters) for _ in range(rng.randint(0, n))]
    peers = [(e, p, words(30, "abcdefghij" * 2 + "uvwxyz")) for e in (0, 1, None) for p in range(20)]
    models = [(e, m, words(25, "abcdefghij")) for e in (0, 1) for m in range(3)]
    folder = str(tmp_path / "many_peers")
    rows = [(e, p, " ".join(t) if p else None) for e, p, t in peers]
    spark.createDataFrame(rows, "eval long, peer int, text string").coalesce(1).write.parquet(folder)
    other = spark.createDataFrame([(e, m, " ".join(t)) for e, m, t in models], "eval long, model int, text string")
    out = rouge.pair_counts(spark.read.parquet(folder), other, metric)
    want = {}
    for e, p, t in peers:
        for f, m, u in models:
            if e == f:
                a, b = plain(t if p else [], metric), plain(u, metric)
                want[e, p, m] = (sum((Counter(a) & Counter(b)).values()), len(a), len(b))
    assert {(r.eval, r.peer, r.model): (r.hits, r.n_peer, r.n_model) for r in out.collect()} == want
    assert "many_peers" not in out._jdf.queryExecution().executedPlan().toString()  # texts are not tokenised again for the numbers of units


def test_units_of_no_model_do_not_become_rows(spark):
    """Of 100 peers' 25,000 skip bigrams only those of a model leave the task that reads them."""
    peers = spark.range(100).select((F.col("id") % 2).alias("eval"), F.col("id").alias("peer"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), F.lit("the cat sat")).alias("text"))
    models = spark.createDataFrame([(0, 7, "the cat was"), (1, 8, "a cat sat")], "eval long, model long, text string")
    seen = []
    kept = rouge.checkpointed
    rouge.checkpointed = lambda df: seen.append(kept(df)) or seen[-1]
    try:
        got = {(r.peer, r.hits) for r in rouge.pair_counts(peers, models, "S4").collect()}
    finally:
        rouge.checkpointed = kept
    assert got == {(i, 1) for i in range(100)}
    assert seen[0].where("g is null").count() == 100 and 100 <= seen[0].where("g is not null").count() < 600


def test_tokens_are_runs_of_letters_and_digits(spark):
    """As by the rules in words: lower case, hyphens apart, other signs to spaces, tokens that begin with a letter, a digit or $."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab9Z -$.'\n\tÉéİıſKß-_,") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "-", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spaced = F.regexp_replace(F.regexp_replace(F.lower("t"), "-", " - "), "[^a-z0-9-]", " ")
    steps = F.filter(F.split(F.trim(F.regexp_replace(spaced, " +", " ")), " "), lambda x: x.rlike("^[a-z0-9$]"))
    rows = df.select(steps.alias("a"), text.rouge_tokens(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)
