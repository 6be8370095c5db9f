"""Learned boundaries: the counts against plain Python, and splits of texts with known sentences."""

import math
import random
from collections import Counter

import pytest

from lectern.functions import boundaries

TEXTS = "did long, text string"


def corpus(seed=1, n=400):
    """Sentences with known ends: abbreviations dr. and approx. inside, The and However as frequent starters."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, known = [], []
    for d in range(n):
        sentences = []
        for _ in range(rng.randrange(1, 6)):
            body = rng.choices(words, k=rng.randrange(4, 9))
            if rng.random() < 0.4:
                body.insert(rng.randrange(1, len(body)), rng.choice(["dr.", "no.", "p.m."]) + " " + rng.choice(["Smith", "7", "Jones"]))
            sentences.append(" ".join([rng.choice(["The", "However", "Word5"]), *body]) + rng.choice([".", ".", "!", "?"]))
        rows.append((d, "  ".join(sentences)))
        known.append(sentences)
    return rows, known


@pytest.fixture(scope="module")
def learned(spark):
    rows, known = corpus()
    df = spark.createDataFrame(rows, TEXTS)
    return df, rows, known, boundaries.learn(df)


def test_abbreviations_against_plain_counts(spark, learned):
    df, rows, _, found = learned
    tokens = [t.lower().strip("\"'([{") for _, text in rows for t in text.split()]
    dots = Counter(t[:-1] for t in tokens if t.endswith(".") and t != ".")
    plain = Counter("##number##" if t.isdigit() else t for t in tokens if not t.endswith("."))
    share = sum(dots.values()) / len(tokens)
    want = {}
    for t, k in dots.items():
        n = k + plain[t]
        ratio = -2 * ((k * math.log(share) + (n - k) * math.log(1 - share)) - (k * math.log(0.99) + (n - k) * math.log(0.01)))
        inner, length = t.count("."), max(len(t) - t.count("."), 1)
        score = ratio * math.exp(-length) * (inner + 1) * length ** -plain[t]
        if score >= 0.3:
            want[t] = score
    got = {r.type: r.score for r in found.abbreviations.collect()}
    assert set(got) == set(want) and {"dr", "no", "p.m"} <= set(got)
    assert all(abs(got[t] - want[t]) < 1e-6 * abs(want[t]) for t in want)


def test_starters_and_splits(learned):
    df, _, known, found = learned
    starters = {r.type for r in found.starters.collect()}
    assert {"the", "however"} <= starters and "smith" not in starters
    got = {}
    for r in sorted(boundaries.split(df, found).collect(), key=lambda r: (r.did, r.sno)):
        got.setdefault(r.did, []).append(r.text)
    right = sum(got[d] == [" ".join(s.split()) for s in sentences] for d, sentences in enumerate(known))
    assert right / len(known) > 0.97


def test_nulls_and_empty_tables(spark, learned):
    found = learned[3]
    df = spark.createDataFrame([(1, None), (2, " "), (3, "One."), (4, "A b! C d")], TEXTS)
    assert sorted((r.did, r.sno, r.text) for r in boundaries.split(df, found).collect()) == [(3, 1, "One."), (4, 1, "A b!"), (4, 2, "C d")]
    none = boundaries.learn(df.limit(0))
    assert none.abbreviations.count() == none.starters.count() == none.collocations.count() == 0


def test_languages_are_learned_apart_in_one_pass(spark):
    rows, _ = corpus()
    both = [(d, "a", t) for d, t in rows] + [(1000 + d, None, t.replace("The", "Der").replace("dr.", "hr.")) for d, t in rows]
    df = spark.createDataFrame(both, "did long, lang string, text string")
    got = boundaries.split(df, boundaries.learn(df, by="lang"), by="lang").collect()
    want = []
    for part in (df.where("lang is not null"), df.where("lang is null")):
        want += boundaries.split(part, boundaries.learn(part)).collect()
    assert sorted(got) == sorted(want) and len({r.did for r in got}) == 2 * len(rows)
