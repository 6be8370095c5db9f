import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [x for x in held if x[2]]
    n_all, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def found(spark, docs, items, parts=5):
    got = lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str), {r.item_id: r.depth for r in got}


@pytest.fixture
def small(monkeypatch):
    """Tiers, segments and matrices small enough that a few hundred documents use all of them."""
    for name, value in (("SEGMENT", 16), ("LEAST", 12), ("ITEMS", 3), ("TERMS", 20), ("CELLS", 200)):
        monkeypatch.setattr(lexical_search, name, value)


def corpus(rng, n):
    words = [f"w{i}" for i in range(40)] + ["Été", "x_y", "日本", "naïve", "ONE", "a1"]
    weights = [1000 // (i + 1) + 1 for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=rng.randrange(60)))) for i in range(n)]
    return words, weights, docs


def test_same_as_scoring_everything(spark, small):
    rng = random.Random(2)
    words, weights, docs = corpus(rng, 400)
    docs += [(1000 + i, "rare gem " + docs[3][1]) for i in range(30)] + [(i, "jewel " * (i % 7 + 1)) for i in range(2000, 2040)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(12)))) for i in range(12)] + [(100 + i, w) for i, w in enumerate(words)] + [(50, "rare gem"), (51, "jewel"), (52, "rare jewel the"), (53, "jewel jewel w1 w30")]
    got, depth = found(spark, docs, items)
    assert got == expected(docs, items)
    assert set(depth.values()) == {0, 1, 2}, depth  # proven in the first tier, in the second, and fallen through


def test_ties_nulls_repeats_and_long_texts(spark, small, monkeypatch):
    monkeypatch.setattr(lexical_search, "_PIECE", 50)
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same"), (7, "same words here"), (8, None), (9, ""), (10, "...")]
    docs += [(100, "long " * 20_000 + "tail"), (101, "tail " + "z" * 5000)]
    items = [(1, "same words"), (1, "same words"), (2, "TAIL long"), (3, None), (4, "..."), (5, "absent"), (None, "tail"), (6, "z" * 5000)]
    assert found(spark, docs, items)[0] == expected(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "word", "x", 2, 3)], "doc_id long, text string, item string, score int, docs int")
    items = spark.createDataFrame([(1, "word", "y", 4)], ITEMS + ", doc_id string, rank int")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(some, spark.createDataFrame([], ITEMS)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, None)], DOCS), items).collect() == []
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(some, items).collect()] == [(1, 1, 1)]


def test_items_in_several_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    rng = random.Random(4)
    words, weights, docs = corpus(rng, 60)
    items = [(i, " ".join(rng.choices(words, k=4))) for i in range(5)]
    assert found(spark, docs, items)[0] == expected(docs, items)


def test_packing_and_terms():
    term, local, value = np.array([1, 1, 5], np.int32), np.array([0, 9, 3], np.uint16), np.array([7, 8, 9], np.int32)
    assert all((a == b).all() for a, b in zip(lexical_search._unpacked(lexical_search._packed(term, local, value)), (term, local, value)))
    text = "A-b É É9_z 日本 x " + "word " * 400_000
    assert [t.decode() for some in lexical_search.terms_of(text) for t in some] == terms(text)
