import random

import numpy as np
import pytest

from lectern.llm import decontamination as D

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string"


def brute(doc, item):
    """All (doc_start, item_start, n_words, n_same): on each diagonal the longest stretch with 80 % the same words, then what is left of it."""
    least, out = min(13, len(item)), set()

    def longest(pairs, low, high):
        best = None
        for a in range(low, high):
            good = 0
            for b in range(a, high):
                good += pairs[b]
                if good * 5 >= (b - a + 1) * 4 and (best is None or b + 1 - a > best[1] - best[0]):
                    best = (a, b + 1)
        return best

    for shift in range(-len(item), len(doc)):
        places = [i for i in range(len(item)) if 0 <= i + shift < len(doc)]
        pairs, todo = [item[i] == doc[i + shift] for i in places], [(0, len(places))]
        while todo:
            low, high = todo.pop()
            found = longest(pairs, low, high)
            if found and found[1] - found[0] >= least:
                a, b = found
                out.add((places[a] + shift, places[a], b - a, sum(pairs[a:b])))
                todo += [(low, a), (b, high)]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_longest_stretch(seed):
    rng = np.random.default_rng(seed)
    same = rng.random(40) < 0.8
    a, b = D.best_overlap(same)
    want = max((j - i for i in range(41) for j in range(i, 41) if same[i:j].sum() * 5 >= (j - i) * 4), default=0)
    assert b - a == want and same[a:b].sum() * 5 >= (b - a) * 4


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(15, 50))] for i in range(12)}
    items |= {50: "six short words make this item".split(), 51: ["alone"], 52: ["a", "pair"], 53: ["three", "in", "row"], 54: "no more than four".split(), 55: ["five"] * 5}
    docs = {0: items[54], 1: ["alone"], 2: ["x", "a", "pair", "a", "pair"], 3: ["no", "more", "then", "four"], 4: ["five"] * 9, 5: items[3] + ["between"] * 3 + items[3], 66: ["but", *items[53], *items[50]]}
    for d in range(6, 66):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            for _ in range(rng.randint(1, 2)):
                item = items[rng.choice(list(items))]
                part = list(item if rng.random() < 0.6 else item[: rng.randint(1, len(item))])
                for _ in range(rng.randint(0, 3)):
                    part[rng.randrange(len(part))] = "changed"
                at = rng.randint(0, len(words))
                words[at:at] = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
        docs[d] = words
    frame = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs.items()], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], ITEMS)
    plain = {d: [w.lower().strip(",") for w in words] for d, words in docs.items()}
    want = sorted((d, i, *x) for d, w in plain.items() for i, item in items.items() for x in brute(w, item))
    for rows in (D.BROADCAST_ROWS, 0):  # the second way joins salted parts
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(D, "BROADCAST_ROWS", rows)
            got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words, r.n_same) for r in D.contaminations(frame, bench).collect())
            assert got == want
            clean = {r.doc_id for r in D.decontaminate(frame, bench).collect()}
            assert clean == set(docs) - {x[0] for x in want}
    assert {x[1] for x in want} >= {51, 52, 53, 54, 55} and sum(x[:2] == (5, 3) for x in want) == 2


def test_a_filter_that_passes_everything_changes_nothing(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(3, item)], ITEMS)
    frame = spark.createDataFrame([(1, "x " + item, ""), (2, "y " * 40, "")], DOCS)
    monkeypatch.setattr(D, "passing", lambda hashes, filter_: np.arange(len(hashes)))
    assert [(r.doc_id, r.doc_start, r.n_words) for r in D.contaminations(frame, bench).collect()] == [(1, 1, 14)]


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(3, item), (2, item.upper()), (9, None), (None, "")], ITEMS)
    rows = [(1, None, ""), (2, "", ""), (None, "x " + item, ""), (4, item, ""), (4, item, ""), (5, "word " * 20000, ""), (6, "tail " * 30000 + item, "")]
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id or 0, r.item_id, r.n_words) for r in D.contaminations(frame, bench).collect()) == [(0, 2, 14), (4, 2, 14), (4, 2, 14), (6, 2, 14)]
    names = ["row", "key", "th", "words", "seeds", "places", "c0", "__hits", "salt"]
    odd = frame.select("*", *(D.F.lit(i).alias(c) for i, c in enumerate(names)))
    left = D.decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5] and {tuple(r[c] for c in names) for r in left.collect()} == {tuple(range(len(names)))}
    none = spark.createDataFrame([], ITEMS)
    assert D.contaminations(frame, none).collect() == [] and D.decontaminate(frame, none).count() == 7
    assert D.contaminations(spark.createDataFrame([], DOCS), bench).collect() == []
