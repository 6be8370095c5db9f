import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import minhash as M
from lectern.llm.common import WordHash, word_hashes
from lectern.llm.components import components

DOCS = "doc_id long, text string, key string, row int"


def counts(text):
    words = [x for w in (text or "").lower().split() if (x := w.strip(".,!?$-"))]
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def groups(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (7, None)], "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in groups(pairs, {x for p in pairs for x in p}).items() if k in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(rng.integers(3, 200))
        h = rng.integers(1, 1 << 62, n).astype(np.uint64)
        a = np.maximum(1, rng.geometric(0.3, n))
        b = np.where(rng.random(n) < 0.2, rng.geometric(0.1, n), a)
        s = M.signatures([(h, a), (h, b)])
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_signature_of_a_set_does_not_depend_on_its_batch():
    cache = WordHash()
    sets = [M.shingles(word_hashes(" ".join(f"w{i * k % 97}" for i in range(40 * k)), cache)) for k in range(1, 6)]
    together = M.signatures(sets)
    assert all((M.signatures([x])[0] == together[i]).all() for i, x in enumerate(sets))


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for d in range(40):
        rows.append((d, " ".join(rng.choice(words) for _ in range(rng.randint(6, 200)))))
    for d in range(40, 110):
        base = rows[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            base[rng.randrange(len(base))] = rng.choice(words)
        if rng.random() < 0.3:
            base += base[:20]
        rows.append((d, (" ".join(base)).title() if d % 3 == 0 else " ".join(base) + "."))
    chain = [f"c{i}" for i in range(100)]
    for d in range(110, 130):
        chain = list(chain)
        chain[(d * 7) % 100] = f"x{d}"
        rows.append((d, " ".join(chain)))
    rows += [(200, "few words"), (201, "Few words."), (202, "$$$"), (203, "$$$"), (204, "---"), (205, ""), (206, None), (207, "  "), (208, "spam " * 3000), (209, "spam " * 2950), (210, "spam")]
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], DOCS).repartition(5)
    got = {r.doc: r for r in M.near_duplicates(df).collect()}
    sets = {d: counts(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8]
    want = groups([*pairs, (202, 203)], sets)
    assert {d: r.class_id for d, r in got.items()} == want
    assert {d for d, r in got.items() if r.kept} == {d for d, c in want.items() if c == d}
    sizes = Counter(want.values())
    assert all(r.n_class == sizes[r.class_id] for r in got.values())
    left = M.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, c in want.items() if c == d)


def test_cells_compare_whole_buckets(spark, monkeypatch):
    """Copies of one text that are like it but not like each other: only the text itself connects them."""
    monkeypatch.setattr(M, "CELL_MEMBERS", 7)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for d in range(60):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([6, 7, 8, 9])):
            copy[at] = f"e{d}x{at}"
        rows.append((d, " ".join(copy)))
    sets = {d: counts(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    want = groups(pairs, sets)
    df = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], DOCS).repartition(3)
    assert {r.doc: r.class_id for r in M.near_duplicates(df).collect()} == want
    assert 2 < len(set(want.values())) < 50 and len(pairs) < 100


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (None, "a b c d e f g", "", 2), (2, "q r s", "", 3), (None, "lone text of its own", "", 4), (None, None, "", 5)]
    df = spark.createDataFrame(rows, DOCS)
    got = M.near_duplicates(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    assert sorted((r.doc_id or 0, r.text or "") for r in M.drop_near_duplicates(df).collect()) == [(0, ""), (0, "lone text of its own"), (1, "a b c d e f g"), (2, "q r s")]
    empty = spark.createDataFrame([], DOCS)
    assert M.near_duplicates(empty).collect() == [] and M.drop_near_duplicates(empty).collect() == []


def test_clashing_names_and_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(40_000))
    rows = [(1, long), (2, long + " tail"), (3, "short and alone"), (4, "short and alone")]
    names = ["own", "node", "key", "row", "doc", "th", "c0", "C1", "__own", "kept", "head", "component"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(M.F.lit(i).alias(c) for i, c in enumerate(names)))
    left = M.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = left.collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and {tuple(r[c] for c in names) for r in got} == {tuple(range(len(names)))}
