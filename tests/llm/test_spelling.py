import random
import re
import zlib
from collections import Counter

import numpy as np

from lectern.llm import spelling

DOCS = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in counts.items():
        some = [v for v in counts if near(w, v)]
        form = min(some, key=lambda v: (-counts[v], v), default=None)
        if form is not None and counts[form] < 2 * n:
            form = None
        out[w] = [form, None, n, len(some), counts.get(form)]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x[1] = root
    return out


def found(df):
    rows = spelling.variants(df).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in rows}


def words_of(rng, letters, sizes, count):
    base = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(count)]
    out = list(base)
    for w in base:
        for _ in range(rng.randrange(6)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]]))
    return out


def test_random_words_against_all_pairs(spark):
    rng = random.Random(5)
    pool = words_of(rng, "abé", [4, 5, 6, 7], 60) + words_of(rng, "ABcdÀÿ×÷", [5, 6, 9, 30], 40)
    weights = [rng.choice([1, 2, 4, 9, 30, 100]) for _ in pool]
    rows = [(rng.randrange(150), rng.choice([" ", ", ", "_", "ā", "1"]).join(rng.choices(pool, weights, k=rng.randrange(200)))) for _ in range(300)]
    want = expected(rows)
    assert sum(x[0] is not None for x in want.values()) > 40 and any(want[x[1]] and x[0] != x[1] for x in want.values() if x[0])
    assert found(spark.createDataFrame(rows, DOCS).repartition(7)) == want


def test_long_words_of_one_letter_and_hot_words(spark):
    rows = [(i, "a" * 3000 + " " + "a" * 2999 + " " + "a" * 1500 + "b" + "a" * 1499 + " aaaaa " + "aaaab " * 400) for i in range(4)]
    want = expected(rows)
    assert want["a" * 3000][3] == 2
    assert found(spark.createDataFrame(rows, DOCS)) == want


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, "Hello hallo"), (1, "Hello hallo"), (1, "Hello hallo"), (None, "HELLO"), (2, None), (3, ""), (None, None), (4, "hello " * 50_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", word string, id string")
    assert found(df) == expected(rows)
    assert found(spark.createDataFrame([], DOCS)) == {}
    assert found(spark.createDataFrame([(1, "one two")], DOCS)) == {}


def test_words_of_one_hash_are_told_apart():
    table = spelling.pa.RecordBatch.from_pydict({"key": [7, 7, 7, 7], "pos": np.array([-1, 0, 0, 0], np.int32), "id": [1, 2, 3, 4], "word": ["abcde", "xabcde", "qother", "zother"], "n": [5, 6, 7, 8]})
    got = sorted((r["id"], r["near"], r["form"]["word"]) for b in spelling._near(iter([table])) for r in b.to_pylist())
    assert got == [(1, 1, "xabcde"), (2, 1, "abcde"), (3, 1, "zother"), (4, 1, "qother")]


def test_groups_are_not_split_between_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = [spelling.pa.RecordBatch.from_arrays([spelling.pa.array(keys[i : i + 7])], names=["key"]) for i in range(0, 500, 7)]
    tables = [t.column(0).to_pylist() for t in spelling._whole_groups(iter(batches))]
    assert sum(tables, []) == keys.tolist() and sum(len(set(t)) for t in tables) == len(set(keys.tolist()))
