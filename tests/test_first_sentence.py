"""Words are counted once a document, and those of the first sentence come with them."""

import random
import re
from collections import Counter
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity
from lectern.operators import features

SENT = "cluster string, did long, sno int, text string"


def test_similarity_with_first_moves_rare_words_alone(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SAMPLED", 1)
    monkeypatch.setattr(similarity, "COMMON", 40)  # so words of more than one in 40 rows are common
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["the"] * 12 + ["of", "to", "in", "é", "", *map(str, range(60))]) for _ in range(rng.randint(0, 12)))
    rows = [(f"c{d % 3}", d, n, text()) for d in range(40) for n in range(1 + (d % 9 == 0), 6)]  # some documents have no first sentence
    s = spark.createDataFrame(rows + [("c0", 99, 1, None), ("c0", 99, 2, "the")], SENT)
    words = features.counted_words(s).cache()
    idf = similarity.idf_table(words)
    bags = {(d, n): Counter(t.split()) for _, d, n, t in rows} | {(99, 1): Counter(), (99, 2): Counter(["the"])}
    of = {}
    for (d, _), bag in bags.items():
        for w in bag:
            of.setdefault(w, set()).add(d)
    docs = len({d for (d, _), bag in bags.items() if bag})
    assert {r.w: (r.df, r.idf) for r in idf.collect()} == {w: (len(x), pytest.approx(log(docs / len(x)))) for w, x in of.items()}
    common = {r.w for r in similarity.common_words(words).collect()}
    assert 0 < len(common) < 40 and "the" in common

    def cosine(d, n):
        a, b = ({w: k * log(docs / len(of[w])) for w, k in bags.get((d, i), {}).items()} for i in (1, n))
        dot, norm = sum(v * b.get(w, 0) for w, v in a.items()), lambda x: sum(v * v for v in x.values())
        return dot / sqrt(norm(a) * norm(b)) if dot > 0 else 0

    for table in (idf, spark.createDataFrame([(w, log(docs / len(x))) for w, x in of.items()], "w string, idf double")):
        out = features.similarity_with_first(s, table, words)
        assert {(r.did, r.sno): r.value for r in out.collect()} == pytest.approx({k: cosine(*k) for k in bags})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(did#\d+L?, w#", plan)  # the first sentence's words are not joined
    assert "LeftAnti" in plan


def test_rows_of_counted_words(spark):
    """Sentences of one number count as one; ``first`` once a word of a document; ``lead`` from sentence 1; a cluster may be null."""
    rows = [("c", 1, 2, "b a"), ("c", 1, 1, "b b"), ("c", 1, 2, "b"), (None, 2, 3, "x é x"), ("c", 3, 1, None), ("c", 4, 1, " . ")]
    got = {(r.cluster, r.did, r.sno, r.w): (r.n, r.first, r.lead) for r in features.counted_words(spark.createDataFrame(rows, SENT)).collect()}
    assert got == {("c", 1, 1, "b"): (2, True, 2), ("c", 1, 2, "b"): (2, False, 2), ("c", 1, 2, "a"): (1, True, None), (None, 2, 3, "x"): (2, True, None), (None, 2, 3, "é"): (1, True, None)}
    assert features.counted_words(spark.createDataFrame([], SENT)).count() == 0
