"""Distances over a random acyclic taxonomy against sets of ancestors in plain Python."""

import math
import random

from lectern.functions import taxonomy


def test_random_taxonomy_against_brute_force(spark):
    rng = random.Random(6)
    n = 60
    links = [(i, p) for i in range(1, n) if i % 20 for p in {rng.randrange(max(0, i - 15), i) for _ in range(2)}]
    links += [(3, 3), (None, 1), (4, None), links[0]]
    counts = [(i, rng.randrange(9)) for i in range(n) if rng.random() < 0.7] + [(5, 2), (None, 9)]
    up = {i: {p for c, p in links if c == i and p is not None and p != i} for i in range(n)}
    named = {c for c, p in links if c is not None and p is not None and c != p} | {p for c, p in links if c is not None and p is not None and c != p}

    def above(i):
        seen, todo = {i}, [i]
        while todo:
            for p in up[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    own = {i: 1.0 + sum(c for k, c in counts if k == i) for i in named}
    total = sum(own.values())
    ic = {i: -math.log(sum(own[j] for j in named if i in above(j)) / total) for i in named}
    pairs = [(a, b) for a in range(0, n, 7) for b in range(0, n, 5)] + [(1, 999)]
    links_df = spark.createDataFrame(links, "child long, parent long")
    reach = taxonomy.ancestors(links_df)
    assert {(r.concept, r.ancestor) for r in reach.collect()} == {(i, j) for i in named for j in above(i)}
    content = taxonomy.information_content(reach, spark.createDataFrame(counts, "concept long, n long"))
    got = {(r.a, r.b): (r.common, r.distance) for r in taxonomy.jiang_conrath(spark.createDataFrame(pairs, "a long, b long"), reach, content).collect()}
    for a, b in pairs:
        both = above(a) & above(b) if a in named and b in named else set()
        if not both:
            assert got[a, b] == (None, None)
            continue
        common = min(both, key=lambda i: (-ic[i], i))
        assert abs(got[a, b][1] - (ic[a] + ic[b] - 2 * ic[common])) < 1e-9 and abs(ic[got[a, b][0]] - ic[common]) < 1e-12


def test_words_take_their_closest_senses(spark):
    links = spark.createDataFrame([("cat", "animal"), ("dog", "animal"), ("bank1", "place"), ("bank2", "firm"), ("shop", "firm"), ("animal", "thing"), ("place", "thing"), ("firm", "thing")], "child string, parent string")
    reach = taxonomy.ancestors(links)
    content = taxonomy.information_content(reach, spark.createDataFrame([("cat", 5)], "concept string, n long"))
    senses = spark.createDataFrame([("cat", "cat"), ("dog", "dog"), ("bank", "bank1"), ("bank", "bank2"), ("shop", "shop")], "word string, concept string")
    pairs = spark.createDataFrame([("cat", "dog"), ("cat", "cat"), ("bank", "shop"), ("cat", "unknown"), ("zzz", "zzz")], "x string, y string")
    got = {(r.x, r.y): r.similarity for r in taxonomy.word_similarity(pairs, senses, reach, content).collect()}
    assert got["cat", "cat"] == got["zzz", "zzz"] == 1 and got["cat", "unknown"] == 0 and 0 < got["cat", "dog"] < 1
    ic = {r.concept: r.ic for r in content.collect()}
    assert abs(got["bank", "shop"] - 1 / (1 + ic["bank2"] + ic["shop"] - 2 * ic["firm"])) < 1e-9
