"""Nested comments and the ancestry of replies against a walk along the parents."""

import random

from pyspark.sql import functions as F

from lectern.operators import threads

XML = """<page><comments><comment id="c1" bloggerId="ann">First &amp; <b>bold</b>
<comment id="c2" bloggerId="bob">reply one<comment id='c3'>deep</comment></comment>
<comment id="c4">reply two</comment><comment id="c5"/></comment>
<COMMENT bloggerid="cy" id="c6">second</COMMENT></comments></page>"""


def test_nested_comments(spark):
    pages = spark.createDataFrame([(1, XML), (2, None), (3, ""), (4, "<p>none</p>")], "did long, xml string")
    got = [(r.did, r.id, r.parent, r.depth, r.author, r.text) for r in threads.nested_comments(pages).orderBy("did", "ord").collect()]
    assert got == [
        (1, "c1", None, 0, "ann", "First &amp; bold"),
        (1, "c2", "c1", 1, "bob", "reply one"),
        (1, "c3", "c2", 2, None, "deep"),
        (1, "c4", "c1", 1, None, "reply two"),
        (1, "c5", "c1", 1, None, ""),
        (1, "c6", None, 0, "cy", "second"),
    ]


def test_ancestry_of_random_threads_and_a_long_chain(spark):
    rng = random.Random(8)
    parent = {i: None if i % 40 == 0 else rng.randrange(i // 40 * 40, i) for i in range(400)}
    parent |= {1000 + i: 999 + i if i else None for i in range(10_000)}  # a chain of replies
    parent |= {50_000: 60_000, 50_001: 50_000}  # an unknown parent
    rows = [*parent.items(), (70_000, 70_001), (70_001, 70_000), (None, 3), (5, parent[5])]  # a ring, no id, a repeated row
    got = {r.id: (r.depth, r.root) for r in threads.ancestry(spark.createDataFrame(rows, "id long, parent long")).collect()}

    def expected(i):
        depth = 0
        while parent.get(i) in parent:
            i, depth = parent[i], depth + 1
        return depth, i

    assert got == {i: expected(i) for i in parent}


def test_paths_links_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", None)], "id string, parent string")
    assert {r.id: r.path for r in threads.paths(rows).collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"], "e": ["e"]}
    labels = spark.createDataFrame([("b", "in_favour"), ("b", "against"), ("b", "against"), ("c", None)], "id string, label string")
    got = {r.id: (r.parent, r.agreement, r.sentiment) for r in threads.reply_links(rows, labels, labels.where(F.lit(False))).collect()}
    assert got == {"b": ("a", "against", None), "c": ("b", None, None), "d": ("b", None, None)}
    none = rows.limit(0)
    assert threads.ancestry(none).collect() == [] and threads.paths(none).collect() == []
