import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity
from lectern.operators import classify, features, select
from lectern.plans import summarizer

SENT = "cluster string, did long, sno int, text string, score double"
ROWS = [
    ("c", 1, 1, "one two three four five", 0.9),
    ("c", 1, 2, "one two three four six", 0.8),
    ("c", 1, 3, "seven eight nine", 0.7),
    ("c", 2, 1, "ten eleven", 0.6),
    ("c", 2, 2, "twelve", 0.5),
    ("d", 3, 1, "lone sentence here", 0.0),
]


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame(ROWS, SENT)


def chosen(df, cluster="c"):
    return [(r.did, r.sno) for r in sorted(df.where(F.col("cluster") == cluster).collect(), key=lambda r: r["rank"])]


def test_top_sentences(candidates):
    assert chosen(select.top_sentences(candidates, 50)) == [(1, 1), (1, 2), (1, 3)]
    assert chosen(select.top_sentences(candidates, absolute=1)) == [(1, 1)]
    assert chosen(select.top_sentences(candidates, 20), "d") == [(3, 1)]


def test_by_words_hits_overshoots_and_stops(candidates):
    assert chosen(select.by_words(candidates, absolute=10)) == [(1, 1), (1, 2)]
    assert chosen(select.by_words(candidates, absolute=2)) == [(1, 1)]
    assert chosen(select.by_words(candidates, absolute=9)) == [(1, 1), (1, 2)]
    assert chosen(select.by_words(candidates, absolute=7)) == [(1, 1)]


def test_without_redundancy(candidates):
    assert chosen(select.without_redundancy(candidates, absolute=3)) == [(1, 1), (1, 3), (2, 1)]
    assert chosen(select.without_redundancy(candidates, absolute=3, threshold=0.9)) == [(1, 1), (1, 2), (1, 3)]
    assert chosen(select.without_redundancy(candidates, absolute=11, words=True)) == [(1, 1), (1, 3), (2, 1), (2, 2)]
    assert chosen(select.drop_repeats(candidates)) == [(1, 1), (1, 3), (2, 1), (2, 2)]


def test_novelty_and_mmr(candidates):
    raised = {(r.did, r.sno): r.score for r in select.novelty(candidates).collect()}
    assert raised[1, 1] == 0.9 and raised[1, 2] == pytest.approx(0.96) and raised[1, 3] == 0.7
    mmr = {(r.did, r.sno): r.score for r in select.mmr(candidates, 0.7, 20).collect()}
    assert mmr[1, 1] == pytest.approx(0.7)
    assert mmr[1, 2] == pytest.approx(0.7 * 0.8 / 0.9 - 0.3 * 0.8)
    assert mmr[2, 1] == pytest.approx(0.6 / 0.9 - 2) and mmr[3, 1] == pytest.approx(0)


def test_budget_preferences_and_text(spark, candidates):
    assert {(r.did, r.sno) for r in select.word_budget(candidates, 6).where("cluster = 'c'").collect()} == {(1, 1), (1, 2)}
    values = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], "did long, sno int, value double")
    plus = {(r.did, r.sno): r.score for r in select.prefer(candidates, values, -1, True).collect()}
    assert plus[1, 1] == pytest.approx(-0.1) and plus[1, 2] == pytest.approx(0.3) and plus[2, 2] == 0.5
    meta = spark.createDataFrame([(1, "b", 0), (2, "a", 1), (3, "b", 2)], "did long, source string, ord int")
    assert {r.did: r.value for r in select.source_order(meta).collect()} == {1: 1, 2: 2, 3: 1}
    extract = select.extract_order(select.top_sentences(candidates, absolute=2))
    assert select.summary_text(extract, candidates).where("cluster = 'c'").first().summary == "[1]  one two three four five\n[2]  one two three four six"


def test_threshold_filter(spark):
    long = " ".join(f"w{i}" for i in range(12))
    rows = [("c", 1, long, 0.1), ("c", 2, long + " more", 0.1), ("c", 3, "too short", 0.9), ("c", 4, " ".join(f"v{i}" for i in range(12)), 0.0)]
    df = spark.createDataFrame(rows, "cluster string, ord int, text string, sal double")
    params = spark.createDataFrame([(0.0, -2.0), (0.0, -0.5), (1.0, 0.5)], "lam double, mini double")
    got = {}
    for r in select.threshold_filter(df, params).collect():
        got.setdefault((r.lam, r.mini), set()).add(r.ord)
    assert got == {(0.0, -2.0): {1, 2, 4}, (0.0, -0.5): {1, 4}, (1.0, 0.5): {1, 2}}


def test_classifiers(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.7, 10.0), (1, 2, 0.5, 0.7, 5.0), (1, 3, 0.5, None, None)], "did long, sno int, Centroid double, Position double, Length double")
    assert [r.s for r in df.select(classify.linear().alias("s")).collect()] == [pytest.approx(1.2), 0, 0]
    assert [r.s for r in df.select(classify.linear(discard_missing=False).alias("s")).collect()] == [pytest.approx(1.2), 0, 0.5]
    a = [r.s for r in df.select(classify.random_score(1).alias("s")).collect()]
    assert a == [r.s for r in df.repartition(3).select("sno", classify.random_score(1).alias("s")).orderBy("sno").collect()] and all(0 <= x < 1 for x in a)


def test_features_of_edge_cases(spark):
    s = spark.createDataFrame([("c", 1, 1, "alpha beta"), ("c", 1, 2, "gamma delta"), ("c", 1, 3, ""), ("e", 2, 1, "...")], "cluster string, did long, sno int, text string")
    idf = spark.createDataFrame([("alpha", 2.0)], "w string, idf double")
    centroid = {(r.did, r.sno): r.value for r in features.centroid(s, idf).collect()}
    assert centroid[1, 1] == 1 and centroid[1, 2] == pytest.approx(0.2 / 2.1) and centroid[1, 3] == 0 and centroid[2, 1] == 0
    assert {(r.did, r.sno): r.value for r in features.is_longest(s).collect()} == {(1, 1): 1, (1, 2): 0, (1, 3): 0, (2, 1): 1}
    phrases = features.parse_keywords(spark.createDataFrame([("c", "ALPHA;2;gam;0.5")], "cluster string, keywords string"))
    assert {(r.did, r.sno): r.value for r in features.phrase_match(s, phrases).collect()} == {(1, 1): 2, (1, 2): 0.5, (1, 3): 0, (2, 1): 0}
    long = spark.createDataFrame([(1, 1, "A", 1.0), (1, 1, "B", 2.0)], "did long, sno int, name string, value double")
    wide = features.long_to_wide(long, ["A", "B"])
    assert sorted(map(tuple, features.wide_to_long(wide).collect())) == sorted(map(tuple, long.collect()))


def test_word_features_from_one_table(spark):
    """Values from the written words equal those of single tokens; sentences without words get 0."""
    rows = [("c", 1, 1, "a b b c"), ("c", 1, 2, "b c d"), ("c", 1, 3, " . "), ("c", 2, 1, "a a e"), ("c", 2, 2, "e a a"), ("d", 3, 1, "..."), ("d", 3, 2, "f")]
    s = spark.createDataFrame(rows, "cluster string, did long, sno int, text string")
    words = features.counted_words(s)
    assert {(r.did, r.sno, r.w): r.n for r in words.where("did < 2").collect()} == {(1, 1, "a"): 1, (1, 1, "b"): 2, (1, 1, "c"): 1, (1, 2, "b"): 1, (1, 2, "c"): 1, (1, 2, "d"): 1}
    idf = similarity.idf_table(features.tokens(s))
    assert {r.w: r.df for r in idf.collect()} == {r.w: r.df for r in similarity.idf_table(words).collect()}
    pairs = s.select("did", "sno", F.concat_ws("#", "did", "sno").alias("x"), F.concat_ws("#", "did", F.lit(1)).alias("y"))
    want = {(r.did, r.sno): r.cosine for r in similarity.idf_cosine(pairs, features.tokens(s).select(F.concat_ws("#", "did", "sno").alias("item"), "w"), idf).collect()}
    assert {(r.did, r.sno): r.value for r in features.similarity_with_first(s, idf).collect()} == pytest.approx({k: v or 0 for k, v in want.items()})
    made = summarizer.Summarizer(("Centroid", "SimWithFirst", "Position", "Length")).scores(s).collect()
    alone = {(r.did, r.sno): r.value for r in features.centroid(s, idf).collect()}
    assert len(made) == len(rows) and {(r.did, r.sno): r.Centroid for r in made} == pytest.approx(alone) and all(r.SimWithFirst is not None for r in made)
    assert summarizer.Summarizer().scores(s.where("false")).collect() == []


def test_summarizer_takes_registered_parts(spark):
    s = spark.createDataFrame([("c", 1, i, f"sentence number {i} " + "word " * 8) for i in range(1, 6)], "cluster string, did long, sno int, text string")
    summarizer.register_feature("Late", lambda df, extra: df.select("did", "sno", F.col("sno").alias("value")))
    summarizer.register_classifier("late", lambda: F.col("Late"))
    made = summarizer.Summarizer(("Late", "Length"), "late", "identity", {"absolute": 1}).extract(s).collect()
    assert [(r.did, r.sno) for r in made] == [(1, 5)]
    both = summarizer.sweep(s.select("cluster", F.col("sno").alias("ord"), "text", F.lit(0.1).alias("sal")), [0.0, 0.5], [-1.0])
    assert {r.lam for r in both.collect()} == {0.0, 0.5}


def test_candidates_that_cannot_be_kept_are_not_gathered(spark):
    """A cluster whose candidates are all too short, too long or over the budget makes no row, and others are as before."""
    good = " ".join(f"word{i}" for i in range(12))
    rows = [("a", 1, "one two", 0.1), ("a", 2, "x" * 700, 0.1), ("b", 1, "short", 0.9), ("b", 2, good, 0.1), ("b", 3, good, 0.1)]
    candidates = spark.createDataFrame(rows, "cluster string, ord int, text string, sal double")
    kept = select.threshold_filter(candidates, spark.createDataFrame([(0.0, -0.5)], "lam double, mini double"))
    assert [(r.cluster, r.ord) for r in kept.collect()] == [("b", 2)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [cluster") < plan.index("<= 665", plan.index("Aggregate [cluster"))
