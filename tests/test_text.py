import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_split_words(spark):
    assert one(spark, 'side-by-side 2,000 Bahrain"s at 2:30.', T.split_words) == ["side", "by", "side", "2", "000", 'Bahrain"s', "at", "2:30"]
    assert one(spark, "", T.split_words) == [] and one(spark, None, T.split_words) is None
    assert one(spark, " a b  ", T.space_tokens) == ["", "a", "b"]


def test_sentences(spark):
    got = one(spark, 'He met Dr. Smith today. "It was late." Nobody came! and so on. 42 left?  Yes', T.split_sentences)
    assert got == ["He met Dr. Smith today.", '"It was late."', "Nobody came! and so on.", "42 left?", "Yes"]
    assert one(spark, "... !", T.split_sentences) == [] and one(spark, None, T.split_sentences) is None


def test_rouge_tokens_and_grams(spark):
    assert one(spark, "A state-of-the-art U.S. plan: $5!", T.rouge_tokens) == ["a", "state", "of", "the", "art", "u", "s", "plan", "5"]
    words = ["a", "b", "c", "d"]
    assert one(spark, words, lambda c: T.ngrams(c, 2), "array<string>") == ["a b", "b c", "c d"]
    assert one(spark, words, lambda c: T.ngrams(c, 5), "array<string>") == []
    assert one(spark, words, lambda c: T.skip_bigrams(c, 0), "array<string>") == ["a b", "b c", "c d"]
    assert one(spark, words, lambda c: T.skip_bigrams(c, 1), "array<string>") == ["a b", "a c", "b c", "b d", "c d"]
    assert len(one(spark, words, lambda c: T.skip_bigrams(c, -1), "array<string>")) == 6
    assert one(spark, words, lambda c: T.skip_bigrams(c, 0, True), "array<string>")[-4:] == words
    assert one(spark, ["b", "a", "b"], T.unordered_bigrams, "array<string>") == ["a#b", "a#b"]
    assert one(spark, ["x"], T.unordered_bigrams, "array<string>") == []


def test_small_functions(spark):
    assert one(spark, "a\r\nb & <c>", T.sanitize) == "a\nb &amp; &lt;c&gt;"
    assert one(spark, ["the", "a", "the", "b"], lambda c: T.drop_stopwords(c, F.array(F.lit("a"))), "array<string>") == ["the", "the", "b"]
    assert one(spark, [0, 1, 0, 1], T.label_positions, "array<int>") == [2, 4]
    be = spark.createDataFrame([("Dog", "big", "mod"), ("Dog", None, None)], "h string, m string, r string")
    for kind, want in (("H", ["dog", "dog"]), ("HM", ["dog|big", "dog|nil"]), ("HMR", ["dog|big|mod", "dog|nil|nil"]), ("HM1", ["dog|big", None]), ("HMR2", ["dog|big|mod", None])):
        assert [r.y for r in be.select(T.basic_element(F.col("h"), F.col("m"), F.col("r"), kind).alias("y")).collect()] == want


def test_ngram_graph_is_symmetric(spark):
    edges = {(r.a, r.b): r.w for r in T.char_ngram_edges(spark.createDataFrame([(1, "abcde"), (2, "")], "k int, t string"), "k", "t").collect()}
    assert edges == {(x, y): 1 for x in ("abc", "bcd", "cde") for y in ("abc", "bcd", "cde") if x != y}


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"), ("formalize", "formal"), ("goodness", "good"), ("revival", "reviv"), ("replacement", "replac"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("bus", "bus")],
)
def test_porter(word, stem):
    assert T.Porter.stem(word) == stem


def test_stem_vocabulary_takes_exceptions_first(spark):
    words = spark.createDataFrame([("geese",), ("geese",), ("running",), ("was",), (None,)], "word string")
    bases = spark.createDataFrame([("geese", "goose"), ("was", "be")], "inflected string, base string")
    assert {r.word: r.stem for r in T.stem_vocabulary(words, bases).collect()} == {"geese": "goose", "running": "run", "was": "was"}
