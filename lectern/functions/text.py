"""Text functions. All but the stemmer are native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens are runs of characters other than white space, comma, full stop and hyphen.
TOKEN = r"[^\s,.\-]+"
#: Abbreviations after which a sentence does not end.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sen.", "Rep.", "Gov.", "Gen.", "Col.", "Lt.", "Sgt.", "St.", "Jr.", "Sr.", "Inc.", "Corp.", "Co.", "Ltd.", "vs.", "etc.", "e.g.", "i.e.", "U.S.", "U.N.", "a.m.", "p.m.", "No.")
VALID_WORDS = (10, 55)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: inside a lambda the expression of a column would run again for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def digits(*parts: Column) -> Column:
    """The first eight hexadecimal digits of an MD5 of the parts joined by colons, as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return digits(*parts) / float(1 << 32)


def split_words(text: Column) -> Column:
    """The tokens of a text, as they are written; null for null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Tokens between single spaces, without trailing empty ones (a leading empty one stays)."""
    return F.split(F.regexp_replace(text, " +$", ""), " ")


def word_counts(words: Column) -> Column:
    """The distinct tokens of an array with how often each occurs, as structs (w, n), in order."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(begins, lambda at: F.transform(at, lambda x, k: F.struct(F.get(s, x).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(s)) - x).cast("bigint").alias("n"))))

    return F.when(F.size(words) > 0, bound(F.array_sort(words), runs))


def sanitize(text: Column) -> Column:
    """Markup-safe text with line feeds alone as line ends."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    for bare, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(bare), F.lit(entity))
    return out


def split_sentences(text: Column) -> Column:
    """Sentences: broken after . ! ? and closing quotes where no lower-case letter follows, joined again after an abbreviation.

    Pieces without a word are dropped. Null gives null.
    """
    broken = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([.!?]+[\"']*) +([^a-z ])", "$1\n$2")
    pieces = F.split(F.trim(broken), "\n")
    ends = lambda s: F.array_contains(F.array(*map(F.lit, ABBREVIATIONS)), F.element_at(F.split(s, " "), -1))
    start = F.array().cast("array<string>")

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, piece)))
        return F.when((F.size(done) > 0) & ends(F.get(done, F.size(done) - 1)), joined).otherwise(F.concat(done, F.array(piece)))

    return F.filter(F.aggregate(pieces, start, add), lambda s: s.rlike(r"[^\s.,!?\-]"))


def rouge_tokens(text: Column) -> Column:
    """The runs of letters a-z and digits of a text in lower case: hyphens and all other signs stand between tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def truncate_words(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def truncate_bytes(text: Column, n: int) -> Column:
    """The first n bytes (UTF-8); a character that would be cut is left out."""
    whole = text.cast("binary")
    tries = (F.try_validate_utf8(F.substring(whole, 1, max(0, n - k)).cast("string")) for k in range(4))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*tries))


def truncate_sentences(sentences: Column, n: int) -> Column:
    """Sentences joined by spaces until their bytes, spaces not counted, reach n; the one that reaches it is cut."""

    def add(s: Column, x: Column) -> Column:
        size = F.octet_length(x)
        text = F.when(s["used"] > 0, F.concat(s["text"], F.lit(" "))).otherwise(s["text"])
        fits = s["used"] + size < n
        cut = F.coalesce(*(F.try_validate_utf8(F.substring(x.cast("binary"), F.lit(1), F.greatest(F.lit(n) - s["used"] - k, F.lit(0))).cast("string")) for k in range(4)))
        one = lambda t, used, stop: F.struct(t.alias("text"), used.alias("used"), F.lit(stop).alias("stop"))
        return F.when(s["stop"], s).when(fits, one(F.concat(text, x), s["used"] + size, False)).otherwise(one(F.concat(text, cut), F.lit(n), True))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("stop"))
    return F.aggregate(sentences, start, add, lambda s: s["text"])


def drop_stopwords(tokens: Column, stopwords: Column) -> Column:
    """Tokens that are not stop words; repeats and order stay."""
    return F.filter(tokens, lambda t: ~F.array_contains(stopwords, t))


def cut_stopwords(text: Column, stopwords: list[str]) -> Column:
    """A text in which each stop word between white space, in any case, has become one space, word by word in the given order."""
    for word in stopwords:
        text = F.regexp_replace(text, r"(?i)\s+" + re.escape(word) + r"\s+", " ")
    return text


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams in order, joined by spaces; none if there are fewer than n tokens."""
    if n == 1:
        return tokens
    grams = lambda ts: F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.array_join(F.slice(ts, i + 1, n), " "))
    return bound(tokens, lambda ts: F.when(F.size(ts) >= n, grams(ts)).otherwise(F.array().cast("array<string>")))


def skip_bigrams(tokens: Column, gap: int = 4, unigrams: bool = False) -> Column:
    """Pairs of tokens in order with at most ``gap`` between them (negative: any), and with ``unigrams`` the tokens too."""

    def pairs(ts: Column) -> Column:
        reach = F.size(ts) if gap < 0 else F.lit(gap + 1)
        found = F.flatten(F.transform(ts, lambda t, i: F.transform(F.slice(ts, i + 2, reach), lambda u: F.concat_ws(" ", t, u))))
        return F.concat(found, ts) if unigrams else found

    return bound(tokens, pairs)


def unordered_bigrams(tokens: Column) -> Column:
    """Neighbouring tokens as smaller#larger."""

    def pair(ts: Column, i: Column) -> Column:
        return F.concat_ws("#", F.least(F.get(ts, i), F.get(ts, i + 1)), F.greatest(F.get(ts, i), F.get(ts, i + 1)))

    none = F.array().cast("array<string>")
    return bound(tokens, lambda ts: F.when(F.size(ts) >= 2, F.transform(F.sequence(F.lit(0), F.size(ts) - 2), lambda i: pair(ts, i))).otherwise(none))


def basic_element(head: Column, modifier: Column, relation: Column, kind: str) -> Column:
    """A basic element's key: H, HM, HMR, or with 1/2 only where modifier (and relation) are present; null drops it."""
    parts = {"H": (head,), "HM": (head, modifier), "HMR": (head, modifier, relation), "HM1": (head, modifier), "HMR1": (head, modifier, relation), "HMR2": (head, modifier, relation)}[kind]
    joined = F.concat_ws("|", *(F.lower(F.coalesce(p, F.lit("NIL"))) for p in parts))
    if kind in ("HM1", "HMR1"):
        return F.when(modifier.isNotNull() & (modifier != "NIL"), joined)
    if kind == "HMR2":
        return F.when(modifier.isNotNull() & (modifier != "NIL") & relation.isNotNull() & (relation != "NIL"), joined)
    return joined


def valid_length(tokens: Column) -> Column:
    return F.size(tokens).between(*VALID_WORDS)


def label_positions(labels: Column) -> Column:
    """1-based positions of the non-zero entries."""
    return F.filter(F.transform(labels, lambda v, i: F.when(v != 0, i + 1)), lambda x: x.isNotNull())


def char_ngram_edges(docs: DataFrame, key: str, text: str, low: int = 3, high: int = 3, window: int = 3) -> DataFrame:
    """(key, a, b, w): how often two character n-grams stand within ``window`` places of each other, both ways."""
    sized = docs.select(key, F.explode(F.array(*map(F.lit, range(low, high + 1)))).alias("n"), F.col(text).alias("t"))
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1), lambda i: F.substring("t", i, F.col("n")))
    arrays = sized.where(F.length("t") >= F.col("n")).select(key, grams.alias("g"))
    near = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, window), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    one = arrays.select(key, F.explode(near).alias("e")).select(key, "e.a", "e.b")
    return one.union(one.select(key, "b", "a")).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("w"))


class Porter:
    """The Porter stemmer (1980) for lower-case words of more than three letters; the endings -ement, -ment, -ent are tried in turn."""

    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        """c for each consonant, v for each vowel."""
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return cls.shape(stem).count("vc")

    @classmethod
    def short(cls, word: str) -> bool:
        return len(word) > 2 and cls.shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    @classmethod
    def stem(cls, word: str) -> str:
        if len(word) <= 3:
            return word
        if word.endswith("sses") or word.endswith("ies"):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss"):
            word = word[:-1]
        if word.endswith("eed"):
            if cls.measure(word[:-3]):
                word = word[:-1]
        else:
            cut = next((len(e) for e in ("ed", "ing") if word.endswith(e) and "v" in cls.shape(word[: -len(e)])), 0)
            if cut:
                word = word[:-cut]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and cls.shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif cls.measure(word) == 1 and cls.short(word):
                    word += "e"
        if word.endswith("y") and "v" in cls.shape(word[:-1]):
            word = word[:-1] + "i"
        for table in (cls.STEP2, cls.STEP3):
            end = max((e for e in table if word.endswith(e)), key=len, default=None)
            if end and cls.measure(word[: -len(end)]):
                word = word[: -len(end)] + table[end]
        end = max((e for e in cls.STEP4 if word.endswith(e)), key=len, default=None)
        tries = [e for e in ("ement", "ment", "ent") if word.endswith(e)] if end in ("ement", "ment", "ent") else [end] if end else []
        for e in tries:
            stem = word[: -len(e)]
            if cls.measure(stem) > 1 and (e != "ion" or stem.endswith(("s", "t"))):
                word = stem
                break
        if word.endswith("e") and (cls.measure(word[:-1]) > 1 or (cls.measure(word[:-1]) == 1 and not cls.short(word[:-1]))):
            word = word[:-1]
        if word.endswith("ll") and cls.measure(word) > 1:
            word = word[:-1]
        return word


def stem_vocabulary(words: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, stem) for the distinct words of a column ``word``: an exception's base first, else the Porter stem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=batch["word"].map(Porter.stem))

    stems = words.select("word").where("word is not null").distinct().mapInPandas(run, "word string, stem string")
    if exceptions is None:
        return stems
    bases = exceptions.groupBy(F.col("inflected").alias("word")).agg(F.min("base").alias("base"))
    return stems.join(bases, "word", "left").select("word", F.when(F.length("word") > 3, F.coalesce("base", "stem")).otherwise(F.col("word")).alias("stem"))
