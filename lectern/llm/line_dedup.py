"""Line deduplication by overlapping windows of three lines, with DataFrame functions only.

A text is cut into lines by one rule for all texts: a line ends at a run of line
feeds, and a new one begins at every word that is smaller than each of the
``REACH`` words on either side of it (in order of bytes, so often a capital; of
equal ones the first; a line feed or an end of the text within reach rules a cut
out, and a word that begins with a control character counts as a line feed). A
cut thus depends on the words around it alone, so a passage pasted anywhere has
the same lines inside, whether it has sentence ends or not, and only beside line
feeds can lines have fewer than ``REACH`` words. Three consecutive lines make a
window; lines are equal if their words are. Windows that occur more than once in
the corpus lose every occurrence but the first (smallest key, then text, then
place); the positions that the lost windows cover are merged and their lines
removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, text_of, written

WINDOW = 3
#: A cut inside running text has so many larger words on either side; lines have 2 * REACH + 1 words on average.
REACH = 3
#: Windows with more than one in so many of all places count as hot: at most so many can be.
HOT_KEYS = 20_000
#: One document in so many is looked at to tell hot windows; this balances tasks and decides nothing else.
SAMPLED = 64

_WORD = r"\S+|\n\s*"
#: The same tokens with all white space around them.
_TOKEN = r"[^\S\n]*\S+[^\S\n]*|[^\S\n]*\n\s*|[^\S\n]+"


def _with(value: Column, then) -> Column:
    """``then`` of a value that is made once."""
    return F.get(F.transform(F.array(value), then), 0)


def _feeds(tokens: Column, i: Column) -> Column:
    return F.startswith(F.get(tokens, i), F.lit("\n"))


def _ends(words: Column) -> Column:
    """The numbers of the tokens that end a line, in order."""

    def smallest(own: Column, i: Column, all_: Column) -> Column:
        out = F.lit(True)
        for k in range(1, REACH + 1):
            out = out & (own < F.get(all_, i - k)) & (own <= F.get(all_, i + k))
        return out  # null, so false, where a neighbour is missing

    def found(all_: Column) -> Column:  # a line feed's token is all white space, which comes before "!"
        return F.array_compact(F.transform(all_, lambda own, i: F.when(own < "!", i).when(smallest(own, i, all_), i - 1)))

    cuts = found(words)
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(cuts, F.array(F.size(words) - 1))))


def _by_line(tokens: Column, ends: Column, then) -> Column:
    """``then(tokens of the line)`` for each line."""

    def one(e: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(ends, k - 1)).otherwise(-1)
        return then(tokens, before, e)

    return F.transform(ends, one)


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; joined again they are the text. White space alone is no line."""

    def cut(s: Column) -> Column:
        return _by_line(s["t"], s["e"], lambda t, before, e: F.array_join(F.slice(t, before + 2, e - before), ""))

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return _with(_words_of(text), lambda w: _with(F.struct(tokens.alias("t"), _ends(w).alias("e")), cut))


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, th, ls): each document's key, its text's hash and its lines' hashes, without the text."""

    def hashes(s: Column) -> Column:  # a line feed that ends a line is no word of it
        return _by_line(s["w"], s["e"], lambda w, before, e: F.xxhash64(F.slice(w, before + 2, e - before - _feeds(w, e).cast("int"))))

    full = text_of(text)
    each = _with(_words_of(full), lambda w: _with(F.struct(w.alias("w"), _ends(w).alias("e")), hashes))
    return docs.select(F.col(key).alias("doc"), F.xxhash64(full).alias("th"), each.alias("ls"))


def _places(hashed: DataFrame) -> DataFrame:
    """(doc, th, at, h, g) for each window: its place and two hashes of its three lines."""
    line = lambda i, k: F.get("ls", i + k)
    three = F.transform(
        F.sequence(F.lit(0), F.size("ls") - WINDOW),
        lambda i: F.struct(F.xxhash64(*(line(i, k) for k in range(WINDOW))).alias("h"), F.xxhash64(*(line(i, k) for k in reversed(range(WINDOW)))).alias("g")),
    )
    some = hashed.where(F.size("ls") >= WINDOW).select("doc", "th", F.posexplode(three).alias("at", "w"))
    return some.select("doc", "th", "at", F.col("w.h").alias("h"), F.col("w.g").alias("g"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc").isNull(), "doc", "th", "at"))


def repeated_places(hashed: DataFrame) -> DataFrame:
    """(doc, th, a, b): lines a to b of a document go, as a later occurrence of a window; from rows of ``_hashed``.

    Windows meet by both hashes of their three lines, 128 bits. One exchange
    brings the places of a window together; those of hot windows, which a sample
    names and whose number is bounded, stay where they are and meet a broadcast
    row with their first place.
    """
    sample = hashed.where(F.pmod(F.xxhash64("doc", "th"), F.lit(SAMPLED)) == 0)
    total = sample.agg(F.sum(F.greatest(F.size("ls") - WINDOW + 1, F.lit(0)).cast("long"))).first()[0] or 0
    often = _places(sample).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") * HOT_KEYS > total) & (F.col("c") > 2)).select("h")
    hot = F.broadcast(often)  # fewer than HOT_KEYS rows, for their shares add up to one
    places = _places(hashed)
    whole = Window.partitionBy("h", "g")
    cold = places.join(hot, "h", "left_anti").withColumn("c", F.count(F.lit(1)).over(whole)).where("c > 1").withColumn("first", _first().over(whole))
    burning = places.join(hot, "h", "left_semi")
    firsts = burning.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), _first().alias("first"))  # a row for each of ``hot``
    met = cold.unionByName(burning.join(F.broadcast(firsts), ["h", "g"])).where("c > 1")
    own = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    # in its first document a window's first place stays whole: what overlaps it loses only what comes after
    begin = F.when(own, F.greatest(F.col("at"), F.col("first.at") + WINDOW)).otherwise(F.col("at"))
    return met.select("doc", "th", begin.alias("a"), (F.col("at") + WINDOW - 1).alias("b")).where("a <= b")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the later occurrences removed from ``text``, and n_lines, n_removed (int).

    A window that overlaps its own first occurrence removes only the lines after
    it, so one copy always stays whole. Null and blank texts have no lines and
    come back as they are; texts of under three lines never change. Rows that
    repeat both key and text count as one document: they are treated alike; other
    texts under one key are documents of their own. Null keys come last in the
    order. Columns of the input with the names n_lines or n_removed are replaced;
    any other name may occur.
    """
    hashed = written(_hashed(docs, key, text), "lines")
    places = repeated_places(hashed)
    both = hashed.select("doc", "th", F.size("ls").alias("n"), F.lit(None).cast("struct<a:int,b:int>").alias("span")).unionByName(
        places.select("doc", "th", F.lit(None).cast("int").alias("n"), F.struct("a", "b").alias("span"))
    )
    known = both.groupBy("doc", "th").agg(F.max("n").alias("n"), F.collect_set("span").alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))
    rows, names = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    joined = rows.withColumn("own", F.xxhash64(text_of(at[text]))).join(
        known.select("doc", "th", "n", gone.alias("gone")), F.col(at[key]).eqNullSafe(F.col("doc")) & (F.col("own") == F.col("th")), "left"
    )
    # as fields of a lambda's variable the values are made once, wherever the optimizer moves the expression
    kept = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["g"])
    rest = _with(F.struct(lines(F.col(at[text])).alias("l"), F.col("gone").alias("g")), lambda s: F.array_join(F.transform(kept(s), lambda i: F.get(s["l"], i)), ""))
    out = [(F.when(F.size("gone") > 0, rest).otherwise(F.col(at[c])) if c == text else F.col(at[c])).alias(c) for c in names if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*out, F.coalesce("n", F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).alias("n_removed"))
