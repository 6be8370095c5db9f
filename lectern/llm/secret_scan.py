"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Every whole text is searched for three base patterns and for other tokens that
look like credentials. The hash of each value is then counted over the corpus by
distinct repositories and owners: a value in ``EXAMPLE_REPOSITORIES`` or more
repositories, or of ``EXAMPLE_OWNERS`` or more owners, is a copied ``example``,
another one that one owner alone has is ``live``, the rest are ``shared``.
Owner-specific live tokens outside all base spans are added as spans of kind
``owned``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, text_of, written

_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
#: kind: (pattern, group of the value, least characters of it), in the order of the listing.
BASE = {
    "assign": (rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # greedy runs: the same as [0-9a-f]+ of 16 or more
}
OWNED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = [*BASE, "owned"]
#: Distinct owners, and distinct repositories, from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5


#: Running values are made in pieces of so many elements: appending copies a piece, never a whole array.
_PIECE = 512


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """For each element of an array of longs, ``join`` of all before it, from ``start``; in time that grows with the array, not its square."""
    start = F.lit(start).cast("long")
    none = F.array().cast("array<long>")

    def before(piece: Column, first: Column) -> Column:
        add = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(piece, F.struct(first.alias("at"), none.alias("out")), add, lambda s: s["out"])

    def pieces(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(_PIECE))
        return F.transform(starts, lambda i: F.slice(all_, i + 1, F.lit(_PIECE)))

    def joined(cut: Column) -> Column:
        totals = F.transform(cut, lambda piece: F.aggregate(piece, start, join))
        return _with(before(totals, start), lambda firsts: F.flatten(F.transform(cut, lambda piece, j: before(piece, F.get(firsts, j)))))

    return _with(values, lambda all_: _with(pieces(all_), joined))


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,k,kind,end,v>> of the leftmost non-overlapping matches whose value is long enough.

    Matches and the text between them alternate, so running sums of their
    lengths are the positions (code points).
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("n"), values.alias("v"))

    def spans(all_: Column) -> Column:
        at = _running(F.transform(all_, lambda x: (x["gap"] + x["n"]).cast("long")), lambda a, b: a + b, 0)
        one = lambda x, before: F.struct((before + x["gap"]).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), (before + x["gap"] + x["n"]).cast("int").alias("end"), x["v"].alias("v"))
        return F.filter(F.zip_with(all_, at, one), lambda s: F.length(s["v"]) >= least)

    none = F.array().cast("array<struct<start:int,k:int,kind:string,end:int,v:string>>")
    return F.when(text.rlike(pattern), _with(steps, spans)).otherwise(none)


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span: in order of start, none before ends behind the span's start, and none behind begins before its end."""
    kind = "array<struct<start:int,k:int,kind:string,end:int,v:string>>"
    far = F.lit(1 << 40).cast("long")
    is_base = lambda s: s["k"] < len(BASE)

    def free(every: Column) -> Column:
        ends = _running(F.transform(every, lambda s: F.when(is_base(s), s["end"].cast("long")).otherwise(F.lit(0).cast("long"))), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(_running(F.transform(F.reverse(every), lambda s: F.when(is_base(s), s["start"].cast("long")).otherwise(far)), lambda a, b: F.least(a, b), 1 << 40))
        rows = F.arrays_zip(every.alias("s"), ends.alias("end"), starts.alias("next"))
        kept = F.filter(rows, lambda x: ~is_base(x["s"]) & (x["end"] <= x["s"]["start"]) & (x["next"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: x["s"])

    none = F.array().cast(kind)
    return F.when(F.size(spans) == 0, none).otherwise(_with(F.array_sort(F.concat(base, spans)), free))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row for each row of ``docs``: key, spans of the base patterns, added spans, each value's spread, values by class.

    Columns: key, base (array<struct<start,k,kind,end,owners,repos>>), added (the
    same, kind ``owned``), n_live, n_shared, n_example (long, over all values).
    owners and repos count the distinct ones that have the span's value. Spans
    are in order of start, then kind as listed; ends are exclusive, in code
    points. A null text is empty; nulls in the repository or owner columns are
    one of their own. Repeated rows are rows of their own but share their owner.
    Extra columns are not read.

    A text with many matches takes time in proportion to them: positions and
    overlaps are running sums and running extremes, made in pieces.

    The texts are read once; only values move, as SHA-256. Values are summed by
    (hash, owner, repository) where they are read, and counts by hash of these
    sums. Occurrences of hot values, whose number is bounded, meet a broadcast
    row with their counts.
    """
    whole = text_of(text)
    named = lambda columns: F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"c{i}") for i, c in enumerate(columns))))
    found = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(key).alias("__key"),
        named(repository).alias("repo"),
        named(owner).alias("own"),
        *(_matches(whole, kind, *rule).alias(kind) for kind, rule in BASE.items()),
        _matches(whole, "owned", OWNED, 0, 20).alias("other"),
    )
    looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 10)
    base = F.array_sort(F.concat(*BASE))
    apart = _apart(F.filter("other", lambda o: looks(o["v"])), F.col("base"))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["v"], 256).alias("h")))
    rows = written(
        found.withColumn("base", base).withColumn("other", apart).select("__row", "__key", "repo", "own", hashed("base").alias("base"), hashed("other").alias("other")),
        "secrets",
    )
    values = rows.select("__row", "repo", "own", F.explode(F.concat("base", "other")).alias("s")).select("__row", "repo", "own", "s", F.col("s.h").alias("h"))
    sums = values.groupBy("h", "own", "repo").agg(F.count(F.lit(1)).alias("n"))
    spread = sums.groupBy("h").agg(F.sum("n").alias("n"), F.count_distinct("own").alias("owners"), F.count_distinct("repo").alias("repos"))
    total = rows.agg(F.sum(F.size("base") + F.size("other"))).first()[0] or 0
    met = meet(values.select("__row", "s", "h"), spread, ["h"], "n", total)
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOSITORIES)
    classed = met.withColumn("class", F.when(example, "example").when(F.col("owners") == 1, "live").otherwise("shared"))
    plain = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "k", "kind", "end")), "owners", "repos")
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, plain)))
    per_row = classed.groupBy("__row").agg(
        listed(F.col("s.kind") != "owned").alias("base"),
        listed((F.col("s.kind") == "owned") & (F.col("class") == "live")).alias("added"),
        *(F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c}") for c in ("live", "shared", "example")),
    )
    none = F.array().cast("array<struct<start:int,k:int,kind:string,end:int,owners:long,repos:long>>")
    out = rows.select("__row", "__key").join(per_row, "__row", "left")
    return out.select(
        F.col("__key").alias(key), *(F.coalesce(c, none).alias(c) for c in ("base", "added")), *(F.coalesce(F.col(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in ("live", "shared", "example"))
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, listing and hash of the spans that ``scan`` found; spread lists owners:repositories of each span's value in the order of spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        key,
        *(count(kind) for kind in BASE),
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
        _listing(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repos"].cast("string"))), ",").alias("spread"),
        "n_live",
        "n_shared",
        "n_example",
    )
