"""Texts without spaces: decoding of Big5 files, and words by the best path through a word table.

The word table (w, n) is an input; none is shipped. It is joined to the places
where its words can stand, so no task holds it, and the best path is a fold over
one run of characters, which punctuation keeps short.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs that are segmented: Han characters.
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"
#: Longer words are not looked for; longer runs are cut (a run of so many characters has no punctuation).
LONGEST, RUN = 8, 400
#: Cost of a character that no word explains: as of a word seen half a time.
UNKNOWN = 0.5


def read_big5(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, text): whole files in Big5 as text, in composed form; what is not Big5 becomes U+FFFD, or with ``strict`` an error. Empty files have no row."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unicodedata.normalize("NFC", x.as_py().decode("big5", "strict" if strict else "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decoded, "path string, text string")


def runs(texts: DataFrame, key: str = "did", text: str = "text") -> DataFrame:
    """(did, part, piece, han): a text's runs of Han characters and what lies between them, in order; long runs are cut after ``RUN`` characters."""
    pattern = f"{HAN}|[^\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\s]+".replace("+|", f"{{1,{RUN}}}|", 1)
    rows = texts.select(F.col(key).alias("did"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("part", "piece"))
    return rows.withColumn("han", F.col("piece").rlike(f"^{HAN}$"))


def segment(texts: DataFrame, words: DataFrame, key: str = "did", text: str = "text") -> DataFrame:
    """(did, ord, w): words of each text, in order: Han runs by the cheapest path, other runs as they are written.

    A word costs -ln(n / total) of the table (w, n); a character that is no word
    costs as one seen ``UNKNOWN`` times. Of equally cheap paths the one with the
    longer last word wins. Candidates are the table's words among the substrings
    of up to ``LONGEST`` characters, which meet it in a join.
    """
    parts = runs(texts, key, text)
    han = parts.where("han").select("did", "part", "piece")
    table = words.where("n > 0 and w is not null").groupBy("w").agg(F.sum("n").alias("n"))
    total = table.agg(F.sum("n").alias("total"))
    costs = table.join(F.broadcast(total)).select("w", (-F.log(F.col("n") / F.col("total"))).alias("cost"))  # one row
    spans = han.select("did", "part", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"), "piece")
    spans = spans.select("did", "part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("at") + 1))).alias("size"), "piece")
    spans = spans.select("did", "part", "at", "size", F.substr("piece", F.col("at"), F.col("size")).alias("w"))
    known = spans.join(costs, "w")
    arcs = known.groupBy("did", "part", (F.col("at") + F.col("size")).alias("end")).agg(F.collect_list(F.struct("size", "cost")).alias("arcs"))
    steps = arcs.groupBy("did", "part").agg(F.map_from_entries(F.collect_list(F.struct("end", "arcs"))).alias("arcs"))
    rows = han.join(steps, ["did", "part"], "left").join(F.broadcast(total))
    none = F.array().cast("array<struct<size:int,cost:double>>")
    alone = F.log(F.coalesce("total", F.lit(1)) / UNKNOWN)

    def step(best, end):
        """best[e]: (cost, size of the last word) of the cheapest path over the first e characters."""
        found = F.concat(F.coalesce(F.try_element_at("arcs", end + 1), none), F.array(F.struct(F.lit(1).alias("size"), alone.alias("cost"))))
        paths = F.transform(found, lambda a: F.struct((F.get(best, end - a["size"])["cost"] + a["cost"]).alias("cost"), (-a["size"]).alias("size")))
        return F.concat(best, F.array(F.array_min(paths)))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("size")))
    best = F.aggregate(F.sequence(F.lit(1), F.length("piece")), start, step)

    def back(state, _):
        """One word less: the end of the path before the last word, and the words' ends so far."""
        end = state["end"] + F.get(state["best"], state["end"])["size"]
        return F.when(state["end"] == 0, state).otherwise(F.struct(end.alias("end"), F.concat(F.array(state["end"]), state["ends"]).alias("ends"), state["best"].alias("best")))

    begin = F.struct(F.length("piece").alias("end"), F.array().cast("array<int>").alias("ends"), F.col("best").alias("best"))
    cut = rows.withColumn("best", best).withColumn("ends", F.aggregate(F.sequence(F.lit(1), F.length("piece")), begin, back, lambda s: s["ends"]))
    begins = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    inside = cut.select("did", "part", F.posexplode(F.zip_with(begins, "ends", lambda b, e: F.substr("piece", b + 1, e - b))).alias("i", "w"))
    every = inside.unionByName(parts.where("not han").select("did", "part", F.lit(0).alias("i"), F.col("piece").alias("w")))
    return every.select("did", F.row_number().over(Window.partitionBy("did").orderBy("part", "i")).alias("ord"), "w")
