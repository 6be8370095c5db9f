"""Jump consistent hashing: stable keys to shards without a ring table.

Built from DataFrame functions only. The 64-bit generator of the published
algorithm (Lamping and Veach, 2014) runs on two 32-bit halves, so that no
product overflows a long, in ANSI mode too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key (read as unsigned 64 bits; null counts as 0).

    Going from n to n + 1 shards a key keeps its shard or moves to shard n.
    A key leaves the loop after about ln(shards) jumps, so most rows walk a
    number of steps that grows with the logarithm; each jump goes at least one
    shard further, so the few keys that are still under way walk ``shards``
    steps more, which always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    c_high, c_low = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(LOW)).alias("low"),
        F.lit(-1).cast("long").alias("last"),
        F.lit(0).cast("long").alias("next"),
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = s["high"], s["low"]
        t0 = low.bitwiseAND(F.lit(0xFFFF)) * c_low + F.lit(1)
        t1 = F.shiftright(low, 16) * c_low + F.shiftright(t0, 16)
        new_low = F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(t0.bitwiseAND(F.lit(0xFFFF)))

        def low_product(a: Column, b: Column) -> Column:
            upper = (F.shiftright(a, 16) * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF))
            return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(upper, 16)).bitwiseAND(F.lit(LOW))

        new_high = (low_product(high, c_low) + low_product(low, c_high) + F.shiftright(t1, 16)).bitwiseAND(F.lit(LOW))
        step = (s["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(new_high, 1) + 1).cast("double"))
        return F.when(s["next"] < shards, F.struct(new_high.alias("high"), new_low.alias("low"), s["next"].alias("last"), F.floor(step).cast("long").alias("next"))).otherwise(s)

    def rest(s: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, jump, lambda e: e["last"])
        return F.when(s["next"] >= shards, s["last"]).otherwise(more).cast("int")

    few = min(shards, 12 + math.ceil(3 * math.log(shards)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, jump, rest)


def slots(rows: DataFrame, shard: str, name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in input order.

    ``rows`` is written first with each row's partition and place, then numbered
    within (shard, partition) and shifted by prefix sums of the partition counts:
    no task ever holds a whole shard.
    """
    placed = written(
        rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()),
        "slots",
    )
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(shard, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    local = F.row_number().over(Window.partitionBy(shard, "__part").orderBy("__place"))
    return (
        placed.withColumn("__local", local)
        .join(offsets, [shard, "__part"])
        .withColumn(name, (F.col("__before") + F.col("__local") - 1).cast("long"))
        .drop("__part", "__place", "__local", "__before")
    )


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place documents by the law ``key``: the key and the number of shards decide.

    Returns key, size (UTF-8 bytes + 1; a null text has none, so 1), text_crc32,
    law, shard, slot (gapless from 0 in its shard) and grown_shard (the shard
    with one more shard). Equal texts under different keys are placed apart, as
    the law asks; rows that repeat a key share its shard and get slots of their
    own. A null key counts as 0. Other columns are not read. The text is read
    once, and only sizes and checksums move.
    """
    whole = text_of(text)
    slim = docs.select(
        F.col(key),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return slots(slim, "shard").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
