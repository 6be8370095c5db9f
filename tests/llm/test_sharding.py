import zlib
from collections import Counter

from lectern.llm import sharding

DOCS = "doc_id long, text string, shard string"


def jump(key: int, shards: int) -> int:
    key &= (1 << 64) - 1
    last, following = -1, 0
    while following < shards:
        last = following
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        following = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_same_shards_as_the_published_loop(spark):
    keys = [*range(300), -1, -(1 << 63), (1 << 63) - 1, 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 37):
        got = {r.k: r.s for r in df.select("k", sharding.jump_shard(df.k, shards).alias("s")).collect()}
        assert got == {k: jump(k, shards) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself_and_sizes_are_even(spark):
    df = spark.range(20000)
    rows = df.select(sharding.jump_shard(df.id, 8).alias("a"), sharding.jump_shard(df.id, 9).alias("b")).collect()
    assert all(r.a == r.b or r.b == 8 for r in rows)
    counts = Counter(r.a for r in rows)
    assert min(counts.values()) > 2200 and max(counts.values()) < 2800


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (None, None, None), (2, "", "y"), (3, "é" * 5, "z"), (4, "many words " * 40_000, "z"), *[(i, "t", "") for i in range(10, 90)]]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(5), 8).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 8) and r.grown_shard == jump(r.doc_id or 0, 9)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    one = next(r for r in got if r.doc_id == 3)
    assert (one["size"], one.text_crc32) == (11, zlib.crc32(("é" * 5).encode()))
    none = next(r for r in got if r.doc_id is None)
    assert (none["size"], none.text_crc32) == (1, 0)


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 8).collect() == []
