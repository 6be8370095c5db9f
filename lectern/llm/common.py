"""What the corpus operators share: scratch tables, input checks and word hashing."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's word cache may hold before it is emptied.
WORD_CACHE = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session of one machine (tests) gets a temporary
    folder, and any other is told what to set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there.

    Tables stay until they are dropped (``drop_scratch``) or the folder is
    cleaned (``release``), so a lost executor recomputes from files that every
    node can read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _made.append((threading.get_ident(), path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this process has written: (thread, path), in order.
_made: list[tuple[int, str]] = []


def made() -> int:
    """A mark for ``drop_scratch``."""
    return len(_made)


def drop_scratch(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables that this thread wrote between two marks; nothing may read them any more."""
    for thread, path in _made[since:until]:
        if thread == threading.get_ident():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this library; call it when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than one in so many of all rows count as hot: at most so many can be, for their shares add up to one.
HOT_KEYS = 20_000


def meet(many: DataFrame, few: DataFrame, on: list[str], count: str, total: int, keys: int = HOT_KEYS) -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key and in ``count`` how many rows of ``many`` have it.

    A key may hold any share of ``total``: rows of hot keys, of which there are
    fewer than ``keys``, meet a broadcast row, so they are spread as they were
    read. Rows of the other keys meet theirs in whatever join Spark chooses.
    """
    if total <= keys:  # so there are at most so many keys
        return many.join(F.broadcast(few), on).drop(count)
    hot = few.where(F.col(count) * keys > total)
    rest = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(few, on)
    return many.join(F.broadcast(hot), on).unionByName(rest).drop(count)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... so that no name can clash with an operator's own; and the names that they had."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def text_of(column: str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


class WordHash(dict):
    """From a white-space token to the 64-bit hash of its word; 0 where no letter or digit is left.

    A word is a token in lower case without the characters at its ends that are
    neither letters nor digits.
    """

    def __missing__(self, token: str) -> int:
        word = token
        if not word.isalnum():
            start, end = 0, len(word)
            while start < end and not word[start].isalnum():
                start += 1
            while end > start and not word[end - 1].isalnum():
                end -= 1
            word = word[start:end]
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1 if word else 0
        if len(self) >= WORD_CACHE:
            self.clear()
        self[token] = value
        return value


def word_hashes(text: str | None, cache: WordHash) -> np.ndarray:
    """Hashes of the words of a whole text, in order."""
    tokens = (text or "").lower().split()
    found = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    return found[found != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, offsets: Iterable[int], count: int) -> np.ndarray:
    """For each start 0..count-1, a hash of the words at the given offsets from it, order included."""
    out = np.zeros(count, dtype=np.uint64)
    for offset in offsets:
        out = (out + hashes[offset : offset + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
