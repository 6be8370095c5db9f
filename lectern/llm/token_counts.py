"""Token counts by a separator scan over flat, unindexed token files.

A flat file holds the ids of many documents one after the other, each document
closed by an end-of-document id, and nothing else. Each file is looked through in
blocks with vectorised comparisons; what a block knows (its separators) is then
stitched to what comes before it by a prefix scan over the blocks of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, slices, written
from .tokens import encoder

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20
#: Documents are written in rows of so many bytes (longer ones by themselves), and files of so many rows at most.
ROW_BYTES, FILE_ROWS = 1 << 22, 64


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = END_OF_DOCUMENT, dtype: str = "<u2", text: str = "text") -> str:
    """Write the ids of all texts as flat files of ``dtype`` and return their folder.

    Spark's text writer puts the bytes down as they are, and its line separator
    is the end-of-document id, so files are flat, go to any store that Spark
    writes to, and are committed as other tables are. Strings of special tokens
    in a text are ordinary text: no text can forge a separator. Null and empty
    texts are a separator alone. A row holds the ids of many documents with
    separators between them, so the number of rows bounds a file's bytes: 256 MB,
    and more only by the length of single documents.
    """
    folder = path or scratch_path(docs.sparkSession, "tokens")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(tokenizer, specials=False), np.array([end], dtype=dtype).tobytes()
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([closing.join(held)], pa.binary())], names=["ids"])

        for batch in slices(batches, 256):
            for t in batch.column(0).to_pylist():
                ids = encode(t or "")
                if (ids == end).any() or (len(ids) and int(ids.max()) > np.iinfo(dtype).max):
                    raise ValueError("an id equals the separator or does not fit the file's type")
                data = ids.astype(dtype).tobytes()
                if held and size + len(data) > ROW_BYTES:
                    yield row()
                    held, size = [], 0
                held.append(data)
                size += len(data) + len(closing)
        if held:
            yield row()

    separator = np.array([end], dtype=dtype).tobytes().decode("latin-1")
    rows = docs.select(F.col(text).alias("text")).mapInArrow(encoded, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", FILE_ROWS).text(folder)
    return folder


def scan_blocks(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, ends): for each block the positions of its separators in the file.

    Files are read whole by one task each (Spark's binaryFile source), so they
    may have up to 2 GB; a file whose bytes are not a multiple of an id's size is
    an error.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            name = batch.column(0)[0].as_py()
            ids = np.frombuffer(batch.column(1)[0].as_buffer(), dtype=dtype)
            for number, at in enumerate(range(0, len(ids), block)):
                part = ids[at : at + block]
                ends = np.flatnonzero(part == end) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([number], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "ends"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "file string, block long, tokens long, ends array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, document, start, n_tokens, closed) from the blocks of ``scan_blocks``, in any order of rows.

    A prefix scan gives each block the place after the last separator before it
    and the number of documents closed by then. The scan's rows are blocks with
    a few numbers each, so a file's group is small; separators' places do not
    pass through it. Ids after the last separator of a file are a document that
    is not closed. The blocks are written once, for both uses.
    """
    blocks = written(blocks, "blocks")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    slim = blocks.select("file", "block", "tokens", F.try_element_at("ends", F.lit(-1)).alias("latest"), F.size("ends").alias("n"))
    scanned = slim.select(
        "file",
        "block",
        F.coalesce(F.max("latest").over(earlier) + 1, F.lit(0)).alias("begin"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("latest").over(whole) + 1, F.lit(0)).alias("rest"),
        F.sum("tokens").over(whole).alias("length"),
        F.sum("n").over(whole).alias("documents"),
        (F.col("block") == F.max("block").over(whole)).alias("last"),
    )
    met = blocks.select("file", "block", "ends").join(scanned, ["file", "block"])
    starts = F.concat(F.array("begin"), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda x: x + 1))
    each = met.select("file", "before", F.posexplode(F.arrays_zip(F.when(F.size("ends") > 0, starts).otherwise(F.array().cast("array<long>")).alias("start"), F.col("ends").alias("stop"))).alias("i", "x"))
    closed = each.select("file", (F.col("before") + F.col("i")).alias("document"), "x.start", (F.col("x.stop") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    open_ = scanned.where(F.col("last") & (F.col("length") > F.col("rest")))
    return closed.unionByName(open_.select("file", F.col("documents").alias("document"), F.col("rest").alias("start"), (F.col("length") - F.col("rest")).alias("n_tokens"), F.lit(False).alias("closed")))


def count_tokens(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document of flat token files: file (name), document (from 0 in its file), start, n_tokens (without the separator), closed.

    Empty documents count 0; empty files and folders have no rows. Repeated
    documents are rows of their own.
    """
    blocks = scan_blocks(spark, path, end, dtype, block)
    return stitch(blocks).withColumn("file", F.element_at(F.split("file", "/"), -1))
