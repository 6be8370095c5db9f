"""Forum threads: nested comments as rows, and the ancestry of every reply.

Comments come as nested XML or as a table of (id, parent). Depth, root and path
of each comment come from doubling joins, so a chain of replies takes as many
rounds as its length has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Opening tags with their attributes, closing tags, and tags that close themselves.
_TAG = r"(?is)<(/?)comment\b([^>]*?)(/?)>"


def nested_comments(pages: DataFrame, key: str = "did", xml: str = "xml") -> DataFrame:
    """(did, id, parent, depth, ord, author, text) of comments nested in one another (``<comment id= bloggerId=>``).

    The parent is the innermost comment that is open where another begins: the
    last earlier one that is one level up. The text is what follows the opening
    tag up to the next tag of a comment, without markup. A comment without an id
    gets a null id; order is the place of its tag. Null and empty pages have no
    rows.
    """
    found = F.regexp_extract_all(xml, F.lit(_TAG), F.lit(0))
    texts = F.slice(F.split(F.col(xml), _TAG, -1), 2, F.greatest(F.size(found), F.lit(1)))
    tags = pages.select(F.col(key).alias("did"), F.posexplode(F.arrays_zip(found.alias("tag"), texts.alias("text"))).alias("ord", "x")).select("did", "ord", "x.tag", "x.text").where("tag is not null")
    step = F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").endswith("/>"), 0).otherwise(1)
    order = Window.partitionBy("did").orderBy("ord")
    level = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = tags.withColumn("step", step).withColumn("depth", F.coalesce(level, F.lit(0)).cast("int")).where("step >= 0")
    attribute = lambda name: F.nullif(F.regexp_extract("tag", rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    rows = opened.select("did", "ord", "depth", attribute("id").alias("id"), attribute("bloggerId").alias("author"), F.trim(F.regexp_replace(F.regexp_replace("text", "(?s)<[^>]*>", " "), r"\s+", " ")).alias("text"))
    # A comment's parent is the last one before it of the level above: a window over neighbouring levels, each of them once as itself and once as a parent.
    self_ = rows.withColumn("level", F.col("depth")).withColumn("own", F.lit(True))
    above = rows.withColumn("level", F.col("depth") + 1).withColumn("own", F.lit(False))
    last = F.last(F.when(~F.col("own"), F.struct("id")), ignorenulls=True).over(Window.partitionBy("did", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return self_.unionByName(above).withColumn("parent", last).where("own").select("did", "id", F.when(F.col("depth") > 0, F.col("parent.id")).alias("parent"), "depth", "ord", "author", "text")


def ancestry(comments: DataFrame, keys: tuple[str, str] = ("id", "parent")) -> DataFrame:
    """(id, parent, depth, root): how many replies lie above each comment, and the comment that its thread began with.

    A comment whose parent is null or unknown begins a thread. In each round a
    comment's pointer jumps to where its parent's points, so rounds grow with
    the logarithm of the longest chain. Comments in a ring, which no thread can
    have, are left out, as are rows without an id; of rows that repeat an id one stays.
    """
    id_, parent = keys
    plain = comments.select(F.col(id_).alias("id"), F.col(parent).alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = plain.select(F.col("id").alias("parent"), F.lit(True).alias("__known"))
    now = plain.join(known, "parent", "left").select("id", F.when(F.col("__known"), F.col("parent")).alias("parent"))
    now = checkpointed(now.select("id", "parent", F.col("parent").alias("tip"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "id").alias("root")))
    rounds, total = 0, now.count()
    while now.where("tip is not null").head(1) and 1 << rounds <= 2 * total:
        on = now.select(F.col("id").alias("tip"), F.col("tip").alias("__tip"), F.col("depth").alias("__depth"), F.col("root").alias("__root"))
        jumped = now.where("tip is not null").join(on, "tip").select("id", "parent", F.col("__tip").alias("tip"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__root").alias("root"))
        now, rounds = checkpointed(now.where("tip is null").unionByName(jumped)), rounds + 1
    return now.where("tip is null").select("id", "parent", "depth", "root")


def paths(comments: DataFrame, keys: tuple[str, str] = ("id", "parent")) -> DataFrame:
    """(id, path): the ids from a thread's first comment down to each comment.

    The path is as long as the comment is deep, so all paths of a chain of n
    replies hold n * n / 2 ids: ask for them where threads are not that deep.
    Halves double, as the pointers of ``ancestry`` do.
    """
    known = ancestry(comments, keys)
    now = checkpointed(known.select("id", F.col("parent").alias("tip"), F.array("id").alias("path")))
    while now.where("tip is not null").head(1):
        on = now.select(F.col("id").alias("tip"), F.col("tip").alias("__tip"), F.col("path").alias("__path"))
        jumped = now.where("tip is not null").join(on, "tip").select("id", F.col("__tip").alias("tip"), F.concat("__path", "path").alias("path"))
        now = checkpointed(now.where("tip is null").unionByName(jumped))
    return now.select("id", "path")


def reply_links(comments: DataFrame, agreements: DataFrame, sentiments: DataFrame, on: str = "id") -> DataFrame:
    """(id, parent, agreement, sentiment): each reply with both labels of its link, where they are known.

    ``agreements`` and ``sentiments`` are (id, label); of several labels of one
    link the most frequent counts (ties: the smallest).
    """

    def most(labels: DataFrame, name: str) -> DataFrame:
        counts = labels.where("label is not null").groupBy(on, "label").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(on).agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("best")).select(on, F.col("best.label").alias(name))

    replies = comments.where("parent is not null").select(on, "parent")
    return replies.join(most(agreements, "agreement"), on, "left").join(most(sentiments, "sentiment"), on, "left")
