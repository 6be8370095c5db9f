"""Readers. XML goes through Spark's own XML source, line formats through text and CSV, markup through native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digits, split_sentences

#: Elements after which a page's text breaks to a new line, and elements whose content is no text.
BREAKS = ("span", "option", "hr", "br", "p", "td", "th")
DROPPED = ("script", "style")


def _xml(spark: SparkSession, path: str, tag: str, schema: str, parent: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", parent or tag).option("attributePrefix", "_").option("valueTag", "_text")
    # files may be written one after the other, so a file may have many roots
    reader = reader.option("useLegacyXMLParser", True).schema(schema)
    return reader.load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sentences_of(documents: DataFrame, docs_per_cluster: int = 200) -> DataFrame:
    """(cluster, did, sno, text): the non-empty lines of documents, numbered from 1; clusters of one language and source.

    A cluster holds the documents of ``docs_per_cluster`` neighbouring ids, so
    its size does not grow with the corpus.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cluster = F.concat_ws("/", "lang", "source", F.floor(F.col("doc_id") / docs_per_cluster).cast("string"))
    return documents.select(cluster.alias("cluster"), F.col("doc_id").alias("did"), F.posexplode(lines).alias("i", "text")).select("cluster", "did", (F.col("i") + 1).alias("sno"), "text")


def read_cluster(spark: SparkSession, path: str) -> DataFrame:
    """(did, ord): the documents of cluster files."""
    out = _xml(spark, path, "D", "_DID string, _ORDER int")
    return out.select(F.col("_DID").alias("did"), F.col("_ORDER").alias("ord"))


def read_listed(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """The documents whose did is listed."""
    return documents.join(listed.select("did").distinct(), "did", "left_semi")


def read_docsent(spark: SparkSession, path: str, did: str | None = None) -> DataFrame:
    """(did, sno, par, rsnt, text) of segmented documents; with ``did`` any other identity is an error when read."""
    out = _xml(spark, path, "S", "_DID string, TEXT struct<S: array<struct<_SNO:int,_PAR:int,_RSNT:int,_text:string>>>", "DOCSENT")
    name = F.col("_DID")
    if did is not None:
        name = F.when(F.assert_true(name == did, F.concat(F.lit("document is not "), F.lit(did))).isNull(), name)
    return out.select(name.alias("did"), F.explode("TEXT.S").alias("s")).select("did", F.col("s._SNO").alias("sno"), F.col("s._PAR").alias("par"), F.col("s._RSNT").alias("rsnt"), F.col("s._text").alias("text"))


def read_query(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, description, narrative, keywords)."""
    out = _xml(spark, path, "QUERY", "_QID string, TITLE string, DESCRIPTION string, NARRATIVE string, KEYWORDS string")
    return out.select(F.col("_QID").alias("qid"), *(F.trim(F.col(c)).alias(c.lower()) for c in ("TITLE", "DESCRIPTION", "NARRATIVE", "KEYWORDS")))


def read_sentfeature(spark: SparkSession, path: str) -> DataFrame:
    """(did, sno, name, value)."""
    out = _xml(spark, path, "S", "_DID string, _SNO int, FEATURE array<struct<_N:string,_V:double>>")
    return out.select(F.col("_DID").alias("did"), F.col("_SNO").alias("sno"), F.explode("FEATURE").alias("f")).select("did", "sno", F.col("f._N").alias("name"), F.col("f._V").alias("value"))


def read_sentjudge(spark: SparkSession, path: str) -> DataFrame:
    """(did, sno, par, rsnt, judge, util)."""
    out = _xml(spark, path, "S", "_DID string, _SNO int, _PAR int, _RSNT int, JUDGE array<struct<_N:string,_UTIL:double>>")
    rows = out.select(F.col("_DID").alias("did"), F.col("_SNO").alias("sno"), F.col("_PAR").alias("par"), F.col("_RSNT").alias("rsnt"), F.explode("JUDGE").alias("j"))
    return rows.select("did", "sno", "par", "rsnt", F.col("j._N").alias("judge"), F.col("j._UTIL").alias("util"))


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """(ord, did, sno, wcnt); wcnt is null in files without word counts."""
    out = _xml(spark, path, "S", "_ORDER int, _DID string, _SNO int, _WCNT int")
    return out.select(F.col("_ORDER").alias("ord"), F.col("_DID").alias("did"), F.col("_SNO").alias("sno"), F.col("_WCNT").alias("wcnt"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(sdid, ssent, tdid, tsent, type, judge): one row for each relation of a pair."""
    out = _xml(spark, path, "R", "_SDID string, _SSENT int, _TDID string, _TSENT int, RELATION array<struct<_TYPE:string,_JUDGE:string>>")
    rows = out.select(F.col("_SDID").alias("sdid"), F.col("_SSENT").alias("ssent"), F.col("_TDID").alias("tdid"), F.col("_TSENT").alias("tsent"), F.explode("RELATION").alias("r"))
    return rows.select("sdid", "ssent", "tdid", "tsent", F.col("r._TYPE").alias("type"), F.col("r._JUDGE").alias("judge"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(did, source, ts, ord) from lines of document, source and seconds since 1970."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("ord")).where(F.size("p") >= 3)
    return lines.select(F.get("p", 0).alias("did"), F.get("p", 1).alias("source"), F.timestamp_seconds(F.get("p", 2).cast("long")).alias("ts"), "ord")


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    """(w, idf) from lines of word and number."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    return lines.select(F.get("p", 0).alias("w"), F.get("p", 1).cast("double").alias("idf"))


def sgml_sentences(texts: DataFrame) -> DataFrame:
    """(did, sno, text) from SGML documents (did, text): each paragraph element is a sentence."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<P>(.*?)</P>"), F.lit(1))
    clean = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return texts.select("did", F.posexplode(clean).alias("i", "text")).select("did", (F.col("i") + 1).alias("sno"), "text")


def text_sentences(texts: DataFrame) -> DataFrame:
    """(did, sno, text) from plain texts (did, text)."""
    return texts.select("did", F.posexplode(split_sentences(F.col("text"))).alias("i", "text")).select("did", (F.col("i") + 1).alias("sno"), "text")


def parallel_corpus(texts: DataFrame) -> DataFrame:
    """(did, headline, sno, text) from newswire documents with a HEADLINE and a TEXT element."""
    head = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?is)<HEADLINE>(.*?)</HEADLINE>", 1), r"\s+", " "))
    body = F.regexp_replace(F.regexp_extract("text", r"(?is)<TEXT>(.*?)</TEXT>", 1), "(?s)<[^>]*>", " ")
    return texts.select("did", head.alias("headline"), F.posexplode(split_sentences(body)).alias("i", "text")).select("did", "headline", (F.col("i") + 1).alias("sno"), "text")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1), r"\s+", " "))


def html_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; new lines at block elements; the common entities."""
    out = html
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?({'|'.join(BREAKS)})( [^>]*)?/?>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t\r]+", " "), " ?\n[ \n]*", "\n"))


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, text)."""
    return pages.select("page_id", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, text): the lines of files whose blocks stand between blank lines."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("block"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("v")).where("v <> ''")
    return blocks.select("block", F.posexplode(F.split("v", "\n")).alias("line", "text"))


def read_salience(spark: SparkSession, path: str) -> DataFrame:
    """(block, doc, sent, sal): a block for each cluster, a line for each document, a number for each sentence."""
    lines = read_blocks(spark, path)
    return lines.select("block", F.col("line").alias("doc"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("sent", "v")).select("block", "doc", "sent", F.col("v").cast("double").alias("sal"))


def read_evaluations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Peers and models (eval, name, file) of an evaluation set."""
    entry = "array<struct<_ID:string,_text:string>>"
    out = _xml(spark, path, "EVAL", f"_ID string, `PEER-ROOT` string, `MODEL-ROOT` string, PEERS struct<P:{entry}>, MODELS struct<M:{entry}>")
    side = lambda group, item, root: out.select(F.col("_ID").alias("eval"), F.trim(root).alias("root"), F.explode(f"{group}.{item}").alias("x")).select("eval", F.col("x._ID").alias("name"), F.concat_ws("/", "root", F.trim("x._text")).alias("file"))
    return side("PEERS", "P", "`PEER-ROOT`"), side("MODELS", "M", "`MODEL-ROOT`")


def read_file_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Peers and models from lines of a peer's file and its models' files; the line's number is the evaluation."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("eval"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") > 1)
    peers = lines.select("eval", F.lit("1").alias("name"), F.get("f", 0).alias("file"))
    models = lines.select("eval", F.posexplode(F.slice("f", 2, F.size("f") - 1)).alias("i", "file")).select("eval", F.col("i").cast("string").alias("name"), "file")
    return peers, models


def summary_lines(text: Column, style: str = "SPL") -> Column:
    """Sentences of a summary file in lower case: SEE (anchors with #id), ISI (S elements) or SPL (a sentence a line)."""
    if style == "SEE":
        found = F.regexp_extract_all(text, F.lit(r"(?i)<a [^>]*href=\"#[^\"]*\"[^>]*>([^<]*)</a>"), F.lit(1))
    elif style == "ISI":
        found = F.regexp_extract_all(text, F.lit(r"(?is)<S [^>]*>(.*?)</S>"), F.lit(1))
    elif style == "SPL":
        found = F.split(text, "\n")
    else:
        raise ValueError(f"no such style: {style}")
    return F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def read_basic_elements(spark: SparkSession, path: str) -> DataFrame:
    """(head, modifier, relation) from lines head|modifier|relation, as they are written: quotes have no meaning."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", r"\|").alias("p"))
    return parts.select(*(F.nullif(F.get("p", i), F.lit("")).alias(name) for i, name in enumerate(("head", "modifier", "relation"))))


def read_classes(spark: SparkSession, path: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test halves of lines of class, tab, text (as it is written, further tabs included); a line's own hash says which half."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "\t", 2).alias("p"))
    rows = parts.select(F.get("p", 0).alias("grp"), F.get("p", 1).alias("text"))
    half = F.pmod(digits(F.col("grp"), F.col("text"), F.lit(seed)), F.lit(2)) == 0
    return rows.where(half), rows.where(~half)


def list_collection(spark: SparkSession, path: str) -> DataFrame:
    """(path, collection, name): the files of a folder of collections; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("collection"), F.element_at(parts, -1).alias("name"))


def forum_pairs(article: DataFrame, comments: DataFrame) -> DataFrame:
    """(article, com_s, target_s, kind): each comment sentence with each article sentence and each earlier comment sentence of its article.

    ``article`` is (article, sent), ``comments`` (article, sent). A thread is one
    article's, so pairs stay within it.
    """
    a, c = article.select("article", F.col("sent").alias("target_s")), comments.select("article", F.col("sent").alias("com_s"))
    to_article = c.join(a, "article").withColumn("kind", F.lit("article"))
    earlier = comments.select("article", F.col("sent").alias("target_s"))
    to_comment = c.join(earlier, "article").where("target_s < com_s").withColumn("kind", F.lit("comment"))
    return to_article.unionByName(to_comment).select("article", "com_s", "target_s", "kind")


def split_column(rows: DataFrame, key: str, train: int = 8, valid: int = 1, test: int = 1) -> DataFrame:
    """Rows with ``split``: train, valid or test by the key's hash in the given proportion."""
    h = F.pmod(digits(F.col(key)), F.lit(train + valid + test))
    return rows.withColumn("split", F.when(h < train, "train").when(h < train + valid, "valid").otherwise("test"))
