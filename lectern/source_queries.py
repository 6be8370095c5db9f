"""One query for each file format: tables are written in the format and read back, and SQL gives the rows that must return."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import sanitize, split_words
from .operators import select
from .operators.graph import shared_folder
from .queries import IDF, JUDGED, SENT, Query, _docs, _idf, _judged, _rel_sql, _relations, _sent, split_sql
from .sources import readers, writers

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def _put(rows: DataFrame, body: Column) -> str:
    """A new folder of text files with a text for each row."""
    path = f"{shared_folder(rows.sparkSession)}/lectern/formats-{uuid.uuid4().hex}"
    rows.select(body.alias("value")).write.text(path)
    return path


def _named(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), sanitize(text), F.lit(f"</{tag}>"))


_CLUSTER = "lang || '/' || source || '/' || (doc_id // 200)"


@_query("s1_cluster_files", f"SELECT CAST(doc_id AS VARCHAR) AS did, row_number() OVER (PARTITION BY {_CLUSTER} ORDER BY doc_id) AS ord FROM documents")
def s1(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.concat_ws("/", "lang", "source", F.floor(F.col("doc_id") / 200).cast("string")).alias("cluster"), F.col("doc_id").alias("did"))
    ordered = docs.withColumn("ord", F.row_number().over(Window.partitionBy("cluster").orderBy("did")))
    return readers.read_cluster(spark, _put(writers.cluster_xml(ordered), F.col("xml")))


@_query("s3_docsent_files", "WITH " + SENT + " SELECT CAST(did AS VARCHAR) AS did, sno, 1 AS par, sno AS rsnt, trim(text) AS text FROM sent")
def s3(spark: SparkSession, d: str) -> DataFrame:
    rows = writers.docsent_xml(_sent(spark, d).withColumn("text", F.trim("text")))
    return readers.read_docsent(spark, _put(rows, F.col("xml")))


@_query("s4_query_files", "SELECT CAST(item_id AS VARCHAR) AS qid, trim(text) AS title, 'about ' || item_id AS description, '' || length(text) AS narrative, 'a;1' AS keywords FROM benchmark")
def s4(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark")
    qid = F.col("item_id").cast("string")
    parts = (_named("TITLE", F.trim("text")), _named("DESCRIPTION", F.concat(F.lit("about "), qid)), _named("NARRATIVE", F.length("text").cast("string")), _named("KEYWORDS", F.lit("a;1")))
    return readers.read_query(spark, _put(b, F.concat(F.lit('<QUERY QID="'), qid, F.lit('">'), *parts, F.lit("</QUERY>"))))


@_query("s5_sentfeature_files", "WITH " + SENT + " SELECT CAST(did AS VARCHAR) AS did, sno, 'Chars' AS name, CAST(length(text) AS DOUBLE) AS value FROM sent UNION ALL SELECT CAST(did AS VARCHAR), sno, 'Sno', CAST(sno AS DOUBLE) FROM sent")
def s5(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    one = lambda name, value: s.select("did", "sno", F.lit(name).alias("name"), value.alias("value"))
    rows = writers.sentfeature_xml(one("Chars", F.length("text")).unionByName(one("Sno", F.col("sno"))))
    return readers.read_sentfeature(spark, _put(rows, F.col("xml")))


@_query("s6_sentjudge_files", "WITH " + JUDGED + " SELECT CAST(did AS VARCHAR) AS did, sno, 1 AS par, sno AS rsnt, judge, CAST(util AS DOUBLE) AS util FROM judged")
def s6(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_sentjudge(spark, _put(writers.sentjudge_xml(_judged(_sent(spark, d))), F.col("xml")))


@_query("s7_extract_files", "WITH " + SENT + """, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length(text) DESC, did, sno) AS rank, count(*) OVER (PARTITION BY cluster) AS size FROM sent)
SELECT row_number() OVER (PARTITION BY cluster ORDER BY CAST(did AS VARCHAR), sno) AS ord, CAST(did AS VARCHAR) AS did, sno FROM r WHERE rank <= ceil(size * 20 / 100)""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """The extract of the longest fifth of each cluster's sentences."""
    chosen = select.top_sentences(_sent(spark, d).withColumn("score", F.length("text").cast("double")))
    return readers.read_extract(spark, _put(writers.extract_xml(select.extract_order(chosen)), F.col("xml"))).select("ord", "did", "sno")


@_query("s8_relation_files", "WITH " + SENT + ", " + _rel_sql("rel", "a", 1) + " SELECT CAST(sdid AS VARCHAR) AS sdid, ssent, CAST(tdid AS VARCHAR) AS tdid, tsent, type, judge FROM rel")
def s8(spark: SparkSession, d: str) -> DataFrame:
    attributes = writers._attributes(SDID=F.col("sdid"), SSENT=F.col("ssent"), TDID=F.col("tdid"), TSENT=F.col("tsent"))
    relation = writers._attributes(TYPE=F.col("type"), JUDGE=F.col("judge"))
    return readers.read_relations(spark, _put(_relations(_sent(spark, d)), F.concat(F.lit("<R"), attributes, F.lit(">\n<RELATION"), relation, F.lit("/>\n</R>"))))


@_query("s9_metadata_files", "SELECT CAST(doc_id AS VARCHAR) AS did, source, make_timestamp(CAST((86400 + doc_id * 60) AS BIGINT) * 1000000) AS ts FROM documents")
def s9(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "source", (86400 + F.col("doc_id") * 60).cast("string"))
    return readers.read_metadata(spark, _put(_docs(spark, d), line)).select("did", "source", "ts")


@_query("s10_s11_idf_files", "WITH " + IDF + " SELECT w, round(idf, 6) AS idf FROM idf")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_idf(spark, _put(_idf(spark, d), F.concat_ws(" ", "w", F.col("idf").cast("string")))).select("w", F.round("idf", 6).alias("idf"))


@_query("s12_sgml_paragraphs", "WITH " + SENT + r" SELECT did, sno, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM sent")
def s12(spark: SparkSession, d: str) -> DataFrame:
    texts = _sent(spark, d).groupBy("did").agg(F.array_sort(F.collect_list(F.struct("sno", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("<P>\n"), x["text"], F.lit("\n</P>"))), "\n")
    return readers.sgml_sentences(texts.select("did", F.concat(F.lit("<TEXT>"), body, F.lit("</TEXT>")).alias("text")))


@_query("s15_parallel_corpus", f"SELECT did, headline, i AS sno, s[i] AS text FROM (SELECT did, headline, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id AS did, 'Item ' || item_id AS headline, {split_sql('text')} AS s FROM benchmark))")
def s15(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("<DOC><HEADLINE>\nItem\n"), F.col("item_id").cast("string"), F.lit("</HEADLINE>\n<TEXT>\n"))
    return readers.parallel_corpus(readers.table(spark, d, "benchmark").select(F.col("item_id").alias("did"), F.concat(head, F.col("text"), F.lit("\n</TEXT></DOC>")).alias("text")))


@_query("s16_evaluation_sets", """SELECT 'peer' AS side, CAST(item_id % 7 AS VARCHAR) AS eval, 'p' || item_id AS name, 'peers/' || item_id || '.html' AS file FROM benchmark
UNION ALL SELECT 'model', CAST(item_id % 7 AS VARCHAR), 'm' || item_id, 'models/' || item_id || '.txt' FROM benchmark""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark")
    side = lambda name, end: b.select((F.col("item_id") % 7).alias("eval"), F.concat(F.lit(name), F.col("item_id").cast("string")).alias("name"), F.concat(F.col("item_id").cast("string"), F.lit(end)).alias("file"))
    peers, models = readers.read_evaluations(spark, _put(writers.rouge_settings(side("p", ".html"), side("m", ".txt"), peer_root="peers", model_root="models"), F.col("xml")))
    return peers.select(F.lit("peer").alias("side"), "eval", "name", "file").unionByName(models.select(F.lit("model").alias("side"), "eval", "name", "file"))


@_query("s17_summary_files", "SELECT style, item_id, list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x))), lambda x: x <> ''), 'string_agg', chr(10)) AS lines FROM benchmark, (VALUES ('SEE'), ('ISI'), ('SPL')) t(style)")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """The same sentences as a page with anchors, as S elements, and a line each."""
    b = readers.table(spark, d, "benchmark")
    rows = b.select("item_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    see = writers.see_html(rows.select(F.col("item_id").cast("string").alias("name"), "ord", "text")).select(F.col("name").cast("long").alias("item_id"), F.lit("SEE").alias("style"), F.col("html").alias("text"))
    isi = b.select("item_id", F.lit("ISI").alias("style"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('<S ID="1">'), x, F.lit("</S>"))), "\n").alias("text"))
    spl = b.select("item_id", F.lit("SPL").alias("style"), "text")
    found = [part.select("style", "item_id", F.array_join(readers.summary_lines(F.col("text"), style), "\n").alias("lines")) for style, part in (("SEE", see), ("ISI", isi), ("SPL", spl))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@_query("s18_basic_element_files", r"""WITH t AS (SELECT list_filter(regexp_extract_all(text, '[^\s,.\-]+'), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS t FROM documents),
i AS (SELECT t, unnest(range(0, len(t) // 3)) AS i FROM t) SELECT t[3 * i + 1] AS head, t[3 * i + 2] AS modifier, t[3 * i + 3] AS relation FROM i""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Every three words of a text as a triple."""
    words = _docs(spark, d).select(F.filter(split_words(F.col("text")), lambda w: w.rlike("^[A-Za-z]+$")).alias("w")).where("size(w) >= 3")
    places = words.select("w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("i"))
    return readers.read_basic_elements(spark, _put(places, F.concat_ws("|", *(F.get("w", 3 * F.col("i") + k) for k in range(3)))))


@_query("s19_salience_files", "SELECT doc, sent, CAST(length(text) * 10 + doc + sent / 4 AS DOUBLE) AS sal FROM documents, (SELECT unnest([0, 1, 2]) AS doc), (SELECT unnest([0, 1]) AS sent)")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """A block for each text, of three lines of two numbers."""
    line = lambda i: F.concat_ws(" ", *((F.length("text") * 10 + i + k / 4).cast("string") for k in range(2)))
    return readers.read_salience(spark, _put(_docs(spark, d), F.concat(F.concat_ws("\n", *(line(i) for i in range(3))), F.lit("\n")))).select("doc", "sent", "sal")


@_query("s22_class_files", r"""SELECT grp, text, CASE WHEN ('0x' || substr(md5(grp || ':' || text || ':0'), 1, 8))::BIGINT % 2 = 0 THEN 'train' ELSE 'test' END AS half
FROM (SELECT lang AS grp, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM documents)""")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as lines under their language."""
    train, test = readers.read_classes(spark, _put(_docs(spark, d), F.concat(F.col("lang"), F.lit("\t"), F.trim(F.regexp_replace("text", r"\s+", " ")))))
    return train.withColumn("half", F.lit("train")).unionByName(test.withColumn("half", F.lit("test")))
