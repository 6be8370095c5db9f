"""One query for each operator over whole tables, and DuckDB SQL for the same rows.

Clusters are documents of one language and source with neighbouring ids,
sentences are their lines, judges and relations are rules of arithmetic on
(did, sno), model summaries are the benchmark's texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boundaries, similarity, taxonomy, text
from .llm.common import written
from .operators import classify, evaluation, features, graph, ngram_graph, pointer, products, redundancy, rouge, select, threads, walks
from .plans.summarizer import Summarizer, sweep
from .sources import readers, writers
from .streaming import single_pass

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SENT = r"""sent AS (
  SELECT cluster, did, row_number() OVER (PARTITION BY did ORDER BY i) AS sno, text FROM (
    SELECT lang || '/' || source || '/' || (doc_id // 200) AS cluster, doc_id AS did,
           unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents)
  WHERE trim(text) <> '')"""
TOK = SENT + r""",
tok AS (SELECT cluster, did, sno, unnest(regexp_extract_all(text, '[^\s,.\-]+')) AS w FROM sent)"""
IDF = TOK + """,
idf AS (SELECT w, count(DISTINCT did) AS df, ln((SELECT count(DISTINCT did) FROM tok) / count(DISTINCT did)) AS idf FROM tok GROUP BY w)"""
LEN = r"len(regexp_extract_all(text, '[^\s,.\-]+'))"
CENTROID = IDF + """,
docs AS (SELECT cluster, count(DISTINCT did) AS docs FROM tok GROUP BY cluster),
weighted AS (SELECT cluster, w, docs, n / docs AS tf, n / docs * coalesce(idf, 0.1) AS tfidf
  FROM (SELECT cluster, w, count(*) AS n FROM tok GROUP BY ALL) JOIN docs USING (cluster) LEFT JOIN idf USING (w)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(tfidf, 9) DESC, w) AS rank FROM weighted)
  WHERE tfidf > 3 OR rank <= 8 * docs),
summed AS (SELECT s.cluster, s.did, s.sno, coalesce(sum(tfidf), 0) AS s
  FROM sent s LEFT JOIN (SELECT * FROM tok JOIN kept USING (cluster, w)) t ON t.did = s.did AND t.sno = s.sno GROUP BY ALL),
centroid AS (SELECT cluster, did, sno, CASE WHEN max(s) OVER (PARTITION BY cluster) > 0 THEN s / max(s) OVER (PARTITION BY cluster) ELSE 0 END AS value FROM summed)"""
SCORED = CENTROID + f""",
scored AS (SELECT sent.cluster, did, sno, text, {LEN} AS n,
    CASE WHEN {LEN} < 9 THEN 0 ELSE value + sqrt(1.0 / sno) END AS score
  FROM sent JOIN centroid USING (did, sno))"""
RANKED = SCORED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, did, sno) AS rank,
  count(*) OVER (PARTITION BY cluster) AS size, sum(n) OVER (PARTITION BY cluster) AS words FROM scored)"""


#: The abbreviations of the sentence splitter, written out again.
_ABBREVIATIONS = "'Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Sen.', 'Rep.', 'Gov.', 'Gen.', 'Col.', 'Lt.', 'Sgt.', 'St.', 'Jr.', 'Sr.', 'Inc.', 'Corp.', 'Co.', 'Ltd.', 'vs.', 'etc.', 'e.g.', 'i.e.', 'U.S.', 'U.N.', 'a.m.', 'p.m.', 'No.'"


def split_sql(text: str) -> str:
    """The sentences of a text as a list."""
    broken = f"regexp_replace(regexp_replace({text}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '([.!?]+[\"'']*) +([^a-z ])', '\\1' || chr(10) || '\\2', 'g')"
    pieces = f"list_transform(string_split(trim({broken}), chr(10)), lambda p: [p])"
    joined = f"CASE WHEN list_contains([{_ABBREVIATIONS}], list_last(string_split(list_last(done), ' '))) THEN list_append(done[1:len(done) - 1], list_last(done) || ' ' || piece[1]) ELSE list_append(done, piece[1]) END"
    return f"list_filter(list_reduce({pieces}, lambda done, piece: {joined}), lambda s: regexp_matches(s, '[^ \\t\\n\\f\\r.,!?-]'))"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "documents")


def _sent(spark: SparkSession, d: str) -> DataFrame:
    return readers.sentences_of(_docs(spark, d))


def _idf(spark: SparkSession, d: str) -> DataFrame:
    return similarity.idf_table(_words(spark, d))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return written(features.counted_words(_sent(spark, d)), "words")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return Summarizer().scores(_sent(spark, d))


def _r(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or str(c))


# -- the pipeline --------------------------------------------------------------


@register("summary_top20", "WITH " + RANKED + r""",
ext AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CAST(did AS VARCHAR), sno) AS ord FROM ranked WHERE rank <= ceil(size * 20 / 100))
SELECT cluster, string_agg('[' || ord || ']  ' || text, chr(10) ORDER BY ord) AS summary FROM ext GROUP BY cluster""")
def summary_top20(spark: SparkSession, d: str) -> DataFrame:
    """Documents to sentences, centroid + position with a length cutoff, the best fifth of each cluster, as text."""
    return Summarizer(reranker="identity").summary(_sent(spark, d))


# -- sources -------------------------------------------------------------------


@register("s2_listed_documents", "SELECT doc_id AS did, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s2(spark: SparkSession, d: str) -> DataFrame:
    listed = readers.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("did"))
    return readers.read_listed(_docs(spark, d).select(F.col("doc_id").alias("did"), "n_chars"), listed)


@register("s13_sentences", "WITH " + SENT + " SELECT cluster, did, sno, text FROM sent")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return _sent(spark, d)


@register("s13_text_to_docsent", f"SELECT did, i AS sno, s[i] AS text FROM (SELECT did, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id AS did, {split_sql('text')} AS s FROM documents))")
def s13b(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_sentences(_docs(spark, d).select(F.col("doc_id").alias("did"), "text"))


@register("s10_s11_idf", "WITH " + IDF + " SELECT w, df, round(idf, 6) AS idf FROM idf")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d).select("w", "df", _r("idf"))


@register("s14_html_title", r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_pages(readers.table(spark, d, "pages")).select("page_id", "title")


@register("s14_html_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
      '(?i)</?(span|option|hr|br|p|td|th)( [^>]*)?/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text FROM pages""")
def s14b(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_pages(readers.table(spark, d, "pages")).select("page_id", "text")


@register("s20_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'valid' ELSE 'test' END AS split FROM (SELECT ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS h FROM documents)) GROUP BY split")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return readers.split_column(_docs(spark, d), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("forum_pairs", """WITH a AS (SELECT conv_id AS article, turn AS sent FROM conversations WHERE role <> 'user'),
c AS (SELECT conv_id AS article, turn AS sent FROM conversations WHERE role = 'user')
SELECT c.article, c.sent AS com_s, a.sent AS target_s, 'article' AS kind FROM c JOIN a USING (article)
UNION ALL SELECT c.article, c.sent, e.sent, 'comment' FROM c JOIN c e ON c.article = e.article AND e.sent < c.sent""")
def forum(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "conversations").select(F.col("conv_id").alias("article"), F.col("turn").alias("sent"), "role")
    return readers.forum_pairs(rows.where("role <> 'user'"), rows.where("role = 'user'"))


# -- sinks ---------------------------------------------------------------------


@register("k1_sentfeature_xml", "WITH " + SENT + r""", f AS (SELECT did, sno, string_agg(line, chr(10) ORDER BY name) AS body FROM (
  SELECT did, sno, 'Length' AS name, '    <FEATURE N="Length" V="' || """ + LEN + r""" || '"/>' AS line FROM sent
  UNION ALL SELECT did, sno, 'Sno', '    <FEATURE N="Sno" V="' || sno || '"/>' FROM sent) GROUP BY ALL)
SELECT did, '<SENT-FEATURE>' || chr(10) || string_agg('  <S DID="' || did || '" SNO="' || sno || '">' || chr(10) || body || chr(10) || '  </S>', chr(10) ORDER BY sno) || chr(10) || '</SENT-FEATURE>' AS xml FROM f GROUP BY did""")
def k1(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    rows = s.select("did", "sno", F.lit("Length").alias("name"), features.length(F.col("text")).alias("value")).unionByName(s.select("did", "sno", F.lit("Sno").alias("name"), F.col("sno").alias("value")))
    return writers.sentfeature_xml(rows)


@register("k2_extract_order", "WITH " + RANKED + " SELECT cluster, did, sno, row_number() OVER (PARTITION BY cluster ORDER BY CAST(did AS VARCHAR), sno) AS ord FROM ranked WHERE rank <= 3")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return select.extract_order(select.top_sentences(_scored(spark, d), absolute=3)).select("cluster", "did", "sno", "ord")


@register("k4_centroid_words", "WITH " + CENTROID + " SELECT cluster, w, round(tf, 6) AS tf, round(tfidf, 6) AS tfidf FROM kept")
def k4(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return features.centroid_words(words, similarity.idf_table(words)).select("cluster", "w", _r("tf"), _r("tfidf"))


@register("k5_score_table", "WITH " + SENT + f" SELECT did, sno, CAST({LEN} AS DOUBLE) AS Length, round(sqrt(1.0 / sno), 6) AS Position, (did * 7 + sno * 13 + 5) % 11 AS j1, (did * 7 + sno * 13 + 20) % 11 AS j2 FROM sent")
def k5(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    long = s.select("did", "sno", F.lit("Length").alias("name"), features.length(F.col("text")).cast("double").alias("value")).unionByName(s.select("did", "sno", F.lit("Position").alias("name"), features.position(F.col("sno")).alias("value")))
    out = writers.score_table(long, ["Length", "Position"], _judged(s, 2), ["j1", "j2"])
    return out.select("did", "sno", "Length", _r("Position"), "j1", "j2")


@register("k7_jackknife", "SELECT a.doc_id AS eval, a.source AS peer, b.source AS model FROM (SELECT DISTINCT doc_id % 7 AS doc_id, source FROM documents) a JOIN (SELECT DISTINCT doc_id % 7 AS doc_id, source FROM documents) b USING (doc_id) WHERE a.source <> b.source")
def k7(spark: SparkSession, d: str) -> DataFrame:
    sides = _docs(spark, d).select((F.col("doc_id") % 7).alias("eval"), F.col("source").alias("name")).distinct()
    return writers.jackknifed(sides, sides)


@register("k10_prefix_summary", "WITH " + RANKED + " SELECT cluster, did, sno, rank FROM (SELECT *, sum(n) OVER (PARTITION BY cluster ORDER BY rank) AS total FROM ranked) WHERE total <= 100")
def k10(spark: SparkSession, d: str) -> DataFrame:
    narrow = _scored(spark, d).select("cluster", "did", "sno", "score", features.length(F.col("text")).alias("n"))  # no text goes through windows
    return select.prefix_summary(select.top_sentences(narrow, percent=100), 100).select("cluster", "did", "sno", "rank")


# -- text functions ------------------------------------------------------------


@register("t1_split_words", "WITH " + TOK + " SELECT w, count(*) AS n FROM tok GROUP BY w")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return features.tokens(_sent(spark, d)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@register("t4_sanitize", r"SELECT doc_id, replace(replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.sanitize(F.col("text")).alias("text"))


_RT = r"list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(text), '-', ' - '), '[^a-z0-9-]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: regexp_matches(t, '^[a-z0-9$]'))"
ROUGE_TOK = f"rt AS (SELECT item_id, {_RT} AS t FROM benchmark)"


@register("t5_rouge_tokens", "WITH " + ROUGE_TOK + " SELECT item_id, array_to_string(t, ' ') AS t, len(t) AS n FROM rt")
def t5(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select("item_id", text.rouge_tokens(F.col("text")).alias("t"))
    return b.select("item_id", F.array_join("t", " ").alias("t"), F.size("t").alias("n"))


@register("t6_t7_t14_lengths", "WITH " + TOK + f""", lead AS (SELECT did, list(w ORDER BY sno, i) AS ws FROM (SELECT did, sno, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT did, sno, regexp_extract_all(text, '[^\\s,.\\-]+') AS ws FROM sent)) GROUP BY did)
SELECT did, array_to_string(ws[1:20], ' ') AS first_words, len(list_filter(ws, lambda x: x NOT IN ('the', 'of', 'and', 'der', 'die', 'la', 'de'))) AS content,
  CAST(coalesce((SELECT sum(CASE WHEN {LEN} BETWEEN 10 AND 55 THEN 1 ELSE 0 END) FROM sent WHERE sent.did = lead.did), 0) AS BIGINT) AS valid FROM lead""")
def t6(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    words = features.lead_words(s, 1 << 30).where(F.size("words") > 0)
    stop = F.array(*map(F.lit, ("the", "of", "and", "der", "die", "la", "de")))
    valid = s.groupBy("did").agg(F.count(F.when(text.valid_length(text.split_words(F.col("text"))), 1)).alias("valid"))
    out = words.select("did", F.array_join(text.truncate_words(F.col("words"), 20), " ").alias("first_words"), F.size(text.drop_stopwords(F.col("words"), stop)).alias("content"))
    return out.join(valid, "did")


@register("t6_byte_truncation", """SELECT doc_id, substr(text, 1, CASE WHEN strlen(text) <= 665 THEN length(text) ELSE (SELECT max(i) FROM (SELECT unnest(range(0, least(length(text), 665) + 1)) AS i) WHERE strlen(substr(text, 1, i)) <= 665) END) AS text FROM documents""")
def t6b(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.truncate_bytes(F.col("text"), 665).alias("text"))


@register("t13_stopwords_by_pattern", "WITH " + SENT + r" SELECT did, sno, regexp_replace(regexp_replace(text, '(?i)\s+the\s+', ' ', 'g'), '(?i)\s+de\s+', ' ', 'g') AS text FROM sent")
def t13(spark: SparkSession, d: str) -> DataFrame:
    return _sent(spark, d).select("did", "sno", text.cut_stopwords(F.col("text"), ["the", "de"]).alias("text"))


@register("t8_porter_stems")
def t8(spark: SparkSession, d: str) -> DataFrame:
    words = features.tokens(_sent(spark, d)).select(F.lower("w").alias("word")).where(F.col("word").rlike("^[a-z]+$"))
    return text.stem_vocabulary(words)


@register("t9_ngrams", "WITH " + ROUGE_TOK + " SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM rt) GROUP BY ALL")
def t9(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select("item_id", F.explode(text.ngrams(text.rouge_tokens(F.col("text")), 2)).alias("g"))
    return b.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"))


@register("t10_skip_bigrams", "WITH " + ROUGE_TOK + ", p AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM rt) SELECT a.item_id, a.w || ' ' || b.w AS g, count(*) AS n FROM p a JOIN p b ON a.item_id = b.item_id AND b.i > a.i AND b.i <= a.i + 5 GROUP BY ALL")
def t10(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select("item_id", F.explode(text.skip_bigrams(text.rouge_tokens(F.col("text")), 4)).alias("g"))
    return b.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"))


@register("t12_unordered_bigrams", "WITH " + ROUGE_TOK + " SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: least(t[i], t[i + 1]) || '#' || greatest(t[i], t[i + 1]))) AS g FROM rt) GROUP BY ALL")
def t12(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select("item_id", F.explode(text.unordered_bigrams(text.rouge_tokens(F.col("text")))).alias("g"))
    return b.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"))


NG = """ng AS (SELECT item_id, substr(text, i, 3) AS g, i FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark)),
half AS (SELECT x.item_id, x.g AS a, y.g AS b FROM ng x JOIN ng y ON x.item_id = y.item_id AND y.i > x.i AND y.i <= x.i + 3),
edge AS (SELECT item_id, a, b, count(*) AS w FROM (SELECT * FROM half UNION ALL SELECT item_id, b, a FROM half) GROUP BY ALL)"""


@register("t16_ngram_graph", "WITH " + NG + " SELECT * FROM edge")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return text.char_ngram_edges(readers.table(spark, d, "benchmark"), "item_id", "text")


@register("t17_label_positions", "SELECT vec_id, list_filter(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0.1 THEN i END), lambda x: x IS NOT NULL)::VARCHAR AS places FROM embeddings")
def t17(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table(spark, d, "embeddings")
    places = text.label_positions(F.transform("embedding", lambda x: F.when(x > F.lit(0.1).cast("double"), 1).otherwise(0)))
    return e.select("vec_id", F.concat(F.lit("["), F.array_join(places.cast("array<string>"), ", "), F.lit("]")).alias("places"))


# -- similarities --------------------------------------------------------------

PAIRS = TOK + r""",
ws AS (SELECT did, sno, regexp_extract_all(text, '[^\s,.\-]+') AS w FROM sent),
pair AS (SELECT a.did, a.sno, a.w AS a, b.w AS b FROM ws a JOIN ws b ON a.did = b.did AND b.sno = a.sno + 1)"""
_BI = "list_transform(range(1, len({0})), lambda i: least({0}[i], {0}[i + 1]) || '#' || greatest({0}[i], {0}[i + 1]))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d).select("did", "sno", text.split_words(F.col("text")).alias("w"))
    return s.select("did", "sno", F.col("w").alias("a")).join(s.select("did", (F.col("sno") - 1).alias("sno"), F.col("w").alias("b")), ["did", "sno"])


@register("m1_m3_m4_overlaps", "WITH " + PAIRS + f""", q AS (SELECT *, {_BI.format("a")} AS ga, {_BI.format("b")} AS gb FROM pair)
SELECT did, sno, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / sqrt(len(list_distinct(a)) * len(list_distinct(b))) ELSE 0 END, 6) AS cosine,
  round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS overlap,
  round(CASE WHEN len(ga) + len(gb) > 0 THEN len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) ELSE 0 END, 6) AS bigram FROM q""")
def m1(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("did", "sno", _r(similarity.binary_cosine(a, b), "cosine"), _r(similarity.overlap(a, b), "overlap"), _r(similarity.bigram_overlap(a, b), "bigram"))


WEIGHT = """v AS (SELECT cluster, did, sno, w, count(*) * coalesce(any_value(idf), 0.1) AS v FROM tok LEFT JOIN idf USING (w) GROUP BY ALL),
norm AS (SELECT did, sno, sum(v * v) AS n FROM v GROUP BY ALL)"""


@register("m2_m10_idf_cosine", "WITH " + IDF + ", " + WEIGHT + """,
dot AS (SELECT a.did, a.sno, sum(a.v * b.v) AS dot FROM v a JOIN v b ON a.did = b.did AND b.sno = a.sno + 1 AND a.w = b.w GROUP BY ALL)
SELECT s.did, s.sno, round(CASE WHEN dot > 0 THEN dot / sqrt(na.n * nb.n) ELSE 0 END, 6) AS cosine FROM sent s JOIN sent t ON s.did = t.did AND t.sno = s.sno + 1
LEFT JOIN dot ON dot.did = s.did AND dot.sno = s.sno LEFT JOIN norm na ON na.did = s.did AND na.sno = s.sno LEFT JOIN norm nb ON nb.did = s.did AND nb.sno = s.sno + 1""")
def m2(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    words = features.sentence_words(s).select(F.concat_ws("#", "did", "sno").alias("item"), "w", "n")
    pairs = _pairs(spark, d).select("did", "sno", F.concat_ws("#", "did", "sno").alias("x"), F.concat_ws("#", F.col("did"), F.col("sno") + 1).alias("y"))
    return similarity.idf_cosine(pairs, words, _idf(spark, d)).select("did", "sno", _r("cosine"))


@register("t15_m10_vectors", "WITH " + IDF + r""", c AS (SELECT did, sno, w, count(*) AS n FROM tok GROUP BY ALL),
v AS (SELECT did, sno, w, n, n * coalesce(idf, 0) AS v FROM c LEFT JOIN idf USING (w)), norm AS (SELECT did, sno, sqrt(sum(n * n)) AS fn, sqrt(sum(v * v)) AS vn FROM v GROUP BY ALL),
dot AS (SELECT a.did, a.sno, sum(a.n * b.n) AS f, sum(a.v * b.v) AS v FROM v a JOIN v b ON a.did = b.did AND b.sno = a.sno + 1 AND a.w = b.w GROUP BY ALL)
SELECT s.did, s.sno, round(coalesce(f, 0) / coalesce(nullif(coalesce(a.fn, 0) * coalesce(b.fn, 0), 0), 0.00001), 6) AS freq_cosine, round(coalesce(dot.v, 0) / coalesce(nullif(coalesce(a.vn, 0) * coalesce(b.vn, 0), 0), 0.00001), 6) AS tfidf_cosine
FROM sent s JOIN sent t ON s.did = t.did AND t.sno = s.sno + 1 LEFT JOIN dot ON dot.did = s.did AND dot.sno = s.sno LEFT JOIN norm a ON a.did = s.did AND a.sno = s.sno LEFT JOIN norm b ON b.did = s.did AND b.sno = s.sno + 1""")
def t15(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of neighbouring sentences by counts, and by tf-idf with a join in which unknown words weigh 0."""
    s = _sent(spark, d)
    words = features.sentence_words(s).select(F.concat_ws("#", "did", "sno").alias("item"), "w", "n")
    pairs = _pairs(spark, d).select("did", "sno", F.concat_ws("#", "did", "sno").alias("x"), F.concat_ws("#", F.col("did"), F.col("sno") + 1).alias("y"), similarity.count_cosine("a", "b").alias("freq"))
    return similarity.idf_cosine(pairs, words, _idf(spark, d), unknown=0.0).select("did", "sno", _r("freq", "freq_cosine"), _r("cosine", "tfidf_cosine"))


_NGRAMS = "(SELECT did, sno, n, array_to_string({0}[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT did, sno, {0}, n, unnest(range(1, len({0}) - n + 2)) AS i FROM pair, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL)"


@register("m9_bleu_mix", "WITH " + PAIRS + f""", hit AS (SELECT did, sno, n, sum(least(x.c, y.c)) AS h FROM {_NGRAMS.format("a")} x JOIN {_NGRAMS.format("b")} y USING (did, sno, n, g) GROUP BY ALL),
k AS (SELECT did, sno, count(*) AS k, sum(ln(h / (len(a) - n + 1))) / 4 AS s FROM hit JOIN pair USING (did, sno) GROUP BY ALL),
e AS (SELECT did, sno, CASE WHEN k = 4 THEN least(1.0, exp(1 - len(b) / len(a))) * exp(s) ELSE 0 END AS bleu,
  CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / sqrt(len(list_distinct(a)) * len(list_distinct(b))) ELSE 0 END AS cosine FROM pair LEFT JOIN k USING (did, sno))
SELECT did, sno, round(bleu, 6) AS bleu, round(0.1 * cosine + 0.9 * bleu, 6) AS mix FROM e""")
def m9(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("did", "sno", _r(similarity.bleu_score(a, b), "bleu"), _r(similarity.mix(a, b), "mix"))


@register("m6_edit_distance", "WITH RECURSIVE " + PAIRS + """,
r AS (SELECT did, sno, a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(b) + 1), lambda j: j) AS row FROM pair
  UNION ALL SELECT did, sno, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: j - k + CASE WHEN k = 1 THEN i + 1 ELSE least(row[k] + 1, row[k - 1] + CASE WHEN b[k - 1] = a[i + 1] THEN 0 ELSE 1 END) END))) FROM r WHERE i < len(a))
SELECT did, sno, CAST(row[len(b) + 1] AS INTEGER) AS edits FROM r WHERE i = len(a)""")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("did", "sno", similarity.token_edit_distance(F.col("a"), F.col("b")).alias("edits"))


@register("m5_lcs", "WITH RECURSIVE " + PAIRS + """,
r AS (SELECT did, sno, a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(b)), lambda j: CAST(0 AS BIGINT)) AS row FROM pair
  UNION ALL SELECT did, sno, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]), lambda k: CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + 1)), 0))) FROM r WHERE i < len(a))
SELECT did, sno, CAST(coalesce(row[len(b)], 0) AS INTEGER) AS lcs, round(CASE WHEN len(a) + len(b) > 0 THEN coalesce(row[len(b)], 0) / (len(a) + len(b) - coalesce(row[len(b)], 0)) ELSE 0 END, 6) AS ratio FROM r WHERE i = len(a)""")
def m5(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("did", "sno", similarity.lcs(a, b).alias("lcs"), _r(similarity.lcs_ratio(a, b), "ratio"))


@register("m7_script_lcs")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("did", "sno", similarity.edit_script_lcs(F.col("a"), F.col("b")).alias("script"))


@register("m8_summary_lcs")
def m8(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d).groupBy("did").agg(F.array_sort(F.collect_list(F.struct("sno", text.split_words(F.col("text")).alias("w")))).alias("s")).select("did", F.transform("s", lambda x: x["w"]).alias("s"))
    pairs = s.select("did", F.col("s").alias("a")).join(s.select((F.col("did") - 20).alias("did"), F.col("s").alias("b")), "did")
    return pairs.select("did", similarity.summary_lcs(F.col("a"), F.col("b")).alias("lcs"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """(graph, id, w, n): the words of every sentence of a cluster; an id is the document's and the sentence's number."""
    return features.sentence_words(_sent(spark, d)).select(F.col("cluster").alias("graph"), (F.col("did") * 1_000_000 + F.col("sno")).alias("id"), "w", "n")


@register("m12_m13_similarity_edges", "WITH " + IDF + ", " + WEIGHT + """,
u AS (SELECT cluster, did * 1000000 + sno AS id, w, v / sqrt(n) AS v FROM v JOIN norm USING (did, sno) WHERE n > 0),
half AS (SELECT a.cluster AS graph, a.id AS src, b.id AS dst, sum(a.v * b.v) AS w FROM u a JOIN u b ON a.cluster = b.cluster AND a.w = b.w AND a.id < b.id GROUP BY ALL HAVING sum(a.v * b.v) > 0)
SELECT graph, src, dst, round(w, 6) AS w FROM half UNION ALL SELECT graph, dst, src, round(w, 6) FROM half""")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return graph.similarity_edges(_nodes(spark, d), _idf(spark, d)).select("graph", "src", "dst", _r("w"))


@register("m12_pairs_above", "WITH " + IDF + ", " + WEIGHT + """,
u AS (SELECT cluster, did * 1000000 + sno AS id, w, v / sqrt(n) AS v FROM v JOIN norm USING (did, sno) WHERE n > 0)
SELECT a.cluster AS graph, a.id AS a, b.id AS b, round(sum(a.v * b.v), 6) AS cosine FROM u a JOIN u b ON a.cluster = b.cluster AND a.w = b.w AND a.id < b.id GROUP BY ALL HAVING sum(a.v * b.v) >= 0.4321""")
def m12_above(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sentences above a cosine, from prefixes of rare words."""
    unit = graph.unit_vectors(_nodes(spark, d), _idf(spark, d))
    return redundancy.pairs_above(unit, 0.4321).select("graph", "a", "b", _r("cosine"))


_CONCEPTS = """l AS (SELECT DISTINCT p_name AS child, 'is ' || string_split(p_name, ' ')[1] AS parent FROM part UNION SELECT DISTINCT p_name, 'a ' || string_split(p_name, ' ')[-1] FROM part
  UNION SELECT DISTINCT 'is ' || string_split(p_name, ' ')[1], 'thing' FROM part UNION SELECT DISTINCT 'a ' || string_split(p_name, ' ')[-1], 'thing' FROM part),
c AS (SELECT p_name AS concept, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT DISTINCT x AS concept, x AS ancestor FROM (SELECT unnest([child, parent]) AS x FROM l) UNION SELECT r.concept, l.parent FROM r JOIN l ON l.child = r.ancestor),
own AS (SELECT concept, coalesce(n, 0) + 1.0::DOUBLE AS n FROM (SELECT DISTINCT concept FROM r) LEFT JOIN c USING (concept)),
ic AS (SELECT ancestor AS concept, -ln(sum(n) / (SELECT sum(n) FROM own)) AS ic FROM r JOIN own USING (concept) GROUP BY 1),
pair AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_name < y.p_name)"""


@register("m9_taxonomy_distance", "WITH RECURSIVE " + _CONCEPTS + """
SELECT a, b, round(any_value(ia.ic) + any_value(ib.ic) - 2 * max(u.ic), 6) AS distance FROM pair JOIN r x ON x.concept = a JOIN r y ON y.concept = b AND y.ancestor = x.ancestor JOIN ic u ON u.concept = x.ancestor JOIN ic ia ON ia.concept = a JOIN ic ib ON ib.concept = b GROUP BY a, b""")
def m9_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts lie under their first and under their last word, counted by lines of orders; pairs are names of one brand."""
    part = readers.table(spark, d, "part")
    words = F.split("p_name", " ")
    what, kind, name, top = F.concat(F.lit("is "), F.get(words, 0)), F.concat(F.lit("a "), F.element_at(words, -1)), F.col("p_name"), F.lit("thing")
    link = lambda child, parent: part.select(child.alias("child"), parent.alias("parent"))
    links = link(name, what).union(link(name, kind)).union(link(what, top)).union(link(kind, top))
    counts = readers.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    names = part.select("p_brand", "p_name").distinct()
    pairs = names.withColumnRenamed("p_name", "a").join(names.withColumnRenamed("p_name", "b"), "p_brand").where("a < b").select("a", "b").distinct()
    above = taxonomy.ancestors(links)
    return taxonomy.jiang_conrath(pairs, above, taxonomy.information_content(above, counts)).select("a", "b", _r("distance"))


@register("m14_generation_edges", "WITH " + TOK + """, t1 AS (SELECT cluster AS graph, did * 1000000 + sno AS id, w FROM tok),
tf AS (SELECT graph, id, w, count(*) AS tf FROM t1 GROUP BY ALL), n AS (SELECT graph, id, count(*) AS n FROM t1 GROUP BY ALL),
p AS (SELECT w, count(*) / (SELECT count(*) FROM t1) AS p FROM t1 GROUP BY w),
base AS (SELECT graph, id, sum(tf * ln(1000 * p)) AS base, sum(tf) AS ns FROM tf JOIN p USING (w) GROUP BY ALL),
gain AS (SELECT s.graph, s.id AS src, d.id AS dst, sum(s.tf * ln((d.tf + 1000 * p.p) / (1000 * p.p))) AS gain FROM tf s JOIN tf d ON s.graph = d.graph AND s.w = d.w AND s.id <> d.id JOIN p ON p.w = s.w GROUP BY ALL)
SELECT graph, src, dst, round(ln(exp((base + gain) / ns - ln(n.n + 1000))), 6) AS log_g FROM gain JOIN base USING (graph) JOIN n USING (graph) WHERE base.id = src AND n.id = dst""")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return graph.generation_edges(_nodes(spark, d)).select("graph", "src", "dst", _r(F.log("g"), "log_g"))


# -- boundaries and threads ----------------------------------------------------

_CORE = r"""lower(regexp_replace(token, '^["''(\[{]+|["'')\]},;:]+$', '', 'g'))"""


@register("t3_abbreviations", r"""WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS token FROM documents), c AS (SELECT """ + _CORE + r""" AS core FROM t),
w AS (SELECT regexp_matches(core, '[^.]\.$') AS dot, CASE WHEN regexp_matches(core, '[^.]\.$') THEN core[:-2] ELSE core END AS bare FROM c),
x AS (SELECT dot, CASE WHEN regexp_matches(bare, '^-?[\d.,]*\d$') THEN '##number##' ELSE bare END AS type FROM w),
n AS (SELECT type, count(*) FILTER (dot) AS k, count(*) FILTER (NOT dot) AS m FROM x WHERE regexp_matches(type, '\p{L}') GROUP BY type HAVING count(*) FILTER (dot) > 0),
s AS (SELECT count(*) FILTER (dot) / count(*) AS p FROM x),
y AS (SELECT type, k, m, -2 * ((k * ln(p) + m * ln(1 - p)) - (k * ln(0.99) + m * ln(0.01))) AS ratio, length(type) - length(replace(type, '.', '')) AS dots FROM n, s)
SELECT type, k AS with_dot, m AS without, round(ratio * exp(-greatest(length(type) - dots, 1)) * (dots + 1) * pow(greatest(length(type) - dots, 1), -m), 6) + 0.0::DOUBLE AS score FROM y""")
def t3_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """How every type that a full stop follows scores as an abbreviation."""
    words = boundaries.word_rows(_docs(spark, d).select(F.col("doc_id").alias("did"), "text"))
    return boundaries.abbreviation_scores(words).select("type", "with_dot", "without", (F.round("score", 6) + 0.0).alias("score"))  # no negative zero


@register("t3_learned_sentences")
def t3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut by boundaries that are learned from all documents of their language; those without one count as one more."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("did"), "lang", "text")
    return boundaries.split(docs, boundaries.learn(docs, by="lang"), by="lang")


_TURNS = "t AS (SELECT conv_id AS did, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations)"


def _forum(spark: SparkSession, d: str) -> DataFrame:
    """(did, xml): each conversation as a page on which every turn replies to the one before it."""
    order = select.Window.partitionBy("conv_id").orderBy("turn")
    turns = readers.table(spark, d, "conversations").withColumn("k", F.row_number().over(order))
    opened = F.concat(F.lit('<comment id="'), F.col("conv_id").cast("string"), F.lit("-"), F.col("k").cast("string"), F.lit('" bloggerId="'), F.coalesce("role", F.lit("")), F.lit('">'), text.sanitize(F.coalesce("text", F.lit(""))))
    pages = turns.select("conv_id", "k", opened.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    return pages.select(F.col("conv_id").alias("did"), F.concat(F.array_join(F.col("s.x"), "\n"), F.repeat(F.lit("</comment>"), F.size("s"))).alias("xml"))


@register("s23_nested_comments", "WITH " + _TURNS + r""" SELECT did, did || '-' || k AS id, CASE WHEN k > 1 THEN did || '-' || (k - 1) END AS parent, CAST(k - 1 AS INTEGER) AS depth, nullif(role, '') AS author,
trim(regexp_replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM t""")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return threads.nested_comments(_forum(spark, d)).drop("ord")


@register("v22_reply_ancestry", "WITH RECURSIVE " + _TURNS + """, c AS (SELECT did || '-' || k AS id, CASE WHEN k > 1 THEN did || '-' || (k - 1) END AS parent FROM t),
a AS (SELECT id, parent, 0 AS depth, id AS root FROM c WHERE parent IS NULL UNION ALL SELECT c.id, c.parent, depth + 1, root FROM a JOIN c ON c.parent = a.id) SELECT id, parent, depth, root FROM a""")
def v22(spark: SparkSession, d: str) -> DataFrame:
    return threads.ancestry(threads.nested_comments(_forum(spark, d)))


# -- features ------------------------------------------------------------------


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's query: the item that its smallest did points at."""
    items = readers.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return _sent(spark, d).groupBy("cluster").agg((F.min("did") % 40).alias("item_id")).join(items, "item_id").select("cluster", "query")


QUERY = r"query AS (SELECT cluster, b.text AS query, regexp_extract_all(b.text, '[^\s,.\-]+') AS q FROM (SELECT cluster, min(did) % 40 AS item_id FROM sent GROUP BY cluster) JOIN benchmark b USING (item_id))"


@register("f1_centroid", "WITH " + CENTROID + " SELECT did, sno, round(value, 6) AS value FROM centroid")
def f1(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return features.centroid(_sent(spark, d), similarity.idf_table(words), words).select("did", "sno", _r("value"))


@register("f2_f3_f5_f10_f12_combined", "WITH " + SENT + f""" SELECT did, sno, round(sqrt(1.0 / sno), 6) AS Position, CAST({LEN} AS DOUBLE) AS Length,
  CAST(CASE WHEN row_number() OVER (PARTITION BY did ORDER BY {LEN} DESC, sno) = 1 THEN 1 ELSE 0 END AS DOUBLE) AS IsLongest, round(sno / 10, 6) AS Skeleton FROM sent""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    out = features.combine(
        ("Position", s.select("did", "sno", features.position(F.col("sno")).alias("value"))), ("Length", s.select("did", "sno", features.length(F.col("text")).alias("value"))),
        ("IsLongest", features.is_longest(s)), ("Skeleton", features.skeleton(s).select("did", "sno", F.col("by_number").alias("value"))),
    )
    return out.select("did", "sno", _r("Position"), "Length", "IsLongest", _r("Skeleton"))


@register("f4_sim_with_first", "WITH " + IDF + ", " + WEIGHT + """,
dot AS (SELECT b.did, b.sno, sum(a.v * b.v) AS dot FROM v a JOIN v b ON a.did = b.did AND a.sno = 1 AND a.w = b.w GROUP BY ALL)
SELECT s.did, s.sno, round(CASE WHEN dot > 0 THEN dot / sqrt(na.n * nb.n) ELSE 0 END, 6) AS value FROM sent s LEFT JOIN dot USING (did, sno)
LEFT JOIN norm na ON na.did = s.did AND na.sno = 1 LEFT JOIN norm nb ON nb.did = s.did AND nb.sno = s.sno""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return features.similarity_with_first(_sent(spark, d), similarity.idf_table(words), words).select("did", "sno", _r("value"))


@register("f6_query_cosine_idf", "WITH " + IDF + ", " + QUERY + ", " + WEIGHT + """,
qv AS (SELECT cluster, w, count(*) * coalesce(any_value(idf), 0.1) AS v FROM (SELECT cluster, unnest(q) AS w FROM query) LEFT JOIN idf USING (w) GROUP BY ALL),
qn AS (SELECT cluster, sum(v * v) AS n FROM qv GROUP BY cluster),
dot AS (SELECT v.did, v.sno, sum(v.v * qv.v) AS dot FROM v JOIN qv USING (cluster, w) GROUP BY ALL)
SELECT s.did, s.sno, round(CASE WHEN dot > 0 THEN dot / sqrt(norm.n * qn.n) ELSE 0 END, 6) AS value FROM sent s LEFT JOIN dot USING (did, sno) LEFT JOIN norm USING (did, sno) LEFT JOIN qn USING (cluster)""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return features.query_cosine(_sent(spark, d), _queries(spark, d), _idf(spark, d)).select("did", "sno", _r("value"))


@register("f7_f8_query_overlap", "WITH " + SENT + ", " + QUERY + r""", x AS (SELECT did, sno, regexp_extract_all(text, '[^\s,.\-]+') AS w, coalesce(q, []) AS q FROM sent LEFT JOIN query USING (cluster))
SELECT did, sno, round(CASE WHEN len(w) > 0 AND len(q) > 0 THEN len(list_intersect(w, q)) / sqrt(len(list_distinct(w)) * len(list_distinct(q))) ELSE 0 END, 6) AS cosine,
  round(CASE WHEN len(w) + len(q) > 0 THEN len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))) ELSE 0 END, 6) AS overlap FROM x""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return features.query_features(_sent(spark, d), _queries(spark, d)).select("did", "sno", _r("cosine"), _r("overlap"))


@register("f9_phrase_match", "WITH " + SENT + """, p AS (SELECT * FROM (VALUES ('and the', 2.0), ('OF THE', 1.0), ('de la', 1.5), ('en', 0.25)) t(phrase, weight))
SELECT did, sno, round(coalesce(sum(weight) FILTER (contains(lower(text), lower(phrase))), 0), 6) AS value FROM sent, p GROUP BY did, sno""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    keywords = s.select("cluster").distinct().withColumn("keywords", F.lit("and the;2;OF THE;1;de la;1.5;en;0.25"))
    return features.phrase_match(s, features.parse_keywords(keywords)).select("did", "sno", _r("value"))


# -- classifiers and selection -------------------------------------------------


@register("c1_c2_classifiers", "WITH " + SCORED + " SELECT did, sno, round(score, 6) AS score, round(CASE WHEN n < 9 THEN 0 ELSE 1.0 / sno END, 6) AS lead FROM scored")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("did", "sno", _r("score"), _r(classify.lead(), "lead"))


@register("c3_random", "WITH " + SENT + " SELECT did, sno, ('0x' || substr(md5(did || ':' || sno || ':7'), 1, 8))::BIGINT / 4294967296.0 AS score FROM sent")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return _sent(spark, d).select("did", "sno", classify.random_score(7).alias("score"))


@register("r1_top_sentences", "WITH " + RANKED + " SELECT cluster, did, sno, rank FROM ranked WHERE rank <= ceil(size * 20 / 100)")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return select.top_sentences(_scored(spark, d)).select("cluster", "did", "sno", "rank")


@register("r2_by_words", "WITH " + RANKED + """, run AS (SELECT *, ceil(words * 20 / 100) AS target, sum(n) OVER (PARTITION BY cluster ORDER BY rank) AS after FROM ranked),
bad AS (SELECT cluster, min(rank) AS stop FROM run WHERE NOT (after <= target OR after - n = 0 OR abs(after - target) < abs(after - n - target)) GROUP BY cluster)
SELECT cluster, did, sno, rank FROM run LEFT JOIN bad USING (cluster) WHERE stop IS NULL OR rank < stop""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return select.by_words(_scored(spark, d)).select("cluster", "did", "sno", "rank")


_FOLD = RANKED + r""",
cand AS (SELECT cluster, did, sno, rank, n, list_distinct(regexp_extract_all(text, '[^\s,.\-]+')) AS w, {target} AS target FROM ranked),
fold AS (SELECT DISTINCT cluster, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS stop, CAST([] AS VARCHAR[][]) AS out, CAST(NULL AS BIGINT) AS did, CAST(NULL AS BIGINT) AS sno, CAST(0 AS BIGINT) AS place FROM cand
  UNION ALL SELECT cluster, rank, used + CASE WHEN take THEN n ELSE 0 END, stop OR NOT fits, CASE WHEN take THEN list_append(out, w) ELSE out END, CASE WHEN take THEN did END, CASE WHEN take THEN sno END, place + CASE WHEN take THEN 1 ELSE 0 END
  FROM (SELECT *, NOT stop AND fits AND NOT redundant AS take FROM (SELECT f.cluster, c.rank, f.used, f.stop, f.out, c.did, c.sno, c.n, c.w, f.place, {fits} AS fits,
    len(list_filter(f.out, lambda o: CASE WHEN len(o) > 0 AND len(c.w) > 0 THEN len(list_intersect(o, c.w)) / sqrt(len(o) * len(c.w)) ELSE 0 END >= {least})) > 0 AS redundant
    FROM fold f JOIN cand c ON c.cluster = f.cluster AND c.rank = f.rank + 1)))
SELECT cluster, did, sno, place AS rank FROM fold WHERE did IS NOT NULL"""


_CHOSEN, _LAST = _FOLD.format(target="ceil(size * 20 / 100)", fits="len(f.out) < c.target", least=0.7).rsplit("\nSELECT", 1)


@register("summary_redundancy", "WITH RECURSIVE " + _CHOSEN + f""", chosen AS (SELECT{_LAST}),
ext AS (SELECT c.cluster, s.text, row_number() OVER (PARTITION BY c.cluster ORDER BY CAST(c.did AS VARCHAR), c.sno) AS ord FROM chosen c JOIN sent s USING (did, sno))
SELECT cluster, string_agg('[' || ord || ']  ' || text, chr(10) ORDER BY ord) AS summary FROM ext GROUP BY cluster""")
def summary_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return Summarizer().summary(_sent(spark, d))


@register("r3_without_redundancy", "WITH RECURSIVE " + _FOLD.format(target="ceil(size * 20 / 100)", fits="len(f.out) < c.target", least=0.7))
def r3(spark: SparkSession, d: str) -> DataFrame:
    return select.without_redundancy(_scored(spark, d)).select("cluster", "did", "sno", "rank")


@register("r4_without_redundancy_words", "WITH RECURSIVE " + _FOLD.format(target="ceil(words * 20 / 100)", fits="(f.used + c.n <= c.target OR f.used = 0 OR abs(f.used + c.n - c.target) < abs(f.used - c.target))", least=0.7))
def r4(spark: SparkSession, d: str) -> DataFrame:
    return select.without_redundancy(_scored(spark, d), words=True).select("cluster", "did", "sno", "rank")


@register("r5_novelty", "WITH " + SCORED + """ SELECT did, sno, round(CASE WHEN round(coalesce(lag(score) OVER (PARTITION BY cluster ORDER BY did, sno), 0), 9) > round(avg(score) OVER (PARTITION BY cluster), 9)
  AND round(score, 9) > round(avg(score) OVER (PARTITION BY cluster), 9) THEN score * 1.2 ELSE score END, 6) AS score FROM scored""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return select.novelty(_scored(spark, d)).select("did", "sno", _r("score"))


@register("r6_mmr", "WITH " + SCORED + r""",
sc AS (SELECT cluster, did, sno, list_distinct(regexp_extract_all(text, '[^\s,.\-]+')) AS w, CASE WHEN max(score) OVER (PARTITION BY cluster) > 0 THEN score / max(score) OVER (PARTITION BY cluster) ELSE score END AS score FROM scored),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, did, sno) AS rank, 2 * ceil(count(*) OVER (PARTITION BY cluster) * 20 / 100) + 1 AS lim FROM sc),
sim AS (SELECT a.cluster, a.rank, max(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)) ELSE 0 END) AS sim FROM rk a JOIN rk b ON a.cluster = b.cluster AND b.rank < a.rank WHERE a.rank <= a.lim GROUP BY ALL)
SELECT did, sno, round(CASE WHEN rank <= lim THEN 0.7 * score - 0.3 * coalesce(sim, 0) ELSE score - 2 END, 6) AS score FROM rk LEFT JOIN sim USING (cluster, rank)""")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return select.mmr(_scored(spark, d)).select("did", "sno", _r("score"))


@register("r7_word_budget", "WITH " + RANKED + r""", c AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS k FROM ranked)
SELECT cluster, did, sno FROM (SELECT *, coalesce(sum(k) OVER (PARTITION BY cluster ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) WHERE before < 75""")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return select.word_budget(_scored(spark, d)).select("cluster", "did", "sno")


def _relations(s: DataFrame, judge: str = "a", step: int = 1) -> DataFrame:
    n = F.count(F.lit(1)).over(select.Window.partitionBy("did"))
    near = s.withColumn("n", n).where(F.col("sno") + step <= F.col("n")).where((F.col("did") + F.col("sno") * step) % 3 != 0)
    return near.select(F.col("did").alias("sdid"), F.col("sno").alias("ssent"), F.col("did").alias("tdid"), (F.col("sno") + step).alias("tsent"), F.concat(F.lit("t"), (F.col("sno") % (2 + step)).cast("string")).alias("type"), F.lit(judge).alias("judge"))


def _rel_sql(name: str, judge: str, step: int) -> str:
    return f"{name} AS (SELECT did AS sdid, sno AS ssent, did AS tdid, sno + {step} AS tsent, 't' || (sno % {2 + step}) AS type, '{judge}' AS judge FROM (SELECT *, count(*) OVER (PARTITION BY did) AS n FROM sent) WHERE sno + {step} <= n AND (did + sno * {step}) % 3 <> 0)"


@register("r8_r11_preferences", "WITH " + SCORED + ", " + _rel_sql("rel", "a", 1) + """,
src AS (SELECT doc_id AS did, source, doc_id AS ord FROM documents), place AS (SELECT source, dense_rank() OVER (ORDER BY min(ord)) AS value FROM src GROUP BY source),
deg AS (SELECT did, sno, count(*) AS value FROM (SELECT sdid AS did, ssent AS sno FROM rel UNION ALL SELECT tdid, tsent FROM rel) GROUP BY ALL),
x AS (SELECT s.*, place.value AS p, coalesce(deg.value, 0) AS g FROM scored s JOIN src USING (did) JOIN place USING (source) LEFT JOIN deg USING (did, sno)),
y AS (SELECT *, min(g) OVER (PARTITION BY cluster) AS lo, max(g) OVER (PARTITION BY cluster) AS hi FROM x)
SELECT did, sno, round(score + p, 6) AS plus_source, round(score - p, 6) AS minus_source, round(score + g, 6) AS plus_degree, round(score + CASE WHEN hi > lo THEN (g - lo) / (hi - lo) ELSE 0 END, 6) AS plus_degree_normalized FROM y""")
def r8(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d)
    place = select.source_order(_docs(spark, d).select(F.col("doc_id").alias("did"), "source", F.col("doc_id").alias("ord")))
    degree = select.relation_degree(_relations(_sent(spark, d)))
    wanted = [("plus_source", "place", 1, False), ("minus_source", "place", -1, False), ("plus_degree", "degree", 1, False), ("plus_degree_normalized", "degree", 1, True)]
    return select.preferences(c, {"place": place, "degree": degree}, wanted).select("did", "sno", *(_r(w[0]) for w in wanted))


@register("r9_r10_preferences", "WITH " + SCORED + """,
src AS (SELECT doc_id AS did, source, doc_id AS ord FROM documents), place AS (SELECT source, dense_rank() OVER (ORDER BY min(ord)) AS value FROM src GROUP BY source),
x AS (SELECT s.*, place.value AS p, 1000000 + did * 60 AS t FROM scored s JOIN src USING (did) JOIN place USING (source)),
y AS (SELECT *, min(p) OVER w AS lp, max(p) OVER w AS hp, min(t) OVER w AS lt, max(t) OVER w AS ht FROM x WINDOW w AS (PARTITION BY cluster)),
z AS (SELECT *, CASE WHEN hp > lp THEN (p - lp) / (hp - lp) ELSE 0 END AS np, CASE WHEN ht > lt THEN (t - lt) / (ht - lt) ELSE 0 END AS nt FROM y)
SELECT did, sno, round(score + np, 6) AS plus_source, round(score - np, 6) AS minus_source, round(score + t, 6) AS plus_epoch, round(score - t, 6) AS minus_epoch, round(score + nt, 6) AS plus_epoch_normalized, round(score - nt, 6) AS minus_epoch_normalized FROM z""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    """Source order normalized in the cluster, and time (a document's id in minutes), plain and normalized."""
    c = _scored(spark, d)
    docs = _docs(spark, d).select(F.col("doc_id").alias("did"), "source", F.col("doc_id").alias("ord"))
    place, epoch = select.source_order(docs), docs.select("did", (1_000_000 + F.col("did") * 60).alias("value"))
    wanted = [(word + name, values, sign, norm) for name, values, norm in (("source", "place", True), ("epoch", "time", False), ("epoch_normalized", "time", True)) for sign, word in ((1, "plus_"), (-1, "minus_"))]
    return select.preferences(c, {"place": place, "time": epoch}, wanted).select("did", "sno", *(_r(w[0]) for w in wanted))


@register("r12_chosen_bonus", "WITH " + RANKED + " SELECT cluster, did, sno, round(score + CASE WHEN rank <= 3 THEN 10000 ELSE 0 END, 6) AS score FROM ranked")
def r12(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d)
    return select.chosen_bonus(c, select.top_sentences(c, absolute=3)).select("cluster", "did", "sno", _r("score"))


def _judged(s: DataFrame, judges: int = 3) -> DataFrame:
    """Judge j gives (7 did + 13 sno + 5 j * j) mod 11."""
    return s.select("cluster", "did", "sno", F.explode(F.sequence(F.lit(1), F.lit(judges))).alias("j")).select("cluster", "did", "sno", F.concat(F.lit("j"), F.col("j").cast("string")).alias("judge"), ((F.col("did") * 7 + F.col("sno") * 13 + 5 * F.col("j") * F.col("j")) % 11).alias("util"))


JUDGED = SENT + ", judged AS (SELECT cluster, did, sno, 'j' || j AS judge, (did * 7 + sno * 13 + 5 * j * j) % 11 AS util FROM sent, (SELECT unnest([1, 2, 3]) AS j))"


@register("r13_judged_extract", "WITH " + JUDGED + " SELECT cluster, did, sno, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, did, sno) AS rank FROM (SELECT cluster, did, sno, sum(util) AS score FROM judged WHERE judge IN ('j1', 'j3') GROUP BY ALL)) WHERE rank <= 10")
def r13(spark: SparkSession, d: str) -> DataFrame:
    return select.judged_extract(_judged(_sent(spark, d)), 10, ["j1", "j3"]).select("cluster", "did", "sno", "rank")


_SWEEP = SENT + r""",
cand AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY did, sno) AS ord, length(text) AS chars, len(regexp_extract_all(text, '[^\s,.\-]+')) AS n, list_distinct(regexp_extract_all(text, '[^\s,.\-]+')) AS w, ((did + sno) % 10) / 100 AS sal FROM sent),
par AS (SELECT * FROM (VALUES (0.0, -0.5), (0.3, -0.2), (0.5, 0.0)) t(lam, mini)),
fold AS (SELECT DISTINCT cluster, lam, mini, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[][]) AS out, false AS take, CAST(0 AS BIGINT) AS chars FROM cand, par
  UNION ALL SELECT cluster, lam, mini, ord, used + CASE WHEN t THEN chars ELSE 0 END, CASE WHEN t THEN list_append(out, w) ELSE out END, t, chars FROM (
    SELECT f.cluster, f.lam, f.mini, c.ord, f.used, f.out, c.w, c.chars,
      round(lam * 10 * c.sal - (1 - lam) * coalesce(list_max(list_transform(f.out, lambda o: CASE WHEN len(o) > 0 AND len(c.w) > 0 THEN len(list_intersect(o, c.w)) / sqrt(len(o) * len(c.w)) ELSE 0 END)), 0), 9) >= mini AND c.n BETWEEN 10 AND 55 AND f.used + c.chars <= 665 AS t
    FROM fold f JOIN cand c ON c.cluster = f.cluster AND c.ord = f.ord + 1))
SELECT cluster, CAST(lam AS DOUBLE) AS lam, CAST(mini AS DOUBLE) AS mini, ord, chars FROM fold WHERE take"""


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    order = F.row_number().over(select.Window.partitionBy("cluster").orderBy("did", "sno"))
    return _sent(spark, d).select("cluster", order.alias("ord"), "text", (((F.col("did") + F.col("sno")) % 10) / 100).alias("sal"))


@register("r15_r16_threshold_filter", "WITH RECURSIVE " + _SWEEP)
def r15(spark: SparkSession, d: str) -> DataFrame:
    params = spark.createDataFrame([(0.0, -0.5), (0.3, -0.2), (0.5, 0.0)], "lam double, mini double")
    return select.threshold_filter(_decoded(spark, d), params)


@register("sweep_settings", "WITH RECURSIVE " + _SWEEP.replace("(0.0, -0.5), (0.3, -0.2), (0.5, 0.0)", ", ".join(f"({a}, {b})" for a in (0.0, 0.2, 0.4) for b in (-0.8, -0.4, 0.0))).replace("\nSELECT cluster, CAST(lam", ", k AS (SELECT cluster, CAST(lam").replace("FROM fold WHERE take", "FROM fold WHERE take) SELECT lam, mini, count(*) AS sentences, CAST(sum(chars) AS BIGINT) AS chars FROM k GROUP BY lam, mini"))
def sweep_settings(spark: SparkSession, d: str) -> DataFrame:
    kept = sweep(_decoded(spark, d), [0.0, 0.2, 0.4], [-0.8, -0.4, 0.0])
    return kept.groupBy("lam", "mini").agg(F.count(F.lit(1)).alias("sentences"), F.sum("chars").alias("chars"))


@register("r16_drop_repeats", "WITH RECURSIVE " + _FOLD.format(target="1000000000", fits="true", least=0.500000000001))
def r16(spark: SparkSession, d: str) -> DataFrame:
    return select.drop_repeats(_scored(spark, d)).select("cluster", "did", "sno", "rank")


@register("r18_permutation", "WITH " + SENT + " SELECT cluster, did, sno, row_number() OVER (PARTITION BY cluster ORDER BY ('0x' || substr(md5(did || ':' || sno || ':3'), 1, 8))::BIGINT, did, sno) AS rank FROM sent")
def r18(spark: SparkSession, d: str) -> DataFrame:
    return select.permutation(_sent(spark, d), 3).select("cluster", "did", "sno", "rank")


@register("r19_pointer_decode")
def r19(spark: SparkSession, d: str) -> DataFrame:
    word = F.transform(text.split_words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(500)).cast("int"))
    docs = _sent(spark, d).groupBy("cluster", F.col("did").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("sno", word.alias("w")))).alias("s"))
    node = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.xxhash64(F.col("doc"), i), F.lit(100)) / 100.0)
    return pointer.point(docs.select("cluster", "doc", F.transform("s", lambda x: x["w"]).alias("sentences"), node.alias("node")), pointer.Weights.random(500, 4, seed=5))


@register("n5_minibatches", "SELECT (rn - 1) // 32 AS batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return pointer.minibatches(_docs(spark, d).select("doc_id"), "doc_id", 32).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


# -- graphs --------------------------------------------------------------------

TRADE = """e AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), k AS (SELECT count(*) AS k FROM nation),
r0 AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 1.0::DOUBLE / k AS rank FROM nation, k)"""
_STEP = "r{1} AS (SELECT r.id, 0.15 / k + 0.85 * (coalesce((SELECT sum(p * rank) FROM p JOIN r{0} q ON q.id = p.src WHERE p.dst = r.id), 0) + coalesce((SELECT sum(rank) FROM r{0} q WHERE q.id NOT IN (SELECT src FROM p)), 0) / k) AS rank FROM r{0} r, k)"


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: readers.table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return edges, t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(1.0).alias("prior"))


@register("g2_pagerank", "WITH " + TRADE + ", " + ", ".join(_STEP.format(i, i + 1) for i in range(8)) + " SELECT id, round(rank, 6) AS rank FROM r8")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(*_trade(spark, d), tolerance=None, iterations=8).select("id", _r("rank"))


def _small_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words, preset = _nodes(spark, d), graph.PRESETS["text"]
    entries = graph.similarity_entries(words, _idf(spark, d))
    order = F.row_number().over(select.Window.partitionBy("graph").orderBy("id"))
    nodes = words.select("graph", "id").distinct().withColumn("prior", graph.position_prior(order, preset["beta"]))
    return entries, nodes


def _walks(name: str, walk, sql: str | None = None) -> None:
    register(name, sql)(lambda spark, d: products.walk_products(*_small_graphs(spark, d), walk).select("graph", "id", _r("rank")))


def _walk_sql(step: str, start: str, live: str, rank: str, p: str = "w / sum(w) OVER (PARTITION BY graph, src)", last: str = "walk") -> str:
    """A walk over the similarity edges of each cluster: ``step`` gives the ``new`` ranks, as long as ``live`` holds for the cluster."""
    return "WITH RECURSIVE " + IDF + ", " + WEIGHT + f""",
u AS (SELECT cluster AS graph, did * 1000000 + sno AS id, w, v / sqrt(n) AS v FROM v JOIN norm USING (did, sno) WHERE n > 0),
half AS MATERIALIZED (SELECT a.graph, a.id AS src, b.id AS dst, sum(a.v * b.v) AS w FROM u a JOIN u b ON a.graph = b.graph AND a.w = b.w AND a.id < b.id GROUP BY ALL HAVING sum(a.v * b.v) > 0),
e AS MATERIALIZED (SELECT graph, src, dst, {p} AS p FROM (FROM half UNION ALL SELECT graph, dst, src, w FROM half)),
nodes AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY id) ** -0.25 AS prior FROM (SELECT DISTINCT cluster AS graph, did * 1000000 + sno AS id FROM tok)),
first AS MATERIALIZED (SELECT graph, id, prior / sum(prior) OVER (PARTITION BY graph) AS r, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph) AS even, n IS NULL AS sink,
  row_number() OVER (PARTITION BY graph ORDER BY coalesce(n, 0) DESC, id) = 1 AS watched FROM nodes LEFT JOIN (SELECT graph, src AS id, count(*) AS n FROM e GROUP BY ALL) USING (graph, id)),
walk AS (SELECT 0 AS step, graph, id, r, even, sink, watched, {start}::DOUBLE AS rank, true AS live FROM first
  UNION ALL
  SELECT step + 1, graph, id, r, even, sink, watched, new, {live} FROM ({step})),
last AS (SELECT * FROM {last} QUALIFY step = max(step) OVER (PARTITION BY graph))
SELECT graph, id, round({rank}, 6) AS rank FROM last"""


def _linear_step(jump: float, prior: str) -> str:
    """A step along the edges, by ``prior`` from nodes without any and with probability ``jump``."""
    return f"""SELECT c.*, {jump} * c.{prior} + {1 - jump} * (coalesce(got, 0) + sum(CASE WHEN c.sink THEN c.rank ELSE 0 END) OVER (PARTITION BY c.graph) * c.{prior}) AS new FROM walk c LEFT JOIN
      (SELECT e.graph, e.dst, sum(p * rank) AS got FROM walk x JOIN e ON e.graph = x.graph AND e.src = x.id GROUP BY ALL) g ON g.graph = c.graph AND g.dst = c.id
    WHERE c.live"""


def _reinforced_step(jump: float, alpha: float) -> str:
    """A step to the nodes by their ranks; each node's way out is scaled to one."""
    share = f"""SELECT c.*, c.rank / ({alpha} * CASE WHEN c.sink THEN sum(c.r * c.rank) OVER (PARTITION BY c.graph) ELSE ahead END + {1 - alpha} * c.rank) AS q FROM walk c LEFT JOIN
      (SELECT e.graph, e.src, sum(p * rank) AS ahead FROM walk x JOIN e ON e.graph = x.graph AND e.dst = x.id GROUP BY ALL) o ON o.graph = c.graph AND o.src = c.id WHERE c.live"""
    return f"""SELECT * EXCLUDE (raw), raw / sum(raw) OVER (PARTITION BY graph) AS new FROM (
      SELECT c.*, {1 - jump} * c.rank * ({alpha} * (coalesce(got, 0) + sum(CASE WHEN c.sink THEN c.q ELSE 0 END) OVER (PARTITION BY c.graph) * c.r) + {1 - alpha} * c.q) + {jump} * c.r AS raw FROM ({share}) c LEFT JOIN
      (SELECT e.graph, e.dst, sum(p * q) AS got FROM ({share}) y JOIN e ON e.graph = y.graph AND e.src = y.id GROUP BY ALL) g ON g.graph = c.graph AND g.dst = c.id)"""


def _moved(least: float) -> str:
    return f"sum(abs(new - rank)) OVER (PARTITION BY graph) >= {least}"


_TEXT = graph.PRESETS["text"]
_LOW, _HIGH = "min(rank) OVER (PARTITION BY graph)", "max(rank) OVER (PARTITION BY graph)"
_walks("f11_g1_lexrank", graph.walk_lexrank, _walk_sql(_linear_step(0.15, "r"), "even", "max(abs(new - rank) / rank) OVER (PARTITION BY graph) >= 1e-6", f"CASE WHEN {_HIGH} > {_LOW} THEN (rank - {_LOW}) / ({_HIGH} - {_LOW}) ELSE 0 END"))
_walks("g2_g7_g8_personalized_pagerank", lambda w, r: graph.walk_pagerank(w, r, **_TEXT["pagerank"]), _walk_sql(_linear_step(0.1, "r"), "r", _moved(1e-5), "rank"))
_walks("g3_divrank", lambda w, r: graph.walk_divrank(w, r, **_TEXT["divrank"]), _walk_sql(_reinforced_step(0.1, 0.25), "even", _moved(1e-3), "rank"))
_walks("g4_divrank_cumulative", lambda w, r: graph.walk_divrank(w, r, tolerance=1e-5, cumulative=True, **_TEXT["divrank"]))
_walks("g5_grasshopper", graph.as_walk(lambda w, r: graph.order_grasshopper(w, r, **_TEXT["grasshopper"])))
_walks("g6_watched_pagerank", graph.walk_watched, _walk_sql(_linear_step(0.15, "even"), "even", "max(CASE WHEN watched THEN abs(new - rank) END) OVER (PARTITION BY graph) >= 1e-3", "rank", "1.0::DOUBLE / count(*) OVER (PARTITION BY graph, src)", "(FROM walk WHERE live)"))
_walks("r17_graph_mmr", graph.as_walk(lambda w, r: graph.order_mmr(w, graph.walk_pagerank(w, r), **_TEXT["mmr"])))


def _reinforced_sql(edges: str, teleport: float, alpha: float, steps: int, cumulative: bool) -> str:
    """Unrolled steps of a reinforced walk over ``edges``: ctes e (src, dst, w) and v (id), with an even prior."""
    out = edges + """, p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), k AS (SELECT count(*) AS k FROM v),
s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / k AS r, id NOT IN (SELECT src FROM p) AS sink, 1.0::DOUBLE / k AS rank, 1.0::DOUBLE / k AS visits FROM v, k)"""
    for i in range(steps):
        new = f"{1 - teleport} * (visits * ({alpha} * (coalesce(got, 0) + r * sinks) + {1 - alpha} * ratio)) + {teleport} * r"
        out += f""",
a{i} AS (SELECT src AS id, sum(p * visits) AS ahead FROM p JOIN s{i} ON id = dst GROUP BY src),
t{i} AS MATERIALIZED (SELECT s.id, r, sink, rank, visits, rank / ({alpha} * CASE WHEN sink THEN (SELECT sum(r * visits) FROM s{i}) ELSE coalesce(ahead, 0) END + {1 - alpha} * visits) AS ratio FROM s{i} s LEFT JOIN a{i} a ON a.id = s.id),
i{i} AS (SELECT dst AS id, sum(p * ratio) AS got FROM p JOIN t{i} ON id = src GROUP BY dst), z{i} AS (SELECT coalesce(sum(ratio) FILTER (sink), 0) AS sinks FROM t{i}),
s{i + 1} AS MATERIALIZED (SELECT t.id, r, sink, {new} AS rank, {"visits + " if cumulative else ""}{new} AS visits FROM t{i} t LEFT JOIN i{i} i ON i.id = t.id, z{i})"""
    return out + f" SELECT id, round(rank, 9) AS rank FROM s{steps}"


_CITED = """e AS (SELECT 2 * o_custkey AS src, 2 * l_partkey + 1 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT 2 * c_custkey AS id FROM customer UNION ALL SELECT 2 * p_partkey + 1 FROM part)"""
_TOGETHER = """x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL),
v AS (SELECT s_suppkey AS id FROM supplier)"""


def _even(ids: DataFrame) -> DataFrame:
    return ids.withColumn("prior", F.lit(1.0))


@register("g3_reinforced_citations", "WITH " + _reinforced_sql(_CITED, 0.15, 0.25, 3, False))
def g3_large(spark: SparkSession, d: str) -> DataFrame:
    """Customers cite the parts that they order; the preset of citation networks."""
    t = lambda n: readers.table(spark, d, n)
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = rows.groupBy((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    nodes = t("customer").select((2 * F.col("c_custkey")).alias("id")).union(t("part").select(2 * F.col("p_partkey") + 1))
    return walks.divrank(edges, _even(nodes), tolerance=None, iterations=3, **graph.PRESETS["citation"]["divrank"]).select("id", F.round("rank", 9).alias("rank"))


def _suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers of one order are linked, as actors of one film; an order has a handful of them."""
    x = readers.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = x.withColumnRenamed("l_suppkey", "src"), x.withColumnRenamed("l_suppkey", "dst")
    edges = a.join(b, "l_orderkey").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return edges, _even(readers.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@register("g4_reinforced_actors", "WITH " + _reinforced_sql(_TOGETHER, 0.1, 0.25, 3, True))
def g4_large(spark: SparkSession, d: str) -> DataFrame:
    """Visits add up over the steps; the preset of actor networks."""
    return walks.divrank(*_suppliers(spark, d), tolerance=None, iterations=3, cumulative=True, **graph.PRESETS["actors"]["divrank"]).select("id", F.round("rank", 9).alias("rank"))


@register("g5_absorbing_walk")
def g5_large(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers that an absorbing walk picks first."""
    return walks.grasshopper(*_suppliers(spark, d), trust=0.5, top=3, tolerance=1e-6)


@register("g9_merged_ngram_graph", "WITH " + NG + " SELECT item_id % 4 AS doc, a, b, round(sum(w) / any_value(k), 6) AS w FROM edge JOIN (SELECT item_id % 4 AS grp, count(*) AS k FROM benchmark GROUP BY 1) ON grp = item_id % 4 GROUP BY 1, a, b")
def g9(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark")
    edges = text.char_ngram_edges(b, "item_id", "text").withColumnRenamed("item_id", "doc")
    return ngram_graph.merge(edges, b.select(F.col("item_id").alias("doc"), (F.col("item_id") % 4).alias("grp"))).select("doc", "a", "b", _r("w"))


# -- clustering and streams ----------------------------------------------------


@register("st1_single_pass")
def st1(spark: SparkSession, d: str) -> DataFrame:
    articles = _docs(spark, d).select(F.concat_ws("/", "lang", "source").alias("stream"), F.col("doc_id").alias("did"), "text")
    return single_pass.cluster_batch(articles, _idf(spark, d))


@register("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    return single_pass.windowed_counts(readers.table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# -- ROUGE ---------------------------------------------------------------------

EVAL = "peers AS (SELECT doc_id % 20 AS eval, doc_id AS peer, {0} AS t FROM documents), models AS (SELECT item_id % 20 AS eval, item_id AS model, {1} AS t FROM benchmark)".format(_RT, _RT)


def _counted(grams: str) -> str:
    g = lambda side, who: f"(SELECT eval, {who}, unnest({grams}) AS g FROM {side})"
    return EVAL + f""",
pg AS (SELECT eval, peer, g, count(*) AS c FROM {g("peers", "peer")} GROUP BY ALL), mg AS (SELECT eval, model, g, count(*) AS c FROM {g("models", "model")} GROUP BY ALL),
hit AS (SELECT eval, peer, model, sum(least(pg.c, mg.c)) AS hits FROM pg JOIN mg USING (eval, g) GROUP BY ALL),
pair AS (SELECT eval, peer, model, coalesce(hits, 0) AS hits, np, nm FROM (SELECT eval, peer, len({grams}) AS np FROM peers) JOIN (SELECT eval, model, len({grams}) AS nm FROM models) USING (eval) LEFT JOIN hit USING (eval, peer, model))"""


_PRF = """, rp AS (SELECT *, CASE WHEN nm > 0 THEN hits / nm ELSE 0 END AS r, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS p FROM one)
SELECT eval, peer, CAST(hits AS BIGINT) AS hits, CAST(np AS BIGINT) AS n_peer, CAST(nm AS BIGINT) AS n_model, round(r, 6) AS r, round(p, 6) AS p, round(CASE WHEN r + p > 0 THEN r * p / (0.5 * p + 0.5 * r) ELSE 0 END, 6) AS f FROM rp"""
_POOL = ", one AS (SELECT eval, peer, sum(hits) AS hits, sum(np) AS np, sum(nm) AS nm FROM pair GROUP BY ALL)"
_BEST = ", one AS (SELECT eval, peer, hits, np, nm FROM (SELECT *, row_number() OVER (PARTITION BY eval, peer ORDER BY round(CASE WHEN nm > 0 THEN hits / nm ELSE 0 END, 9) DESC, model) AS k FROM pair) WHERE k = 1)"
_N2 = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
_S4 = "flatten(list_transform(range(1, len(t)), lambda i: list_transform(t[i + 1:i + 5], lambda u: t[i] || ' ' || u)))"


def _evals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    peers = _docs(spark, d).select((F.col("doc_id") % 20).alias("eval"), F.col("doc_id").alias("peer"), "text")
    models = readers.table(spark, d, "benchmark").select((F.col("item_id") % 20).alias("eval"), F.col("item_id").alias("model"), "text")
    return peers, models


def _rouge(metric: str, mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = rouge.over_models(rouge.pair_counts(*_evals(spark, d), metric), mode)
        return out.select("eval", "peer", "hits", "n_peer", "n_model", _r("r"), _r("p"), _r("f"))

    return run


_LIMIT = "list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:100], ' ')), '-', ' - '), '[^a-z0-9-]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: regexp_matches(t, '^[a-z0-9$]') AND t NOT IN ('the', 'of', 'and'))"


@register("e9_rouge_2_limits", ("WITH " + _counted(_N2) + _POOL + _PRF).replace(_RT, _LIMIT))
def e9(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 words of each text, without stop words."""
    out = rouge.over_models(rouge.pair_counts(*_evals(spark, d), "2", options=rouge.Options(words=100, stopwords=("the", "of", "and"))))
    return out.select("eval", "peer", "hits", "n_peer", "n_model", _r("r"), _r("p"), _r("f"))


@register("e9_rouge_1_stemmed")
def e9b(spark: SparkSession, d: str) -> DataFrame:
    out = rouge.over_models(rouge.pair_counts(*_evals(spark, d), "1", options=rouge.Options(stem=True)))
    return out.select("eval", "peer", "hits", "n_peer", "n_model", _r("r"), _r("p"), _r("f"))


register("e1_rouge_1", "WITH " + _counted("t") + _POOL + _PRF)(_rouge("1", "A"))
register("e1_e6_rouge_2_best", "WITH " + _counted(_N2) + _BEST + _PRF)(_rouge("2", "B"))
register("e4_rouge_s4", "WITH " + _counted(_S4) + _POOL + _PRF)(_rouge("S4", "A"))
register("e4_rouge_su4", "WITH " + _counted(f"list_concat({_S4}, t)") + _POOL + _PRF)(_rouge("SU4", "A"))


@register("e7_averages", "WITH " + _counted("t") + _POOL + """, rp AS (SELECT *, CASE WHEN nm > 0 THEN hits / nm ELSE 0 END AS r, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS p FROM one)
SELECT eval, round(avg(r), 6) AS mean_r, round(avg(p), 6) AS mean_p, round(sum(hits) / sum(nm), 6) AS pooled_r, round(sum(hits) / sum(np), 6) AS pooled_p, CAST(sum(hits) AS BIGINT) AS hits FROM rp GROUP BY eval""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    scores = rouge.score(*_evals(spark, d), ("1",))
    mean, pooled, raw = (rouge.average(scores, how, ("eval",)) for how in (0, 1, 2))
    out = mean.select("eval", _r("r", "mean_r"), _r("p", "mean_p")).join(pooled.select("eval", _r("r", "pooled_r"), _r("p", "pooled_p")), "eval")
    return out.join(raw.select("eval", "hits"), "eval")


@register("e5_basic_elements", "WITH " + EVAL + f""", pb AS (SELECT eval, peer, g, count(*) AS c FROM (SELECT eval, peer, unnest({_N2.replace("' '", "'|'")}) AS g FROM peers) GROUP BY ALL),
mb AS (SELECT eval, model, g, count(*) AS c FROM (SELECT eval, model, unnest({_N2.replace("' '", "'|'")}) AS g FROM models) GROUP BY ALL),
hit AS (SELECT eval, peer, model, sum(least(pb.c, mb.c)) AS hits FROM pb JOIN mb USING (eval, g) GROUP BY ALL),
one AS (SELECT eval, peer, sum(coalesce(hits, 0)) AS hits, sum(np) AS np, sum(nm) AS nm FROM (SELECT eval, peer, sum(c) AS np FROM pb GROUP BY ALL) JOIN (SELECT eval, model, sum(c) AS nm FROM mb GROUP BY ALL) USING (eval) LEFT JOIN hit USING (eval, peer, model) GROUP BY ALL)"""
    + _PRF)
def e5(spark: SparkSession, d: str) -> DataFrame:
    """Head and modifier: a token and the next one."""
    peers, models = _evals(spark, d)

    def elements(df: DataFrame, who: str) -> DataFrame:
        grams = df.select("eval", who, F.explode(text.ngrams(text.rouge_tokens(F.col("text")), 2)).alias("g"))
        rows = grams.select("eval", who, F.split("g", " ").alias("x"))
        return rows.select("eval", who, text.basic_element(F.get("x", 0), F.get("x", 1), F.lit(None).cast("string"), "HM").alias("be"))

    out = rouge.basic_elements(elements(peers, "peer"), elements(models, "model"))
    return out.select("eval", "peer", "hits", "n_peer", "n_model", _r("r"), _r("p"), _r("f"))


@register("e2_rouge_l")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return rouge.sequence_score(*_evals(spark, d))


@register("e3_rouge_w")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return rouge.sequence_score(*_evals(spark, d), weight=1.2)


_DRAWS = "(CASE WHEN u >= 0.36787944117 THEN 1 ELSE 0 END" + "".join(f" + CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in (0.73575888234, 0.9196986029, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975079)) + ")"


def _resampled(values: str, by: str) -> str:
    """Means and percentiles of 1000 resamples of ``values`` (by, eval, v)."""
    return f"""u AS (SELECT {by}, eval, v, s, ('0x' || substr(md5(eval || ':' || s || ':0'), 1, 8))::BIGINT / 4294967296.0 AS u FROM {values}, (SELECT unnest(range(1, 1001)) AS s)),
m AS (SELECT {by}, s, sum({_DRAWS} * v) / nullif(sum({_DRAWS}), 0) AS m FROM u GROUP BY ALL), ci AS (SELECT {by}, avg(m) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL)"""


@register("e8_bootstrap", "WITH " + _counted("t") + _POOL + ", x AS (SELECT 1 AS metric, eval, avg(CASE WHEN nm > 0 THEN hits / nm ELSE 0 END) AS v FROM one GROUP BY eval), " + _resampled("x", "metric") + " SELECT CAST(metric AS VARCHAR) AS metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def e8(spark: SparkSession, d: str) -> DataFrame:
    scores = rouge.score(*_evals(spark, d), ("1",)).groupBy("metric", "eval").agg(F.avg("r").alias("r"))
    return rouge.bootstrap(scores, by=("metric",)).select("metric", _r("mean"), _r("low"), _r("high"))


@register("k11_results_text", "WITH " + _counted("t") + _POOL + """, rp AS (SELECT eval, CASE WHEN nm > 0 THEN hits / nm ELSE 0 END AS r, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS p FROM one),
e AS (SELECT eval, avg(r) AS r, avg(p) AS p, avg(CASE WHEN r + p > 0 THEN r * p / (0.5 * p + 0.5 * r) ELSE 0 END) AS f FROM rp GROUP BY eval),
x AS (SELECT 1 AS kind, eval, r AS v FROM e UNION ALL SELECT 2, eval, p FROM e UNION ALL SELECT 3, eval, f FROM e), """ + _resampled("x", "kind") + """
SELECT 'all' AS peer, 'ROUGE-1' AS metric, repeat('-', 45) || chr(10) || string_agg('all ROUGE-1 Average_' || substr('RPF', kind, 1) || ': ' || format('{:.5f}', mean) || ' (95%-conf.int. ' || format('{:.5f}', low) || ' - ' || format('{:.5f}', high) || ')', chr(10) ORDER BY kind) AS value FROM ci""")
def k11(spark: SparkSession, d: str) -> DataFrame:
    scores = rouge.score(*_evals(spark, d), ("1",)).groupBy("metric", F.lit("all").alias("peer"), "eval").agg(*(F.avg(c).alias(c) for c in "rpf"))
    rows = [rouge.bootstrap(scores, value=c).select("peer", F.lit("ROUGE-1").alias("metric"), F.lit(c.upper()).alias("kind"), "mean", "low", "high") for c in "rpf"]
    return writers.results_text(rows[0].unionByName(rows[1]).unionByName(rows[2]))


# -- extracts, judges, rankings, relations -------------------------------------

TWO = RANKED + ", a AS (SELECT cluster, did, sno, n AS wcnt FROM ranked WHERE rank <= 5), b AS (SELECT cluster, did, sno, n AS wcnt FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sno, did) AS k FROM ranked) WHERE k <= 8)"


def _extracts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The five best sentences and the first eight of each cluster; scores are made once, and only chosen sentences are written."""
    c = _scored(spark, d).select("cluster", "did", "sno", "score", features.length(F.col("text")).alias("wcnt"))
    places = {"rank": F.row_number().over(select.ordered()), "k": F.row_number().over(select.Window.partitionBy("cluster").orderBy("sno", "did"))}
    chosen = graph.checkpointed(c.withColumns(places).where("rank <= 5 or k <= 8"))
    keep = ["cluster", "did", "sno", "wcnt"]
    return chosen.where("rank <= 5").select(*keep), chosen.where("k <= 8").select(*keep)


@register("v1_v2_precision_recall", "WITH " + TWO + """, c AS (SELECT a.* FROM a JOIN b USING (cluster, did, sno)),
x AS (SELECT cluster, count(*) AS n, sum(wcnt) AS w FROM a GROUP BY cluster), y AS (SELECT cluster, count(*) AS n, sum(wcnt) AS w FROM b GROUP BY cluster), z AS (SELECT cluster, count(*) AS n, sum(wcnt) AS w FROM c GROUP BY cluster)
SELECT cluster, round(coalesce(z.n, 0) / x.n, 6) AS precision, round(coalesce(z.n, 0) / y.n, 6) AS recall, round(CASE WHEN x.w > 0 THEN coalesce(z.w, 0) / x.w ELSE 0 END, 6) AS precisionw, round(CASE WHEN y.w > 0 THEN coalesce(z.w, 0) / y.w ELSE 0 END, 6) AS recallw
FROM x JOIN y USING (cluster) LEFT JOIN z USING (cluster)""")
def v1(spark: SparkSession, d: str) -> DataFrame:
    a, b = _extracts(spark, d)
    plain, words = evaluation.extract_scores(a, b), evaluation.extract_scores(a, b, "wcnt")
    return plain.select("cluster", _r("precision"), _r("recall")).join(words.select("cluster", _r("precision", "precisionw"), _r("recall", "recallw")), "cluster")


@register("v3_v4_kappa", """WITH item AS (SELECT DISTINCT doc_id AS item FROM labels), pick AS (SELECT doc_id AS item, 'q' AS judge FROM labels WHERE quality = 1 UNION SELECT doc_id, 't' FROM labels WHERE toxic = 1),
t AS (SELECT item, j.judge, CASE WHEN pick.item IS NULL THEN 0 ELSE 1 END AS c FROM item CROSS JOIN (VALUES ('q'), ('t')) j(judge) LEFT JOIN pick USING (item, judge)),
i AS (SELECT item, sum(n * (n - 1)) AS agree FROM (SELECT item, c, count(*) AS n FROM t GROUP BY ALL) GROUP BY item), pa AS (SELECT avg(agree / 2) AS pa FROM i),
pe AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM (SELECT c, count(*) AS n FROM t GROUP BY c))
SELECT round(pa, 6) AS pa, round(pe, 6) AS pe, round((pa - pe) / (1 - pe), 6) AS kappa FROM pa, pe""")
def v3(spark: SparkSession, d: str) -> DataFrame:
    labels = readers.table(spark, d, "labels")
    chosen = labels.where("quality = 1").select(F.col("doc_id").alias("item"), F.lit("q").alias("judge")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("item"), F.lit("t").alias("judge")))
    judges = spark.createDataFrame([("q",), ("t",)], "judge string")
    return evaluation.kappa(evaluation.judge_table(labels.select(F.col("doc_id").alias("item")), judges, chosen)).select(_r("pa"), _r("pe"), _r("kappa"))


UTILITY = JUDGED + """,
ext AS (SELECT cluster, did, sno FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY did, sno) AS k FROM sent) WHERE k <= 4), size AS (SELECT cluster, count(*) AS size FROM ext GROUP BY cluster),
jr AS (SELECT *, row_number() OVER (PARTITION BY cluster, judge ORDER BY util DESC, did, sno) AS k FROM judged), top AS (SELECT jr.* FROM jr JOIN size USING (cluster) WHERE k <= size),
best AS (SELECT cluster, judge, sum(util) AS best FROM top GROUP BY ALL), got AS (SELECT cluster, judge, sum(util) AS got FROM judged JOIN ext USING (cluster, did, sno) GROUP BY ALL),
ru AS (SELECT cluster, avg(CASE WHEN best > 0 THEN coalesce(got, 0) / best ELSE 0 END) AS utility FROM best LEFT JOIN got USING (cluster, judge) GROUP BY cluster),
rnd AS (SELECT cluster, avg(CASE WHEN best > 0 THEN mean * size / best ELSE 0 END) AS random FROM (SELECT cluster, judge, avg(util) AS mean FROM judged GROUP BY ALL) JOIN size USING (cluster) JOIN best USING (cluster, judge) GROUP BY cluster),
ij AS (SELECT cluster, t.judge, j.judge AS other, sum(j.util) AS got FROM top t JOIN judged j USING (cluster, did, sno) WHERE t.judge <> j.judge GROUP BY ALL),
iju AS (SELECT ij.cluster, ij.judge, other, CASE WHEN best > 0 THEN got / best ELSE 0 END AS utility FROM ij JOIN best b ON b.cluster = ij.cluster AND b.judge = other),
agree AS (SELECT cluster, avg(utility) AS judges FROM iju GROUP BY cluster)"""


def _first4(s: DataFrame) -> DataFrame:
    return s.withColumn("k", F.row_number().over(select.Window.partitionBy("cluster").orderBy("did", "sno"))).where("k <= 4").select("cluster", "did", "sno")


@register("v5_v6_relative_utility", "WITH " + UTILITY + """ SELECT cluster, round(utility, 6) AS utility, round(random, 6) AS random, round(judges, 6) AS judges,
round(CASE WHEN round(judges, 9) > round(random, 9) THEN (utility - random) / (judges - random) END, 6) AS normalized FROM ru JOIN rnd USING (cluster) JOIN agree USING (cluster)""")
def v5(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    return evaluation.normalized_utility(_first4(s), _judged(s)).select("cluster", _r("utility"), _r("random"), _r("judges"), _r("normalized"))


@register("v7_judge_utility", "WITH " + UTILITY + " SELECT cluster, judge, other, round(utility, 6) AS utility FROM iju")
def v7(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    sizes = _first4(s).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return evaluation.judge_utility(_judged(s), sizes).select("cluster", "judge", "other", _r("utility"))


@register("v8_model_units", "WITH " + IDF + r""", unit AS (SELECT w, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[^\s,.\-]+')) AS w FROM benchmark) GROUP BY w),
x AS (SELECT DISTINCT did, sno, w FROM tok), y AS (SELECT did, sno, sum(CASE WHEN freq > 0 THEN coalesce(idf, 5) * ln(freq) ELSE 0 END) AS same, sum(CASE WHEN freq IS NULL THEN coalesce(idf, 5) ELSE 0 END) AS other FROM x LEFT JOIN unit USING (w) LEFT JOIN idf USING (w) GROUP BY ALL)
SELECT did || '#' || sno AS item, round(CASE WHEN same + other > 0 THEN 10 * same / (same + other) ELSE 0 END, 6) AS util FROM y""")
def v8(spark: SparkSession, d: str) -> DataFrame:
    units = readers.table(spark, d, "benchmark").select(F.explode(text.split_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("freq"))
    words = features.tokens(_sent(spark, d)).select(F.concat_ws("#", "did", "sno").alias("item"), "w")
    return evaluation.model_unit_utility(units, words, _idf(spark, d)).select("item", _r("util"))


LISTS = "a AS (SELECT doc_id AS did, n_chars AS score FROM documents), b AS (SELECT doc_id AS did, 2 * quality - toxic AS score FROM labels)"


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by length, and the labelled ones among them by their labels."""
    docs, labels = _docs(spark, d), readers.table(spark, d, "labels")
    return docs.select(F.col("doc_id").alias("did"), F.col("n_chars").alias("score")), labels.select(F.col("doc_id").alias("did"), (2 * F.col("quality") - F.col("toxic")).alias("score"))


@register("v9_pearson", "WITH " + LISTS + ", j AS (SELECT CAST(coalesce(a.score, 0) AS DOUBLE) AS x, CAST(coalesce(b.score, 0) AS DOUBLE) AS y FROM a FULL JOIN b USING (did)) SELECT count(*) AS items, round(corr(x, y), 6) AS pearson FROM j")
def v9(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.withColumn("score", F.col("score").cast("double")) for x in _lists(spark, d))
    return evaluation.pearson(a, b).select("items", _r("pearson"))


@register("v10_spearman", "WITH " + LISTS + """, ra AS (SELECT did, avg(k) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS k FROM a)), rb AS (SELECT did, avg(k) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS k FROM b)),
j AS (SELECT coalesce(ra.r, (SELECT count(*) + 1 FROM a)) AS x, coalesce(rb.r, (SELECT count(*) + 1 FROM b)) AS y FROM ra FULL JOIN rb USING (did)) SELECT count(*) AS items, round(corr(x, y), 6) AS spearman FROM j""")
def v10(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spearman(*_lists(spark, d)).select("items", _r("spearman"))


TWO_JUDGES = SENT + ", " + _rel_sql("ra", "a", 1) + ", " + _rel_sql("rb0", "b", 2) + ", rb AS (SELECT sdid, ssent, tdid, tsent - 1 AS tsent, type, judge FROM rb0)"


def _two_judges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _sent(spark, d)
    return _relations(s), _relations(s, "b", 2).withColumn("tsent", F.col("tsent") - 1)


@register("v11_agreement", "WITH " + TWO_JUDGES + """, j AS (SELECT ra.type AS x, rb.type AS y FROM ra FULL JOIN rb USING (sdid, ssent, tdid, tsent))
SELECT count(*) AS pairs, count(*) FILTER (x = y) AS "full", CAST(0 AS BIGINT) AS partial, count(*) FILTER (x IS NULL OR y IS NULL) AS single FROM j""")
def v11(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.relation_agreement(*_two_judges(spark, d))


@register("v12_v13_v14_relation_tools", "WITH " + TWO_JUDGES + """, back AS (SELECT tdid AS sdid, tsent AS ssent, sdid AS tdid, ssent AS tsent, type, judge FROM rb),
m AS (SELECT * FROM ra UNION SELECT * FROM rb), strong AS (SELECT sdid, ssent, tdid, tsent FROM m GROUP BY ALL HAVING count(DISTINCT judge) >= 2)
SELECT (SELECT count(*) FROM (SELECT DISTINCT sdid, ssent, tdid, tsent FROM ra) JOIN (SELECT DISTINCT tdid AS sdid, tsent AS ssent, sdid AS tdid, ssent AS tsent FROM back) USING (sdid, ssent, tdid, tsent)) AS conflicts,
  (SELECT count(*) FROM m) AS merged, (SELECT count(*) FROM m JOIN strong USING (sdid, ssent, tdid, tsent)) AS strong""")
def v12(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_judges(spark, d)
    back = b.select(F.col("tdid").alias("sdid"), F.col("tsent").alias("ssent"), F.col("sdid").alias("tdid"), F.col("ssent").alias("tsent"), "type", "judge")
    merged = evaluation.merge_relations(a, b)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(evaluation.reversed_pairs(a, back), "conflicts").join(count(merged, "merged")).join(count(evaluation.filter_relations(merged, least=2), "strong"))


@register("v15_connectivity", "WITH " + RANKED + ", " + _rel_sql("rel", "a", 1) + """, ext AS (SELECT cluster, did, sno FROM ranked WHERE rank <= ceil(size * 50 / 100)),
c AS (SELECT x.cluster, count(DISTINCT (x.did, x.sno, y.sno)) AS connected FROM rel JOIN ext x ON x.did = sdid AND x.sno = ssent JOIN ext y ON y.did = tdid AND y.sno = tsent AND y.cluster = x.cluster GROUP BY 1), n AS (SELECT cluster, count(*) AS sentences FROM ext GROUP BY cluster)
SELECT cluster, sentences, sentences * (sentences - 1) // 2 AS pairs, coalesce(connected, 0) AS connected FROM n LEFT JOIN c USING (cluster)""")
def v15(spark: SparkSession, d: str) -> DataFrame:
    s = _sent(spark, d)
    return evaluation.connectivity(select.top_sentences(_scored(spark, d), percent=50).select("cluster", "did", "sno"), _relations(s))


@register("v16_similarity_as_relation", "WITH " + PAIRS + ", " + _rel_sql("rel", "a", 1) + """, v AS (SELECT did || '#' || sno AS x, did || '#' || (sno + 1) AS y, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / sqrt(len(list_distinct(a)) * len(list_distinct(b))) ELSE 0 END AS value FROM pair),
r AS (SELECT DISTINCT sdid || '#' || ssent AS x, tdid || '#' || tsent AS y, 1 AS rel FROM rel), m AS (SELECT coalesce(round(value, 9) >= 0.2, false) AS s, rel IS NOT NULL AS t FROM v FULL JOIN r USING (x, y)),
c AS (SELECT count(*) FILTER (s) AS "similar", count(*) FILTER (t) AS related, count(*) FILTER (s AND t) AS "both" FROM m)
SELECT "similar", related, "both", round("both" / "similar", 6) AS precision, round("both" / related, 6) AS recall FROM c""")
def v16(spark: SparkSession, d: str) -> DataFrame:
    values = _pairs(spark, d).select(F.concat_ws("#", "did", "sno").alias("x"), F.concat_ws("#", F.col("did"), F.col("sno") + 1).alias("y"), similarity.binary_cosine(F.col("a"), F.col("b")).alias("value"))
    related = _relations(_sent(spark, d)).select(F.concat_ws("#", "sdid", "ssent").alias("x"), F.concat_ws("#", "tdid", "tsent").alias("y"))
    return evaluation.similarity_as_relation(values, related, 0.2).select("similar", "related", "both", _r("precision"), _r("recall"))


@register("v17_npower", "WITH " + NG.replace("benchmark", "txt").replace("ng AS", "txt AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents), ng AS", 1) + """,
size AS (SELECT item_id, count(*) AS n FROM edge GROUP BY 1), link AS (SELECT -1 - doc_id AS peer, item_id AS model FROM documents JOIN benchmark ON item_id % 20 = doc_id % 20),
s1 AS (SELECT peer, model, sum(least(x.w, y.w) / greatest(x.w, y.w)) AS v FROM link JOIN edge x ON x.item_id = peer JOIN edge y ON y.item_id = model AND y.a = x.a AND y.b = x.b GROUP BY ALL),
auto AS (SELECT peer, avg(CASE WHEN greatest(coalesce(p.n, 0), coalesce(m.n, 0)) > 0 THEN coalesce(v, 0) / greatest(coalesce(p.n, 0), coalesce(m.n, 0)) ELSE 0 END) AS autosummeng FROM link LEFT JOIN s1 USING (peer, model) LEFT JOIN size p ON p.item_id = peer LEFT JOIN size m ON m.item_id = model GROUP BY peer),
k AS (SELECT peer, count(*) AS k FROM link GROUP BY peer), mg AS (SELECT peer, a, b, sum(w) / any_value(k) AS w FROM link JOIN edge ON item_id = model JOIN k USING (peer) GROUP BY peer, a, b), mn AS (SELECT peer, count(*) AS n FROM mg GROUP BY peer),
s2 AS (SELECT mg.peer, sum(least(mg.w, x.w) / greatest(mg.w, x.w)) AS v FROM mg JOIN edge x ON x.item_id = mg.peer AND x.a = mg.a AND x.b = mg.b GROUP BY 1),
memo AS (SELECT peer, CASE WHEN greatest(coalesce(p.n, 0), coalesce(mn.n, 0)) > 0 THEN coalesce(v, 0) / greatest(coalesce(p.n, 0), coalesce(mn.n, 0)) ELSE 0 END AS memog FROM k LEFT JOIN s2 USING (peer) LEFT JOIN size p ON p.item_id = peer LEFT JOIN mn USING (peer))
SELECT peer, round(autosummeng, 6) AS autosummeng, round(memog, 6) AS memog, round((5.2905 * autosummeng + 3.0053 * memog + 0.5866) / 10, 6) AS npower FROM auto JOIN memo USING (peer)""")
def v17(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")
    p = _docs(spark, d).select((-1 - F.col("doc_id")).alias("doc"), "text")
    links = p.select(F.col("doc").alias("peer"), ((-1 - F.col("doc")) % 20).alias("k")).join(b.select(F.col("doc").alias("model"), (F.col("doc") % 20).alias("k")), "k").select("peer", "model")
    return ngram_graph.text_scores(p, b, links).select("peer", _r("autosummeng"), _r("memog"), _r("npower"))


@register("v18_class_distances", "WITH " + NG + """,
cls AS (SELECT item_id, 'c' || (item_id % 3) AS grp FROM benchmark WHERE item_id % 2 = 0), k AS (SELECT grp, count(*) AS k FROM cls GROUP BY grp),
mg AS (SELECT grp, a, b, sum(w) / any_value(k) AS w FROM edge JOIN cls USING (item_id) JOIN k USING (grp) GROUP BY grp, a, b), mn AS (SELECT grp, count(*) AS n FROM mg GROUP BY grp),
tn AS (SELECT b.item_id, count(edge.a) AS n FROM benchmark b LEFT JOIN edge USING (item_id) WHERE b.item_id % 2 = 1 GROUP BY 1),
v AS (SELECT item_id, grp, sum(least(x.w, mg.w) / greatest(x.w, mg.w)) AS v FROM edge x JOIN mg USING (a, b) WHERE item_id % 2 = 1 GROUP BY ALL)
SELECT tn.item_id AS doc, g.grp, round(CASE WHEN greatest(tn.n, coalesce(mn.n, 0)) > 0 THEN coalesce(v, 0) / greatest(tn.n, coalesce(mn.n, 0)) ELSE 0 END, 6) AS value
FROM tn CROSS JOIN (SELECT DISTINCT grp FROM cls) g LEFT JOIN mn ON mn.grp = g.grp LEFT JOIN v ON v.item_id = tn.item_id AND v.grp = g.grp""")
def v18(spark: SparkSession, d: str) -> DataFrame:
    b = readers.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")
    halves = b.select("doc", (F.col("doc") % 2).alias("half"), F.concat(F.lit("c"), (F.col("doc") % 3).cast("string")).alias("grp"))
    return ngram_graph.class_distances(text.char_ngram_edges(b, "doc", "text"), halves.where("half = 0").select("doc", "grp"), halves.where("half = 1").select("doc")).select("doc", "grp", _r("value"))


@register("v19_decoder_scores", "WITH " + SENT + """, x AS (SELECT cluster, list(did + sno) FILTER (sno % 2 = 0) AS answer, list(did + sno) FILTER (sno % 3 = 0) AS pred FROM sent GROUP BY cluster),
y AS (SELECT cluster, list_filter(list_distinct(coalesce(answer, [])), lambda v: v <> 0) AS a, list_filter(list_distinct(coalesce(pred, [])), lambda v: v <> 0) AS p FROM x)
SELECT cluster, round(len(list_intersect(a, p)) / greatest(len(p), 1), 6) AS precision, round(len(list_intersect(a, p)) / greatest(len(a), 1), 6) AS recall FROM y""")
def v19(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("did") + F.col("sno")
    rows = _sent(spark, d).groupBy("cluster").agg(F.collect_list(F.when(F.col("sno") % 2 == 0, place)).alias("answer"), F.collect_list(F.when(F.col("sno") % 3 == 0, place)).alias("pred"))
    return evaluation.decoder_scores(rows).select("cluster", _r("precision"), _r("recall"))
