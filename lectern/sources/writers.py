"""Writers and the texts they write. All rows of a file's group are joined natively; Spark's writers put them down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize


def _lines(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n")


def _attributes(**columns: Column) -> Column:
    parts = [F.concat(F.lit(f' {name}="'), sanitize(c.cast("string")), F.lit('"')) for name, c in columns.items()]
    return F.concat(*parts)


def sentfeature_xml(features: DataFrame) -> DataFrame:
    """(did, xml): a sentfeature file for each document from (did, sno, name, value)."""
    one = features.groupBy("did", "sno").agg(_lines(F.struct("name", F.concat(F.lit("    <FEATURE"), _attributes(N=F.col("name"), V=F.col("value")), F.lit("/>")).alias("line"))).alias("body"))
    block = F.concat(F.lit("  <S"), _attributes(DID=F.col("did"), SNO=F.col("sno")), F.lit(">\n"), F.col("body"), F.lit("\n  </S>"))
    joined = one.select("did", "sno", block.alias("line")).groupBy("did").agg(_lines(F.struct("sno", "line")).alias("body"))
    return joined.select("did", F.concat(F.lit("<SENT-FEATURE>\n"), "body", F.lit("\n</SENT-FEATURE>")).alias("xml"))


def sentjudge_xml(judgements: DataFrame) -> DataFrame:
    """(did, xml) from (did, sno, judge, util)."""
    one = judgements.groupBy("did", "sno").agg(_lines(F.struct("judge", F.concat(F.lit("    <JUDGE"), _attributes(N=F.col("judge"), UTIL=F.col("util")), F.lit("/>")).alias("line"))).alias("body"))
    block = F.concat(F.lit("  <S"), _attributes(DID=F.col("did"), SNO=F.col("sno"), PAR=F.lit(1), RSNT=F.col("sno")), F.lit(">\n"), F.col("body"), F.lit("\n  </S>"))
    joined = one.select("did", "sno", block.alias("line")).groupBy("did").agg(_lines(F.struct("sno", "line")).alias("body"))
    return joined.select("did", F.concat(F.lit("<SENT-JUDGE>\n"), "body", F.lit("\n</SENT-JUDGE>")).alias("xml"))


def extract_xml(extract: DataFrame) -> DataFrame:
    """(cluster, xml): an extract file for each cluster from (cluster, ord, did, sno)."""
    line = F.concat(F.lit("  <S"), _attributes(ORDER=F.col("ord"), DID=F.col("did"), SNO=F.col("sno")), F.lit("/>"))
    joined = extract.groupBy("cluster").agg(_lines(F.struct("ord", line.alias("line"))).alias("body"))
    return joined.select("cluster", F.concat(F.lit("<EXTRACT>\n"), "body", F.lit("\n</EXTRACT>")).alias("xml"))


def cluster_xml(docs: DataFrame) -> DataFrame:
    """(cluster, xml) from (cluster, did, ord)."""
    line = F.concat(F.lit("  <D"), _attributes(DID=F.col("did"), ORDER=F.col("ord")), F.lit("/>"))
    joined = docs.groupBy("cluster").agg(_lines(F.struct("ord", line.alias("line"))).alias("body"))
    return joined.select("cluster", F.concat(F.lit("<CLUSTER>\n"), "body", F.lit("\n</CLUSTER>")).alias("xml"))


def docsent_xml(sentences: DataFrame) -> DataFrame:
    """(did, xml) from (did, sno, text)."""
    line = F.concat(F.lit("  <S"), _attributes(PAR=F.lit(1), RSNT=F.col("sno"), SNO=F.col("sno")), F.lit(">"), sanitize(F.col("text")), F.lit("</S>"))
    joined = sentences.groupBy("did").agg(_lines(F.struct("sno", line.alias("line"))).alias("body"))
    return joined.select("did", F.concat(F.lit('<DOCSENT DID="'), F.col("did").cast("string"), F.lit('">\n<TEXT>\n'), F.col("body"), F.lit("\n</TEXT>\n</DOCSENT>")).alias("xml"))


def see_html(summaries: DataFrame) -> DataFrame:
    """(name, html): a page with an anchor for each sentence from (name, ord, text)."""
    ord_ = F.col("ord")
    anchor = F.concat(F.lit("<a"), _attributes(name=ord_), F.lit(">["), ord_.cast("string"), F.lit("]</a>"))
    link = F.concat(F.lit("<a"), _attributes(href=F.concat(F.lit("#"), ord_.cast("string")), id=ord_), F.lit(">"), sanitize(F.col("text")), F.lit("</a>"))
    joined = summaries.groupBy("name").agg(_lines(F.struct("ord", F.concat_ws(" ", anchor, link).alias("line"))).alias("body"))
    return joined.select("name", F.concat(F.lit("<html>\n<head><title>"), "name", F.lit("</title></head>\n<body>\n"), "body", F.lit("\n</body>\n</html>")).alias("html"))


def rouge_settings(peers: DataFrame, models: DataFrame, style: str = "SEE", peer_root: str = ".", model_root: str = ".") -> DataFrame:
    """(eval, xml): EVAL elements from (eval, name, file) of peers and models, files by their folders."""
    entry = lambda df, tag: df.groupBy("eval").agg(_lines(F.struct("name", F.concat(F.lit(f'<{tag} ID="'), "name", F.lit('">'), "file", F.lit(f"</{tag}>")).alias("line"))).alias(tag))
    both = entry(peers, "P").join(entry(models, "M"), "eval")
    return both.select("eval", F.concat(F.lit('<EVAL ID="'), F.col("eval").cast("string"), F.lit(f'">\n<PEER-ROOT>{peer_root}</PEER-ROOT>\n<MODEL-ROOT>{model_root}</MODEL-ROOT>\n<INPUT-FORMAT TYPE="{style}"/>\n<PEERS>\n'), "P", F.lit("\n</PEERS>\n<MODELS>\n"), "M", F.lit("\n</MODELS>\n</EVAL>")).alias("xml"))


def jackknifed(peers: DataFrame, models: DataFrame) -> DataFrame:
    """(eval, peer, model): each peer with the models of its evaluation but its own."""
    return peers.select("eval", F.col("name").alias("peer")).join(models.select("eval", F.col("name").alias("model")), "eval").where("peer <> model")


def results_text(scores: DataFrame, confidence: int = 95) -> DataFrame:
    """(peer, metric, value): the printed results of (peer, metric, kind, mean, low, high), kinds R, P, F in this order."""
    number = lambda c: F.format_string("%.5f", F.col(c).cast("double"))
    line = F.concat("peer", F.lit(" "), "metric", F.lit(" Average_"), "kind", F.lit(": "), number("mean"), F.lit(f" ({confidence}%-conf.int. "), number("low"), F.lit(" - "), number("high"), F.lit(")"))
    place = F.array_position(F.array(*map(F.lit, "RPF")), F.col("kind"))
    rows = scores.groupBy("peer", "metric").agg(_lines(F.struct(place.alias("k"), line.alias("line"))).alias("body"))
    return rows.select("peer", "metric", F.concat(F.lit("-" * 45 + "\n"), "body").alias("value"))


def parse_results(text: DataFrame) -> DataFrame:
    """(run, metric, kind, value) from result lines such as ``7 ROUGE-1 Average_R: 0.25 (95%-conf...)``."""
    pattern = r"^(\S+) (ROUGE-\S+) Average_([RPF]): ([0-9.]+)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return text.where(F.col("value").rlike(pattern)).select(part(1).alias("run"), part(2).alias("metric"), part(3).alias("kind"), part(4).cast("double").alias("value"))


def results_csv(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each run and kind, a column for each metric's mean."""
    return results.groupBy("run", "kind").pivot("metric", metrics).agg(F.avg("value"))


def score_table(features: DataFrame, names: list[str], judgements: DataFrame | None = None, judges: list[str] | None = None) -> DataFrame:
    """One row for each sentence, a column for each feature and each judge."""
    out = features.groupBy("did", "sno").pivot("name", names).agg(F.last("value", ignorenulls=True))
    if judgements is not None:
        out = out.join(judgements.groupBy("did", "sno").pivot("judge", judges or []).agg(F.last("util")), ["did", "sno"], "left")
    return out


def write_texts(rows: DataFrame, name: str, body: str, path: str) -> None:
    """Write a text for each row under path/name=.../."""
    rows.select(F.col(name).alias("name"), F.col(body).alias("value")).write.partitionBy("name").text(path)
