import pytest
from pyspark.sql import functions as F

from lectern.sources import readers as R
from lectern.sources import writers as W


def put(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def test_xml_round_trips(spark, tmp_path):
    feats = spark.createDataFrame([("D&1", 1, "Length", 5.0), ("D&1", 1, "Position", 0.5), ("D&1", 2, "Length", 3.0)], "did string, sno int, name string, value double")
    path = put(tmp_path, "f.xml", W.sentfeature_xml(feats).first().xml)
    assert sorted(map(tuple, R.read_sentfeature(spark, path).collect())) == sorted(map(tuple, feats.collect()))
    judged = spark.createDataFrame([("d", 1, "j1", 7.0), ("d", 1, "j2", 3.0)], "did string, sno int, judge string, util double")
    path = put(tmp_path, "j.xml", W.sentjudge_xml(judged).first().xml)
    assert sorted((r.judge, r.util) for r in R.read_sentjudge(spark, path).collect()) == [("j1", 7.0), ("j2", 3.0)]
    extract = spark.createDataFrame([("c", 1, "d", 4), ("c", 2, "d", 9)], "cluster string, ord int, did string, sno int")
    path = put(tmp_path, "e.xml", W.extract_xml(extract).first().xml)
    assert [(r.ord, r.did, r.sno, r.wcnt) for r in R.read_extract(spark, path).collect()] == [(1, "d", 4, None), (2, "d", 9, None)]
    docs = spark.createDataFrame([("c", "d1", 1), ("c", "d2", 2)], "cluster string, did string, ord int")
    path = put(tmp_path, "c.xml", W.cluster_xml(docs).first().xml)
    assert [(r.did, r.ord) for r in R.read_cluster(spark, path).collect()] == [("d1", 1), ("d2", 2)]
    sents = spark.createDataFrame([("d", 1, "A < b."), ("d", 2, "C.")], "did string, sno int, text string")
    path = put(tmp_path, "s.xml", W.docsent_xml(sents).first().xml)
    assert [(r.did, r.sno, r.text) for r in R.read_docsent(spark, path, "d").collect()] == [("d", 1, "A < b."), ("d", 2, "C.")]
    with pytest.raises(Exception, match="document is not"):
        R.read_docsent(spark, path, "other").collect()


def test_other_xml(spark, tmp_path):
    path = put(tmp_path, "r.xml", '<TABLE><R SDID="a" SSENT="1" TDID="b" TSENT="2"><RELATION TYPE="4" JUDGE="x"/><RELATION TYPE="5" JUDGE="y"/></R></TABLE>')
    assert [(r.ssent, r.type, r.judge) for r in R.read_relations(spark, path).collect()] == [(1, "4", "x"), (1, "5", "y")]
    path = put(tmp_path, "q.xml", '<X><QUERY QID="q"><TITLE> t </TITLE><NARRATIVE>n</NARRATIVE><DESCRIPTION>d</DESCRIPTION></QUERY></X>')
    assert tuple(R.read_query(spark, path).first()) == ("q", "t", "d", "n", None)
    peers = spark.createDataFrame([(1, "p", "p.html")], "eval int, name string, file string")
    models = spark.createDataFrame([(1, "A", "a.html"), (1, "B", "b.html")], "eval int, name string, file string")
    xml = W.rouge_settings(peers, models).first().xml.replace("<PEERS>", "<PEER-ROOT>x</PEER-ROOT><MODEL-ROOT>y</MODEL-ROOT><PEERS>")
    got_peers, got_models = R.read_evaluations(spark, put(tmp_path, "e.xml", f"<ROUGE>{xml}</ROUGE>"))
    assert [(r.eval, r.name, r.file) for r in got_peers.collect()] == [("1", "p", "x/p.html")]
    assert sorted((r.name, r.file) for r in got_models.collect()) == [("A", "y/a.html"), ("B", "y/b.html")]
    assert [(r.peer, r.model) for r in W.jackknifed(models, models).orderBy("peer").collect()] == [("A", "B"), ("B", "A")]


def test_line_formats(spark, tmp_path):
    meta = R.read_metadata(spark, put(tmp_path, "m", "d1 BBC 1000\nd2  CNN 2000\n\n"))
    assert [(r.did, r.source, r.ts.timestamp()) for r in meta.collect()] == [("d1", "BBC", 1000), ("d2", "CNN", 2000)]
    assert [tuple(r) for r in R.read_idf(spark, put(tmp_path, "i", "the 0.1\nx 5\n")).collect()] == [("the", 0.1), ("x", 5.0)]
    sal = R.read_salience(spark, put(tmp_path, "s", "0.1 0.2\n0.3\n\n0.4\n"))
    assert [(r.doc, r.sent, r.sal) for r in sal.collect()] == [(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3), (0, 0, 0.4)]
    peers, models = R.read_file_list(spark, put(tmp_path, "l", "p1 m1 m2\np2 m3\n"))
    assert peers.count() == 2 and [(r.name, r.file) for r in models.collect()] == [("0", "m1"), ("1", "m2"), ("0", "m3")]
    assert R.read_basic_elements(spark, put(tmp_path, "b", "dog|big|mod\n")).first().modifier == "big"
    train, test = R.read_classes(spark, put(tmp_path, "t", "".join(f"c{i % 2}\ttext {i}\n" for i in range(40))))
    assert train.count() + test.count() == 40 and 8 < train.count() < 32
    rows = W.parse_results(spark.read.text(put(tmp_path, "o", "11 ROUGE-1 Average_R: 0.5 (95%-conf.int. 0 - 1)\nnoise\n11 ROUGE-1 Average_R: 0.7 (x)\n")))
    assert W.results_csv(rows, ["ROUGE-1"]).first()["ROUGE-1"] == pytest.approx(0.6)
    assert [r.name for r in R.list_collection(spark, str(tmp_path)).where("name = 'o'").collect()] == ["o"]


def test_markup(spark):
    page = "<html><head><title> A\n title </title><style>p{}</style></head><body><p>One &amp; two</p><script>x()</script>three<br/>four <b>five</b></body></html>"
    got = R.read_pages(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()
    assert got[0].title == "A title" and " ".join(got[0].text.split()) == "A title One & two three four five"
    assert "x()" not in got[0].text and "p{}" not in got[0].text and got[0].text.endswith("three\nfour five") and got[1].text is None
    sgml = spark.createDataFrame([("d", "<TEXT><P>\nFirst\nsentence.</P><p>Second.</p><P> </P></TEXT>")], "did string, text string")
    assert [(r.sno, r.text) for r in R.sgml_sentences(sgml).collect()] == [(1, "First sentence."), (2, "Second.")]
    wire = spark.createDataFrame([("d", "<HEADLINE>Big\nnews</HEADLINE><TEXT>It came. It went.</TEXT>")], "did string, text string")
    assert [(r.headline, r.sno, r.text) for r in R.parallel_corpus(wire).collect()] == [("Big news", 1, "It came."), ("Big news", 2, "It went.")]
    styles = spark.createDataFrame([('<a name="1">[1]</a> <a href="#1" id=1>One A.</a>', '<S ID="1">Two B.</S>', "Three C.\n\nFour.")], "see string, isi string, spl string")
    row = styles.select(R.summary_lines(F.col("see"), "SEE").alias("a"), R.summary_lines(F.col("isi"), "ISI").alias("b"), R.summary_lines(F.col("spl")).alias("c")).first()
    assert tuple(row) == (["one a."], ["two b."], ["three c.", "four."])
    summary = spark.createDataFrame([("s", 1, "One A."), ("s", 2, "B.")], "name string, ord int, text string")
    html = W.see_html(summary).select(R.summary_lines(F.col("html"), "SEE").alias("x")).first().x
    assert html == ["one a.", "b."]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a\n \nb", "en", "s"), (250, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [(r.cluster, r.sno, r.text) for r in R.sentences_of(docs).collect()] == [("en/s/0", 1, "a"), ("en/s/0", 2, "b")]
    art = spark.createDataFrame([("x", 0)], "article string, sent int")
    com = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "article string, sent int")
    assert sorted(map(tuple, R.forum_pairs(art, com).collect())) == [("x", 1, 0, "article"), ("x", 2, 0, "article"), ("x", 2, 1, "comment")]
