"""m8, r16 and r19 over all sentences of a document, not its first ones."""

import pytest

from lectern import queries
from lectern.functions.similarity import normalized_lcs

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    own = lambda d: [f"alpha{d}x{i} beta{d}x{i} gamma{d}x{i} delta{d}x{i}" for i in range(1, 13)]
    texts = {d: own(d) for d in (1, 2, 21, 22)}
    texts[1][11] = texts[1][10]  # the last sentence repeats the one before it
    texts[21][8] = texts[1][8]
    rows = [(d, "\n".join(t), "en", "web", len("\n".join(t))) for d, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, texts


def test_lcs_of_whole_documents(spark, folder):
    path, texts = folder
    got = {r.did: r.lcs for r in queries.QUERIES["m8_summary_lcs"](spark, path).collect()}
    words = lambda d: [t.split() for t in texts[d]]
    assert got == {d: pytest.approx(normalized_lcs(words(d), words(d + 20))) for d in (1, 2)}
    assert got[1] > 0


def test_repeats_go_wherever_they_stand_and_all_others_stay(spark, folder):
    path, texts = folder
    got = {(r.did, r.sno) for r in queries.QUERIES["r16_drop_repeats"](spark, path).collect()}
    by_text = {}
    for d, sentences in texts.items():
        for i, t in enumerate(sentences, 1):
            by_text.setdefault(t, set()).add((d, i))
    assert all(len(places & got) == 1 for places in by_text.values()) and len(got) == len(by_text) == 46


def test_pointer_sees_late_sentences(spark, folder):
    path, texts = folder
    rows = [r.asDict() for r in queries.QUERIES["r19_pointer_decode"](spark, path).collect()]
    docs = sorted(texts)
    assert all(r["place"] == 12 * docs.index(r["doc"]) + r["sent"] + 1 for r in rows)
    assert any(r["sent"] >= 10 for r in rows)
