"""Queries against DuckDB on the smallest tables; the driver compares all of them on larger ones."""

import duckdb
import pytest

from lectern import queries

FOLDER = "/root/testdata/sf0.001"
SOME = ["s13_sentences", "s14_html_text", "k1_sentfeature_xml", "t6_t7_t14_lengths", "t16_ngram_graph", "m1_m3_m4_overlaps", "f1_centroid", "r2_by_words", "r15_r16_threshold_filter", "e4_rouge_su4", "v5_v6_relative_utility", "v10_spearman", "v19_decoder_scores", "windowed_events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    value = lambda v: round(float(v), 5) if type(v).__name__ in ("float", "Decimal") else v.isoformat()[:19] if hasattr(v, "isoformat") else v
    rows = lambda found, names: sorted((tuple(value(r[names.index(c)]) for c in columns) for r in found), key=str)
    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), rel.columns)
