import os
import random

import corpus_pipeline as P
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases, as tables of a folder."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ["n", "r", "st", "ll", "m"]]

    def prose(n):
        out = []
        for i in range(n):
            w = rng.choice(words)
            out.append((w.capitalize() if i % 9 == 0 else w) + (". " if i % 9 == 8 else " "))
        return "".join(out).strip()

    rows = [(i, prose(rng.randint(60, 160))) for i in range(300)]
    labels = [(i, 1, 0) for i in range(200)]
    for i in range(300, 360):
        rows.append((i, " | ".join(rng.choice(words) for _ in range(60))))
        labels.append((i, 0, 0))
    for i in range(360, 420):
        parts = prose(80).split()
        for _ in range(4):
            parts[rng.randrange(len(parts))] = rng.choice(["vile", "rotten", "nasty"])
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, 1))
    passage = prose(70)
    for i in range(420, 425):
        rows.append((i, f"{prose(40)}\n{passage}\n{prose(40)}"))
    near = prose(150).replace(". ", " ").split()  # without sentence ends: lines of their own survive line dedup
    for i in range(430, 434):
        copy = list(near)
        copy[i % 100] = "zzz"
        copy[::16] = [f"{w}{i}" if k % 10 == 9 else w for k, w in enumerate(copy[::16])]
        rows.append((i, " ".join(copy)))
    item = prose(30)
    rows.append((440, f"{prose(50)}\n{item}\n{prose(50)}"))
    rows.append((441, prose(2000)))
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(20))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(rows), passage


def test_stages_take_effect(spark, folder, tmp_path):
    at, texts, passage = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r.asDict() for r in docs.collect()})
    good, lines, near, clean, packed = seen
    assert not set(good) & set(range(300, 420)) and set(range(300)) <= set(good)
    assert [i for i in range(420, 425) if passage.split(". ")[2] in lines[i]["text"]] == [420]
    assert all(lines[i]["text"] == texts[i] for i in range(300)) and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert set(lines) - set(near) <= {431, 432, 433} and set(range(300)) <= set(near)
    assert set(near) - set(clean) == {440}
    assert set(packed) == set(clean)


def test_run_gives_the_last_stage(spark, folder):
    tables = lambda: set(os.listdir(f"{P.common.shared_dir(spark).removeprefix('file:')}/lectern"))
    P.common.written(spark.range(1), "other")
    before = tables()
    out = P.run(spark, folder[0])
    left = tables() - before
    assert len([x for x in left if x.startswith("best-fit-packing")]) == 1 and not [x for x in left if x.startswith(("quality", "line", "MinHash", "signed", "hits"))] and before <= tables()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    total = out.groupBy("sequence_id").sum("length").collect()
    assert total and max(r[1] for r in total) <= 1024


def test_nulls_repeats_long_texts_and_clashing_names(spark, folder, tmp_path):
    """Every stage gets nulls in all columns, repeated rows, a long text and columns by the operators' own names."""
    at, texts, _ = folder
    names = ["own", "doc", "th", "row", "key", "node", "site", "good", "toxic", "n", "c0", "hits", "__own", "gone"]
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s1", 0), (2, long, None, "s2", len(long)), (2, long, None, "s2", len(long)), (3, " \n ", "en", None, 3), (4, "one", "en", "s1", None), (None, texts[5], "en", "s1", 9), (6, texts[6], "en", "s1", 9)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(P.F.lit(i).alias(c) for i, c in enumerate(names)))
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, at)
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns, name
            assert {tuple(r[c] for c in names) for r in kept.collect()} <= {tuple(range(len(names)))}
            docs = kept
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 3, 4, 6} >= ids - {None} >= {6} and None in ids


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder[0])
    assert docs.collect() == []
