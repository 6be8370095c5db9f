import numpy as np
import pytest

from lectern.llm import embedding_dedup as E


def brute(rows):
    """n_links and component_id by vec_id, by comparing all pairs."""
    good = [(i, label, np.array(v, dtype=np.float64)) for i, label, v in rows if label is not None and v and all(c is not None for c in v) and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    unit = np.array([E.unit_vector(v.tobytes()) for _, _, v in good])
    labels = np.array([x[1] for x in good])
    ids = np.array([x[0] for x in good])
    for k in range(len(good)):
        for j in np.flatnonzero((unit @ unit[k] >= E.COSINE) & (labels == labels[k])):
            if j != k:
                links[ids[k]].add(ids[j])
    root = {}
    for i in sorted(links):
        if i in root:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i]) for i in links}


def test_transform_keeps_lengths_and_undoes_itself():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(E.hadamard(E.hadamard(x)), x) and np.allclose((E.hadamard(x) ** 2).sum(1), (x**2).sum(1))


def test_recall_near_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for cosine, least in ((0.93, 0.985), (0.95, 0.995)):
        other = cosine * x + np.sqrt(1 - cosine**2) * y
        found = np.zeros(len(x), dtype=bool)
        for t in range(E.TABLES):
            a, pa_ = E.buckets(x, t)
            b, pb = E.buckets(other, t)
            found |= (a == b) | (pa_ == b[:, None]).any(1) | (pb == a[:, None]).any(1)
        assert found.mean() >= least, (cosine, found.mean())


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_all_links_of_the_given_tables(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").toPandas()
    rows = [(int(r.vec_id), int(r.label), [float(x) for x in r.embedding]) for r in table.itertuples()]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(x[0] for x in got.values()) >= 0.999 * sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.999


def test_edges_and_large_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, 1, (base + rng.normal(size=16) * 0.05).tolist()) for i in range(1300)]
    rows += [(2000 + i, 1, base.tolist()) for i in range(40)]
    rows += [(3000, 2, base.tolist()), (3001, None, base.tolist()), (3002, 1, None), (3003, 1, [0.0] * 16), (3004, 1, [float("nan")] * 16), (3005, 1, [None] * 16), (3006, 1, []), (3007, 1, (base * 1e30).tolist()), (3008, 1, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, n_links int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    want = brute([r for r in rows if r[0] != 3008]) | {3008: (0, 3008)}
    assert got == want
    schema = "vec_id long, label int, embedding array<float>"
    assert E.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0])], schema)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(twice).collect()) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_cells_of_one_bucket_count_each_pair_once(spark, monkeypatch):
    """Small cells, so that a bucket is a grid of many, and copies of dense groups."""
    monkeypatch.setattr(E, "CELL", 8)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        base = rng.normal(size=20)
        rows += [(g * 100 + i, 1, (base + rng.normal(size=20) * 0.12).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    want = brute(rows)
    # what shares no bucket in any table is missed; what is counted is counted once
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.99 * sum(x[0] for x in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01])], "vec_id long, label int, embedding array<double>")
    odd = df.select("*", *(E.F.lit(i).alias(c) for i, c in enumerate(["node", "x", "n", "key", "bucket", "component", "l", "k"])))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(odd).collect()) == [(1, 1, 1), (2, 1, 1)]
