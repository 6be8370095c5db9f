import random

import numpy as np
import pytest

from lectern.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, keep string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = Q.judge(docs, train).join(test, "doc_id").collect()
    bad = [r for r in rows if not r.quality or r.toxic]
    good = [r for r in rows if r.quality and not r.toxic]
    assert len(bad) > 200 and len(good) > 1000
    assert np.mean([not r.keep for r in bad]) > 0.97
    assert np.mean([r.keep for r in good]) > 0.98


def brute_posteriors(rows):
    """(site, posterior) of each (host, path, good, toxic), by sums over all other documents of its path and host."""
    e = np.clip([g * (1 - t) for _, _, g, t in rows], 1e-6, 1 - 1e-6)
    hosts, paths = [r[0] for r in rows], [r[:2] for r in rows]
    mean, n = e.mean(), len(e)

    def between(keys):
        return sum(e[[k == key for k in keys]].sum() ** 2 / keys.count(key) for key in set(keys))

    def strength(keys, above, groups):
        within = (sum(e**2) - between(keys)) / n
        spread = (between(keys) - above) / n - groups / n * within
        return min(1e9, max(1.0, within / spread)) if spread > 0 else 1e9

    kh = strength(hosts, n * mean**2, len(set(hosts)) - 1)
    kp = strength(paths, between(hosts), len(set(paths)) - len(set(hosts)))
    logit = lambda p: np.log(p / (1 - p))
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        in_host, in_path = [j for j in others if hosts[j] == hosts[i]], [j for j in others if paths[j] == paths[i]]
        host = (e[in_host].sum() + kh * mean) / (len(in_host) + kh)
        site = (e[in_path].sum() + kp * host) / (len(in_path) + kp)
        out.append((site, 1 / (1 + np.exp(-logit(e[i]) - logit(np.clip(site, 1e-6, 1 - 1e-6)) + logit(mean)))))
    return out


def test_posteriors_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"h{h}", f"p{rng.randint(0, 2)}", min(1.0, max(0.0, rng.gauss(0.3 + 0.06 * h, 0.3))), rng.random() * 0.2) for h in range(9) for _ in range(rng.randint(1, 30))]
    rows += [("lone", "p", 0.02, 0.1), ("h1", "rare", 0.99, 0.0)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, good double, toxic double")
    sites, prior = Q.site_sums(scored)
    assert sum(r.n for r in sites.collect()) == prior.documents == len(rows)
    got = sorted(Q.with_posterior(scored.join(sites, ["host", "path"]), prior).collect(), key=lambda r: r.i)
    for r, (site, posterior) in zip(got, brute_posteriors(rows), strict=True):
        assert r.site == pytest.approx(site, abs=1e-9) and r.posterior == pytest.approx(posterior, abs=1e-9)


def test_sparse_sites_stay_near_their_parent(spark):
    rng = random.Random(2)
    rows = []
    for h in range(40):
        rate = 0.9 if h % 2 else 0.3
        rows += [(f"h{h}", "p", min(0.99, max(0.01, rng.gauss(rate, 0.2))), 0.0) for _ in range(200)]
    rows += [("sparse", "p", 0.01, 0.0), ("h1", "rare", 0.01, 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, good double, toxic double")
    sites, prior = Q.site_sums(scored)
    got = {(r.host, r.path): r for r in Q.with_posterior(scored.join(sites, ["host", "path"]), prior).collect()}
    total = np.mean([r[2] for r in rows])
    assert abs(got["h0", "p"].site - 0.3) < 0.05
    # a lone document's site says nothing of it: the host's other documents do, or the global mean
    assert got["sparse", "p"].site == pytest.approx(total, abs=1e-3) and got["h1", "rare"].site > 0.8


def test_nulls_repeats_and_empty_tables(spark):
    prose = "The rain came down on the hills, and all was still. Nobody spoke of it again. "
    rng = random.Random(4)
    words = "red green blue house tree river stone cloud".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)).capitalize() + ". " + prose, "en", f"s{i % 3}", "x") for i in range(60)]
    rows += [(i, "| # | % | # " * 40, None, None, "x") for i in range(60, 100)]
    rows += [(200, None, None, None, None), (200, None, None, None, None), (None, prose, "en", "s1", "x")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 1), (3, None, 0), (5, 1, 0)], LABELS)
    got = Q.judge(df, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].keep == (i < 60) for i in range(100)) and by_id[None].keep
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id < 100").count() == 60
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep for r in Q.judge(df, none).collect())
    assert Q.judge(spark.createDataFrame([], DOCS), labels).collect() == []


def test_clashing_names_long_texts_and_large_sites(spark):
    words = "red green blue house tree river stone cloud".split()
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)).capitalize() + ".", "en", f"s{i % 3}") for i in range(60)]
    rows += [(i, "| # | % | # " * 40, "en", "s1") for i in range(60, 100)] + [(100, "The long one. " * 30_000, "en", f"s{i}") for i in range(2)]
    names = ["host", "path", "good", "toxic", "n", "s", "hn", "hs", "site", "posterior", "c0", "C1", "__host", "__good", "kh", "words"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(Q.F.lit(i).alias(c) for i, c in enumerate(names)))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], LABELS)
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    got = kept.collect()
    assert {tuple(r[c] for c in names) for r in got} == {tuple(range(len(names)))}
    texts = {(r[0], r[1]) for r in rows}
    assert {r.doc_id for r in got} >= set(range(60)) and not {r.doc_id for r in got} & set(range(60, 100)) and all((r.doc_id, r.text) in texts for r in got)
