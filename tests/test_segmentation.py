"""Big5 round trips, and best paths against all ways to cut a run."""

import math
import random

from lectern.functions import segmentation

WORDS = "w string, n long"


def test_big5_round_trip(spark, tmp_path):
    texts = {"a": "中文摘要，第一句。\nABC 臺灣", "c": "香港特別行政區"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode("big5"))
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "d").write_bytes("好".encode("big5") + b"\xff\xff")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in segmentation.read_big5(spark, str(tmp_path / "in")).collect()}
    assert {k: got[k] for k in texts} == texts and "empty" not in got and got["d"].startswith("好") and "�" in got["d"]


def cheapest(piece, cost, alone):
    """The cheapest cut, and its cost, over all cuts."""
    best = [(0.0, 0, [])]
    for end in range(1, len(piece) + 1):
        options = [(best[end - k][0] + cost[piece[end - k : end]], -k, [*best[end - k][2], piece[end - k : end]]) for k in range(1, min(8, end) + 1) if piece[end - k : end] in cost]
        options.append((best[end - 1][0] + alone, -1, [*best[end - 1][2], piece[end - 1]]))
        best.append(min(options))
    return best[-1]


def test_best_paths_against_brute_force(spark):
    rng = random.Random(7)
    signs = "中文字典分詞路徑最好"
    table = {"".join(rng.choices(signs, k=rng.choice([1, 1, 2, 2, 3, 4]))): rng.randrange(1, 50) for _ in range(40)}
    total = sum(table.values())
    cost = {w: -math.log(n / total) for w, n in table.items()}
    alone = math.log(total / 0.5)
    rows = [(i, "".join(rng.choices(signs + "罕", k=rng.randrange(1, 25)))) for i in range(60)]
    got = {}
    for r in sorted(segmentation.segment(spark.createDataFrame(rows, "did long, text string"), spark.createDataFrame(list(table.items()), WORDS)).collect(), key=lambda r: (r.did, r.ord)):
        got.setdefault(r.did, []).append(r.w)
    for i, piece in rows:
        assert "".join(got[i]) == piece
        assert abs(sum(cost.get(w, alone) for w in got[i]) - cheapest(piece, cost, alone)[0]) < 1e-9


def test_mixed_texts_nulls_long_runs_and_an_empty_table(spark):
    rows = [(1, "我愛 Spark 3.5，中文！"), (2, None), (3, "  "), (4, "中" * 1000)]
    words = spark.createDataFrame([("中文", 5), ("我", 3), ("愛", 2), (None, 3), ("壞", 0)], WORDS)
    got = sorted((r.did, r.ord, r.w) for r in segmentation.segment(spark.createDataFrame(rows, "did long, text string"), words).collect())
    assert [w for d, _, w in got if d == 1] == ["我", "愛", "Spark", "3.5，", "中文", "！"]
    assert [w for d, _, w in got if d == 4] == ["中"] * 1000 and {d for d, _, _ in got} == {1, 4}
    none = segmentation.segment(spark.createDataFrame(rows[:1], "did long, text string"), words.limit(0)).collect()
    assert sorted((r.ord, r.w) for r in none) == [(1, "我"), (2, "愛"), (3, "Spark"), (4, "3.5，"), (5, "中"), (6, "文"), (7, "！")]
