import random
import re

from lectern.llm import line_dedup as L

DOCS = "doc_id long, text string, lang string, n_lines string"


def py_lines(text):
    """(lines, words of each line) by the rule of the docstring, word by word."""
    tokens = re.findall(r"[^\S\n]*\S+[^\S\n]*|[^\S\n]*\n\s*|[^\S\n]+", text, re.ASCII)
    if not text.strip():
        return [], []
    word = [None if "\n" in t else t.strip().encode() for t in tokens]
    out = [[]]
    for i, t in enumerate(tokens):
        near = word[max(0, i - 3) : i], word[i + 1 : i + 4]
        if out[-1] and word[i] is not None and all(len(x) == 3 and None not in x for x in near) and all(word[i] < x for x in near[0]) and all(word[i] <= x for x in near[1]):
            out.append([])
        out[-1].append(t)
        if word[i] is None and i + 1 < len(tokens):
            out.append([])
    return ["".join(x) for x in out], [tuple(t.strip() for t in x if "\n" not in t) for x in out]


def brute(rows):
    """rows: (doc_id, text), keys unique. Texts after removal, by doc_id."""
    seen, spans = {}, []
    cut = {d: py_lines(t or "") for d, t in rows}
    for d in sorted(cut, key=lambda d: (d is None, d or 0)):
        words = cut[d][1]
        for i in range(len(words) - 2):
            w = tuple(words[i : i + 3])
            if w in seen:
                e, j = seen[w]
                spans.append((d, max(i, j + 3) if e == d else i, i + 3))
            else:
                seen[w] = (d, i)
    gone = {d: set() for d in cut}
    for d, a, b in spans:
        gone[d] |= set(range(a, b))
    texts = dict(rows)
    return {d: ("".join(x for i, x in enumerate(cut[d][0]) if i not in gone[d]) if gone[d] else texts[d] or "", len(gone[d])) for d in cut}


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS).repartition(4)
    return {r.doc_id: (r.text or "", r.n_removed) for r in L.dedup_lines(df).collect()}


def some_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_lines_lose_nothing(spark):
    rng = random.Random(1)
    texts = ["a", "One. Two!\n\nThree? \"Four.\" five " + "word " * 50 + "\nend", "  lead. x", "\n\n x \n", "é ü. ß x.", " ".join(some_words(rng, 500)), "\tx y\r\nz " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.x for r in df.select(L.lines(df.text).alias("x")).collect()]
    assert ["".join(x) for x in got] == texts
    assert got == [py_lines(t)[0] for t in texts]


def test_lines_in_running_text_have_three_words_or_more(spark):
    text = " ".join(some_words(random.Random(2), 4000))
    found = spark.createDataFrame([(text,)], "text string").select(L.lines(L.F.col("text")).alias("x")).first().x
    assert min(len(x.split()) for x in found) >= 3 and 6 < 4000 / len(found) < 8


def test_against_brute_force(spark):
    rng = random.Random(5)
    sentences = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(2, 9))).capitalize() + rng.choice([". ", "!\n", "? "]) for _ in range(25)]
    rows = [(i, "".join(rng.choice(sentences) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    rows += [(100, "same line of text here.\n" * 30), (101, rows[3][1]), (102, None), (None, rows[4][1]), (103, "word " * 300), (104, "x " + "word " * 300)]
    rows += [(105, " ".join(some_words(rng, 30_000))), (106, "\n".join(some_words(rng, 30_000))), (107, " \n\t ")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[100][0] == "same line of text here.\n" * 3 and got[107] == (" \n\t ", 0)


def test_hot_windows_are_like_others(spark, monkeypatch):
    rng = random.Random(6)
    common = "One line\nthat all have\nin common\nat the top.\n"
    rows = [(i, common + "\n".join(" ".join(some_words(rng, 3)) for _ in range(5))) for i in range(400)]
    monkeypatch.setattr(L, "SAMPLED", 2)
    monkeypatch.setattr(L, "HOT_KEYS", 200)
    got = run(spark, rows)
    assert got == brute(rows) and got[0][1] == 0 and all(got[i][1] == 4 for i in range(1, 400))


def test_a_passage_in_the_middle_goes_and_the_rest_stays(spark):
    passage = "The quick brown fox jumps over the dog. It never looked back at all! Then the rain came down on the hills. All was still."
    rows = [(1, f"Head one.\n{passage}\nTail one."), (2, f"Another head.\n{passage}\nOther tail.")]
    got = run(spark, rows)
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("Another head.\nOther tail.", len(py_lines(passage)[0]))


def test_three_short_lines_go(spark):
    rows = [(1, "Yes.\nNo.\nOk."), (2, "Yes.\nNo.\nOk."), (3, "Yes.\nNo.\nBut."), (4, "a b c\nYes.\nNo.\n\nOk.\nx y z")]
    assert run(spark, rows) == {1: (rows[0][1], 0), 2: ("", 3), 3: (rows[2][1], 0), 4: ("a b c\nx y z", 3)}


def test_sixty_short_lines_go(spark):
    block = "".join(f"item {i} ok\n" for i in range(10, 70))
    got = run(spark, [(1, "Head of one.\n" + block), (2, "Another head.\n" + block)])
    assert got[1][1] == 0 and got[2] == ("Another head.\n", 60)


def test_a_passage_without_sentence_ends_is_found_behind_any_number_of_words(spark):
    rng = random.Random(7)
    passage = some_words(rng, 200)
    texts = {k: " ".join([*some_words(rng, k), *passage, *some_words(rng, 30)]) for k in range(1, 24)}
    got = run(spark, list(texts.items()))
    assert got[1] == (texts[1], 0)
    for k in range(2, 24):
        left = set(got[k][0].split())
        gone = [w not in left for w in passage]
        # all but what lies before the first cut and after the last one
        assert all(gone[30:-30]) and set(texts[k].split()) - left <= set(passage), k


def test_passages_of_over_fifty_words_have_a_window(spark):
    rng = random.Random(9)
    rows, n = [], 200
    around = lambda p: " ".join([*some_words(rng, rng.randint(0, 40)), *p, *some_words(rng, rng.randint(0, 40))])
    for i in range(n):
        passage = some_words(rng, 51 + i % 30)
        rows += [(i, around(passage)), (n + i, around(passage))]
    got = run(spark, rows)
    assert all(got[i][1] == 0 for i in range(n))
    assert sum(got[n + i][1] >= 3 for i in range(n)) >= 0.98 * n


def test_empty_table_repeated_rows_and_clashing_names(spark):
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    text = "First line of the text is here.\nSecond line of it.\nThird line of it all."
    df = spark.createDataFrame([(1, text, "a", "b"), (1, text, "a", "b"), (1, "another text", "a", "b"), (2, text, None, None)], DOCS)
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "First line of the text is here.\nSecond line of it.\nThird line of it all."), (1, text), (1, "another text"), (2, "")]
    names = ["own", "doc", "th", "n", "gone", "c0", "c1", "C2", "__gone", "__lines"]
    odd = L.dedup_lines(df.select("doc_id", "text", *(L.F.lit(i).alias(c) for i, c in enumerate(names))))
    assert odd.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    assert {tuple(r[c] for c in names) for r in odd.collect()} == {tuple(range(10))} and sorted(r.n_removed for r in odd.collect()) == [0, 0, 0, 3]
