import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat_format as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, mask string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"\\#<>/ turn:Asita|", "</turn>", "### Assistant:", "### :", "<turn>", "é"]), max_size=40).map("".join))
def test_escapes_are_undone_and_no_control_string_is_left_bare(text):
    shown = C.escape(text)
    assert C.unescape(shown) == text
    bare = C._BACK.sub("\0", shown)
    assert not any(x in bare for x in C.CONTROL)


def test_mask_is_the_prefix_sum_of_segment_edges():
    rng = random.Random(0)
    parts = [(np.arange(rng.randint(0, 4), dtype=np.uint32), rng.random() < 0.5) for _ in range(30)]
    ids, mask = C.assemble(parts)
    assert mask.tolist() == [flag for x, flag in parts for _ in x] and len(ids) == len(mask)


def expected(rows):
    out = {}
    tie = lambda r, t: hashlib.sha256(f"{r or ''}\0{t or ''}".encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, tie(r[2], r[3])))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        shown = sum(sum(map(len, C.MARKS)) + len(C.escape(r[2] or "")) + len(C.escape(r[3] or "")) for r in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), shown)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(4)
    got = C.digest(C.format_conversations(df, PATH), PATH).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got}, got


def test_round_trip(spark):
    rng = random.Random(1)
    bits = ["hello ", "\\", "### Assistant: ", "</turn>", "<|endoftext|>", "é漢\U0001f600", "\n\n", "\\### :", "<turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(100, None, "assistant", None), (100, 2, None, "x"), (100, 2, None, "x"), (100, 2, "assistant", "tie"), (None, 0, "user", "lost"), (101, 0, "assistant", "long " * 30000), (102, 0, "weird\nrole </turn>", "")]
    rows += [(103, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(25000)]
    got, raw = run(spark, rows)
    assert got == expected(rows) and len(raw) == len(got)


def test_turns_are_placed_one_after_the_other(spark):
    rows = [(1, t, "assistant", f"text number {t}", "x") for t in range(6)]
    turns = sorted(C.format_conversations(spark.createDataFrame(rows, TURNS), PATH).collect(), key=lambda r: r.turn_no)
    at = 0
    for r in turns:
        assert r.start == at
        at += len(r.ids) // 4
        ids = np.frombuffer(r.ids, "<u4")
        assert C.read_turn(ids, C.pieces_of(PATH)) == ("assistant", f"text number {r.turn_no}")
    with pytest.raises(ValueError):
        C.read_turn(ids[1:], C.pieces_of(PATH))


def test_empty_table(spark):
    assert run(spark, [])[1] == []
