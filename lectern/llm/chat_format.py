"""Chat formatting by token-level assembly.

A conversation is a list of turns. Role and text of each turn are encoded on
their own, and reserved ids above the vocabulary are spliced between them; no
text can make such an id. Control strings that stand in a text are escaped
before encoding, so that the rendered string is as unambiguous as the ids:
a backslash doubles, and a control string gets one in front. Which ids count for
the loss follows from prefix sums over the segments' lengths.

    <turn> role ### : text </turn>      (each mark is one reserved id)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder, pieces_of

#: Reserved marks: the string each renders as, and its place above the vocabulary.
OPEN, MIDDLE, CLOSE = "<turn>", "### :", "</turn>"
MARKS = (OPEN, MIDDLE, CLOSE)
#: Strings that a text must not show as they are.
CONTROL = ("<turn>", "</turn>", "### :", "### User:", "### Assistant:", "### System:", "<|endoftext|>")
_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_BACK = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def assemble(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of segments in order; a segment's flag says whether its ids count for the loss.

    The mask is the prefix sum of +1 where a counted segment starts and -1 where
    it ends; starts and ends are prefix sums of the lengths.
    """
    ids = np.concatenate([x for x, _ in segments]) if segments else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x) for x, _ in segments], dtype=np.int64)
    edges = np.zeros(len(ids) + 1, dtype=np.int32)
    for (x, counted), end in zip(segments, ends, strict=True):
        if counted:
            edges[end - len(x)] += 1
            edges[end] -= 1
    return ids, np.cumsum(edges[:-1]) > 0


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(tokenizer, specials=False), len(pieces_of(tokenizer))
        mark = {m: np.array([first + i], dtype=np.uint32) for i, m in enumerate(MARKS)}
        for batch in slices(batches, 512):
            ids, masks, chars = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shown = escape(role), escape(text)
                parts = [(mark[OPEN], False), (encode(shown[0]), False), (mark[MIDDLE], False), (encode(shown[1]), role == LOSS_ROLE), (mark[CLOSE], False)]
                got, mask = assemble(parts)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                ids.append(got.astype("<u4").tobytes())
                masks.append(edge.tolist())
                chars.append(sum(map(len, MARKS)) + sum(map(len, shown)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(ids, pa.binary()), pa.array(masks, pa.list_(pa.int32())), pa.array(chars, pa.int64())],
                names=["conv", "turn", "tie", "ids", "mask", "n_chars"],
            )

    return run


def _splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation and place them one after the other; rows come sorted, a conversation may span batches."""
    last, number, start, begun = None, 0, 0, False
    for batch in batches:
        starts, numbers = [], []
        for conv, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not begun or conv != last:
                last, number, start, begun = conv, 0, 0, True
            starts.append(start)
            numbers.append(number)
            number, start = number + 1, start + len(ids) // 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), *batch.columns[1:]], names=["conv", "turn_no", "start", "ids", "mask", "n_chars"])


def format_conversations(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, in order within partitions: conv, turn_no, start, ids, mask, n_chars.

    ids (binary, little-endian uint32) of all turns of a conversation, one after
    the other, are its sequence; start is the turn's place in it; mask holds the
    edges [from, to, ...) within the turn of the ids that count for the loss;
    n_chars is the length of the rendered turn. Rows are ordered by turn (null
    first), ties by a hash of role and text; repeated rows are turns of their own. Null
    roles and texts are empty; a null conversation is one of its own. Other
    columns are not read.

    Turns are encoded where they are read. Only then are they dealt by
    conversation and sorted; a conversation passes through its task turn by
    turn, so one of any length needs the memory of a single turn.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"), F.sha2(F.concat(empty(role), F.lit("\0"), empty(text)), 256).alias("tie"))
    encoded = source.mapInArrow(_encode(tokenizer), "conv long, turn long, tie string, ids binary, mask array<int>, n_chars long")
    dealt = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "tie").select("conv", "ids", "mask", "n_chars")
    return dealt.mapInArrow(_splice, "conv long, turn_no long, start long, ids binary, mask array<int>, n_chars long")


def shown_turn(ids: np.ndarray, pieces: list[bytes]) -> tuple[str, str]:
    """(role, text) of one turn's ids as they are rendered, escapes included."""
    first = len(pieces)
    cuts = np.flatnonzero(ids >= first)
    if ids[cuts].tolist() != [first, first + 1, first + 2] or cuts[0] != 0 or cuts[-1] != len(ids) - 1:
        raise ValueError("not a turn")
    role, text = (b"".join(pieces[i] for i in ids[a + 1 : b]).decode("utf-8", "surrogatepass") for a, b in pairwise(cuts))
    return role, text


def read_turn(ids: np.ndarray, pieces: list[bytes]) -> tuple[str, str]:
    """(role, text) of one turn's ids."""
    role, text = shown_turn(ids, pieces)
    return unescape(role), unescape(text)


def _read(tokenizer: str):
    """Digests of whole conversations from their turns' ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now: list | None = None
        done: list[list] = []

        def out() -> pa.RecordBatch:
            rows = [[c, n, a.hexdigest(), m, b.hexdigest(), k] for c, n, a, m, b, k in done]
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)

        for batch in batches:
            for conv, number, raw, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if number == 0:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, dtype="<u4")
                shown = shown_turn(ids, pieces)
                role, text = map(unescape, shown)
                counted = "".join(unescape(b"".join(pieces[i] for i in ids[a:b]).decode("utf-8", "surrogatepass")) for a, b in zip(mask[::2], mask[1::2], strict=True))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(counted)
                now[4].update(counted.encode("utf-8", "surrogatepass"))
                now[5] += sum(map(len, MARKS)) + sum(map(len, shown))
            if done:
                yield out()
        if now:
            done.append(now)
            yield out()

    return run


def digest(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each conversation, read back from the ids and masks of ``format_conversations``."""
    return formatted.select("conv", "turn_no", "ids", "mask").mapInArrow(
        _read(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
