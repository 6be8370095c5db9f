import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing as P
from lectern.llm.tokens import encoder, pieces_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def naive(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return Counter(left)


@pytest.mark.parametrize("seed", range(30))
def test_runs_make_the_same_sequences_as_one_piece_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100])
    lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 300))] + [rng.randint(1, 5)] * rng.randint(0, 100)
    runs, made = P.best_fit_decreasing(Counter(lengths), capacity)
    load = defaultdict(int)
    counts = Counter(lengths)
    ends = [b.rank if b and b.length == a.length else counts[a.length] for a, b in zip(runs, [*runs[1:], None])]
    for a, last in sorted(zip(runs, ends), key=lambda x: (-x[0].length, x[0].rank)):
        for x in range(a.rank, last):
            q = a.sequence + (x - a.rank) // a.each
            assert a.offset + (x - a.rank) % a.each * a.length == load[q]
            load[q] += a.length
    assert Counter(capacity - v for v in load.values()) == naive(lengths, capacity)
    assert len(load) == made


def test_segment_tree():
    tree = P.Tightest(10)
    tree.add(3, 1), tree.add(8, 2), tree.add(10, 1)
    assert [tree.find(x) for x in range(11)] == [3, 3, 3, 3, 8, 8, 8, 8, 8, 10, 10]
    tree.add(10, -1)
    assert tree.find(9) is None


def check(rows, texts, capacity):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
        assert all(r.length == capacity for r in parts[1:])
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == ids
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity


def test_documents(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["alpha", "béta", "gam\nma", "12", "?!", "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for i in range(150)}
    texts |= {1000: None, 1001: "", 1002: "long " * 900, 1003: "a very long one " * 30_000}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, piece int, ids string").repartition(5)
    rows = P.pack(df, PATH, capacity=64).collect()
    check(rows, texts, 64)
    lengths = [r.length for r in rows if r.length < 64]
    assert len({r.sequence_id for r in rows}) == sum(naive(lengths, 64).values()) + sum(r.length == 64 for r in rows)


def test_empty_table_null_keys_and_repeats(spark):
    schema = "doc_id long, text string"
    assert P.pack(spark.createDataFrame([], schema), PATH).collect() == []
    rows = P.pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], schema), PATH).collect()
    assert len(rows) == 4 and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == [0, 2, 4, 6]


def test_fast_coder_is_the_tokenizer(spark):
    whole = Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b\n\n c\t", "naïve Straße　漢字 \U0001f600‍", "it's 1234 <|endoftext|> x", "x" * 3000, "\r\n" * 40, "á \x00 end "]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["many words of it " * 30_000]
    encode = encoder(PATH)
    bytes_of = pieces_of(PATH)
    for t in texts:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert encode(t).tolist() == ids
        assert b"".join(bytes_of[i] for i in ids).decode() == t


def test_fast_coder_is_the_tokenizer_on_every_text(spark):
    """All 10,000 documents of the largest given table, ids by both coders."""

    def differ(batches):
        import pyarrow as pa

        whole, encode = Tokenizer.from_file(PATH), encoder(PATH)
        for batch in batches:
            out = [d for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if encode(t or "").tolist() != whole.encode(t or "", add_special_tokens=False).ids]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["doc_id"])

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    assert docs.repartition(8).mapInArrow(differ, "doc_id long").collect() == []
