import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_scan_against_a_plain_loop(spark, tmp_path, block):
    rng, end = random.Random(block), 0xC450
    for name, n, p in (("a", 300, 0.1), ("b", 50, 0.9), ("c", 40, 0.0), ("d", 0, 0), ("e", 64, 0.02)):
        ids = [end if rng.random() < p else rng.choice([0x50C4, 0x5000, 0x00C4, 7]) for _ in range(n)]
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    want = []
    for f in sorted(tmp_path.iterdir()):
        start, number, ids = 0, 0, np.frombuffer(f.read_bytes(), "<u2").tolist()
        for i, x in enumerate(ids):
            if x == end:
                want.append((f.name, number, start, i - start, True))
                start, number = i + 1, number + 1
        if start < len(ids):
            want.append((f.name, number, start, len(ids) - start, False))
    got = T.count_tokens(spark, str(tmp_path), end=end, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_round_trip_of_documents(spark, tmp_path):
    texts = ["", None, "a", "<|endoftext|> forged", "naïve \n\n text" * 9, "dup", "dup", "w" * 4000, "many words of it " * 30_000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, tokens int").repartition(3)
    folder = T.write_tokens(df, PATH, str(tmp_path / "out"))
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    rows = T.count_tokens(spark, folder, block=16).collect()
    assert all(r.closed for r in rows)
    assert Counter(r.n_tokens for r in rows) == Counter(len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    files = defaultdict(list)
    for r in rows:
        files[r.file].append((r.document, r.start, r.n_tokens))
    read = []
    for name, found in files.items():
        ids = np.fromfile(tmp_path / "out" / name, "<u2")
        assert [d for d, _, _ in sorted(found)] == list(range(len(found)))
        read += [whole.decode(ids[s : s + n].tolist()) for _, s, n in found]
    assert Counter(read) == Counter(t or "" for t in texts)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(spark, T.write_tokens(df, PATH, str(tmp_path / "none"))).collect() == []
