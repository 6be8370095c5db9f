"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is read on the workers, from a path that is a parameter. The
ids are those of ``tokenizers`` for the .json file; where the same vocabulary
lies beside it as .tiktoken ranks, that faster coder makes them (tests hold the
two against each other), and a text that contains a special token's string,
where the two differ, goes through ``tokenizers``.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = True) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32). specials: strings of special tokens become their ids, else ordinary text."""

    @lru_cache(maxsize=1)
    def whole():  # loaded where it is needed: both coders together take twice a worker's memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path)
        out.encode_special_tokens = not specials
        return out

    def slow(text: str) -> np.ndarray:
        return np.array(whole().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = f"{path.removesuffix('.json')}.tiktoken"
    if not (path.endswith(".json") and os.path.exists(ranks)):
        return slow
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    with open(path, encoding="utf-8") as file:
        text = file.read()  # of which the vocabulary, its largest part, is not parsed
    reserved = [x["content"] for x in json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))[0]]

    def fast(text: str) -> np.ndarray:
        if specials and any(x in text for x in reserved):
            return slow(text)
        return np.array(coder.encode_ordinary(text), dtype=np.uint32)

    return fast


@lru_cache(maxsize=4)
def pieces_of(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary (special tokens: their strings)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out = []
    for i in range(whole.get_vocab_size()):
        token = whole.id_to_token(i)
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out
