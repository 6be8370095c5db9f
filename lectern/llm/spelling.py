"""Groups of spelling variants: words one edit apart meet on rolling hashes of their deletions.

A word's prefix and suffix sums of a polynomial hash give the hash of the word
without any one of its code points, for all of them at once in numpy. Words that
differ by a replacement share the deletion at that place; a word that is another
one without a code point has that deletion's hash as its own. Keys are dealt by
their upper bits and sorted; only keys that meet another word's go on, with their
words, and are compared as strings. At most 90 letters can stand at a place, so a
key's group is small whatever the corpus holds, and its members are counted and
ranked without listing pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, mix, numbered, slices, written

#: Words have so many code points, and so many occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form has at least so many times its occurrences.
FORM_TIMES = 2
#: One run in so many, by its hash, loses a code point.
SLIPS = 97

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it passes them on, and code points that are hashed at a time.
_HELD, _CELLS = 200_000, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def with_slips(doc: object, text: str | None, slips: int = SLIPS) -> Counter[str]:
    """Counts of the runs of letters of a whole text, A-Z in lower case; a run whose CRC-32 with the document's id ``slips`` divides loses one code point."""
    runs = Counter(_RUN.findall((text or "").encode("utf-8", "replace").lower().decode()))
    begin, out = zlib.crc32(f"{'' if doc is None else doc}:".encode()), Counter()
    for run, n in runs.items():
        if len(run) >= LEAST_LENGTH:  # shorter ones only get shorter
            h = zlib.crc32(run.encode(), begin)
            if h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """(id, word, n) of the words of all texts, counted in the tasks that read them and then summed by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= LEAST_LENGTH]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in slices(batches, 64):
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(with_slips(doc, whole, slips))
                if len(held) >= _HELD:
                    yield passed()
                    held.clear()
        yield passed()

    plain, _ = numbered(docs.select(key, text))
    sums = plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return written(sums.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length: (whole, deleted, first): their hashes, those without each code point, and which deletions are not the one before them."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), size)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
    before = np.zeros((len(words), size + 1), dtype=np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + _BASE) * power, axis=1, out=before[:, 1:])
    whole = before[:, size]
    deleted = before[:, :size] + (whole[:, None] - before[:, 1:]) * _INVERSE
    first = np.ones(points.shape, dtype=bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    return mix(whole), mix(deleted), first


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (key, pos, id, first): the whole word's key at pos -1, and one for each deletion."""
    for batch in batches:
        by_size: dict[int, list[int]] = defaultdict(list)
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for i, w in enumerate(words):
            by_size[len(w)].append(i)
        for size, rows in by_size.items():
            step = max(1, _CELLS // size)
            for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                whole, deleted, first = deletion_hashes([words[i] for i in some])
                n = len(some)
                keys = np.concatenate([whole[:, None], deleted], axis=1).ravel().view(np.int64)
                pos = np.tile(np.arange(-1, size, dtype=np.int32), n)
                flags = np.concatenate([np.zeros((n, 1), bool), first], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pos), pa.array(np.repeat(ids[some], size + 1)), pa.array(flags)], names=["key", "pos", "id", "first"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` (the first column), in tables that split no key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, pos), those that share both with another word, and whole words with the deletions that have their key."""
    for table in _whole_groups(batches):
        key, pos, ids, first = (table.column(i).to_numpy() for i in range(4))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new_key) - 1
        new_pos = new_key | np.concatenate([[True], pos[1:] != pos[:-1]])
        same = np.bincount(np.cumsum(new_pos) - 1)[np.cumsum(new_pos) - 1]
        wholes, firsts = np.bincount(group, pos < 0)[group] > 0, np.bincount(group, first)[group] > 0
        kept = np.where(pos < 0, firsts, (same > 1) | (first & wholes))
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(pos[kept]), pa.array(ids[kept])], names=["key", "pos", "id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pos, id, word, n) sorted by key to (id, near, form): how many near words a key gives a word, and the best of them.

    Hashes only brought the rows together; words are told apart as strings.
    """
    for table in _whole_groups(batches):
        at: dict[tuple[int, str], list[tuple[int, str, int]]] = defaultdict(list)
        wholes: dict[tuple[int, str], tuple[int, str, int]] = {}
        dropped: dict[tuple[int, str], list[tuple[int, str, int]]] = defaultdict(list)
        out: list[tuple[int, int, int, str, int]] = []
        for key, pos, id_, word, n in zip(*(c.to_pylist() for c in table.columns), strict=True):
            one = (-n, word, id_)
            if pos < 0:
                wholes[key, word] = one
                continue
            rest = word[:pos] + word[pos + 1 :]
            at[pos, rest].append(one)
            if pos == 0 or word[pos] != word[pos - 1]:
                dropped[key, rest].append(one)
        for members in at.values():  # replacements
            if len(members) > 1:
                members.sort()
                out += [(x[2], len(members) - 1, *members[x is members[0]]) for x in members]
        for place, short in wholes.items():  # insertions and deletions
            if place in dropped:
                long = dropped[place]
                out.append((short[2], len(long), *min(long)))
                out += [(x[2], 1, *short) for x in long]
        if out:
            ids, near, n, word, other = zip(*out, strict=True)
            form = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(word, pa.string()), pa.array(other, pa.int64())], names=["n", "word", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int64()), form], names=["id", "near", "form"])


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, to, root), where ``root`` is the word of ``to``: pointers jump until none has a further one.

    Counts at least double along a chain, so chains are short and there are no
    cycles. Rows that point at a word that many point at meet a broadcast row.
    """
    now = written(forms, "forms")
    while True:
        total = now.count()
        if not total:
            break
        on = now.groupBy("to").agg(F.count(F.lit(1)).alias("c")).join(now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("last")), "to")
        on = written(on, "jumps")
        if not on.head(1):
            break
        jumped = meet(now.select("id", "to"), on, ["to"], "c", total).select("id", "next", "last")
        now = written(now.join(jumped, "id", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce("last", "root").alias("root")), "forms")
    return now.select("id", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    Words are the runs of letters of whole texts after ``slips``, of at least
    ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences. Near words are
    one inserted, deleted or replaced code point apart. A word's form is its near
    word of most occurrences (ties: the smallest in code-point order), if that
    has at least ``FORM_TIMES`` times the word's; the root is where forms lead,
    the word itself if it has none.

    Null texts are empty, a null key counts as an empty id, repeated rows count
    again, other columns are not read, and an empty table gives no rows. Texts
    are read once and words move as counts. Of the keys, one for each code point
    of each word, only a hash, a place and an id move; words join those that met.
    """
    words = word_counts(docs, key, text, slips)
    keys = words.select("id", "word").mapInArrow(_keys, "key long, pos int, id long, first boolean")
    dealt = lambda df, *order: df.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key", *order)
    met = dealt(keys, "pos").mapInArrow(_meeting, "key long, pos int, id long").join(words, "id").select("key", "pos", "id", "word", "n")
    near = dealt(met).mapInArrow(_near, "id long, near long, form struct<n:long,word:string,id:long>")
    best = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("form").alias("form"))
    has = -F.col("form.n") >= FORM_TIMES * F.col("n")
    rows = written(words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form")), "near")
    roots = _roots(rows.where("form is not null").select("id", F.col("form.id").alias("to"), F.col("form.word").alias("root")))
    return rows.join(roots, "id", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.n")).alias("form_n"))
