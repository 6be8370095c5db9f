"""No overlap that the law accepts is missed, by enumeration."""

import itertools

import numpy as np
import pytest

from lectern.llm import decontamination as D

PLACES = [tuple(i for i, c in enumerate(m) if c == "1") for m in D.MASKS]


def placements(n):
    """All rows of n words with as many others as the law allows."""
    chosen = np.array(list(itertools.combinations(range(n), n * (100 - D.SAME_PERCENT) // 100)), dtype=int)
    same = np.ones((len(chosen), n), dtype=bool)
    same[np.arange(len(chosen))[:, None], chosen] = False
    return same


@pytest.mark.parametrize("n", range(D.TOLERANT, 2 * D.LEAST_WORDS))
def test_every_placement_has_enough_seeds(n):
    same = placements(n)
    seeds = sum(same[:, [i + p for p in places]].all(axis=1).astype(int) for places in PLACES for i in range(n - places[-1]))
    assert seeds.min() >= (D.LEAST_SEEDS if n >= D.LEAST_WORDS else 1)


@pytest.mark.parametrize("n", range(1, 17))
def test_every_placement_is_one_stretch(n):
    for same in placements(n):
        assert D.stretches(same, min(D.LEAST_WORDS, n)) == [(0, n)]
