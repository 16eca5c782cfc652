"""Suffix arrays and their family against plain slices, also where all fingerprints collide."""

from collections import Counter

import numpy as np
import pytest

from millrace.llm.suffix_dedup import prints
from millrace.llm.suffixes import IndexFamily, Suffixes, byte_loads, ordered

U = np.uint64


def made(width, bits):
    rnd = np.random.default_rng(width)
    buf = rnd.integers(97, 100, 3000).astype(np.uint8)
    buf[1000:1200] = buf[2500:2700]
    at = np.arange(len(buf) - width + 1)
    marks = np.zeros(len(buf), U)
    marks[at] = prints(buf, [width])[0] & U(2**bits - 1)
    raw = buf.tobytes()
    return Suffixes(*byte_loads(buf, width), marks), at, [raw[i : i + width] for i in at], rnd


@pytest.mark.parametrize("width", [3, 8, 13, 40])
@pytest.mark.parametrize("bits", [0, 6, 64])
def test_groups_order_and_marks(width, bits):
    suffixes, at, strings, rnd = made(width, bits)
    order, new = suffixes.groups(at)
    got = [strings[i] for i in order]
    assert all(n == (i == 0 or got[i] != got[i - 1]) for i, n in enumerate(new.tolist())) and new.sum() == len(set(strings))
    assert [strings[i] for i in suffixes.lexicographic(order[new])] == sorted(set(strings))
    family = IndexFamily(suffixes)
    for batch in np.array_split(rnd.permutation(at), 20):
        family.add(batch)
    count = Counter(strings)
    assert family.shared[at].tolist() == [count[x] > 1 for x in strings]
    assert len(family.levels) <= 8
    for level in family.levels:
        assert [strings[i] for i in level] == sorted({strings[i] for i in level})


def test_ordered_is_a_stable_argsort():
    rnd = np.random.default_rng(2)
    for top in (3, 2**40, 2**63):
        keys = rnd.integers(0, top, 5000).astype(U)
        keys[::7] = keys[0] ^ U(1)
        assert (ordered(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ordered(np.zeros(0, U))) == 0
