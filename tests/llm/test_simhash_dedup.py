import random

import brute
import numpy as np
import pytest

from millrace.llm.common import components
from millrace.llm.simhash_dedup import forest, links, near_fingerprints, signatures, simhash_dedup


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = brute.prose(seed)
    rnd = random.Random(seed)
    for i, t in rows[10:20]:
        w = (t or "x y z").split() or ["a"]
        for _ in range(3):
            w[rnd.randrange(len(w))] = "q"
            rows.append((len(rows) + 100, " ".join(w).upper().replace("É", "é")))
    prints, low = brute.simhash(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(brute.docs(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", low[i]) for i, p in prints}
    assert len(set(low.values())) < len(low)


def test_links_finds_all_within_three_bits():
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(50)]
    for f in fps[:30]:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                g = f
                for b in rnd.sample(range(64), n):
                    g ^= 1 << b
                fps.append(g)
    fps = sorted(set(fps))
    a, b = links(*signatures(np.array(fps, np.uint64)), 3)
    want = brute.reach(fps, [(x, y) for k, x in enumerate(fps) for y in fps[:k] if bin(x ^ y).count("1") <= 3])
    assert brute.reach(fps, list(zip(a.tolist(), b.tolist()))) == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(-5, 7), (3, 3)]
    low = brute.reach({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: low[n] for n in got} and {n for n in low if low[n] != n} <= set(got)


def test_empty_and_nulls(spark):
    assert simhash_dedup(brute.docs(spark, [])).collect() == []
    got = simhash_dedup(brute.docs(spark, [(4, None), (2, ""), (3, "a"), (None, "a")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (2, 2), (3, 3), (4, 2)]
    assert {r.fingerprint for r in got if r.doc_id in (2, 4)} == {"0" * 16}


def test_hot_signature_is_compared_in_many_tasks(spark):
    """10,000 fingerprints of one lower half, against all pairs."""
    rnd = np.random.default_rng(8)
    seeds = rnd.integers(0, 2**32, 2500, np.uint64)
    flips = (np.uint64(1) << rnd.integers(0, 32, (3, 7500), np.uint64)).astype(np.uint64)
    near = seeds[rnd.integers(0, 2500, 7500)] ^ flips[0] ^ flips[1] * rnd.integers(0, 2, 7500, np.uint64) ^ flips[2] * rnd.integers(0, 2, 7500, np.uint64)
    fps = np.unique(np.concatenate([seeds, near]) << np.uint64(32) | np.uint64(0xABCD1234))
    assert len(fps) > 9000
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    edges = [(r.a, r.b) for r in near_fingerprints(df, block=1000).collect()]
    root = np.arange(len(fps))
    for i in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 3)
        root = forest(len(fps), root[a + i], root[b])[root]
    x, y = (np.searchsorted(fps, np.array(e, np.int64).view(np.uint64)) for e in zip(*edges))
    got = forest(len(fps), x, y)
    assert (root[x] == root[y]).all()
    assert (got == np.unique(root, return_index=True)[1][np.unique(root, return_inverse=True)[1]]).all()
    assert 1 < len(set(got.tolist())) < len(fps)


def test_any_ids(spark):
    """Ids up to 2^63 - 1; unlike texts of one id stay apart; of rows without an id only like ones are one component."""
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6000))
    a, b, c, d = text(), text(), text(), text()
    near = a + " z"
    assert bin(brute_fp(a) ^ brute_fp(near)).count("1") <= 3 < min(bin(brute_fp(x) ^ brute_fp(y)).count("1") for x in (a,) for y in (b, c, d))
    rows = [(2**62 + 5, a), (2**62 + 6, near), (2**63 - 1, b), (-(2**63), c), (3, near), (5, a), (5, b), (None, d), (None, c)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup(brute.docs(spark, rows)).collect()}
    key = lambda i, t: (i, f"{brute_fp(t):016x}")
    assert got[key(2**62 + 5, a)] == got[key(2**62 + 6, near)] == got[key(3, near)] == got[key(5, a)] == 3
    assert got[key(2**63 - 1, b)] == got[key(5, b)] == 5 and got[key(-(2**63), c)] == got[key(None, c)] == -(2**63) and got[key(None, d)] is None
    alone = {r.doc_id: r.component_id for r in simhash_dedup(brute.docs(spark, [(2**62 + 5, a), (2**62 + 6, near), (2**62 + 9, b)])).collect()}
    assert alone == {2**62 + 5: 2**62 + 5, 2**62 + 6: 2**62 + 5, 2**62 + 9: 2**62 + 9}


def brute_fp(text):
    from millrace.llm.simhash_dedup import fingerprint

    return fingerprint(text.encode())
