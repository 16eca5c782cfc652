import math
import random

import numpy as np
import pytest

from millrace.llm.vector_codes import Chunk, digest, op13_vector_codes, vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd in Python integers; rows (vec_id, vector)."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else y for j, y in enumerate(books[p])]
    out = []
    for i, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def vectors(n, dims, seed, spread=0.02):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("n,entries,chunk", [(300, 256, 64), (900, 16, 128), (50, 256, 4096)])
def test_equals_brute_force(spark, n, entries, chunk):
    rows = vectors(n, 8, n)
    rows = [(i * 7 % n, v) for i, v in rows]
    rows += [(n + 1, None), (n + 2, [1.0] * 7 + [None]), (n + 3, [float("nan")] * 8), (n + 4, [float("inf")] * 8), (n + 5, rows[0][1]), (n + 6, rows[0][1])]
    df = spark.createDataFrame([(i, v, i % 3 or None, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, codes string").repartition(3)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got, books = vector_codes(df, entries=entries, chunk=chunk)
    want, said = brute(rows, entries=entries)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted(want)
    assert books.tolist() == said


def test_bounds_decide_what_is_rescanned():
    """Few parts are rescanned once entries rest; without drift in the limits the result is wrong somewhere."""
    rnd = np.random.default_rng(4)
    x = rnd.integers(-1000, 1000, (3000, 1, 6))
    books = x[:40].transpose(1, 0, 2).copy()
    seen = {}
    for bounds in (True, False):
        c, b, drift, rescanned = Chunk(x), books.copy(), np.zeros((1, 40)), []
        right = True
        for k in range(12):
            c.assign(b, drift)
            d = ((x[:, 0, None] - b[0][None]) ** 2).sum(2)
            right &= bool((c.codes[:, 0] == d.argmin(1)).all())
            moved = np.array([x[c.codes[:, 0] == e, 0].sum(0) // max(1, (c.codes[:, 0] == e).sum()) for e in range(40)])[None]
            step = np.sqrt(((moved - b) ** 2).sum(2))
            if bounds:
                drift = drift + step + np.array([[np.delete(step[0], e).max() for e in range(40)]])
                rescanned.append(int((np.concatenate([h.keys for h in c.heaps]) <= np.repeat(drift[0], c.heaps[0].sizes)).sum()))
            b = moved
        seen[bounds] = right
        if bounds:
            assert rescanned[-1] < rescanned[0] < 3000
    assert seen == {True: True, False: False}


def test_heap_order_survives_the_state():
    x = np.random.default_rng(1).integers(-50, 50, (500, 2, 3))
    books = x[:20].transpose(1, 0, 2).copy()
    c = Chunk(x)
    c.assign(books, np.zeros((2, 20)))
    drift = np.full((2, 20), 3.0)
    c.assign(books + 1, drift)
    again = Chunk.read(c.state(), 2, 3, 20)
    assert (again.codes == c.codes).all() and (again.x == x).all()
    for h in again.heaps:
        at = 0
        for n in h.sizes:
            keys = h.keys[at : at + n]
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, n))
            at += n
        assert sorted(h.order.tolist()) == [*range(500)]


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    got, books = vector_codes(make([]))
    assert got.collect() == [] and books.size == 0
    assert vector_codes(make([(1, None, "a"), (2, [None, 1.0], "b")]))[0].collect() == []
    # of another length: dropped; no multiple of four: zeros; no id: last; repeated ids and rows: each for itself
    rows = [(3, [0.5] * 5, "a"), (3, [0.5] * 5, None), (None, [0.25] * 5, "a"), (1, [-0.0005] * 5, None), (2, [9.0] * 4, "a")]
    got, books = vector_codes(make(rows), entries=2)
    assert books.shape == (4, 2, 2) and books[3].tolist() == [[0, 0], [0, 0]]
    assert sorted((r.vec_id is None, r.vec_id, r.code) for r in got.collect() if r.vec_id) == [(False, 1, "00000000"), (False, 3, "01010100"), (False, 3, "01010100")]
    assert got.count() == 4
    one = vector_codes(make([(1, [], "a"), (2, [], "a")]))[0].collect()
    assert [(r.code, r.error) for r in one] == [("00000000", 0)] * 2
    with pytest.raises(Exception, match="too large"):
        vector_codes(make([(1, [1e300] * 4, "a")]))[0].collect()
    large = vector_codes(make([(i, [1e5 * i + 0.5] * 4, "a") for i in range(5)]), entries=2)
    want, said = brute([(i, [1e5 * i + 0.5] * 4) for i in range(5)], entries=2)
    assert large[1].tolist() == said and sorted((r.vec_id, r.code, r.error) for r in large[0].collect()) == want


def test_query(spark):
    rows = op13_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert len({r.codebooks_sha256 for r in rows}) == 1 and len(rows[0].codebooks_sha256) == 64 and digest(np.array([[[1, -2]]])) != rows[0].codebooks_sha256
