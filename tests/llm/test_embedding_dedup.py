import brute
import numpy as np

from millrace.llm import embedding_dedup as E


def near(rnd, x, cosine):
    y = rnd.standard_normal(len(x))
    y -= (y @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def sample(seed, dims=64):
    rnd = np.random.default_rng(seed)
    rows = []
    add = lambda x, label: rows.append((len(rows), None if x is None else [float(v) for v in np.asarray(x, np.float32)], label))
    for label in (0, 1, None):
        for _ in range(60):
            add(rnd.standard_normal(dims), label)
    for i in range(0, 100, 3):
        for c in (0.999, 0.985, 0.981, 0.979, 0.95):
            add(3 * near(rnd, np.array(rows[i][1]), c), rows[i][2])
    centre = rnd.standard_normal(dims)
    for _ in range(150):
        add(near(rnd, centre, 0.9915), 1)
    for _ in range(40):
        add(centre, 1)
    for x in (None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), centre[:32]):
        add(x, 1)
    rows.append((len(rows), [None, *([1.0] * (dims - 1))], 1))
    rows.append((len(rows), [None, *([1.0] * (dims - 1))], 1))
    return rows


def expected(rows, threshold):
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    edges = []
    for k, a in enumerate(ok):
        for b in ok[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    edges.append((a[0], b[0]))
    n = {r[0]: 0 for r in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    low = brute.reach([r[0] for r in rows], edges)
    return {(r[0], n[r[0]], low[r[0]], low[r[0]] == r[0]) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, n int")


def test_equals_brute_force(spark):
    rows = sample(1)
    want = expected(rows, 0.98)
    assert {tuple(r) for r in E.embedding_dedup(frame(spark, rows)).collect()} == want
    assert {tuple(r) for r in E.embedding_dedup(frame(spark, rows), block=20, least_block=10).collect()} == want  # cuts the crowd into blocks
    assert max(r[1] for r in want) > 100


def test_recall_of_pairs_at_the_threshold():
    rnd = np.random.default_rng(4)
    for largest in (100, 100_000):
        bits, bands = E.band_plan(largest)
        x = rnd.standard_normal((400, 64))
        y = np.array([near(rnd, v, 0.98) for v in x])
        a, b = (E.band_keys(E.band_values(E.units(v), bits, bands), np.zeros(400, np.int64), 64) for v in (x, y))
        assert (a == b).any(axis=1).mean() > 0.99


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(2)
    x = E.units(rnd.standard_normal((500, 64)))
    y = E.units([near(rnd, v, 0.9) for v in x])
    turn = E.rotation(64, 128, E.SEED)
    code, factor = E.encode(x, turn)
    signs = np.unpackbits(code, axis=1)[:, :128] * 2.0 - 1
    error = ((signs / np.sqrt(128)) * (y @ turn.T)).sum(axis=1) / factor - 0.9
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= E.EPSILON * np.sqrt((1 / factor**2 - 1) / 127)).all()


def test_empty(spark):
    assert E.embedding_dedup(frame(spark, [])).collect() == []
    got = E.embedding_dedup(frame(spark, [(1, None, 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True)]


def test_repeated_and_missing_ids(spark):
    rnd = np.random.default_rng(6)
    a, b, c = (rnd.standard_normal(64) for _ in range(3))
    rows = [(5, a), (5, b), (6, near(rnd, a, 0.99)), (None, c), (None, near(rnd, c, 0.99)), (None, near(rnd, b, 0.99)), (7, c * 0)]
    got = E.embedding_dedup(frame(spark, [(i, [float(v) for v in np.asarray(x, np.float32)], 1) for i, x in rows])).collect()
    want = [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 1, 5, False), (7, 0, 7, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_recall_against_all_rows(spark):
    """All partners of every row whose id is divisible by 100 are found, and no others."""
    rnd = np.random.default_rng(12)
    centres = rnd.standard_normal((150, 64))
    x = np.asarray([near(rnd, centres[i % 150], 0.992) for i in range(4000)], np.float32)
    unit = E.units(x)
    want = {i: int((unit @ unit[i] >= 0.98).sum()) - 1 for i in range(0, 4000, 100)}
    got = {r.vec_id: r.n_links for r in E.embedding_dedup(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).where("vec_id % 100 = 0").collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values()) > 100
