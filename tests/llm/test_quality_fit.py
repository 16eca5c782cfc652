"""The fit and the probabilities of op7 against a plain implementation of the same model."""

import math
import random

import numpy as np
import pyarrow as pa
from test_quality import tables

from millrace.llm import quality as Q


def loss(rows, grades, weights, thresholds):
    """Penalised negative log likelihood, a row at a time."""
    out = Q.RIDGE / 2 * sum(w * w for w in weights.values())
    for found, grade in zip(rows, grades):
        score = sum(weights.get(f, 0.0) for f in found)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        out -= math.log(max(below[grade + 1] - below[grade], 1e-12))
    return out / len(rows)


def by_hand(rows, grades, used, steps=1500, rate=0.5):
    """Plain gradient descent by differences of the loss, thresholds as a first one and the logarithm of the gap."""
    point = dict.fromkeys([*used, "first", "gap"], 0.0)

    def value(p):
        return loss(rows, grades, {f: p[f] for f in used}, [p["first"], p["first"] + math.exp(p["gap"])])

    for _ in range(steps):
        slope = {}
        for k in point:
            up, down = ({**point, k: point[k] + d} for d in (1e-5, -1e-5))
            slope[k] = (value(up) - value(down)) / 2e-5
        if max(map(abs, slope.values())) < 1e-5:
            break
        point = {k: x - rate * slope[k] for k, x in point.items()}
    return value(point), point


def test_fit_reaches_the_plain_optimum():
    rnd = random.Random(5)
    grades = [rnd.randrange(3) for _ in range(60)]
    rows = [sorted({f for f in range(4) if rnd.random() < (0.2 + 0.3 * g if f < 2 else 0.8 - 0.3 * g)} | {9}) for g in grades]
    used = [f for f in range(10) if sum(f in r for r in rows) >= Q.LEAST_DOCS]
    docs = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    model = Q.train(docs, np.array([f for r in rows for f in r], np.int64), np.array(grades))
    assert set(np.flatnonzero(model.weights)) <= set(used)
    best, point = by_hand(rows, grades, used)
    got = loss(rows, grades, {f: model.weights[f] for f in used}, model.thresholds.tolist())
    assert got - best < 1e-3
    for found in rows[:20]:
        score = sum(model.weights[f] for f in found)
        plain = sum(point[f] for f in found if f in used)
        want = [1 / (1 + math.exp(plain - t)) for t in (point["first"], point["first"] + math.exp(point["gap"]))]
        assert np.allclose(model.probabilities(np.array([score]))[0], [want[0], want[1] - want[0], 1 - want[1]], atol=0.02)


def test_every_row_has_the_probabilities_of_its_own_features(spark):
    docs, labels, _ = tables(spark, 120)
    model = Q.fit(docs, labels)
    weights = model.weights.astype(np.float32).astype(float)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        score = sum(weights[f] for f in Q.features(*Q.buffer_of(pa.array([t])))[1].tolist())
        below = [1 / (1 + math.exp(score - x)) for x in model.thresholds]
        assert abs(got[i].tail_prob - (1 - below[1])) < 1e-9
        assert abs(got[i].expected_grade - ((below[1] - below[0]) + 2 * (1 - below[1]))) < 1e-9
        assert got[i].kept == (1 - below[1] >= Q.KEEP)
