import random

import brute
import numpy as np
import pyarrow as pa

from millrace.llm import quality as Q

WORDS = ["".join(random.Random(i).choices("aeioumnrst", k=4)) for i in range(300)]


def text(rnd, grade):
    w = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 80))]
    if grade == 0:
        for _ in range(3):
            w[rnd.randrange(len(w))] = rnd.choice(["vile", "scum", "curse"])
    if grade == 1:
        w = [x + "%%%" for x in w] if rnd.random() < 0.5 else [w[0]] * len(w)
    return " ".join(w)


def tables(spark, n=600):
    rnd = random.Random(3)
    grades = [rnd.choice([0, 1, 2, 2, 2]) for _ in range(n)]
    docs = brute.docs(spark, [(i, text(rnd, g)) for i, g in enumerate(grades)] + [(n, None), (n + 1, ""), (n + 2, "a" * 100_000)])
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0), 1) for i, g in enumerate(grades) if i < n // 2] + [(n, None, None, 1), (None, 1, 0, 1)], "doc_id long, quality int, toxic int, grade int")
    return docs, labels, grades


def test_held_out_accuracy(spark):
    docs, labels, grades = tables(spark)
    got = {r.doc_id: r for r in Q.quality_classifier(docs, labels).collect()}
    assert len(got) == len(grades) + 3
    held = [i for i in range(len(grades) // 2, len(grades))]
    assert np.mean([got[i].kept == (grades[i] == 2) for i in held]) > 0.95
    mean = [np.mean([got[i].expected_grade for i in held if grades[i] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_thresholds_are_ordered_and_sample_is_bounded(spark):
    docs, labels, _ = tables(spark)
    whole, small = Q.fit(docs, labels), Q.fit(docs, labels, sample_rows=40)
    assert whole.thresholds[0] < whole.thresholds[1] and small.thresholds[0] < small.thresholds[1]
    p = whole.probabilities(np.linspace(-9, 9, 50))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (np.diff(p[:, 2]) > 0).all()


def test_features_are_those_of_each_text_alone():
    texts = ["Ab ab %%% 12", "", "é É", "x" * 50, "Ab ab %%% 12"]
    buf, off = Q.buffer_of(pa.array(texts))
    d, f = Q.features(buf, off)
    for i, t in enumerate(texts):
        one = Q.features(*Q.buffer_of(pa.array([t])))[1]
        assert sorted(f[d == i].tolist()) == sorted(one.tolist())


def test_no_labels_and_no_documents(spark):
    docs, labels, _ = tables(spark, 20)
    assert all(r.kept for r in Q.quality_classifier(docs, labels.where("false")).collect())
    assert Q.quality_classifier(docs.where("false"), labels).collect() == []
    kept = Q.quality_classifier(docs, labels, columns=["doc_id", "chunk", "kind"])
    assert kept.columns == ["doc_id", "chunk", "kind", "expected_grade", "tail_prob", "kept"]
