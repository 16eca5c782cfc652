import random

import brute
import numpy as np

from millrace.llm import pii as P


def texts():
    rnd = random.Random(8)
    bits = ["a@b.co", "x.y+z@mail.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "10.0.0.255", "4111 1111 1111 1111", "4111111111111112", "+1 (826) 555-4081", "+49", "-", " ", "12", "7", "é", "_", "+", "(", ")", "\n", "word", "5500-0000-0000-0004", "0000", "1.2", "\U0001f600"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    return out + [None, "", "a@b.c_d@e.f", "a@b@c.de", "1.2.3.4.5.6.7.8", "1" * 30, "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 16, "+1 2345678901 )", "é@b.c x@y-.z"]


def rows_of(spark, values):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(values)], "doc_id long, text string, pii string").repartition(4)


def test_base_spans_equal_brute_force(spark):
    values = texts()
    got = P.find_pii(rows_of(spark, values)).collect()
    assert len(got) == len(values)
    for r in got:
        assert [(c.start, c.kind, c.end) for c in r.pii if c.base] == brute.pii(values[r.doc_id]), values[r.doc_id]


def test_very_long_runs_take_linear_time(spark):
    values = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a.b" * 60_000 + "@", "a@" + "b." * 80_000 + "c", "+1" * 50_000, "1." * 80_000]
    got = {r.doc_id: r.pii for r in P.find_pii(rows_of(spark, values), np.zeros(sum(P.FEATURES.values()) + 1)).collect()}
    assert [c.kind for c in got[4]] == [0] and got[0] == []
    assert len(got[6]) == 20_000


def test_method_adds_secrets_and_leaves_clean_texts(spark):
    rnd = random.Random(3)
    secret = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    values = [f'some words token = "{secret()}" and more' for _ in range(40)] + ["plain words without anything of the kind"] * 200 + [f"call +1 (826) 555-40{i} now" for i in range(10, 60)] + ["supercalifragilisticexpialidocious_words_only"] * 30
    got = {r.doc_id: r.pii for r in P.find_pii(rows_of(spark, values)).collect()}
    assert all([c.kind for c in got[i]] == [4] for i in range(40))
    assert all(got[i] == [] for i in range(40, 240)) and all(got[i] == [] for i in range(290, 320))


def test_redaction(spark):
    df = P.find_pii(rows_of(spark, ["é a@b.co, 10.0.0.1!", None, "nothing"]), columns=["doc_id", "text"])
    got = {r[0]: r[1] for r in df.select("doc_id", P.redacted(df.text, df.pii)).collect()}
    assert got == {0: "é [EMAIL], [IP]!", 1: None, 2: "nothing"}


def test_em_learns_who_is_right():
    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.3
    right = [0.95, 0.9, 0.7, 0.6]
    votes = np.stack([np.where(rnd.random(20_000) < 0.2, 1, np.where((rnd.random(20_000) < r) == truth, 2, 0)) for r in right], axis=1)
    table, back, counts = np.unique(np.concatenate([np.zeros((20_000, 1), int), votes], axis=1), axis=0, return_inverse=True, return_counts=True)
    p = P.expectation_maximisation(counts.astype(float), table)
    assert ((p[back.reshape(-1)] > 0.5) == truth).mean() > 0.93


def test_empty_and_plan(spark):
    empty = rows_of(spark, ["x"]).where("doc_id > 5")
    assert P.find_pii(empty).collect() == []
    plan = P.find_pii(spark.range(3).selectExpr("id as doc_id", "'a@b.co' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
