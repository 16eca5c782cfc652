import random

from millrace.llm import pii as P


def test_runs_of_more_than_200_characters_are_secrets(spark):
    rnd = random.Random(3)
    secret = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    values = [f'some words token = "{secret(n)}" and more' for n in [40] * 40 + [201, 300, 1000]] + ["plain words without anything of the kind"] * 200
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r.doc_id: [(c.kind, c.end - c.start) for c in r.pii] for r in P.find_pii(docs).collect()}
    assert [got[i] for i in (40, 41, 42)] == [[(4, 201)], [(4, 300)], [(4, 1000)]]
    assert all(got[i] == [] for i in range(43, 243))
