import random

import brute
import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from millrace.llm.near_copies import near_copies, shingles, similar

DATA = "/root/testdata/sf0.001"


def sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def pairs(rows):
    s = sets(rows)
    return [(x, y) for x in s for y in s if x < y and s[x] and s[y] and 5 * len(s[x] & s[y]) >= 4 * len(s[x] | s[y])]


def test_stage_drops_one_changed_word_in_200(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(0, 40, 2):
        w = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:100], "other", *w[101:]]))]
    _, low = brute.simhash(rows)
    assert sum(low[i] != low[i + 1] for i in range(0, 40, 2)) > 0  # SimHash alone leaves some
    docs = brute.docs(spark, rows)
    stage = dict(C.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, DATA).collect()) == list(range(0, 40, 2))


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.reach([i for i, _ in rows], pairs(rows))
    got = {r.id: r.component for r in near_copies(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want and any(want[i] != i for i in want)


def test_shingles_and_threshold():
    texts = ["a B c", None, "", "a b c d e", "A b c d e f", "x " * 9]
    grams, first = shingles(pa.array(texts))
    assert np.diff(first).tolist() == [1, 0, 0, 1, 2, 5]
    assert grams[first[3]] == grams[first[4]] and len(set(grams[first[5] :].tolist())) == 1
    assert similar(np.arange(9), np.arange(1, 9)) and similar(np.arange(4), np.arange(5)) and not similar(np.arange(3), np.arange(4))
