import random

import brute
import pytest

from millrace.llm.decontamination import decontamination


@pytest.mark.parametrize(("seed", "block_bytes"), [(0, 1 << 20), (1, 200), (2, 1 << 20)])
def test_equals_brute_force(spark, seed, block_bytes):
    rows = brute.prose(seed, vocabulary=30, longest=900)
    rnd = random.Random(seed)
    long = [t for _, t in rows if t and len(t.split()) > 60]
    items = []
    for i in range(12):
        w = rnd.choice(long).split()
        at, n = rnd.randrange(len(w) - 40), rnd.choice([2, 3, 12, 13, 14, 20, 30])
        items.append((i, "-".join(w[at : at + n]).upper().replace("É", "é") + "!"))
    items += [(20, None), (21, " ... "), (22, items[0][1]), (0, items[0][1]), (23, "é" if seed else "no such words anywhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontamination(brute.docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert got == brute.contamination(rows, items)
    assert any(r[5] for r in got) and any(0 < r[2] and not r[5] for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = brute.docs(spark, [(1, "x a b c"), (None, None)])
    assert decontamination(rows.where("false"), bench).collect() == []
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontamination(rows, bench).collect()} == {(1, 4, 3, True), (None, 0, 0, False)}
    assert {(r.doc_id, r.n_hit) for r in decontamination(rows, bench.where("false")).collect()} == {(1, 0), (None, 0)}
