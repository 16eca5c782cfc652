import brute
import pytest

import corpus_pipeline as C

DATA = "/root/testdata/sf0.001"


def columns(df):
    return df.columns, [t for _, t in df.dtypes]


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    shape = columns(docs)

    good = C.quality(spark, docs, DATA).cache()
    assert columns(good) == shape and 0.5 * docs.count() < good.count() < docs.count()

    one = C.near_dedup(spark, good, DATA).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    _, low = brute.simhash(rows)
    rest = [r for r in rows if low[r[0]] == r[0]]
    near = brute.reach([i for i, _ in rest], brute.similar(rest))
    assert columns(one) == shape and {r.doc_id for r in one.collect()} == {i for i, m in near.items() if i == m}

    clean = C.decontaminate(spark, one, DATA).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in one.collect()], items) if r[5]}
    assert columns(clean) == shape and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad

    hidden = C.hide_pii(spark, clean, DATA).cache()
    assert columns(hidden) == shape and hidden.count() == clean.count()
    for r in hidden.collect():
        assert not brute.pii(r.text)
        if not brute.pii(texts[r.doc_id]) and "token" not in (texts[r.doc_id] or "").lower():
            assert r.text == texts[r.doc_id]

    packed = C.pack(spark, hidden, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in hidden.collect()}


OUTPUTS = ["kept", "tail_prob", "expected_grade", "contaminated", "n_words", "n_hit", "pii", "row", "component", "component_id", "fingerprint", "c0", "c2", "id", "a.b", "x`y"]


def odd(spark):
    """Rows that repeat ids, nulls, empties, and columns called like everything the operators return."""
    rows = [(1, "a b"), (1, "a b"), (1, "something else entirely"), (None, "a b"), (None, "only here without an id"), (2, None), (3, "")]
    kinds = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in OUTPUTS)
    return spark.createDataFrame([(i, t, -1, *["z"] * len(OUTPUTS)) for i, t in rows], kinds)


def test_near_dedup_keeps_unlike_texts_of_one_id_and_one_of_equal_rows(spark):
    got = [(r.doc_id, r.text) for r in C.near_dedup(spark, odd(spark), DATA).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b"), (1, "something else entirely"), (None, "only here without an id"), (2, None)], key=str)


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES[:-1]])
def test_clashing_and_dotted_columns(spark, stage):
    docs = odd(spark)
    out = stage(spark, docs, DATA)
    assert columns(out) == columns(docs) and out.count() > 0
    assert all(r[-1] == "z" and r.kept == "z" and r.n_chars == -1 for r in out.collect())


def test_packing_of_odd_rows(spark):
    assert {r.doc_id for r in C.pack(spark, odd(spark), DATA).collect()} == {1, 2, 3, None}


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_empty_table(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0")
    assert stage(spark, docs, DATA).collect() == []


def test_run(spark):
    assert C.run(spark, DATA).count() > 50
