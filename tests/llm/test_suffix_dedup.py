import brute
import pytest

from millrace.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("seed", "width", "gram", "hot"), [(0, 200, 100, 48), (1, 60, 30, 2), (2, 40, 20, 1), (3, 200, 100, 1), (4, 50, 25, 48)])
def test_equals_brute_force(spark, seed, width, gram, hot):
    rows = brute.prose(seed)
    got = suffix_dedup(brute.docs(spark, rows), width, gram, hot).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == brute.suffix(rows, width)
    assert any(r.n_removed for r in got)


def test_periods(spark):
    rows = [(0, "a" * 500), (1, "b" + "a" * 300), (2, "ab" * 200), (3, "x" + "abc" * 150), (4, "a" * 199), (5, "é" * 100), (6, "é" * 101)]
    got = suffix_dedup(brute.docs(spark, rows)).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == brute.suffix(rows, 200)


def test_empty_table(spark):
    assert suffix_dedup(brute.docs(spark, [])).collect() == []
    assert [tuple(r)[:4] for r in suffix_dedup(brute.docs(spark, [(None, None)])).select(COLUMNS).collect()] == [(None, 0, 0, 0)]
