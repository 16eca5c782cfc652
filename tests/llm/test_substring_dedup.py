import brute
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.substring_dedup import Parsed, substring_dedup, word_numbers

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize(("seed", "hot"), [(0, 48), (1, 48), (2, 1), (3, 2)])
def test_equals_brute_force(spark, seed, hot):
    rows = brute.prose(seed)
    got = substring_dedup(brute.docs(spark, rows), hot=hot).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == brute.substring(rows)
    assert any(r.n_removed for r in got)


def test_runs_and_periods(spark):
    rows = [(0, "a " * 50), (1, "b " + "a " * 30), (2, "a b " * 30), (3, "x a b a b " + "a b " * 20), (4, "a " * 19), (5, "c " * 21 + "d")]
    got = substring_dedup(brute.docs(spark, rows)).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == brute.substring(rows)


def test_empty_table_and_nulls(spark):
    assert substring_dedup(brute.docs(spark, [])).collect() == []
    got = substring_dedup(brute.docs(spark, [(None, None), (1, None), (1, "a b")])).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 2] and all(r.n_removed == 0 for r in got)


@pytest.mark.parametrize("seed", range(20, 32))
def test_equal_windows_have_equal_keys(seed):
    """Also at the ends of documents, in runs, and for every number of rounds."""
    rows = brute.prose(seed, 60)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    for rounds in (1, 2, 3):
        parsed = Parsed(table, 12)
        keys = parsed.anchors(rounds, 2)
        order = np.lexsort((keys, parsed.hash))
        same = parsed.hash[order][1:] == parsed.hash[order][:-1]
        assert same.any() and (keys[order][1:] == keys[order][:-1])[same].all()
        assert rounds > 1 or (keys == parsed.hash ^ np.uint64(0x5DEECE66D)).mean() < 0.9


def test_words_with_one_hash_have_numbers_of_their_own():
    words = [b"one", b"two", b"one", b"three", b"two"]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for hashes in ([1, 1, 1, 1, 1], [1, 2, 1, 3, 2]):
        n = word_numbers(buf, starts, ends, np.array(hashes, np.uint64))
        assert all((n[i] == n[j]) == (words[i] == words[j]) for i in range(5) for j in range(5))
