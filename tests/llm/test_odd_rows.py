"""Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""

import random

import brute
import numpy as np
import pytest

from millrace.llm.chat_format import chat_segments, read_back
from millrace.llm.decontamination import decontamination
from millrace.llm.packing import packing
from millrace.llm.pii import find_pii
from millrace.llm.quality import quality_classifier
from millrace.llm.simhash_dedup import simhash_dedup
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.suffix_dedup import suffix_dedup

RND = random.Random(9)
LONG = " ".join(RND.choice(["alpha", "beta", "gamma", "délta", "a@b.co", "12", "epsilon."]) + str(RND.randint(0, 99)) for _ in range(40_000))
ROWS = [(None, None), (None, "a b"), (1, ""), (1, "x y"), (1, "x y"), (2, LONG), (3, LONG), (4, " \n"), (5, "w" * 200_000)]
CLASHING = ["chunk", "part", "kind", "keys", "order", "fp", "component", "row", "ids", "mask", "items", "c0", "u", "v", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    kinds = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in ROWS], kinds).repartition(3)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {None: 2, 1: 3, 2: 1, 3: 1, 4: 1, 5: 1}
    return out


def test_substring(docs):
    got = by_id(substring_dedup(docs))
    words = len(LONG.split())
    assert (got[2][0].n_words, got[2][0].n_removed) == (words, 0)
    assert (got[3][0].n_words, got[3][0].n_removed, got[3][0].kept) == (words, words, "")
    assert all(r.n_removed == 0 for i in (None, 1, 4, 5) for r in got[i])


def test_suffix(docs):
    got = by_id(suffix_dedup(docs))
    n = len(LONG.encode())
    for i in (2, 3):
        assert (got[i][0].n_bytes, got[i][0].n_removed, got[i][0].n_spans) == (n, n, 1)
    assert (got[5][0].n_removed, got[5][0].n_spans) == (200_000, 1)
    assert all(r.n_removed == 0 for i in (None, 1, 4) for r in got[i])


def test_simhash(docs):
    got = by_id(simhash_dedup(docs))
    assert got[2][0].component_id == got[3][0].component_id == 2
    assert got[4][0].component_id == 1 and {r.component_id for r in got[1]} == {1}  # empty texts are linked
    assert got[2][0].fingerprint == f"{dict(brute.simhash([(2, LONG)])[0])[2]:016x}"


def test_decontamination(spark, docs):
    w = LONG.split()
    bench = spark.createDataFrame([("t", " ".join(w[39_000:39_030]), 1), ("t", None, 2), (None, "x y", 3)], "item_id string, text string, mask int")
    got = by_id(decontamination(docs, bench))
    want = {r[0]: r for r in brute.contamination([(2, LONG), (5, "w" * 200_000)], [("t", " ".join(w[39_000:39_030])), ("", "x y")])}
    for i in (2, 5):
        assert tuple(got[i][0]) == want[i]
    assert {r.contaminated for r in got[1]} == {True, False} and [r.n_words for r in got[4]] == [0]
    kept = decontamination(docs, bench, columns=docs.columns)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == len(ROWS)


def test_pii_and_quality(spark, docs):
    got = by_id(find_pii(docs))
    assert [(c.start, c.kind, c.end) for c in got[2][0].pii if c.base] == brute.pii(LONG)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    judged = by_id(quality_classifier(docs, labels, columns=docs.columns))
    assert all(0 <= r.tail_prob <= 1 for rows in judged.values() for r in rows)


def test_packing(docs):
    got = packing(docs, with_ids=True).collect()
    total = {i: sum(r.length for r in got if r.doc_id == i) for i in {i for i, _ in ROWS}}
    assert total[2] == total[3] > 40_000 and total[4] == 1 and total[1] == sum(r.doc_tokens for r in got if r.doc_id == 1 and r.start == 0)
    full = {}
    for r in got:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert sorted(full.values())[1:] == [4096] * (len(full) - 1) or sorted(full.values()) == [4096] * len(full)


def test_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "\\" * 50_000 + "###" * 20_000), (None, 0, None, None), (None, 0, None, None), (2, None, "assistant", ""), (3, 7, "user", "x")] + [(9, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame([(*r, "s", True) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss boolean")
    got = {r.conv_id: r for r in read_back(chat_segments(df)).collect()}
    assert set(got) == {1, None, 2, 3, 9} and got[9].n_turns == 3000 and got[9].valid and not got[3].valid
    assert got[1].loss_chars == 110_000 and got[1].loss_sha256 == brute.sha(rows[1][3].encode())
    assert got[None].n_turns == 2 and got[None].turns_sha256 == brute.sha(b"\n\n\n\n")


def test_long_words_and_numpy_limits():
    from millrace.llm.textbytes import buffer_of, rolling, space_split, words_of
    import pyarrow as pa

    buf, off = buffer_of(pa.array(["", None, "a" * 100_000, "b"]))
    starts, ends, hashes, first = words_of(buf, off, space_split())
    assert (ends - starts).tolist() == [100_000, 1] and first.tolist() == [0, 0, 0, 1, 2] and len(np.unique(hashes)) == 2
    assert len(rolling(hashes, 3)) == 0


def test_embeddings_and_urls(spark):
    from millrace.llm.embedding_dedup import embedding_dedup
    from millrace.llm.url_filters import rule_table, url_filters

    names = ["cls", "code", "key", "block", "a", "b", "host", "path", "rule", "verdict", "h", "p", "digest"]
    more = ", ".join(f"`{c}` string" for c in names)
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.001], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [1.0, 0.0], None), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1)]
    df = spark.createDataFrame([(*r, *names) for r in rows], f"vec_id long, embedding array<double>, label int, {more}")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect())
    assert got == [(-1, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    urls = [(1, None), (None, "http://a.com/en/x"), (2, ""), (2, "HTTP://A.COM/en/" + "y" * 50_000), (3, "http://a.com/en/x")]
    pages = spark.createDataFrame([(*r, *names) for r in urls], f"page_id long, url string, {more}")
    got = sorted(((r.page_id or -1, r.host, len(r.path), r.verdict) for r in url_filters(pages, rule_table(spark)).collect()), key=str)
    assert got == sorted([(1, "", 0, "allow"), (-1, "a.com", 5, "block"), (2, "", 0, "allow"), (2, "a.com", 50_004, "block"), (3, "a.com", 5, "block")], key=str)
