"""Very long hosts and texts with very many spans."""

import time

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm.pii import find_pii, redacted
from millrace.llm.url_filters import rule_table, url_filters


def test_host_of_a_megabyte(spark):
    host = "a." * 500_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/7"), (2, f"http://{host}/en/8"), (None, None)], "page_id long, url string")
    start = time.perf_counter()
    got = {r.page_id: (len(r.host), r.rule, r.verdict) for r in url_filters(pages, rule_table(spark)).collect()}
    assert time.perf_counter() - start < 20
    assert got == {1: (len(host), "example.com/en/7", "allow"), 2: (len(host), "com/en/", "block"), None: (0, None, "allow")}


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_redaction_equals_plain_slices(spark, n):
    spans = [(i * 7 + i % 3, i % 4, i * 7 + 3 + i % 6) for i in range(n)]
    text = "".join(chr(97 + i % 26) if i % 11 else "é𝄞"[i % 2] for i in range(n * 7 + 50))
    want, pos = "", 0
    for s, k, e in spans:
        if s >= pos:
            want += text[pos:s] + f"[{('email', 'ip', 'card', 'phone')[k].upper()}]"
        pos = max(pos, e)
    want += text[pos:]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,kind:int,end:int>>")
    assert df.select(redacted(F.col("text"), F.col("spans"))).first()[0] == (want if n else text)


def test_a_hundred_thousand_spans(spark):
    text = "".join(f"u{i % 10}@b{i % 7}.de xx " for i in range(100_000))
    spans = [(m[0], m[1], m[2]) for m in brute.pii(text)]
    assert len(spans) == 100_000
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,kind:int,end:int>>").cache()
    df.count()
    start = time.perf_counter()
    assert df.select(redacted(F.col("text"), F.col("spans"))).first()[0] == "[EMAIL] xx " * 100_000
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("n", [2000, 30_000])
def test_finding_many_spans(spark, n):
    text = "".join(f"u{i % 10}@b{i % 7}.de xx " for i in range(n))
    got = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(c.start, c.kind, c.end) for c in got.pii if c.base] == brute.pii(text)
