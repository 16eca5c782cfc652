import gzip
import hashlib
import random

import pytest

from millrace.llm.common import new_folder
from millrace.llm.warc import BREAK, NOTHING, gaps, member, page_record, read_warc, record, resolved, salvaged, write_warc

BIG = "é<p>WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 50
PAGES = [(1, "http://a/ b\r\nX: y", BIG), (2, "http://b/é", BIG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "x" * 100), (7, "u", "x" * 100), (8, "u", "y" * 99), (9, "u", "y" * 99), (None, "u", BIG), (None, "v", "z" * 300)]
SCHEMA = "page_id long, url string, html string, first string, refers_to string, payload_digest string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "f", "r", "d") for r in rows], SCHEMA)


def sha(s):
    return hashlib.sha256((s or "").encode()).hexdigest()


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("segment", [1, 5000, 1 << 22])
def test_round_trip(spark, compress, segment):
    folder = new_folder(spark, "warc")
    write_warc(pages(spark), folder, gzip=compress, segment=segment)
    read = read_warc(spark, folder, payloads=True)
    assert gaps(read).count() == 0
    rows = resolved(read).where("type <> 'warcinfo'").collect()
    first = {sha(BIG): 1, sha("x" * 100): 6}
    want = []
    for i, _, html in PAGES:
        to = first.get(sha(html)) if html and len(html.encode()) >= 100 else None
        to = None if to == i else to
        want.append((f"<urn:page:{'' if i is None else i}>", "response" if to is None else "revisit", to and f"<urn:page:{to}>", len((html or "").encode()), sha(html), True))
    got = [(r.record_id, r.type, r.refers_to, r.payload_bytes, r.payload_digest, r.resolved) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in rows if r.type == "response"} == {h or "" for _, _, h in PAGES}
    assert {r.target_uri for r in rows} == {"http://a/%20b%0D%0AX:%20y", "http://b/%C3%A9", "", "u", "v"}


def test_files_are_ordinary_archives(spark):
    folder = new_folder(spark, "warc")
    write_warc(pages(spark).coalesce(1), folder)
    for r in spark.read.format("binaryFile").load(folder).collect():
        text = gzip.decompress(bytes(r.content))
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(BREAK)


def test_empty_table(spark):
    folder = new_folder(spark, "warc")
    write_warc(pages(spark).where("false"), folder)
    assert resolved(read_warc(spark, folder)).count() == 0


def test_unresolved(spark):
    folder = new_folder(spark, "warc")
    lost = member(page_record(2, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), 1) + BREAK)
    spark.createDataFrame([(bytearray(lost),)], "x binary").selectExpr("cast(x as string)").write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    row = resolved(read_warc(spark, folder)).first()
    assert (row.type, row.payload_bytes, row.refers_to, row.resolved) == ("revisit", 200, "<urn:page:1>", False)


def archive(compress, n=12, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        html = bytes(rnd.choice(b"abc \r\n<>") for _ in range(rnd.randint(0, 3000)))
        one = page_record(i, "u", html, hashlib.sha256(html).hexdigest(), None) + BREAK
        out.append(member(one) if compress else one)
    return out


def ids(raw):
    found = [*salvaged(raw)]
    assert all(a < b for a, b, _, _ in found) and all(x[1] <= y[0] or x[:2] == y[:2] for x, y in zip(found, found[1:]))
    return [int(r["record_id"][10:-1]) for _, _, _, r in found if r], [(a, b, p) for a, b, p, _ in found if p]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    whole = b"".join(parts)
    at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    assert ids(whole) == ([*range(12)], [])
    for i in (0, 5, 11):  # one byte of a record's middle
        broken = bytearray(whole)
        broken[(at[i] + at[i + 1]) // 2] ^= 0x55
        got, lost = ids(bytes(broken))
        assert got == [k for k in range(12) if k != i] and [(a, b) for a, b, _ in lost] == [(at[i], at[i + 1])]
    got, lost = ids(whole[: at[7] + 30])  # cut off
    assert got == [*range(7)] and lost[0][:2] == (at[7], at[7] + 30)
    got, lost = ids(whole[at[2] + 17 :])  # begins within a record
    assert got == [*range(3, 12)] and lost[0][:2] == (0, at[3] - at[2] - 17)
    noise = bytes(random.Random(1).randrange(256) for _ in range(5000)) + b"\n" + b"\x1f\x8b\x08" * 5 + b"\nWARC/1.1\r\nfoo\r\n\r\n"
    got, lost = ids(b"".join(parts[:4]) + noise + b"".join(parts[4:]))
    assert got == [*range(12)] and [(a, b) for a, b, _ in lost] == [(at[4], at[4] + len(noise))]
    assert ids(b"") == ([], []) and ids(noise)[0] == []


def test_mixed_and_foreign_records():
    one, two = archive(True, 1)[0], archive(False, 1)[0]
    old = b"WARC/1.0\r\nwarc-type: metadata\r\nWARC-Record-ID: <urn:page:77>\r\nWARC-Block-Digest: sha1:" + __import__("base64").b32encode(hashlib.sha1(b"a: b").digest()) + b"\r\nX:\r\n folded\r\nContent-Length: 4\r\n\r\na: b" + BREAK
    wrong = old.replace(b"a: b", b"a: c")
    assert ids(one + two + old + one)[0] == [0, 0, 77, 0]
    got, lost = ids(two + wrong + two)
    assert got == [0, 0] and lost == [(len(two), len(two) + len(wrong), "wrong block digest")]
    many = member(two + old)  # two records in one member
    assert ids(many)[0] == [0, 77]
    short = record("metadata", "<urn:page:5>", "t", b"abc").replace(b"Length: 3", b"Length: 999") + BREAK
    got, lost = ids(short + two)
    assert got == [0] and lost == [(0, len(short), "length that doesn't fit")]
