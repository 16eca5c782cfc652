"""Operator 12, WARC archives: a writer with revisits, and a reader that salvages damaged archives.

Writing.  Of pages with equal payloads of LEAST bytes or more, the one of smallest page_id is a response and the others
revisit it; smaller ones are all responses.  Rows meet their group's smallest id in a join on the payload's digest, whose
hot keys Spark splits.  Tasks pack records (one gzip member each, or plain) into segments of about SEGMENT bytes, which
the text sink commits as files of one segment: no file grows with its task, and a lost executor's files are never committed.
Between segments and at a file's end the sink's separator is an empty gzip member, or the end of a plain record.

Reading.  Archives are read as whole files of about SEGMENT bytes.  A record holds if its member inflates with the right
checksum, its version line, header and length fit, it ends with two empty lines and its digests are right.  Otherwise
1. if its extent is known all the same (an intact member, or a plain record that ends before another's start), that extent is a gap;
2. if not, the reader searches for the next member or version line from which a whole record can be read, and what lies between is a gap.
Gaps come as rows of their own with their bytes' range and the problem; records after them are recovered.  What a damaged record's
payload quotes as a whole valid record is taken for one.

A null html is empty.  A null page_id comes back null; such a row is a response if nobody of its group has an id, else a revisit.  Of rows
that repeat page_id and payload each is what the first is.  A null url is empty; control characters, blanks and non-ASCII characters
in it are percent-encoded.  An empty table gives no records.  A record, however long, must fit into its task's memory.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_folder, read, written

LEAST, SEGMENT, LEVEL, DATE, LONGEST_HEADER = 100, 4 << 20, 5, "1970-01-01T00:00:00Z", 1 << 16
MAGIC, BREAK, START = b"\x1f\x8b\x08", b"\r\n\r\n", b"WARC/"
#: A gzip member of no bytes.
NOTHING = zlib.compressobj(9, zlib.DEFLATED, 31)
NOTHING = NOTHING.compress(b"") + NOTHING.flush()
#: The names of digests in headers, with the names that hashlib has for them.
DIGESTS = {b"sha256": "sha256", b"sha-256": "sha256", b"sha1": "sha1", b"md5": "md5"}
FIELDS = ["version", "type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes"]
RECORDS = "path string, start long, end long, problem string, version string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


# Writing


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to); refers_to is null for responses."""
    html = F.coalesce(col("html").cast("string"), F.lit(""))
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    long = rows.where(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    # no repartitioning and an equi-join: Spark splits the partition of a hot payload
    return rows.join(long, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))).drop("first")


def record(kind: str, record_id: str, content_type: str, block: bytes, **more: str) -> bytes:
    """A record without the two empty lines behind it; fields by name, _ for -."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "Content-Type": content_type, **{"WARC-" + k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block


def page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"Target_URI": quote(url or "", safe="".join(map(chr, range(33, 127)))), "Payload_Digest": f"sha256:{digest}"}
    if refers_to is None:
        return record("response", page_urn(page_id), "application/http;msgtype=response", http + payload, **more)
    more |= {"Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers_To": page_urn(refers_to), "Block_Digest": f"sha256:{hashlib.sha256(http).hexdigest()}"}
    return record("revisit", page_urn(page_id), "application/http;msgtype=response", http, **more)


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def segments(gzip: bool, segment: int):
    """Records of a task, joined to segments; each begins with a warcinfo record."""
    info = record("warcinfo", "<urn:info:0>", "application/warc-fields", b"format: WARC File Format 1.1\r\n")

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b[c].cast(pa.binary()).to_pylist() if c == "html" else b[c].to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                one = page_record(page_id, url, html, digest, refers_to)
                for x in (one,) if held else (info, one):
                    held.append(member(x + BREAK) if gzip else x)
                    size += len(held[-1])
                if size >= segment:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([(b"" if gzip else BREAK).join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([(b"" if gzip else BREAK).join(held)], pa.binary())})

    return pack


def write_warc(pages: DataFrame, folder: str, gzip: bool = True, segment: int = SEGMENT, least: int = LEAST) -> None:
    """Archives of pages (page_id, url, html) as files of a segment each in a new folder."""
    packed = typed(pages, least).select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(segments(gzip, segment), "segment binary")
    separator = (NOTHING if gzip else BREAK).decode("latin-1")  # the sink encodes it back to these bytes
    packed.select(F.col("segment").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(folder)


# Reading


def fits(declared: bytes, data: bytes) -> bool:
    """Whether a digest "name:value" (hexadecimal or base32) is that of data; one of an unknown name isn't checked."""
    name, _, value = declared.partition(b":")
    if name.lower() not in DIGESTS:
        return True
    digest = hashlib.new(DIGESTS[name.lower()], data).digest()
    return value.lower() == digest.hex().encode() or value.upper().rstrip(b"=") == base64.b32encode(digest).rstrip(b"=")


def parsed(raw: bytes, at: int) -> tuple[str | None, dict | None, int | None]:
    """(problem, record, end) of the plain record at a place; an end with a problem says how far it goes all the same."""
    version = re.compile(rb"WARC/(\d+\.\d+)\r\n").match(raw, at)
    if not version:
        return "no version line", None, None
    stop = raw.find(BREAK, version.end() - 2, at + LONGEST_HEADER)
    if stop < 0:
        return "header without end", None, None
    fields, name = {}, b""
    for line in raw[version.end() : stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without a name", None, None
        name = name.strip().lower()
        fields[name] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15:
        return "no content length", None, None
    start = stop + len(BREAK)
    end = start + int(length)
    if raw[end : end + len(BREAK)] != BREAK:
        return "length that doesn't fit", None, None
    block = raw[start:end]
    said = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind = said(b"warc-type")
    payload, http = block, b""
    if b"application/http" in fields.get(b"content-type", b"").lower():
        http, _, payload = block.partition(BREAK)
    for what, data in ((b"block", block), (b"payload", payload)):
        if (what == b"block" or kind != "revisit") and (declared := fields.get(b"warc-" + what + b"-digest")) and not fits(declared, data):
            return f"wrong {what.decode()} digest", None, end + len(BREAK)
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":  # what it refers to has the payload
        length = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", http, re.M)
        size, digest = int(length[1]) if length else None, (said(b"warc-payload-digest") or "").partition(":")[2] or None
    return None, {"version": version[1].decode(), "type": kind, "record_id": said(b"warc-record-id"), "target_uri": said(b"warc-target-uri"), "refers_to": said(b"warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload}, end + len(BREAK)


def inflated(raw: bytes, at: int, piece: int = 1 << 18) -> tuple[bytes, int] | None:
    """What the gzip member at a place holds, and its end; None if it is damaged."""
    z, out, view = zlib.decompressobj(31), [], memoryview(raw)
    try:
        while not z.eof:
            if at >= len(raw):
                return None
            out.append(z.decompress(view[at : at + piece]))
            at += min(piece, len(raw) - at)
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def read_at(raw: bytes, at: int) -> tuple[str | None, list[dict], int | None]:
    """(problem, records, end) of the member or plain record at a place."""
    if not raw.startswith(MAGIC, at):
        problem, one, end = parsed(raw, at)
        if problem and end is not None and end < len(raw) and not raw.startswith((START, MAGIC), end):
            end = None  # two empty lines there are chance
        return problem, [one] if one else [], end
    opened = inflated(raw, at)
    if not opened:
        return "damaged member", [], None
    data, end = opened
    records, i = [], 0
    while i < len(data):
        problem, one, i = parsed(data, i)
        if problem:
            return problem, records, end
        records.append(one)
    return None, records, end


def next_valid(raw: bytes, at: int) -> int:
    """The next place from which a whole record can be read; the end if there is none."""
    while True:
        found = [i for i in (raw.find(MAGIC, at), raw.find(START, at)) if i >= 0]
        if not found:
            return len(raw)
        at = min(found)
        if raw.startswith(MAGIC, at) or at == 0 or raw[at - 1 : at] == b"\n":
            problem, records, _ = read_at(raw, at)
            if not problem and records:
                return at
        at += 1


def salvaged(raw: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(start, end, problem, record): records of an archive, and its gaps, in order."""
    at = 0
    while at < len(raw):
        if raw[at] in b"\r\n":  # empty lines between records
            at += 1
            continue
        problem, records, end = read_at(raw, at)
        if problem and end is None:
            end = next_valid(raw, at + 1)
        for r in records:
            yield at, end, None, r
        if problem:
            yield at, end, problem, None
        at = end


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """RECORDS of the archives in a folder; rows with a problem are gaps.  payloads: with the payload's bytes."""

    def rows(batches):
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                held, size = [], 0
                for start, end, problem, r in salvaged(raw):
                    held.append((path, start, end, problem, *((r or {}).get(f) for f in FIELDS), *([(r or {}).get("payload")] if payloads else [])))
                    size += 500 + payloads * len((r or {}).get("payload") or b"")
                    if size > SEGMENT:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * payloads
    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*held))], names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(rows, RECORDS + ", payload binary" * payloads)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes: (path, start, end, problem)."""
    return records.where("problem is not null").select("path", "start", "end", "problem")


def resolved(records: DataFrame) -> DataFrame:
    """Records with `resolved`: of a revisit, whether a response of that id and payload was read."""
    good = records.where("problem is null")
    responses = good.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct().withColumn("resolved", F.lit(True))
    revisits = good.where("type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return good.where("type <> 'revisit'").withColumn("resolved", F.lit(True)).unionByName(revisits)


def op12_warc(spark, sf_dir) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, resolved."""
    folder = new_folder(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), folder)
    records = resolved(written(read_warc(spark, folder), "records")).where("type in ('response', 'revisit')")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "resolved")


OP12_SQL = """
WITH r AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS resolved FROM f
"""
