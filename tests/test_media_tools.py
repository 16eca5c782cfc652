import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import tools as T
from millrace.sources import generators, media


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 70_000 % 65_536) + b"x" * (70_000 % 65_536 - 2) + b"\xff\xff\xc4\x00\x04ab" + b"\xff\xd0" + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 300, 200, 3)
    webp = {
        "lossy": b"RIFF....WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 0x4000 | 33, 44), "lossless": b"RIFF....WEBPVP8L" + b"\0" * 5 + struct.pack("<I", (55 - 1) | (66 - 1) << 14),
        "extended": b"RIFF....WEBPVP8X" + b"\0" * 8 + (77 - 1).to_bytes(3, "little") + (88 - 1).to_bytes(3, "little"),
    }
    assert media.header_size(png) == ("png", 640, 480) and media.header_size(jpeg) == ("jpeg", 200, 300)
    assert [media.header_size(w)[1:] for w in webp.values()] == [(33, 44), (55, 66), (77, 88)]
    assert media.header_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == ("gif", 7, 9) and media.header_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == ("bmp", 5, 6)
    for cut in (png[:20], jpeg[:100], b"\xff\xd8", b"GIF87a", b"BM", webp["lossy"][:20]):
        assert media.header_size(cut)[0] and media.header_size(cut)[1:] == (None, None)
    assert [media.header_size(x) for x in (None, b"", b"<html>")] == [(None, None, None)] * 3


def test_images_of_a_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 4000, 1000))
    (tmp_path / "b.txt").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.images(spark, str(tmp_path), 1_000_000).collect()}
    assert (got["a.png"].width, got["a.png"].height, tuple(got["a.png"].capped)) == (4000, 1000, (2000, 500)) and got["b.txt"].format is None and got["b.txt"].capped is None
    assert tuple(media.images(spark, str(tmp_path), 0).where("format = 'png'").first().capped) == (4000, 1000)


def frames(total, rate, own, own_fps, least, most, /, **caller):
    if own is None and own_fps is None:
        own, own_fps = caller.get("frames"), caller.get("fps")
        if own_fps is not None:
            least, most = (a if a is not None else b for a, b in ((least, caller.get("least")), (most, caller.get("most"))))
    if own is not None:
        n = round(own / 2) * 2
    else:
        low, high = -(-(4 if least is None else least) // 2) * 2, (min(768, total) if most is None else most) // 2 * 2
        n = int(min(min(max(total / rate * (own_fps or 2.0), low), high), total) // 2 * 2)
    if not 2 <= n <= total:
        return None, None
    return n, [round((total - 1) * i / (n - 1)) for i in range(n)]


def test_frames(spark):
    rows = [(t, r, o, f, a, b) for t in (1, 2, 9, 300, 5000) for r in (24.0, 1.0) for o, f in ((None, None), (7, None), (None, 0.5), (None, 30.0)) for a, b in ((None, None), (10, 32))]
    df = spark.createDataFrame(rows, "total int, rate double, own int, fps double, a int, b int")
    for caller in ({}, {"frames": 16}, {"fps": 4.0, "least": 2, "most": 100}):
        rule = media.sampling(F.col("own"), F.col("fps"), F.col("a"), F.col("b"), **caller)
        out = df.withColumn("n", media.frame_count(F.col("total"), F.col("rate"), rule)).withColumn("i", media.frame_indices(F.col("total"), F.col("n")))
        for r in out.collect():
            n, at = frames(*tuple(r)[:6], **caller)
            assert (r.n, r.i) == (n, at), (r, caller)
    with pytest.raises(ValueError):
        media.sampling(F.col("own"), F.col("fps"), F.col("a"), F.col("b"), frames=1, fps=1.0)


SCHEMA = {"properties": {"q": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "number"}, "a b": {"type": "array"}}, "required": ["q"]}


def checked(s):
    try:
        v = json.loads(s or "")
    except ValueError:
        return "{}", True, ["no JSON"]
    if not isinstance(v, dict):
        return "{}", True, ["no object"]
    out = [] if "q" in v else ["missing q"]
    if "q" in v:
        out += ["type q"] if not isinstance(v["q"], str) else ["choice q"] if v["q"] not in ("x", "y") else []
    if "n" in v and (isinstance(v["n"], bool) or not isinstance(v["n"], (int, float))):
        out.append("type n")
    if "a b" in v and not isinstance(v["a b"], list):
        out.append("type a b")
    return s, False, out


def test_arguments(spark):
    values = ['{"q": "x", "n": 1.5, "a b": []}', '{"q": "z"}', '{"q": 1, "n": "2", "a b": {}}', "{}", "[1]", "5", '"s"', "null", "{bad", "", None, '{"n": 12345678901234567890, "q": "y", "more": null}', '{"q": null, "n": true}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [tuple(r.c) for r in df.select("i", T.checked_arguments("v", SCHEMA).alias("c")).orderBy("i").collect()]
    assert got == [checked(v) for v in values]
    with pytest.raises(ValueError, match="unknown type"):
        T.checked_arguments("v", {"properties": {"q": {"type": "text"}}})


def test_loose_results(spark):
    parts = [["{'query': 'a b', 'results': [{'title': 1}, [2]]}", None, "no", "\"query\" : \"c\" \"results\":\n [x\ny] 'title':"], [], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p array<string>")
    got = [r.r for r in df.select("i", T.loose_results(F.col("p")).alias("r")).orderBy("i").collect()]
    text = [p.replace("'", '"') for p in parts[0] if p]
    found = "".join(m[1] if (m := re.search(r'"results"\s*:\s*(\[.*?\])', t, re.S)) else "" for t in text)
    assert (got[0].text, got[0].queries, got[0].query_count, got[0].total_results, got[0].status) == (found, ["a b", "", "c"], 3, 2, "success")
    assert (got[1].text, got[1].query_count, got[1].status) == ("", 0, "success") and got[2].status == "unknown"


def test_generated_rows(spark, tmp_path):
    def squares(first, last):
        for i in range(first, last):
            yield i, float(i * i)

    generators.register(spark, "squares", "i long, x double", squares)
    df = spark.read.format("squares").option("rows", 1000).option("partitions", 7).load()
    assert df.rdd.getNumPartitions() == 7 and sorted(map(tuple, df.collect())) == [(i, float(i * i)) for i in range(1000)]
    assert spark.read.format("squares").option("rows", 0).load().count() == 0
    assert [(s.first, s.last) for s in generators.spans(3, 10, 3)] == [(3, 5), (5, 7), (7, 10)] and len(generators.spans(0, 2, 9)) == 2

    def run(rows):
        stream = spark.readStream.format("squares").option("rows", rows).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run(70)
    run(100)  # goes on from the checkpoint
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(100))
