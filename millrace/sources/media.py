"""Images and videos without decoding: sizes from headers, caps by size, and which frames of a video are taken."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .files import fit_size

#: Bytes of a file that its header is looked for in; a JPEG's size may stand behind a large profile.
HEADER = 1 << 20
SIZE = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())])
# The markers of JPEG frames (not 0xC4, 0xC8 and 0xCC, which are tables), and those without a length.
FRAMES, BARE = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD8)}


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame's segment; segments are passed over by their lengths."""
    at = 2
    while at + 9 <= len(raw):
        if raw[at] != 0xFF:
            return None
        mark = raw[at + 1]
        if mark == 0xFF:  # a fill byte
            at += 1
        elif mark in BARE:
            at += 2
        elif mark in FRAMES:
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def webp_size(raw: bytes) -> tuple[int, int] | None:
    """Of the three kinds of WebP: lossy, lossless, and extended."""
    kind = raw[12:16]
    if kind == b"VP8 " and len(raw) >= 30:
        width, height = struct.unpack("<HH", raw[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L" and len(raw) >= 25:
        bits = struct.unpack("<I", raw[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(raw) >= 30:
        return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
    return None


def header_size(raw: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height); the format alone where the header breaks off, nothing for what is no image."""
    raw = bytes(raw or b"")
    if raw.startswith(b"\x89PNG\r\n\x1a\n"):
        size, kind = struct.unpack(">II", raw[16:24]) if raw[12:16] == b"IHDR" and len(raw) >= 24 else None, "png"
    elif raw[:6] in (b"GIF87a", b"GIF89a"):
        size, kind = struct.unpack("<HH", raw[6:10]) if len(raw) >= 10 else None, "gif"
    elif raw.startswith(b"BM"):
        size, kind = tuple(map(abs, struct.unpack("<ii", raw[18:26]))) if len(raw) >= 26 else None, "bmp"
    elif raw.startswith(b"\xff\xd8"):
        size, kind = jpeg_size(raw), "jpeg"
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        size, kind = webp_size(raw), "webp"
    else:
        return None, None, None
    return (kind, *size) if size else (kind, None, None)


@F.pandas_udf(SIZE)
def _sizes(head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_size(h) for h in head], columns=["format", "width", "height"]).astype({"format": object, "width": "Int32", "height": "Int32"})


def image_size(content: Column) -> Column:
    """struct<format, width, height> from the first HEADER bytes."""
    return _sizes(F.substring(content, 1, HEADER))


def images(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """Files of a folder: path, length, format, width, height, and the size that a cap of `most` pixels leaves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", image_size(F.col("content")).alias("s"))
    sized = files.select("path", "length", "s.*")
    return sized.withColumn("capped", F.when(F.col("width").isNotNull(), fit_size(F.col("width").cast("double"), F.col("height").cast("double"), most) if most > 0 else F.struct("width", "height")))


# Videos


def sampling(own_frames: Column, own_fps: Column, own_least: Column, own_most: Column, frames: int | None = None, fps: float | None = None, least: int | None = None, most: int | None = None) -> Column:
    """struct<nframes, fps, least, most>: a video's own rule (a number of frames or a rate) stands before the caller's; bounds come with the rate they belong to."""
    if frames is not None and fps is not None:
        raise ValueError("either a number of frames or a rate")
    own = own_frames.isNotNull() | own_fps.isNotNull()
    pick = lambda mine, value, kind: F.when(own, mine.cast(kind)).otherwise(F.lit(value).cast(kind))
    bounds = fps is not None
    return F.struct(
        pick(own_frames, frames, "int").alias("nframes"), pick(own_fps, fps, "double").alias("fps"),
        F.coalesce(own_least.cast("int"), F.when(~own, F.lit(least if bounds else None).cast("int"))).alias("least"), F.coalesce(own_most.cast("int"), F.when(~own, F.lit(most if bounds else None).cast("int"))).alias("most"),
    )


def frame_count(total: Column, rate: Column, rule: Column, factor: int = 2) -> Column:
    """How many frames are taken of a video of `total` frames at `rate` a second: the number asked for, or as many as the rate of the rule gives, within its
    bounds (2 a second, 4 to 768, unless it says otherwise) and the video; a multiple of `factor`.  Null where that is less than `factor`."""
    down = lambda x: (F.floor(x / factor) * factor).cast("int")
    up = lambda x: (F.ceil(x / factor) * factor).cast("int")
    asked = (F.round(rule["nframes"] / factor) * factor).cast("int")
    low, high = up(F.coalesce(rule["least"], F.lit(4))), down(F.coalesce(rule["most"], F.least(F.lit(768), total)))
    wanted = F.try_divide(total.cast("double"), rate.cast("double")) * F.coalesce(rule["fps"], F.lit(2.0))
    by_rate = down(F.least(F.least(F.greatest(wanted, low), high), total))
    n = F.coalesce(asked, by_rate)
    return F.when((n >= factor) & (n <= total), n)


def frame_indices(total: Column, n: Column) -> Column:
    """n frames at even distances from the first to the last, halves to the even number."""
    at = lambda i: F.bround((total - 1).cast("double") * i / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))
