"""Operator 4, packing along a space-filling curve.

1. Documents become token ids.  White space separates tokens, so ids are looked up by
   white-space-free piece of text, and only new pieces are encoded (see Known).  The ids are
   hashed to a vector of three coordinates a document (the mean of its ids' fixed random
   vectors).  Ids and coordinates are written once, compressed, to the shared folder.
2. Coordinates are centred and scaled by the whole table's means and deviations, cut into
   1024 cells each, and numbered along a Hilbert curve.
3. Documents are range-sorted by Hilbert number (then doc_id), and each gets the number of
   ids before it in the whole order: sums within ranges, plus the totals of the ranges
   before, one a range.
4. The order is one stream of ids, cut every `size` (4096): neighbours on the curve share
   sequences, every sequence but the last is full, and each document gives its pieces by itself.

Copies have one Hilbert number; doc_id and a row number split them over ranges.  Null and
empty texts are one id, the end.  Rows that repeat a doc_id are documents of their own; rows without one come last among copies.
A very long text is encoded by one task, piece by piece, and spans as many sequences as it needs.  Equal rows get pieces of equal
content; which of them comes first is left open.  An empty table gives no rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, written
from .textbytes import U, mix, release

SIZE, END, BITS, AXES, VOCABULARY = 4096, 2, 10, 3, 49_408
#: Pieces of text whose ids a worker keeps.
KEPT_PIECES = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Pieces of text (between white space) of these characters are cut and looked up here; all others go to the tokenizer.
PLAIN = r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+"  # without the one letter whose lower case is two
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Known(dict):
    """Packed 16-bit ids by white-space-free piece of text; unknown pieces are encoded and kept.

    The tokenizer's vocabulary numbers bytes first (with the end-of-word mark as a byte of its own, FF, which
    UTF-8 lacks), then merges in their order, and merges each of its tokens from bytes to itself.  Then merging the
    neighbours whose union is the first token of the vocabulary gives what its list of merges gives.
    """

    def __init__(self, path: str, kept: int):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.signs: dict[str, bytes] = {}
        self.kept, self.tokenizer = kept, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special, end = {x["content"] for x in spec["added_tokens"]}, spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in special:
                closed = token.endswith(end) and token != end
                ranks[bytes(byte[c] for c in (token[: -len(end)] if closed else token)) + b"\xff" * closed] = number
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cut = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
        self.plain = regex.compile(PLAIN).fullmatch

    def one(self, piece: str) -> bytes:
        return array("H", self.merge(piece.lower().encode() + b"\xff")).tobytes()

    def is_plain(self, piece: str) -> bool:
        return (piece.isprintable() if piece.isascii() else self.plain(piece) is not None) and "<|" not in piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.kept:
            self.clear()
            self[""] = b""
        if not self.is_plain(piece):
            out = array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        elif piece.isalpha():
            out = self.one(piece)
        else:
            core = piece.rstrip(SIGNS)
            if core.isalpha():
                tail = piece[len(core) :]
                signs = self.signs.get(tail)
                if signs is None:
                    signs = self.one(tail)
                    if len(self.signs) < self.kept:
                        self.signs[tail] = signs
                out = self[core] + signs
            else:
                out = b"".join(map(self.one, self.cut(piece.lower())))
        self[piece] = out
        return out


class Encoder:
    """Ids of texts as packed 16-bit numbers."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.known = Known(path, kept)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]

    @staticmethod
    def of_worker(path: str) -> "Encoder":
        """One encoder for all tasks of a Python worker."""
        import public_tokenizers

        held = public_tokenizers.__dict__.setdefault("encoders_of_this_worker", {})
        if path not in held:
            held[path] = Encoder(path)
        return held[path]


def token_vectors(n: int = VOCABULARY, axes: int = AXES) -> np.ndarray:
    """Fixed pseudo-random coordinates in -1..1 of each id."""
    h = mix(np.arange(n * axes, dtype=U) * U(0x9E3779B97F4A7C15) + U(11))
    return (h.astype(np.float64) / 2**63 - 1).astype(np.float32).reshape(n, axes)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of rows of cells (one column an axis), after Skilling."""
    x = cells.astype(np.int64).T.copy()
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[axes - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[i] >> b & 1)
    return out


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n (with the end id), ids (16-bit, little-endian), x0, x1, x2."""
    where = path or tokenizer_path()
    names = ["doc_id", "n", "ids", *(f"x{i}" for i in range(AXES))]

    def each(batches):
        encoder, vectors, end = Encoder.of_worker(where), np.ascontiguousarray(token_vectors().T), np.array([END], np.uint16).tobytes()
        for whole in batches:
            release()
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [x + end for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
                size = np.array([len(x) // 2 for x in ids], np.int64)
                flat, first = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(size) - size
                means = [np.add.reduceat(axis[flat], first, dtype=np.float64) / size for axis in vectors]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(ids, pa.binary()), *map(pa.array, means)], names)

    kinds = "doc_id long, n long, ids binary, " + ", ".join(f"x{i} double" for i in range(AXES))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, kinds)


def curve_order(rows: DataFrame) -> DataFrame:
    """row, before: the number of ids before each document along the curve.  rows: row, doc_id, n, x0, x1, x2."""
    axes = [f"x{i}" for i in range(AXES)]
    stats = rows.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{f.__name__}_{c}") for c in axes for f in (F.avg, F.stddev_pop))).first()
    centre, spread = np.array([stats[f"avg_{c}"] for c in axes]), np.array([stats[f"stddev_pop_{c}"] or 1.0 for c in axes])

    def number(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(3, 3 + AXES)], axis=1)
            cells = np.clip(((x - centre) / spread + 3) / 6 * 2**BITS, 0, 2**BITS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hilbert(cells))], ["row", "doc_id", "n", "place"])

    placed = rows.select("row", "doc_id", "n", *axes).mapInArrow(number, "row long, doc_id long, n long, place long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(placed.repartitionByRange(parts, "place", "doc_id", "row").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # a row a range: no more than there are partitions
    begin = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    along = Window.partitionBy("part").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.col("begin") + F.coalesce(F.sum("n").over(along), F.lit(0))).cast("long")
    return ranged.join(F.broadcast(begin), "part").select("row", before.alias("before"))


def packing(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids: ids (16-bit, binary)."""
    rows = written(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "table")
    order = curve_order(rows)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        for batch in batches:
            out = []
            for doc, ids, before in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, start = np.frombuffer(ids, "<u2"), 0
                while start < len(x):
                    sequence, offset = divmod(before + start, size)
                    piece = x[start : start + size - offset]
                    out.append((doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(x), sequence, offset, piece.tobytes()))
                    start += len(piece)
            cols = list(zip(*out)) if out else [[]] * 8
            arrays = [pa.array(list(c), pa.int64()) for c in cols[:7]] + [pa.array(list(cols[7]), pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return rows.join(order, "row").select("doc_id", "ids", "before").mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids)


def op4_packing(spark, sf_dir) -> DataFrame:
    from .common import read

    return packing(read(spark, sf_dir, "documents"))
