"""Operator 9, benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of `width` (13) consecutive words of each benchmark item; an
item of fewer words, but not none, is one window.  A document word inside any occurrence of
a window is hit.  A document is contaminated if at least one in 20 of its words is hit.

Patterns of one length are searched together.  A pattern set has a shift table over blocks
of BLOCK words: how far the search may jump when the block ends at the current position,
which is 0 only for blocks that end a pattern.  There, the bucket of the last BLOCK words'
hash selects patterns, and the words are compared one by one.  All documents of a batch are
searched in step: each has its own position, and one array operation moves all of them.
Long documents are cut into overlapping stretches for this, so that a batch takes few steps.

Words are compared by 64-bit hashes, and those of the patterns' vocabulary then byte for
byte, so that a word that only has a pattern word's hash isn't taken for it.

Patterns are broadcast in blocks of at most PATTERN_BYTES of item text.  A larger benchmark
is searched block by block: documents pass one block after another, and take along which of
their words were hit.  Null and empty texts
have no words, and are never contaminated; items without words have no windows.  A repeated
item_id counts once.  Equal rows get equal results; an empty table gives no rows, and without items nothing is hit.  A very long
text is searched in one task, in stretches.  Passed columns that are called like an output get "_input" behind their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, passed_names
from .textbytes import U, alnum_split, buffer_of, lower_table, release, words_of

WIDTH, BLOCK, SHARE, PATTERN_BYTES, STRETCH = 13, 2, 20, 16 << 20, 256
TEXT_AT_ONCE = 1 << 20
BETWEEN = "text string, mask binary, items array<string>"
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_in(text: bytes) -> list[bytes]:
    buf = lower_table()[np.frombuffer(text, np.uint8)]
    starts, ends, _, _ = words_of(buf, np.array([0, len(buf)]), alnum_split())
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class PatternSet:
    """All windows of one length, as rows of word numbers (1 and up), with shift table and buckets."""

    def __init__(self, rows: dict[tuple[int, ...], set]):
        self.rows = np.array(sorted(rows), np.int64)
        self.items = [sorted(rows[tuple(r)]) for r in self.rows.tolist()]
        n, self.length = self.rows.shape
        self.block = min(BLOCK, self.length)
        codes = self.codes(self.rows.reshape(-1), np.arange(self.length, n * self.length + 1, self.length) - 1)
        order = np.argsort(codes, kind="stable")
        self.tails, at = np.unique(codes[order], return_index=True)
        self.rows, self.items = self.rows[order], [self.items[i] for i in order]
        self.bucket = np.append(at, n)
        shift: dict[int, int] = {}
        flat = self.rows.reshape(-1)
        for end in range(self.block - 1, self.length):
            for c in np.unique(self.codes(flat, np.arange(n) * self.length + end)).tolist():
                shift[c] = self.length - 1 - end
        self.blocks = np.array(sorted(shift), np.int64)
        self.shifts = np.array([shift[c] for c in self.blocks.tolist()], np.int64)
        self.skip = self.length - self.block + 1

    def codes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for the block of words that ends at each position; below 0 if a word is in no pattern."""
        code, known = numbers[at], numbers[at] > 0
        if self.block > 1:
            code, known = code + (numbers[at - 1] << 32), known & (numbers[at - 1] > 0)
        return np.where(known, code, -1)

    def search(self, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(start, pattern) of all occurrences in the stretches begin:end of the word numbers."""
        starts, found = [], []
        at, end = begin + self.length - 1, end.copy()
        while True:
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
            if not len(at):
                break
            code = self.codes(numbers, at)
            i = np.minimum(np.searchsorted(self.blocks, code), len(self.blocks) - 1)
            jump = np.where(self.blocks[i] == code, self.shifts[i], self.skip)
            stop = at[jump == 0]
            if len(stop):
                b = np.searchsorted(self.tails, code[jump == 0])
                low, high = self.bucket[b], self.bucket[b + 1]
                while len(stop):
                    same = (numbers[stop[:, None] - self.length + 1 + np.arange(self.length)] == self.rows[low]).all(axis=1)
                    starts.append(stop[same] - self.length + 1)
                    found.append(low[same])
                    low = low + 1
                    more = low < high
                    stop, low, high = stop[more], low[more], high[more]
            at = at + np.maximum(jump, 1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *found])


class Benchmark:
    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        number: dict[bytes, int] = {}
        by_length: dict[int, dict] = {}
        for item, text in items:
            w = [number.setdefault(x, len(number) + 1) for x in words_in(text)]
            n = min(width, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(w[s : s + n]), set()).add(item)
        self.sets = [PatternSet(by_length[n]) for n in sorted(by_length)]
        vocabulary = list(number)
        raw = np.frombuffer(b" ".join(vocabulary), np.uint8)
        size = np.array([len(x) for x in vocabulary], np.int64)
        off = np.cumsum(size + 1) - size - 1
        _, _, h, _ = words_of(raw, np.array([0, len(raw)]), alnum_split())
        order = np.argsort(h)
        self.hashes, self.raw, self.off, self.size, self.order = h[order], raw, off[order], size[order], order + 1

    def numbers(self, buf, starts, ends, hashes) -> np.ndarray:
        """The pattern vocabulary's number of each word, 0 if it has none."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.hashes) or not len(hashes):
            return out
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero((self.hashes[i] == hashes) & (self.size[i] == ends - starts))
        i = i[at]
        ok = np.ones(len(at), bool)
        for k in range(int(self.size[i].max()) if len(i) else 0):
            has = np.flatnonzero(self.size[i] > k)
            ok[has] &= buf[starts[at[has]] + k] == self.raw[self.off[i[has]] + k]
        out[at[ok]] = self.order[i[ok]]
        return out

    def search(self, buf, off):
        """For each document: word count, flags of its words (one array), and (document, item) pairs."""
        buf = lower_table()[buf]
        starts, ends, hashes, first = words_of(buf, off, alnum_split())
        numbers = self.numbers(buf, starts, ends, hashes)
        n = np.diff(first)
        hit = np.zeros(len(numbers) + 1, np.int64)
        pairs = set()
        for p in self.sets:
            pieces = np.maximum(1, -(-n // STRETCH))
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = first[doc] + k * STRETCH
            end = np.minimum(begin + STRETCH + p.length - 1, first[doc + 1])
            at, found = p.search(numbers, begin, end)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + p.length, -1)
            of = np.searchsorted(first, at, side="right") - 1
            for d, f in set(zip(of.tolist(), found.tolist())):
                pairs.update((d, item) for item in p.items[f])
        return first, np.cumsum(hit)[:-1] > 0, pairs


def verdict(n_words, n_hit, items: list[list[str]], share: int) -> list:
    n_words, n_hit = np.asarray(n_words), np.asarray(n_hit)
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    bad = (n_hit > 0) & (share * n_hit >= n_words)
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())]


def pattern_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Items in blocks of at most block_bytes of text (one item at least), read one after another."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    for r in rows.toLocalIterator():
        raw = r.t.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i if r.i is not None else "", raw))
        size += len(raw)
    yield block


def decontamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, item_id: str = "item_id", block_bytes: int = PATTERN_BYTES, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id), then n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = pattern_blocks(benchmark, item_id, "text", block_bytes)
    columns = columns or ["doc_id"]
    n = len(columns)
    names = passed_names(columns, [x.split()[0] for x in RESULT.split(", ")])
    inner = [f"c{i}" for i in range(n)]
    kinds = ", ".join(f"{i} {t}" for i, (_, t) in zip(inner, docs.select(*map(col, columns)).dtypes))
    # a text that is passed on isn't sent twice
    own = columns.index("text") if ("text", "string") in docs.select(*map(col, columns)).dtypes else n
    extra = own == n
    after = n + extra
    between = BETWEEN if extra else BETWEEN.removeprefix("text string, ")
    rows = docs.select(*(col(c).alias(i) for c, i in zip(columns, inner)), *[F.col("text").cast("string").alias("text")] * extra, F.lit(b"").alias("mask"), F.lit(None).cast("array<string>").alias("items"))
    context = docs.sparkSession.sparkContext

    def scan(sent, last):
        def each(batches):
            bench = Benchmark(sent.value, width)
            for batch in batches:
                release()
                buf, off = buffer_of(batch.column(own))
                cut = np.unique(np.concatenate([[0], np.searchsorted(off, np.arange(TEXT_AT_ONCE, off[-1], TEXT_AT_ONCE)), [len(off) - 1]]))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    first, hit, pairs = bench.search(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    items = [set(x or ()) for x in batch.column(after + 1)[a:b].to_pylist()]
                    for d, item in pairs:
                        items[d].add(item)
                    for d, x in enumerate(batch.column(after)[a:b].to_pylist()):
                        if x:
                            hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(x, np.uint8))[: first[d + 1] - first[d]].astype(bool)
                    if last:
                        total = np.concatenate([[0], np.cumsum(hit)])
                        out = verdict(np.diff(first), total[first[1:]] - total[first[:-1]], [sorted(x) for x in items], share)
                    else:
                        masks = [np.packbits(hit[s:e]).tobytes() if hit[s:e].any() else b"" for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
                        out = [*[batch.column(n)[a:b]] * extra, pa.array(masks, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                    kept = [batch.column(i)[a:b] for i in range(n)]
                    yield pa.RecordBatch.from_arrays([*kept, *out], [*inner, *(x.split()[0] for x in (RESULT if last else between).split(", "))])

        return each

    block, passed = next(blocks), 0
    while True:
        following = next(blocks, None)
        rows = rows.mapInArrow(scan(context.broadcast(block), following is None), f"{kinds}, {RESULT if following is None else between}")
        if following is None:
            return rows.withColumnsRenamed(dict(zip(inner, names)))
        block, passed = following, passed + 1
        if passed % 4 == 0:
            rows = checkpoint(rows)


def op9_decontamination(spark, sf_dir) -> DataFrame:
    from .common import read

    return decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH raw AS (
  SELECT 0 AS item, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT item, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
iw AS (SELECT DISTINCT id AS item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
  SELECT id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM w WHERE item = 1 AND len(ws) > 0)),
dw AS (SELECT id AS doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
  SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM iw) WHERE item = 0 AND len(ws) >= n)),
occ AS (SELECT doc_id, n, s, item_id FROM dw JOIN iw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT s + j) AS n_hit FROM occ, range(13) r(j) WHERE j < n GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = id LEFT JOIN found ON found.doc_id = id WHERE item = 0
"""
