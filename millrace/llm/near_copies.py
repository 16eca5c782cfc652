"""Near copies by Jaccard similarity of word shingles, for the pipeline's near_dedup stage.

op6's contract fixes 3-word shingles and 3 bits, which reaches few pairs at a similarity of 0.8
(they differ by about ten of 64 bits).  What op6 leaves is compared here by 5-word shingles.

Candidates share a band of `ROWS` minhashes; with `BANDS` bands a pair at the threshold is a
candidate with probability 1 - (1 - 0.8**5)**24 = 0.99993, and a more similar one more surely.
Members of a band key come together with their texts and are verified exactly on their sets of
shingles (of 64-bit hashes).  Pairs that are already connected there aren't compared again, so
that a large group of near copies costs about its length.  Components come from joins.

Words are lower-cased (A-Z) and cut at space and 09 to 0D; a text of fewer than five words is
one shingle.  Null and empty texts have no shingle and are nobody's copies here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components
from .textbytes import U, buffer_of, inside, lower_table, mix, release, rolling, space_split, words_of

SHINGLE, ROWS, BANDS, SEED = 5, 5, 24, 77
#: The similarity as a fraction, so that the comparison is exact.
OVER, UNDER = 4, 5
#: Bytes of text that are hashed at once.
BYTES_AT_ONCE = 2 << 20


def shingles(column, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, first): text d has the hashes first[d]:first[d+1]."""
    buf, off = buffer_of(column)
    _, _, h, first = words_of(lower_table()[buf], off, space_split())
    counts = np.diff(first)
    grams = rolling(h, shingle)
    grams = grams[inside(first, shingle, len(h))] if len(grams) else grams
    long = np.maximum(counts - shingle + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    out_first = np.concatenate([[0], np.cumsum(long + ((counts > 0) & (counts < shingle)))])
    whole = np.array([rolling(h[first[d] : first[d + 1]], int(counts[d]))[0] for d in short], U)
    return np.insert(grams, np.concatenate([[0], np.cumsum(long)])[short], whole), out_first


def band_keys(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the texts that have shingles, their BANDS keys as rows)."""
    some = np.flatnonzero(np.diff(first))
    keys = np.zeros((len(some), BANDS), U)
    if len(some):
        rng = np.random.default_rng(SEED)
        for band in range(BANDS):
            key = np.full(len(some), band, U)
            for factor in rng.integers(0, 2**63, ROWS, U) * U(2) + U(1):
                key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(grams * factor, first[some]))
            keys[:, band] = key
    return some, keys


def blocks(column):
    """Slices (from, to) of a text column with about BYTES_AT_ONCE each."""
    off = buffer_of(column)[1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BYTES_AT_ONCE, "right")) - 1)
        yield i, j
        i = j


def keyed(batches):
    for batch in batches:
        text = batch.column(1)
        for i, j in blocks(text):
            some, keys = band_keys(*shingles(text.slice(i, j - i)))
            ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)[some] if len(some) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS), pa.int64()), pa.array(keys.ravel().view(np.int64), pa.int64())], ["id", "key"])
        release()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sets (ascending, each value once) OVER/UNDER or more?"""
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def connected(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges, each member's two at most, that connect the members which similar pairs connect."""
    root = np.arange(len(sets))
    for shift in range(1, len(sets)):
        for i in np.flatnonzero(root[:-shift] != root[shift:]).tolist():
            if root[i] != root[i + shift] and similar(sets[i], sets[i + shift]):
                low, high = sorted((root[i], root[i + shift]))
                root[root == high] = low
        if not root.any():
            break
    order = np.argsort(root, kind="stable")
    return [(int(x), int(y)) for x, y in zip(order[:-1], order[1:]) if root[x] == root[y]]


def verified(batches):
    """Edges of each bucket from rows (bucket, id, text) that are sorted by bucket."""
    bucket, ids, sets = None, [], []

    def edges():
        found = connected(sets)
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        text = batch.column(2)
        for i, j in blocks(text):
            grams, first = shingles(text.slice(i, j - i))
            for k, (b, d) in enumerate(zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist())):
                if b != bucket:
                    if len(ids) > 1:
                        yield edges()
                    bucket, ids, sets = b, [], []
                ids.append(d)
                sets.append(np.unique(grams[first[k] : first[k + 1]]))
    if len(ids) > 1:
        yield edges()


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component): rows with a near copy, and the smallest id that they reach; docs holds each id once, and none null."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    keys = rows.mapInArrow(keyed, "id long, key long")
    members = keys.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    # the same members under several keys are compared once
    members = checkpoint(members.groupBy("ids").agg(F.min("key").alias("bucket")).select("bucket", F.explode("ids").alias("id")))
    together = members.join(rows, "id").select("bucket", "id", "text").repartition("bucket").sortWithinPartitions("bucket", "id")
    return components(together.mapInArrow(verified, "a long, b long")).select(F.col("node").alias("id"), "component")
