"""Operator 6, SimHash near-dedup with deletion-variant signatures.

A document's fingerprint has bit b set if over half the XXH64 values of its word shingles
have it.  Fingerprints link at `distance` (3) or fewer differing bits.

Four segments would be needed for one of them to be equal in a linked pair.  Cut into two
segments of 32 bits instead, one of them differs by at most one bit.  Each distinct
fingerprint is indexed under 64 signatures: a segment with one of its bits wiped out, and
which bit that was.  Linked pairs have a signature in common; pairs under a signature are
verified by their number of differing bits.

Copies have one fingerprint and are one row of the index.  Signatures are dealt to parts as
packed blobs; there are so many parts that each holds about SIGNATURES_A_PART of them.  A signature of more than
`block` fingerprints is cut into blocks, and each pair of blocks is compared in a task of its own.  A part returns the links
that it finds as chains, which connect what is linked: never all pairs of a group, and no node with many
edges.  Components come from joins of these edges.

Null and empty texts have fingerprint zero and are linked like any other.  A very long text is hashed in one task,
its bits counted BITS_AT_ONCE shingles at a time.  Equal rows get equal results; an empty table gives no rows.  A row without doc_id takes part, but is nobody's
representative unless its group has no doc_id at all.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components
from .textbytes import U, mix, split_by

SHINGLE, DISTANCE, SEED, SEGMENT = 3, 3, 42, 32
#: Signatures of a part (16 bytes each), fingerprints of one signature that are compared in one task, and signatures of a task.
SIGNATURES_A_PART, BLOCK, SIGNATURES_A_TASK = 1 << 20, 4096, 1 << 22
#: Shingles whose bits are counted at once.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone, and cut at space and 09 to 0D
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), U, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, BITS_AT_ONCE):
        count += np.unpackbits(h[i : i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long: the fingerprint's 64 bits)."""

    def each(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in raw], U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def signatures(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, fingerprint) for the two segments and each wiped bit."""
    out = []
    for segment in range(64 // SEGMENT):
        value = (fps >> U(SEGMENT * segment)) & U(2**SEGMENT - 1)
        for bit in range(SEGMENT):
            out.append((value & ~U(1 << bit)) | U((segment * SEGMENT + bit) << 32))
    return np.concatenate(out), np.tile(fps, len(out))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if (before == root).all() and not keep.any():
            break
    return root


def links(keys: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the fingerprints which reach each other here."""
    order = np.lexsort((values, keys))
    keys, fps = keys[order], values[order]
    nodes, index = np.unique(fps, return_inverse=True)
    root = np.arange(len(nodes))
    at, shift = np.arange(len(keys)), 1
    while True:
        at = at[at + shift < len(keys)]
        at = at[keys[at + shift] == keys[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        if len(near):
            a, b = root[index[near]], root[index[near + shift]]
            new = a != b
            if new.any():
                root = forest(len(nodes), a[new], b[new])[root]
        shift += 1
    return chained(nodes, root)


def chained(nodes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges along each component's nodes in order, so that no node has more than two."""
    order = np.lexsort((nodes, root))
    next_too = root[order][1:] == root[order][:-1]
    return nodes[order][:-1][next_too], nodes[order][1:][next_too]


def between(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the fingerprints of a block, or those of two blocks, which are linked across."""
    nodes = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    root = np.arange(len(nodes))
    for start in range(0, len(a), 256):
        some = np.arange(start, min(start + 256, len(a)))
        near = np.bitwise_count(a[some, None] ^ right[None, :]) <= distance
        near &= root[some][:, None] != root[shift : shift + len(right)][None, :]
        x, y = np.nonzero(near)
        if len(x):
            root = forest(len(nodes), root[some[x]], root[shift + y])[root]
    return chained(nodes, root)


def near_fingerprints(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges a-b (longs) that connect all linked fingerprints of the column fp, which holds each once."""
    least = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = distinct.count() * 64
    parts, tasks = max(least, -(-total // SIGNATURES_A_PART)), max(least, -(-total // SIGNATURES_A_TASK))

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(U)
            for i in range(0, len(fps), 20_000):
                keys, values = signatures(fps[i : i + 20_000])
                rows = split_by(mix(keys), parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([keys[x].tobytes() for _, x in rows], pa.binary()), pa.array([values[x].tobytes() for _, x in rows], pa.binary())], ["part", "keys", "fps"]
                )

    def verify(table):
        """Edges, and the blocks of signatures that are too many for one task."""
        keys, fps = (np.frombuffer(b"".join(table[c].to_pylist()), U) for c in ("keys", "fps"))
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(head, len(keys)))
        cold = np.repeat(size <= block, size)
        a, b = links(keys[cold], fps[cold], distance)
        blocks = []
        for start, n in zip(head[size > block].tolist(), size[size > block].tolist()):
            count = -(-n // block)
            blocks += [(int(keys[start].view(np.int64)), k, count, fps[start + k : start + n : count].tobytes()) for k in range(count)]
        none = [None] * len(blocks)
        cols = list(zip(*blocks)) or [[]] * 4
        return pa.table({
            "a": pa.array([*a.view(np.int64).tolist(), *none], pa.int64()), "b": pa.array([*b.view(np.int64).tolist(), *none], pa.int64()),
            **{c: pa.array([*[None] * len(a), *x], k) for c, x, k in zip(("key", "own", "blocks", "fps"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))},
        })

    def compare(table):
        sides = [np.frombuffer(x, U) for x in table.sort_by("own")["fps"].to_pylist()]
        a, b = between(sides[0], sides[1] if len(sides) > 1 else None, distance)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    dealt = distinct.select("fp").repartition(tasks, "fp").mapInArrow(deal, "part int, keys binary, fps binary").repartition(tasks, "part")
    found = checkpoint(dealt.groupBy("part").applyInArrow(verify, "a long, b long, key long, own int, blocks int, fps binary"))
    other = found.where("blocks is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fps")
    return found.where("b is not null").select("a", "b").union(pairs.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    rows = checkpoint(fingerprints(docs, shingle))
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    # nodes are the fingerprints themselves: rows without an id, and unlike rows of one id, stay apart
    group = components(near_fingerprints(one, distance)).select(F.col("node").alias("fp"), "component")
    labelled = checkpoint(one.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(smallest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash_dedup(spark, sf_dir) -> DataFrame:
    from .common import read

    return simhash_dedup(read(spark, sf_dir, "documents"))
