"""Operator 2, embedding near-dedup with randomised-rotation binary codes.

Vectors of one label link at a cosine (in double precision) of `threshold` (0.98) or more.

1. Equal vectors of a label are one class with a number of its own, and the number of copies.
2. A class's unit vector is rotated at random into CODE dimensions; the signs are its code.
   With it is stored the correction factor, the inner product of vector and code: the inner
   product of a's code with b, divided by a's factor, is an unbiased estimate of the inner
   product of a and b, with an error of about EPSILON * sqrt((1/factor^2 - 1) / (CODE - 1)).
3. The sign codes of further rotations, cut into bands, give keys; classes meet under equal
   keys.  A band has SPARE bits more than the logarithm of the largest label, so that few vectors meet by
   chance, and in proportion to the input; bands are added until a pair at the threshold meets with a
   probability of RECALL at least.
4. Keys alone (class, band, key) find the keys that several classes have.  Only classes under such a key go on,
   with their vector, as it is in the table, and code.  Keys of many classes are cut into blocks, and pairs of blocks are
   tasks of their own: eight blocks at most up to 8 * BLOCK classes, so that a class is sent eight times at most there.
5. Pairs whose estimate plus error bound is below the threshold are out; the others are computed exactly.  A pair
   counts under the first of its common keys.
6. What comes out is a link count for each class, and a spanning forest of the links - never
   the pairs.  Components come from joins of the forests' edges.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without a
label, link with nothing.  Vectors of a label but of different lengths don't meet.  Rows that
repeat a vec_id are vectors of their own, which are linked by their vectors alone.  A row without vec_id is linked like any other, but is
nobody's representative: its component has the smallest id there is, null if there is none, and it is kept only then.  An empty table gives no
rows; a very long vector is worked on like any other.  Columns beyond the three are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components
from .simhash_dedup import forest
from .textbytes import U, mix

THRESHOLD, CODE, EPSILON, RECALL, SPARE, BLOCK, LEAST_BLOCK, ROWS_A_PART, SEED = 0.98, 128, 4.0, 0.9995, 3, 8192, 256, 16_000, 5


def rotation(dims: int, out: int, seed: int) -> np.ndarray:
    """out x dims; of every dims rows (or all, if out is larger in one piece) the columns are orthonormal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((out, dims)))
    return q * np.sign(np.diag(r))


def code_size(dims: int) -> int:
    return max(CODE, -(-dims // 64) * 64)


def units(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors."""
    p = unit @ turn.T
    return np.packbits(p > 0, axis=1), np.abs(p).sum(axis=1) / math.sqrt(turn.shape[0])


def band_plan(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits a band, bands) for a label of so many classes."""
    bits = min(48, max(6, math.ceil(math.log2(largest + 1)) + SPARE))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def band_values(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The signs of each band as a number, one column a band."""
    dims = unit.shape[1]
    turns = [rotation(dims, dims, SEED + 1 + k) for k in range(-(-bits * bands // dims))]
    signs = (unit @ np.concatenate(turns)[: bits * bands].T > 0).reshape(len(unit), bands, bits)
    kind = np.uint32 if bits <= 32 else U
    return (signs.astype(kind) << np.arange(bits, dtype=kind)).sum(axis=2, dtype=kind)


def band_keys(values: np.ndarray, labels: np.ndarray, dims: int) -> np.ndarray:
    """One 64-bit key a band: of the label, the vector's length, the band and its signs."""
    place = np.arange(values.shape[1], dtype=U) + (U(dims) << U(20))
    return mix(mix(values.astype(U) ^ mix(place)[None, :]) + mix(labels.astype(np.int64).view(U))[:, None])


def valid(embedding):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return embedding.isNotNull() & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0)


def linked(table: pa.Table, threshold: float, bits: int):
    """Link counts (weighted by copies) and forest edges of a part; its groups are blocks or pairs of blocks."""
    cols = {c: table[c].to_numpy(zero_copy_only=False) for c in ("task", "band", "side", "id", "copies", "factor")}
    order = np.argsort(cols["task"], kind="stable")
    tasks, at = np.unique(cols["task"][order], return_index=True)
    counts_id, counts_n, edges_a, edges_b = [], [], [], []
    for rows in np.split(order, at[1:]) if len(tasks) else []:
        side = cols["side"][rows]
        if len(rows) < 2 or (side[0] > 0 and (side == side[0]).all()):
            continue
        rows = rows[np.argsort(side, kind="stable")]
        side, some = np.sort(side), table.take(rows)
        vectors = some["embedding"].combine_chunks()
        unit = units(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        size = code_size(unit.shape[1])
        turn = rotation(unit.shape[1], size, SEED)
        code = np.unpackbits(np.frombuffer(b"".join(some["code"].to_pylist()), np.uint8).reshape(len(rows), -1), axis=1)[:, :size].astype(np.float32) * 2 - 1
        factor, ids, copies = (cols[c][rows] for c in ("factor", "id", "copies"))
        values = np.frombuffer(b"".join(some["bands"].to_pylist()), np.uint32 if bits <= 32 else U).reshape(len(rows), -1)
        band = int(cols["band"][rows[0]])
        error = EPSILON * np.sqrt(np.maximum(1 / factor**2 - 1, 0) / (size - 1))
        turned = (unit @ turn.T).astype(np.float32)
        got, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        first = int((side < 2).sum()) if side[-1] > 0 else len(rows)  # of two blocks, pairs across alone
        for start in range(0, first, 256):
            part = np.arange(start, min(start + 256, first))
            other = np.arange(len(rows) if first == len(rows) else first, len(rows)) if first < len(rows) else np.arange(start, len(rows))
            maybe = (code[part] @ turned[other].T) / (math.sqrt(size) * factor[part, None]) + error[part, None] >= threshold
            if first == len(rows):
                maybe &= part[:, None] < other[None, :]
            if not maybe.any():
                continue
            if maybe.mean() > 0.02:
                near = maybe & (unit[part] @ unit[other].T >= threshold)
            else:
                a, b = np.nonzero(maybe)
                near = np.zeros_like(maybe)
                near[a, b] = np.einsum("ij,ij->i", unit[part[a]], unit[other[b]]) >= threshold
            for earlier in range(band):
                near &= values[part, earlier][:, None] != values[other, earlier][None, :]
            got[part] += near @ copies[other]
            got[other] += copies[part] @ near
            # one neighbour of each row first, then the pairs that these haven't connected
            has = np.flatnonzero(near.any(axis=1))
            root = forest(len(rows), root[part[has]], root[other[near[has].argmax(axis=1)]])[root]
            a, b = np.nonzero(near & (root[part][:, None] != root[other][None, :]))
            if len(a):
                root = forest(len(rows), root[part[a]], root[other[b]])[root]
        moved, some = np.flatnonzero(root != np.arange(len(rows))), np.flatnonzero(got)
        edges_a.append(ids[moved])
        edges_b.append(ids[root[moved]])
        counts_id.append(ids[some])
        counts_n.append(got[some])
    none = np.zeros(0, np.int64)
    ids, got, a, b = (np.concatenate([none, *x]) for x in (counts_id, counts_n, edges_a, edges_b))
    return pa.table({
        "a": pa.array(np.concatenate([ids, a]), pa.int64()),
        "b": pa.array([None] * len(ids) + b.tolist(), pa.int64()),
        "n": pa.array(got.tolist() + [None] * len(a), pa.int64()),
    })


def embedding_dedup(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    sound = rows.where(F.col("label").isNotNull() & valid(F.col("embedding")))
    # numbers of rows of a checkpoint stay the same
    classes = checkpoint(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))).withColumn("id", F.monotonically_increasing_id())
    total = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    bits, bands = band_plan(total.most or 1, threshold)

    def each(batches, made):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = pc.list_value_length(table["embedding"]).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                some = table.filter(pa.array(lengths == dims))
                unit = units(some["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                yield made(some, unit, dims)

    def keyed(batches):
        def made(some, unit, dims):
            keys = band_keys(band_values(unit, bits, bands), some["label"].to_numpy(), dims)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(some["id"].to_numpy(), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(unit))), pa.array(keys.ravel().view(np.int64))], ["id", "band", "key"])

        return each(batches, made)

    def coded(batches):
        def made(some, unit, dims):
            code, factor = encode(unit, rotation(dims, code_size(dims), SEED))
            arrays = [some[c].combine_chunks() for c in ("id", "copies", "embedding", "met")]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes() for x in code], pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in band_values(unit, bits, bands)], pa.binary())], ["id", "copies", "embedding", "met", "code", "factor", "bands"])

        return each(batches, made)

    keys = checkpoint(classes.select("id", "label", "embedding").mapInArrow(keyed, "id long, band int, key long"))
    crowd = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.lit(8), F.ceil(F.col("n") / least_block))).cast("int")
    met = checkpoint(keys.join(crowd.select("key", blocks.alias("blocks")), "key").groupBy("id").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("met")))  # at most a row a band
    sent = met.agg(F.sum(F.aggregate("met", F.lit(0).cast("long"), lambda t, m: t + m["blocks"]))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // ROWS_A_PART))
    own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    struct = f"id long, copies long, embedding {kind}, met array<struct<band:int,key:long,blocks:int>>, code binary, factor double, bands binary"
    tasks = (
        classes.join(met, "id").select("id", "copies", "embedding", "met").mapInArrow(coded, struct)
        .withColumn("m", F.explode("met")).select("id", "copies", "embedding", "code", "factor", "bands", "m.band", "m.key", "m.blocks")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("task", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
        .select(F.pmod("task", F.lit(parts)).alias("part"), "task", "band", "side", "id", "copies", "factor", "embedding", "code", "bands")
    )
    found = checkpoint(tasks.groupBy("part").applyInArrow(lambda table: linked(table, threshold, bits), "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    group = components(found.where("b is not null")).select(F.col("node").alias("id"), "component")
    grouped = classes.select("id", "first").join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    judged = grouped.join(smallest, "component").join(counts, "id", "left").select("id", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    of_vector = classes.join(judged, "id").select("label", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("sound"))
    joined = rows.join(of_vector, ["label", "embedding"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_embedding_dedup(spark, sf_dir) -> DataFrame:
    from .common import read

    return embedding_dedup(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
