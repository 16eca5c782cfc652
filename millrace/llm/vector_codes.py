"""Operator 13, vector code compression: product quantisation whose codebooks are trained by heap Lloyd.

Components become integers floor(SCALE * x); vectors are cut into PARTS consecutive parts, each with a codebook of at most
ENTRIES entries.  ROUNDS times parts go to their nearest entry (squared Euclidean distance, ties to the lower index) and
entries become the floor of their parts' means; then parts are assigned once more.  All distances and sums are exact.

Vectors are packed into chunks where they are read, without an exchange.  A chunk keeps, from pass to pass, its codes and
one heap per part and entry: the key of a part is its slack, the distance to the second nearest entry less that to its own,
plus what the entry had drifted by then.  An entry's drift in a round is its own move plus the largest move of another
entry, the most by which that slack can shrink.  A pass pops only parts whose key the cumulative drift has reached (their
bounds may be violated), rescans them against all entries, and pushes them on the heap of their entry; all others keep theirs.

Spark keeps nothing between jobs, so that a pass writes its chunks with their heaps to the shared folder, beside the sums
of the parts that changed their entry, one row a task, part and entry; the sums' totals, of a fixed size, go to the driver,
which moves the entries.  A pass that a lost executor breaks off is repeated from the pass before; older ones are deleted.

Rows whose vector is null or holds null or non-finite components are dropped, and so are those whose vector has another
length than that of the smallest vec_id.  Vectors whose length isn't a multiple of PARTS end with zeros.  Rows without vec_id come
last in the first codebook; rows that repeat one are vectors of their own, in the order of vectors there.  Rows without label are one
label together.  With fewer vectors than ENTRIES codebooks are as small; an empty table gives no rows.  Components of which squares
don't fit 63 bits in sum raise an error, as the result has them as long.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, delete_folder, new_folder, read, written

SCALE, PARTS, ENTRIES, ROUNDS, CHUNK = 1024, 4, 256, 4, 4096
#: Room for rounding in a comparison of bounds, absolute and of their size.
ROOM = (1e-6, 1e-12)


def integers(values: np.ndarray, n: int, dims: int, parts: int, scale: int) -> np.ndarray:
    """n x parts x width integers of n vectors' components, zeros added at the end."""
    width = max(1, -(-dims // parts))
    x = np.floor(values.astype(np.float64).reshape(n, dims) * scale)
    if n and dims and np.abs(x).max() >= math.isqrt((1 << 62) // (parts * width)) // 2:
        raise ValueError("components are too large: squared distances don't fit a long")
    out = np.zeros((n, parts * width), np.int64)
    out[:, :dims] = x
    return out.reshape(n, parts, width)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and rows of y: in doubles where these are exact, else in integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(largest) ** 2 < 1 << 52 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the lowest of equals, and its slack."""
    d = squares(x, book)
    best = d.argmin(1)
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return best, two[:, 1] - two[:, 0]


class Heaps:
    """The heaps of a chunk's part: keys and rows, heap after heap by entry, each in heap order."""

    def __init__(self, sizes: np.ndarray, order: np.ndarray, keys: np.ndarray):
        self.sizes, self.order, self.keys = sizes, order, keys

    @classmethod
    def of(cls, entries: np.ndarray, keys: np.ndarray, count: int) -> Heaps:
        """Of all rows at once: in ascending order, which is a heap's."""
        order = np.lexsort((keys, entries)).astype(np.int32)
        return cls(np.bincount(entries, minlength=count).astype(np.int32), order, keys[order])

    def rescan(self, limits: np.ndarray, exact) -> tuple[np.ndarray, np.ndarray]:
        """Pops what is at or below its entry's limit, asks exact(rows) for (entries, keys) and pushes them; returns rows and entries."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        full = np.flatnonzero(self.sizes)
        opened: dict[int, list] = {}
        open_heap = lambda e: opened.setdefault(e, [*zip(self.keys[starts[e] : ends[e]].tolist(), self.order[starts[e] : ends[e]].tolist())])
        popped = []
        for e in full[self.keys[starts[full]] <= limits[full]].tolist():
            heap = open_heap(e)
            while heap and heap[0][0] <= limits[e]:
                popped.append(heapq.heappop(heap)[1])
        rows = np.array(popped, np.int64)
        if not popped:
            return rows, rows
        entries, keys = exact(rows)
        for key, row, e in zip(keys.tolist(), popped, entries.tolist()):
            heapq.heappush(opened[e] if e in opened else open_heap(e), (key, row))
        keys_out, order_out = [], []
        for e in range(len(self.sizes)):
            if e in opened:
                keys_out.append(np.array([k for k, _ in opened[e]], np.float64))
                order_out.append(np.array([r for _, r in opened[e]], np.int32))
                self.sizes[e] = len(opened[e])
            else:
                keys_out.append(self.keys[starts[e] : ends[e]])
                order_out.append(self.order[starts[e] : ends[e]])
        self.keys, self.order = np.concatenate(keys_out), np.concatenate(order_out)
        return rows, entries


class Chunk:
    """Some vectors (n x parts x width), their codes and heaps."""

    def __init__(self, x: np.ndarray, codes: np.ndarray | None = None, heaps: list[Heaps] | None = None):
        self.x, self.codes, self.heaps = x, codes, heaps

    def assign(self, books: np.ndarray, drift: np.ndarray, room: tuple[float, float] = ROOM) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Assigns by codebooks (parts x entries x width) after cumulative drift (parts x entries); what changed, as (part, rows, old, new) with old -1 at first."""
        changed, count = [], books.shape[1]
        first = self.codes is None
        if first:
            self.codes, self.heaps = np.zeros(self.x.shape[:2], np.uint8), []
        for p in range(books.shape[0]):
            x = self.x[:, p]

            def exact(rows, p=p, x=x):
                entries, slack = scan(x[rows], books[p])
                return entries, slack + drift[p][entries]

            if first:
                rows = np.arange(len(x))
                entries, keys = exact(rows)
                self.heaps.append(Heaps.of(entries, keys, count))
                old = np.full(len(rows), -1)
            else:
                size = np.abs(drift[p]) + np.sqrt(float(x.shape[1])) * np.abs(x).max(initial=0)
                rows, entries = self.heaps[p].rescan(drift[p] + room[0] + room[1] * size, exact)
                old = self.codes[rows, p].astype(np.int64)
                other = old != entries
                rows, old, entries = rows[other], old[other], entries[other]
            self.codes[rows, p] = entries
            changed.append((p, rows, old, entries))
        return changed

    def errors(self, books: np.ndarray) -> np.ndarray:
        return sum(((self.x[:, p] - books[p][self.codes[:, p]]) ** 2).sum(1) for p in range(books.shape[0]))

    def state(self) -> dict[str, bytes]:
        return {"vectors": self.x.astype(np.int32 if np.abs(self.x).max(initial=0) < 1 << 31 else np.int64).tobytes(), "codes": self.codes.tobytes(), **{n: b"".join(getattr(h, n).tobytes() for h in self.heaps) for n in ("sizes", "order", "keys")}}

    @classmethod
    def read(cls, state: dict[str, bytes], parts: int, width: int, count: int) -> Chunk:
        codes = np.frombuffer(state["codes"], np.uint8).reshape(-1, parts).copy()
        n = len(codes)
        x = np.frombuffer(state["vectors"], np.int32 if len(state["vectors"]) == 4 * n * parts * width else np.int64).reshape(n, parts, width).astype(np.int64)
        sizes, order, keys = (np.frombuffer(state[c], k).reshape(parts, -1) for c, k in (("sizes", np.int32), ("order", np.int32), ("keys", np.float64)))
        return cls(x, codes, [Heaps(sizes[p].copy(), order[p], keys[p]) for p in range(parts)])


STATE = ["vectors", "codes", "sizes", "order", "keys"]


def trained(label: str, dims: int, parts: int, scale: int, chunk: int, books: np.ndarray, drift: np.ndarray, first: bool):
    """(step, schema) of a pass: chunks with their state, and the task's sums of what changed."""
    count, width = books.shape[1], books.shape[2]
    schema = f"what string, ids array<long>, labels array<{label}>, {', '.join(f'{c} binary' for c in STATE)}, part int, entry int, n long, total binary"

    def chunks(batches):
        """(ids, labels, Chunk) of the pass."""
        if not first:
            for b in batches:
                for row in range(len(b)):
                    yield b["ids"].slice(row, 1), b["labels"].slice(row, 1), Chunk.read({c: b[c][row].as_py() for c in STATE}, parts, width, count)
            return
        for b in batches:
            for at in range(0, len(b), chunk):
                piece = b.slice(at, chunk)
                x = integers(piece["embedding"].flatten().to_numpy(zero_copy_only=False), len(piece), dims, parts, scale)
                one = lambda c, n=len(piece): pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)
                yield one(piece["vec_id"]), one(piece["label"]), Chunk(x)

    def step(batches):
        total, n, kinds = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64), None
        for ids, labels, c in chunks(batches):
            kinds = labels.type
            for p, rows, old, new in c.assign(books, drift):
                np.add.at(total[p], new, c.x[rows, p])
                np.add.at(n[p], new, 1)
                before = old >= 0
                np.subtract.at(total[p], old[before], c.x[rows[before], p])
                np.subtract.at(n[p], old[before], 1)
            state = c.state()
            yield batch("chunk", ids, labels, [[state[s]] for s in STATE], [None], [None], [None], [None])
        at = np.argwhere((n != 0) | (total != 0).any(2))
        if len(at):
            none = [None] * len(at)
            yield batch("sum", pa.array(none, pa.list_(pa.int64())), pa.array(none, kinds), [none] * len(STATE), at[:, 0].tolist(), at[:, 1].tolist(), [int(n[p, e]) for p, e in at], [total[p, e].tobytes() for p, e in at])

    def batch(what, ids, labels, state, part, entry, n, total):
        cols = {"what": pa.array([what] * len(part)), "ids": ids, "labels": labels}
        cols |= {c: pa.array(v, pa.binary()) for c, v in zip(STATE, state)}
        cols |= {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n, pa.int64()), "total": pa.array(total, pa.binary())}
        return pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    def last(batches):
        for ids, labels, c in chunks(batches):
            c.assign(books, drift)
            code = c.codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([ids.flatten(), labels.flatten(), pa.array([code[i : i + 2 * parts] for i in range(0, len(code), 2 * parts)], pa.string()), pa.array(c.errors(books), pa.int64())], ["vec_id", "label", "code", "error"])

    return step, schema, last, f"vec_id long, label {label}, code string, error long"


def totals(sums: DataFrame) -> DataFrame:
    """Sums a part and entry over tasks."""

    def add(table):
        total = np.sum([np.frombuffer(t, np.int64) for t in table["total"].to_pylist()], axis=0)
        return pa.table({"part": table["part"][:1], "entry": table["entry"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    return sums.groupBy("part", "entry").applyInArrow(add, "part int, entry int, n long, total binary")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of rows (vec_id, embedding, label), and the codebooks (parts x entries x width)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so that a codebook has 1 to 256 entries")
    spark = rows.sparkSession
    label = rows.schema["label"].dataType.simpleString()
    vectors = rows.select(col("vec_id").cast("long").alias("vec_id"), col("embedding").cast("array<double>").alias("embedding"), col("label").alias("label"))
    vectors = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()  # ENTRIES rows at most
    if not start:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    dims = len(start[0]["embedding"])
    x = np.array([r["embedding"] for r in start if len(r["embedding"]) == dims], np.float64)
    if len(x) < len(start):  # the smallest ones of that length
        x = np.array([r["embedding"] for r in vectors.where(F.size("embedding") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()], np.float64)
    books = integers(x, len(x), dims, parts, scale).transpose(1, 0, 2).copy()
    total, n, drift = np.zeros_like(books), np.zeros(books.shape[:2], np.int64), np.zeros(books.shape[:2])
    source, before = vectors.where(F.size("embedding") == dims), None
    for k in range(rounds):
        step, schema, _, _ = trained(label, dims, parts, scale, chunk, books, drift, k == 0)
        folder = new_folder(spark, f"codes-{k}")
        source.mapInArrow(step, schema).write.partitionBy("what").option("compression", "zstd").parquet(folder)
        if before:
            delete_folder(spark, before)
        stored = spark.read.schema(schema).parquet(folder)
        for r in totals(stored.where("what = 'sum'").select("part", "entry", "n", "total")).collect():  # a row a part and entry
            total[r["part"], r["entry"]] += np.frombuffer(r["total"], np.int64)
            n[r["part"], r["entry"]] += r["n"]
        moved = np.where((n > 0)[:, :, None], total // np.maximum(n, 1)[:, :, None], books)
        step_size = np.sqrt(((moved - books) ** 2).sum(2).astype(np.float64))
        for p in range(parts):
            top = np.sort(step_size[p])[::-1]
            others = np.where(step_size[p] == top[0], top[1] if (step_size[p] == top[0]).sum() == 1 and len(top) > 1 else top[0], top[0])
            drift[p] += step_size[p] + (others if len(top) > 1 else 0)
        books, before = moved, folder
        source = stored.where("what = 'chunk'").select("ids", "labels", *STATE)
    _, _, last, out = trained(label, dims, parts, scale, chunk, books, drift, rounds == 0)
    coded = written(source.mapInArrow(last, out), "codes")
    if before:
        delete_folder(spark, before)
    return coded, books


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = vector_codes(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of op13: every assignment and update is a table of its own."""
    sql = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, c[p * len(c) // 4 + 1 : (p + 1) * len(c) // 4] AS x FROM v, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS y FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
"""
    near = "SELECT vec_id, x.p, any_value(x) AS x, arg_min(j, d) AS j, min(d) AS d FROM (SELECT vec_id, x.p, x, j, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) + j / 1024.0 AS d FROM x JOIN b{k} b ON x.p = b.p) x GROUP BY vec_id, x.p"
    for k in range(rounds):
        sql += f"""a{k} AS MATERIALIZED ({near.format(k=k)}),
m{k} AS (SELECT p, j, list(m ORDER BY i) AS y FROM (SELECT p, j, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, j, i) GROUP BY p, j),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.j = m.j),
"""
    return sql + f"""a AS MATERIALIZED ({near.format(k=rounds)}),
o AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(floor(d))::BIGINT AS error FROM a GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: c::BIGINT), ','), ',' ORDER BY p, j)) FROM b{rounds}) AS codebooks_sha256
FROM o JOIN v USING (vec_id)
"""


OP13_SQL = op13_sql()
