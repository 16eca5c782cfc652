"""Operator 7, quality classifier: ordinal regression with cumulative links on hashed text.

A graded rating - 0 toxic, 1 poor, 2 good - is modelled by one score and ordered thresholds:
P(grade <= k) = sigmoid(threshold[k] - score).  The score is a sum of weights, one for each
hashed feature that the text has, shared by all grades.  Features are the document's
distinct words, its runs of signs, and the steps that some shares of its words and bytes reach
(repeats, capitals, signs, digits, lengths), also written as words and hashed.  Out come the expected grade and
the tail probability P(grade >= 2), and a document is kept if the latter is at least `keep`.

The fit uses at most SAMPLE_ROWS labelled documents, those of smallest hashed doc_id.  Their
features, not their texts, go to one task, which returns the weights; weights of features in
fewer than LEAST_DOCS sampled documents are zero.  Scoring reads each document once,
without a shuffle.

Null and empty texts have no words and get the score of their shares alone; a very long one is read in one task.  Of rows that repeat a doc_id one is
learnt from; all are judged, equal rows alike.  An empty table gives no rows.  Passed columns that are called like an output get "_input" behind their names.  Labels that
are null are passed over; of several labels of a document the worst grade counts.  Without
any usable label all documents get grade 1 with probability 1/3 each way and are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, passed_names
from .textbytes import U, alnum_split, buffer_of, lower_table, mix, release, space_split, words_of

BITS, SAMPLE_ROWS, LEAST_DOCS, EPOCHS, RATE, RIDGE, GRADES, KEEP = 18, 19_000, 12, 200, 0.15, 2.0, 3, 0.5
TEXT_AT_ONCE = 1 << 20
#: A share is told by those of these steps that it reaches.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 2.5)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One column a grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))
        ones = np.ones((len(score), 1))
        return np.diff(np.concatenate([0 * ones, below, ones], axis=1), axis=1)


def sign_bytes() -> np.ndarray:
    """ASCII bytes that are neither letters, digits nor white space."""
    lut = ~alnum_split()[lower_table()] & space_split()
    lut[0x80:] = False
    return lut


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all features, each once a document, by document."""
    low = lower_table()[buf]
    _, _, h, first = words_of(low, off, alnum_split())
    n = np.diff(first)
    docs = np.repeat(np.arange(len(n)), n)
    bucket = (h >> U(64 - BITS)).astype(np.int64)
    # shares, each in classes of its own
    spaced = words_of(buf, off, space_split(), seed=3)
    m = np.diff(spaced[3])
    sums = lambda x, o: np.diff(np.concatenate([[0], np.cumsum(x)])[o])
    upper, digit = (buf >= 0x41) & (buf <= 0x5A), (buf >= 0x30) & (buf <= 0x39)
    sign = sign_bytes()[buf]
    twice = np.zeros(len(spaced[2]), bool)
    twice[1:] = spaced[2][1:] == spaced[2][:-1]
    of = np.repeat(np.arange(len(m)), m).astype(U)
    kinds = np.unique(mix(spaced[2] ^ mix(of)), return_index=True)[1]
    distinct = np.bincount(of[kinds].astype(np.int64), minlength=len(m)) if len(m) else m
    size, words = np.maximum(np.diff(off), 1), np.maximum(m, 1)
    shares = [sums(upper, off) / size, sums(digit, off) / size, sums(sign, off) / words, sums(twice, spaced[3]) / words, distinct / words, size / words / 20, np.log2(size) / 20]
    found = [docs * 2**BITS + bucket]
    for k, x in enumerate(shares):
        for j, step in enumerate(STEPS):
            name = mix(np.array([1000 * (k + 1) + j], U)) >> U(64 - BITS)
            found.append(np.flatnonzero(x >= step) * 2**BITS + int(name[0]))
    starts, ends, h, first = words_of(buf, off, sign_bytes(), seed=5)
    long = ends - starts > 1
    found.append(np.repeat(np.arange(len(m)), np.diff(first))[long] * 2**BITS + (h[long] >> U(64 - BITS)).astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & (2**BITS - 1)


def slices(batch, column: int):
    """(first, last, bytes, offsets) of stretches of the batch's texts."""
    release()
    buf, off = buffer_of(batch.column(column))
    cut = np.unique(np.concatenate([[0], np.searchsorted(off, np.arange(TEXT_AT_ONCE, off[-1], TEXT_AT_ONCE)), [len(off) - 1]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def train(docs: np.ndarray, found: np.ndarray, grades: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by full-batch steps with Adam."""
    n = len(grades)
    dims = 2**BITS
    if not n:
        return Model(np.zeros(dims), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    often = np.bincount(found, minlength=dims) >= min(LEAST_DOCS, n)
    used = np.flatnonzero(often)
    number = np.full(dims, -1)
    number[used] = np.arange(len(used))
    keep = often[found]
    docs, found = docs[keep], number[found[keep]]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    x = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    at = np.arange(n)
    for step in range(1, EPOCHS + 1):
        w, first, gap = x[: len(used)], x[len(used)], np.exp(x[len(used) + 1 :])
        theta = first + np.concatenate([[0], np.cumsum(gap)])
        score = np.bincount(docs, w[found], minlength=n)
        s = sigmoid(theta[None, :] - score[:, None])
        upper, lower = np.concatenate([s, np.ones((n, 1))], axis=1), np.concatenate([np.zeros((n, 1)), s], axis=1)
        p = np.maximum((upper - lower)[at, grades], 1e-12)
        # derivatives of -log p by the threshold above and below the grade
        above = -(upper * (1 - upper))[at, grades] / p
        under = (lower * (1 - lower))[at, grades] / p
        by_theta = np.array([above[grades == k].sum() + under[grades == k + 1].sum() for k in range(GRADES - 1)]) / n
        by_w = np.bincount(found, (-(above + under) / n)[docs], minlength=len(used)) + RIDGE / n * w
        grad = np.concatenate([by_w, [by_theta.sum()], gap * np.cumsum(by_theta[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x - RATE * (1 - step / (EPOCHS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(dims)
    weights[used] = x[: len(used)]
    return Model(weights, x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def featured(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch, 1):
                d, f = features(buf, off)
                at = np.searchsorted(d, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([f[s:e].astype(np.int32).tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["doc_id", "grade", "features"])

    def learnt(table):  # a row for each of at most sample_rows ids
        table = table.sort_by([("doc_id", "ascending"), ("features", "ascending")])  # one order on every run
        found = [np.frombuffer(x, np.int32) for x in table["features"].to_pylist()]
        model = train(np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found).astype(np.int64), table["grade"].to_numpy().astype(np.int64))
        return pa.table({"weights": pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), "thresholds": pa.array([model.thresholds.tobytes()], pa.binary())})

    table = rows.select("doc_id", "text", "grade").mapInArrow(featured, "doc_id long, grade int, features binary")
    # of rows that repeat an id one is learnt from; the smallest, so that it is the same on every run
    table = table.groupBy("doc_id").agg(F.min(F.struct("features", "grade")).alias("r")).select("doc_id", "r.grade", "r.features")
    got = table.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learnt, "weights binary, thresholds binary").collect()  # one row of a fixed size
    if not got:
        none = np.zeros(0, np.int64)
        return train(none, none, none)
    return Model(np.frombuffer(got[0].weights, np.float32).astype(np.float64), np.frombuffer(got[0].thresholds, np.float64))


def score(docs: DataFrame, model: Model, keep: float = KEEP, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id), then expected_grade, tail_prob (of grade 2) and kept."""
    spark, columns = docs.sparkSession, columns or ["doc_id"]
    names = passed_names(columns, ["expected_grade", "tail_prob", "kept"])
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    trained = bool(np.any(model.weights))
    inner = [f"c{i}" for i in range(len(columns))]
    # a text that is passed on isn't sent twice
    place = columns.index("text") if ("text", "string") in docs.select(*map(col, columns)).dtypes else len(columns)
    rows = docs.select(*(col(c).alias(i) for c, i in zip(columns, inner)), *[F.col("text").cast("string").alias("text")] * (place == len(columns)))

    def each(batches):
        weights, thresholds = sent.value
        own = Model(weights, thresholds)
        for batch in batches:
            for a, b, buf, off in slices(batch, place):
                d, f = features(buf, off)
                p = own.probabilities(np.bincount(d, weights[f], minlength=b - a))
                arrays = [batch.column(i)[a:b] for i in range(len(inner))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array((p[:, -1] >= keep) | (not trained))], [*inner, "expected_grade", "tail_prob", "kept"])

    kinds = ", ".join(f"{i} {t}" for i, (_, t) in zip(inner, docs.select(*map(col, columns)).dtypes))
    out = rows.mapInArrow(each, f"{kinds}, expected_grade double, tail_prob double, kept boolean")
    return out.withColumnsRenamed(dict(zip(inner, names)))


def quality_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: float = KEEP, columns: list[str] | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, sample_rows), keep, columns)


def op7_quality_classifier(spark, sf_dir) -> DataFrame:
    from .common import read

    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
