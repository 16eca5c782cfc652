"""Balanced partitions of sequence lengths.

A batch has thousands of rows: its lengths are partitioned in one task, a batch a group, and
batches in parallel.  What comes back is the part of each row.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two partial solutions of widest spread are joined, largest part to smallest.

    A solution is k parts (sum, indexes), largest first.  equal_size: parts of as many rows each, for
    which solutions start as k rows; k must divide their number."""
    n = len(lengths)
    if k < 1 or (equal_size and n % k):
        raise ValueError(f"{n} rows don't make {k} parts")
    ranked = sorted(range(n), key=lambda i: (lengths[i], i))
    starts = [ranked[i : i + k] for i in range(0, n, k)] if equal_size else [[i] for i in ranked]
    heap = []
    for rows in starts:
        parts = sorted(((lengths[i], [i]) for i in rows), key=lambda p: (-p[0], p[1]))
        parts += [(0, [])] * (k - len(parts))
        heap.append((-(parts[0][0] - parts[-1][0]), min(rows), parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        parts = sorted(((s + t, x + y) for (s, x), (t, y) in zip(a, reversed(b))), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), min(first, second), parts))
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def least_loaded(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each row, in order, to the part of smallest sum (of those that aren't full, if equal_size)."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows don't make {k} equal parts")
    sums, parts, most = [0] * k, [[] for _ in range(k)], len(lengths) // k if equal_size else len(lengths)
    for i, n in enumerate(lengths):
        open_ = [j for j in range(k) if len(parts[j]) < most or not equal_size]
        j = min(open_, key=lambda j: (sums[j], j))
        parts[j].append(i)
        sums[j] += n
    return parts


def checked(parts: list[list[int]], n: int) -> list[list[int]]:
    if sorted(i for p in parts for i in p) != list(range(n)) or (n >= len(parts) and not all(parts)):
        raise ValueError("the parts don't cover each row once, or one is empty")
    return parts


def heavy_in_the_middle(parts: list[list[int]], weights: list[int]) -> list[list[int]]:
    """Parts reordered: the lightest at both ends."""
    order = sorted(parts, key=lambda p: (sum(weights[i] for i in p), p[0] if p else 0), reverse=True)
    return order[::2][::-1] + order[1::2]


def micro_batch_count(total: int, longest: int, most_tokens: int, rows: int, least: int = 1, multiple: int = 1) -> int:
    """How many micro-batches hold all tokens with at most most_tokens each on average."""
    if longest > most_tokens:
        raise ValueError(f"a sequence of {longest} tokens in batches of {most_tokens}")
    n = max(least, min(rows, -(-total // most_tokens)))
    return -(-n // multiple) * multiple


def balanced_parts(df: DataFrame, batch: str, row: str, length: str, k: int, equal_size: bool = False, greedy: bool = False) -> DataFrame:
    """batch, row, part."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row").reset_index(drop=True)
        lengths = pdf["_length"].tolist()
        parts = (least_loaded if greedy else differencing)(lengths, k, equal_size)
        if len(lengths) >= k:
            checked(parts, len(lengths))
        at = {i: p for p, rows in enumerate(parts) for i in rows}
        return pd.DataFrame({batch: pdf["_batch"], row: pdf["_row"], "part": [at[i] for i in range(len(pdf))]})

    kinds = dict(df.dtypes)
    rows = df.selectExpr(f"`{batch}` AS _batch", f"`{row}` AS _row", f"CAST(`{length}` AS LONG) AS _length")
    return rows.groupBy("_batch").applyInPandas(each, f"`{batch}` {kinds[batch]}, `{row}` {kinds[row]}, part int")


def micro_batches(df: DataFrame, batch: str, row: str, length: str, most_tokens: int) -> DataFrame:
    """batch, row, part: token-budget micro-batches of balanced workload, the heaviest in the middle."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row").reset_index(drop=True)
        lengths = pdf["_length"].tolist()
        work = [24576 * n + n * n for n in lengths]
        k = micro_batch_count(sum(lengths), max(lengths), most_tokens, len(lengths))
        at = {i: p for p, rows in enumerate(heavy_in_the_middle(differencing(work, k), work)) for i in rows}
        return pd.DataFrame({batch: pdf["_batch"], row: pdf["_row"], "part": [at[i] for i in range(len(pdf))]})

    kinds = dict(df.dtypes)
    rows = df.selectExpr(f"`{batch}` AS _batch", f"`{row}` AS _row", f"CAST(`{length}` AS LONG) AS _length")
    return rows.groupBy("_batch").applyInPandas(each, f"`{batch}` {kinds[batch]}, `{row}` {kinds[row]}, part int")


def grouped_parts(df: DataFrame, batch: str, group: str, length: str, k: int) -> DataFrame:
    """df with part: a batch's groups are balanced by their summed lengths and stay whole.  Groups aren't null; a batch
    of fewer groups than parts leaves parts empty."""
    whole = F.coalesce(F.col(group), F.raise_error(F.lit("a row without a group")).cast(dict(df.dtypes)[group]))
    rows = df.withColumn(group, whole)
    sums = rows.groupBy(batch, group).agg(F.sum(F.col(length).cast("long")).alias("_sum"))
    return rows.join(balanced_parts(sums, batch, group, "_sum", k), [batch, group])


def interleaved(df: DataFrame, batch: str, part: str, row: str, length: str) -> DataFrame:
    """df with new_pos, a row's place in its batch: part after part, and in a part from short to long and back to short."""
    by = Window.partitionBy(batch, part).orderBy(length, row)
    rank, n = F.row_number().over(by) - 1, F.count("*").over(Window.partitionBy(batch, part))
    place = F.when(F.col("_rank") % 2 == 0, F.expr("_rank div 2")).otherwise(F.col("_n") - 1 - F.expr("_rank div 2"))
    rows = df.withColumn("_rank", rank.cast("long")).withColumn("_n", n).withColumn("_place", place)
    return rows.withColumn("new_pos", F.row_number().over(Window.partitionBy(batch).orderBy(part, "_place")).cast("long") - 1).drop("_rank", "_n", "_place")


def restored(results: DataFrame, places: DataFrame, batch: str, row: str) -> DataFrame:
    """Results by batch and new_pos get back the row that `interleaved` put there."""
    return results.join(places.select(batch, "new_pos", row), [batch, "new_pos"]).drop("new_pos")
