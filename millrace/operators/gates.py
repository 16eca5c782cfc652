"""Checks of tables before use, filters by length and vocabulary, seeded samples, small reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that the batch has, in its order."""
    return df.select(*[c for c in df.columns if c in wanted])


def short_enough(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens; where tokens can't be had (null), the row goes."""
    return df.where(F.coalesce(F.size(tokens), F.lit(most + 1)).between(0, most))


def forbidden_tokens(ids, mask, forbidden: list[int]) -> Column:
    """Does a masked token have a forbidden id?"""
    return F.arrays_overlap(S.compact(ids, mask), F.array(*[F.lit(int(i)).cast("long") for i in forbidden]))


def checked_rows(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The batch, refused when read if any row is bad."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def table_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows, and how many fail each check."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def pinned(df: DataFrame, expected: dict[str, tuple[Column, int | None]]) -> list[str]:
    """What differs from the expected counts of rows; None isn't checked."""
    pins = {n: (c, k) for n, (c, k) in expected.items() if k is not None}
    if not pins:
        return []
    got = df.agg(*[F.count_if(c).alias(n) for n, (c, _) in pins.items()]).first()
    return [f"{n}: {got[n]} rows, not {k}" for n, (_, k) in pins.items() if got[n] != k]


def half_size(full: tuple[Column, Column], half: tuple[Column, Column]) -> Column:
    """Are both sides half of the full ones, rounded down, give or take a pixel?"""
    from .validity import half_of

    return half_of(half[0], full[0]) & half_of(half[1], full[1])


def sampled(df: DataFrame, n: int, seed: int | None = None, row: str = "row_id", count: int | None = None) -> DataFrame:
    """The first n rows, or n rows drawn without replacement by NumPy's generator of the seed (n is the feature's limit)."""
    if seed is None:
        return df.where(F.col(row) < n)
    size = df.count() if count is None else count
    picked = np.random.default_rng(seed).choice(size, size=min(n, size), replace=False)
    ids = df.sparkSession.createDataFrame([(int(i),) for i in picked], f"{row} long")
    return df.join(F.broadcast(ids), row, "left_semi")


def shown_generations(df: DataFrame, n: int, seed: int = 42, by: str = "input") -> DataFrame:
    """n generations for a report, with their place: the first n in the order of their input's hash with the seed (ties by input).

    The order depends on inputs and seed alone; no task or driver sees more than n rows."""
    rest = [c for c in df.columns if c != by]
    first = df.select(F.struct(F.xxhash64(F.lit(seed), by).alias("_h"), by, *rest).alias("_r")).orderBy("_r._h", f"_r.{by}").limit(n)
    placed = first.agg(F.sort_array(F.collect_list("_r")).alias("_l")).select(F.posexplode("_l").alias("place", "_r"))
    return placed.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns], "place")


def unbalance(df: DataFrame, part: str, length: Column) -> DataFrame:
    """Smallest, largest and mean sum of lengths of the parts."""
    sums = df.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.avg("s").alias("mean"))


def throughput(df: DataFrame, tokens: Column, seconds: float, devices: int) -> DataFrame:
    n = F.sum(tokens).cast("double")
    return df.agg(n.alias("total_tokens"), F.lit(float(seconds)).alias("time_per_step"), (n / (seconds * devices)).alias("tokens_per_device_second"))


def slowest(df: DataFrame, seconds: str, order: str, *columns: str) -> DataFrame:
    """Extremes and mean of the times, and the columns of the slowest row (of equal ones the first)."""
    worst = F.max_by(F.struct(*columns), F.struct(F.col(seconds), -F.col(order)))
    return df.agg(F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.avg(seconds).alias("mean"), worst.alias("_w")).select("min", "max", "mean", *[F.col(f"_w.{c}").alias(c) for c in columns])


def metric_section(df: DataFrame, core: str) -> DataFrame:
    """source, name and value rows of validation metrics with their section: val-core for mean, best or majority of the core
    variable at the source's largest N, else val-aux.  name: variable/metric@N/...; without the core variable, reward is it."""
    parts = F.split("name", "/")
    n = F.regexp_extract("name", r"@(\d+)", 1).try_cast("int")
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    has = F.max((parts[0] == core).cast("int")).over(w)
    variable = F.when(has == 1, F.lit(core)).otherwise("reward")
    rows = df.withColumn("_n", n).withColumn("_top", F.max("_n").over(w)).withColumn("_v", variable)
    is_core = (parts[0] == F.col("_v")) & F.rlike("name", F.lit("/(mean|maj|best)")) & (F.col("_n") == F.col("_top"))
    return rows.withColumn("section", F.when(is_core, "val-core").otherwise("val-aux")).drop("_n", "_top", "_v")


def distillation_fractions(df: DataFrame, uid: str, success: Column, feedback: Column, mask: Column) -> DataFrame:
    """Shares of groups with a success, of successful samples, of samples with feedback, and of masked-in samples."""
    groups = F.countDistinct(F.when(success, F.col(uid))) / F.countDistinct(uid)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(groups.alias("success_group"), share(success).alias("success_sample"), share(feedback).alias("feedback"), F.avg(mask).alias("mask"))


def run_prefixes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Stretches of rows with the same key: number, length and the first row's value."""
    from .records import runs

    return runs(df, key, order).groupBy("run").agg(F.count("*").alias("size"), F.min_by(value, order).alias("prefix"), F.min(key).alias(key))


def window_load(df: DataFrame, key: str, second: str, width: int) -> DataFrame:
    """How many requests of the key fell in the `width` seconds up to each."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(second).rangeBetween(-(width - 1), 0)
    return df.withColumn("load", F.count("*").over(w))


def valid_box(box: Column, width: Column, height: Column, least: int = 28) -> Column:
    """The box (left, top, right, bottom) cut to the image; null if it is turned over or smaller than `least` pixels a side."""
    x1, y1 = F.greatest(box[0], F.lit(0)), F.greatest(box[1], F.lit(0))
    x2, y2 = F.least(box[2], width), F.least(box[3], height)
    return F.when((box[0] < box[2]) & (box[1] < box[3]) & (x2 - x1 >= least) & (y2 - y1 >= least), F.array(x1, y1, x2, y2))


def merged_tool_score(answer: str, gold: str) -> float:
    """1 if the answer's actions are the gold ones, as a multiset, and the merged JSON inputs are equal."""
    import json
    import re
    from collections import Counter

    want = json.loads(gold)
    inputs: dict = {}
    for block in re.findall(r"Action Input:\s*({.*?})", answer or "", re.S):
        try:
            inputs |= json.loads(block)
        except ValueError:
            continue
    right: dict = {}
    for item in want:
        given = item["Action_Input"]
        try:
            right |= json.loads(given) if isinstance(given, str) else given
        except ValueError:
            continue
    return float(Counter(re.findall(r"Action:\s*(\w+)", answer or "")) == Counter(i["Action"] for i in want) and inputs == right)


def python_score(df: DataFrame, function: Callable[[str, str], float], answer: str, gold: str, name: str = "score") -> DataFrame:
    """df with the score of a function of answer and gold, on Arrow batches."""
    from .scoring import score_with

    def frame(pdf):
        import pandas as pd

        return pd.Series([function(a, g) for a, g in zip(pdf[answer], pdf[gold])], index=pdf.index)

    return score_with(df, frame, name)


def code_block(answer: Column) -> Column:
    """The longest fenced block of the answer, null without one."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?s)```(?:python|py)?\n(.*?)```"), F.lit(1))
    longest = F.array_max(F.transform(found, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))
    return longest["b"]


def code_score(results: Column, sparse: bool = True) -> Column:
    """From an array of passed tests: all (1 or 0), or the share of them; no tests give 0."""
    n = F.size(results)
    passed = F.size(F.filter(results, lambda r: r))
    return F.when(n <= 0, 0.0).otherwise(F.when(passed == n, 1.0).otherwise(0.0) if sparse else passed / n)


def run_code(df: DataFrame, code: str, tests: str, runner: Callable[[str, str], bool]) -> DataFrame:
    """df with passed: for each of the tests what the runner says.  The runner is the caller's: it must isolate the code,
    which is never run in this process."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def each(frames):
        for pdf in frames:
            yield pdf.assign(passed=[[bool(runner(c, t)) for t in ts] if c is not None else [False for _ in ts] for c, ts in zip(pdf[code], pdf[tests])])

    return df.mapInPandas(each, f"{kinds}, passed array<boolean>")
