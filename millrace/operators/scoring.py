"""Reward managers: scorers by data source, over batches of responses.

A scorer takes the columns response, gold and extra of a row and gives a Column struct with a score;
user code in Python is a function on a pandas frame.  Rows that have a score already keep it.
"""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex as X
from ..functions import sequences as S
from ..functions import text as T
from .registry import Registry

SCORERS = Registry("scorer")


def simple(score: Column, pred: Column | None = None, bad_format: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(score.cast("double").alias("score"), (none.cast("string") if pred is None else pred).alias("pred"), (none.cast("boolean") if bad_format is None else bad_format).alias("incorrect_format"))


def equal(pred: Column, gold: Column) -> Column:
    return F.when(F.coalesce(pred == gold, F.lit(False)), 1.0).otherwise(0.0)


@SCORERS.register("gsm8k")
def gsm8k(answer: Column, gold: Column) -> Column:
    return simple(T.number_score(answer, gold), T.number_answer(answer))


@SCORERS.register("math_line")
def math_line(answer: Column, gold: Column) -> Column:
    s = X.line_score(answer, gold)
    return simple(s["score"], s["pred"])


@SCORERS.register("gpqa")
def gpqa(answer: Column, gold: Column) -> Column:
    pred = T.letter_last(answer)
    return simple(equal(pred, gold), pred, ~pred.isin("A", "B", "C", "D"))


@SCORERS.register("mcq")
def mcq(answer: Column, gold: Column, compat: bool = False) -> Column:
    """compat: the flag says "right format" where its name says the opposite."""
    pred, ok = T.xml_answer(answer), T.xml_format_ok(answer)
    return simple(equal(pred, gold), pred, ok if compat else ~ok)


@SCORERS.register("mmlu_pro")
def mmlu_pro(answer: Column, gold: Column) -> Column:
    pred = T.ten_choice(answer)
    return simple(equal(pred, gold), pred, ~F.rlike(pred, F.lit("^[A-J]$")))


@SCORERS.register("qa_exact")
def qa_exact(answer: Column, gold: Column) -> Column:
    return simple(T.qa_score(answer, F.array(gold)), T.tagged_answer(answer))


@SCORERS.register("mixed")
def mixed(answer: Column, gold: Column) -> Column:
    s = T.mixed_score(answer, gold, F.lit(""))
    return simple(s["score"], s["pred"])


def score(df: DataFrame, routes: dict[str, str], source: str = "data_source", answer: str = "response", gold: str = "gold") -> DataFrame:
    """df with result by the scorer of its source; a source without one is refused, a row with `given_score` keeps it."""
    result = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(F.col(source), F.lit("null")))).cast("struct<score:double,pred:string,incorrect_format:boolean>")
    for name, scorer in routes.items():
        result = F.when(F.col(source) == name, SCORERS.get(scorer)(F.col(answer), F.col(gold))).otherwise(result)
    if "given_score" in df.columns:
        result = F.when(F.col("given_score").isNotNull(), simple(F.col("given_score"))).otherwise(result)
    return df.withColumn("result", result)


def score_with(df: DataFrame, function: Callable[[pd.DataFrame], pd.Series], name: str = "score", default: float = 0.0, given: str | None = None) -> DataFrame:
    """df with the score of a user's function on frames; a frame that it fails on is tried row by row, and failing rows get the default.

    Rows that have a score in the column `given`, if one is named, keep it; the function doesn't see them."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def tried(pdf):
        try:
            return pd.Series(function(pdf)).to_numpy(dtype="float64")
        except Exception:
            values = []
            for i in range(len(pdf)):
                try:
                    values.append(float(function(pdf.iloc[i : i + 1]).iloc[0]))
                except Exception:  # a scorer's failure is the default score
                    values.append(default)
            return values

    def each(frames):
        for pdf in frames:
            yield pdf.assign(**{name: around_given(pdf, tried, given)})

    return df.mapInPandas(each, f"{kinds}, `{name}` double")


def around_given(pdf: pd.DataFrame, scores: Callable[[pd.DataFrame], object], given: str | None) -> pd.Series:
    """Given scores where there are any; of the other rows alone what `scores` says."""
    out = pdf[given].astype("float64") if given in pdf else pd.Series(float("nan"), index=pdf.index)
    rest = out.isna()
    if rest.any():
        out = out.copy()
        out[rest] = scores(pdf[rest])
    return out


class Bucket:
    """Permits that come back at a rate a second, at most as many as one second gives (one at least)."""

    def __init__(self, rate: float):
        self.rate, self.most = rate, max(1.0, rate)
        self.level, self.at = self.most, time.monotonic()

    async def take(self, n: float) -> None:
        n = min(n, self.most)  # a larger need waits for a full bucket
        while True:
            now = time.monotonic()
            self.level, self.at = min(self.most, self.level + (now - self.at) * self.rate), now
            if self.level >= n:
                self.level -= n
                return
            await asyncio.sleep((n - self.level) / self.rate)


def score_calls(df: DataFrame, call: Callable[[dict], object], at_once: int = 8, seconds: float = 300.0, default: float = 0.0, calls_a_minute: float | None = None, tokens_a_minute: float | None = None, tokens: Callable[[dict], float] | None = None, tasks: int | None = None, given: str = "given_score") -> DataFrame:
    """df with score, status and problem: each row by a remote scorer, call(row) -> number, a coroutine's or a plain function's.

    Within a task at most `at_once` calls run at a time, each for at most `seconds`; one that takes longer is a `timeout`, one that fails an
    `error`, and both get the default score.  Rows with a given score are `given` and cause no call.  Rates hold for the whole job: with any, the
    rows are dealt to `tasks` tasks (1 unless given), which share them evenly.  A plain function that doesn't end keeps its thread; the row goes on without it."""
    if (calls_a_minute or tokens_a_minute) and tasks is None:
        tasks = 1
    rows = df.repartition(tasks) if tasks else df
    share = lambda rate: Bucket(rate / 60 / tasks) if rate else None
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    async def scored(records: list[dict], buckets) -> list[tuple]:
        gate, pool = asyncio.Semaphore(at_once), ThreadPoolExecutor(at_once)
        loop = asyncio.get_running_loop()

        async def one(record):
            if record.get(given) is not None and record[given] == record[given]:
                return float(record[given]), "given", None
            for bucket, need in zip(buckets, (1.0, tokens(record) if tokens else 1.0)):
                if bucket:
                    await bucket.take(need)
            async with gate:
                try:
                    work = call(record) if inspect.iscoroutinefunction(call) else loop.run_in_executor(pool, call, record)
                    return float(await asyncio.wait_for(work, seconds)), "ok", None
                except TimeoutError:
                    return default, "timeout", f"no answer within {seconds:g} s"
                except Exception as failure:  # a scorer's failure is the default score
                    return default, "error", f"{type(failure).__name__}: {failure}"

        try:
            return await asyncio.gather(*map(one, records))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def each(frames):
        buckets = (share(calls_a_minute), share(tokens_a_minute))
        for pdf in frames:
            got = asyncio.run(scored(pdf.to_dict("records"), buckets)) if len(pdf) else []
            yield pdf.assign(score=[float(g[0]) for g in got], status=[g[1] for g in got], problem=[g[2] for g in got])

    return rows.mapInPandas(each, f"{kinds}, score double, status string, problem string")


def token_rewards(df: DataFrame, score_: str = "score", mask: str = "mask", longest: int | None = None, buffer: int | None = None, factor: float = 1.0) -> DataFrame:
    """rewards: the score at the last valid token, less the penalty of overlong responses if a buffer is set."""
    value = F.col(score_)
    if buffer is not None:
        value = value + S.overlong_penalty(S.count_mask(mask), longest, buffer, factor)
    return df.withColumn("rewards", S.at_last_valid(mask, value))
