"""Reward managers by name: each gives a batch its score and token rewards.

A manager takes rows with a response mask and what its scorer reads.  Rows with a `given_score` keep
it, whatever the manager.  The result has `score`, `rewards` (the reward at the last token of the mask;
all zero for an empty mask) and what the manager itself adds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .registry import Registry
from .scoring import around_given, score, score_calls, score_with

MANAGERS = Registry("reward manager")


def given(df: DataFrame) -> DataFrame:
    """A given score stands before the manager's."""
    return df.withColumn("score", F.coalesce("given_score", "score")) if "given_score" in df.columns else df


def routed(df: DataFrame, routes: dict[str, str]) -> DataFrame:
    return score(df, routes).withColumn("score", F.col("result")["score"]).drop("result")


@MANAGERS.register("naive")
def naive(df: DataFrame, routes: dict[str, str], mask: str = "mask") -> DataFrame:
    """Scores by the rows' sources."""
    return routed(df, routes).withColumn("rewards", S.at_last_valid(mask, F.col("score")))


@MANAGERS.register("dapo")
def dapo(df: DataFrame, routes: dict[str, str], longest: int, buffer: int, factor: float = 1.0, mask: str = "mask") -> DataFrame:
    """Scores by source, less a penalty that grows over the last `buffer` of the `longest` tokens: overlong_reward, and overlong where it isn't zero.
    Given scores stay as they are, without a penalty."""
    if not 0 < buffer <= longest:
        raise ValueError(f"a buffer of {buffer} for responses of {longest}")
    penalty = S.overlong_penalty(S.count_mask(mask), longest, buffer, factor)
    own = F.col("given_score").isNull() if "given_score" in df.columns else F.lit(True)
    rows = routed(df, routes).withColumn("overlong_reward", F.when(own, penalty).otherwise(0.0))
    return rows.withColumn("overlong", F.col("overlong_reward") < 0).withColumn("rewards", S.at_last_valid(mask, F.col("score") + F.col("overlong_reward")))


@MANAGERS.register("batch")
def batch(df: DataFrame, function: Callable[[pd.DataFrame], pd.Series], mask: str = "mask") -> DataFrame:
    """Scores of a function on frames; its failure is the batch's."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def each(frames):
        for pdf in frames:
            yield pdf.assign(score=around_given(pdf, lambda rest: pd.Series(function(rest)).to_numpy(dtype="float64"), "given_score"))

    return df.mapInPandas(each, f"{kinds}, score double").withColumn("rewards", S.at_last_valid(mask, F.col("score")))


@MANAGERS.register("prime")
def prime(df: DataFrame, function: Callable[[pd.DataFrame], pd.Series], seconds: float | None = None, mask: str = "mask") -> DataFrame:
    """As batch, but a row that the function fails on scores 0; with a time limit rows are scored one by one, and one that takes longer scores 0."""
    if seconds is None:
        rows = score_with(df, function, given="given_score")
    else:
        rows = score_calls(df, lambda record: float(function(pd.DataFrame([record])).iloc[0]), seconds=seconds).drop("status", "problem")
    return rows.withColumn("rewards", S.at_last_valid(mask, F.col("score")))


@MANAGERS.register("limited")
def limited(df: DataFrame, call: Callable[[dict], object], mask: str = "mask", **limits) -> DataFrame:
    """Scores of a remote scorer under limits of time, number and rate (`score_calls`), with each row's status."""
    return score_calls(df, call, **limits).withColumn("rewards", S.at_last_valid(mask, F.col("score")))


def rewarded(df: DataFrame, manager: str, reward_free: bool = False, mask: str = "mask", **options) -> DataFrame:
    """The named manager's rewards; without rewards (reward_free) given scores stay and all else is 0, and no scorer runs."""
    if reward_free:
        rows = given(df.withColumn("score", F.lit(0.0)))
        return rows.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rewards", S.at_last_valid(mask, F.col("score")))
    return MANAGERS.get(manager)(df, mask=mask, **options)
