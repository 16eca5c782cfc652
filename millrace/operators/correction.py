"""Rollout correction: importance weights, rejection masks and off-policy metrics.

Rows are sequences with arrays log_prob, rollout_log_prob and mask.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S

BOUND = 20.0
TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
SEQUENCE_OPTIONS = ("seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def parse_thresholds(options: list[str], spec) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) of each option.  spec: a number, or comma-separated ones: one for all options or one each;
    for k1 "lower_upper", or an upper bound whose reciprocal is the lower one; for others an upper bound."""
    if spec is None:
        raise ValueError("a threshold is needed")
    if not isinstance(spec, (int, float, str)):
        raise TypeError("thresholds are a number or text")
    parts = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(parts) not in (1, len(options)) or not parts:
        raise ValueError(f"{len(parts)} thresholds for {len(options)} options")
    out = {}
    for option, part in zip(options, parts * len(options) if len(parts) == 1 else parts):
        pair = part.split("_", 1)
        if not option.endswith("k1") and len(pair) > 1:
            raise ValueError(f"{option} has an upper bound alone, not {part!r}")
        try:
            upper = float(pair[-1])
            lower = (float(pair[0]) if len(pair) > 1 else 1 / upper) if option.endswith("k1") else None
        except (ValueError, ZeroDivisionError) as error:
            raise ValueError(f"no threshold: {part!r}") from error
        if upper <= 0 or (lower is not None and lower <= 0):
            raise ValueError(f"thresholds are positive, not {part!r}")
        out[option] = (lower, upper)
    return out


def ratio(df: DataFrame) -> DataFrame:
    """_r: log ratio of the trained to the rollout policy, a token."""
    return df.withColumn("_r", F.zip_with("log_prob", "rollout_log_prob", lambda a, b: a - b))


def bounded(x: Column) -> Column:
    return S.clip(x, -BOUND, BOUND)


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalise: bool = False) -> DataFrame:
    """is_weights: exp of the log ratio of each token, or of its sequence's sum, cut at the threshold; over the
    batch's mean if normalised.  raw_weights: before the cut."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    rows = ratio(df)
    if level == "token":
        raw = F.zip_with(F.transform("_r", lambda x: F.exp(bounded(x))), "mask", lambda w, m: w * m)
    elif level == "sequence":
        rows = rows.withColumn("_s", F.exp(bounded(S.masked_sum("_r", "mask"))))
        raw = F.transform("mask", lambda m: F.col("_s") * m)
    else:
        raise ValueError(f"no level {level}")
    rows = rows.withColumn("raw_weights", raw).withColumn("is_weights", F.transform("raw_weights", lambda w: F.least(w, F.lit(float(threshold)))))
    if normalise:
        if level == "token":
            mean = F.sum(S.masked_sum("is_weights", "mask")) / (F.sum(S.count_mask("mask")) + S.EPS)
        else:
            some = F.when(S.count_mask("mask") > 0, 1.0).otherwise(0.0)
            mean = F.sum(S.masked_mean("is_weights", "mask") * some) / F.greatest(F.sum(some), F.lit(S.EPS))
        rows = rows.crossJoin(F.broadcast(rows.agg(mean.alias("_mean"))))
        rows = rows.withColumn("is_weights", F.transform("is_weights", lambda w: F.when(F.col("_mean") > S.EPS, w / F.col("_mean")).otherwise(w))).drop("_mean")
    return rows.drop("_r", "_s")


def statistic(option: str) -> tuple[Column, bool]:
    """The option's statistic (an array for token options, else one number), and whether it is a token's."""
    level, kind = option.rsplit("_", 1)
    value = {"k1": lambda x: -x, "k2": lambda x: 0.5 * x * x, "k3": lambda x: F.exp(x) - 1 - x}[kind]
    tokens = F.transform("_r", lambda x: value(bounded(x)))
    if level == "token":
        return tokens, True
    if level == "seq_sum":
        return S.masked_sum(tokens, "mask"), False
    if level == "seq_mean":
        return S.masked_mean(tokens, "mask"), False
    return F.coalesce(F.array_max(S.compact(tokens, "mask")), F.lit(0.0)), False


def within(x: Column, bounds: tuple[float | None, float], kind: str) -> Column:
    lower, upper = bounds
    return (x >= math.log(lower)) & (x <= math.log(upper)) if kind == "k1" else x <= upper


def token_test(bounds, kind: str):
    return lambda v: within(v, bounds, kind)


def rejection_mask(df: DataFrame, options: list[str], thresholds) -> DataFrame:
    """kept_mask: the mask without tokens that any option refuses; seq_kept: nothing of the row is refused."""
    bounds = parse_thresholds(options, thresholds)
    for option in options:
        if option not in (*TOKEN_OPTIONS, *SEQUENCE_OPTIONS):
            raise ValueError(f"no option {option}")
    keep = F.transform("mask", lambda _: F.lit(True))
    for option in options:
        x, by_token = statistic(option)
        kind = option[-2:]
        own = F.transform(x, token_test(bounds[option], kind)) if by_token else F.array_repeat(within(x, bounds[option], kind), F.size("mask"))
        keep = F.zip_with(keep, own, lambda a, b: a & b)
    rows = ratio(df).withColumn("_k", keep).withColumn("kept_mask", F.zip_with("mask", "_k", lambda m, k: F.when(k, m).otherwise(0)))
    return rows.withColumn("seq_kept", S.count_mask("kept_mask") == S.count_mask("mask")).drop("_r", "_k")


def rejection_metrics(df: DataFrame, options: list[str], thresholds) -> DataFrame:
    rows = rejection_mask(df, options, thresholds)
    gone = F.sum(S.count_mask("mask") - S.count_mask("kept_mask")).cast("double") / (F.sum(S.count_mask("mask")) + S.EPS)
    return rows.agg(gone.alias("masked_fraction"), F.avg(F.when(F.col("seq_kept"), 0.0).otherwise(1.0)).alias("seq_masked_fraction"))


def option_metrics(df: DataFrame, options: list[str], thresholds) -> DataFrame:
    """One row an option: mean, extremes, deviation (within the bounds) and shares beyond the bounds of its statistic, by
    token or, for sequence options, by sequences with tokens, and the same by sequence (seq_*).  k1's bounds are logarithms; others
    have no lower one.  A batch without tokens is refused."""
    bounds = parse_thresholds(options, thresholds)
    rows, out = ratio(df).withColumn("_n", S.count_mask("mask")), []
    for i, option in enumerate(options):
        x, by_token = statistic(option)
        rows = rows.withColumn(f"_x{i}", S.compact(x, "mask") if by_token else F.array_repeat(x, F.col("_n").cast("int"))).withColumn(f"_s{i}", F.when(F.col("_n") > 0, S.masked_mean(x, "mask") if by_token else x))
    total = F.sum("_n").cast("double")
    refused = F.raise_error(F.lit("a batch without tokens")).cast("double")
    for i, option in enumerate(options):
        lower, upper = (None if b is None else math.log(b) if option.endswith("k1") else b for b in bounds[option])
        tokens, s, by_token = F.col(f"_x{i}"), F.col(f"_s{i}"), option in TOKEN_OPTIONS
        mean = lambda f: F.sum(F.aggregate(F.transform(tokens, f), F.lit(0.0), lambda a, b: a + b)) / total  # noqa: B023, E731
        share = lambda c: F.avg(c.cast("double"))
        clamp = lambda v: S.clip(v, 0.0 if lower is None else lower, upper)  # noqa: B023, E731
        below = (lambda v: v < lower) if lower is not None else (lambda v: F.lit(False))  # noqa: B023
        flag = lambda test: mean(lambda v: test(v).cast("double"))  # noqa: B023, E731
        variance = mean(lambda v: clamp(v) * clamp(v)) - mean(clamp) ** 2  # noqa: B023
        low, high = share(F.when(s.isNotNull(), below(s))), share(s > upper)
        out.append(F.struct(
            F.lit(option).alias("option"), F.when(F.coalesce(total, F.lit(0.0)) > 0, mean(lambda v: v)).otherwise(refused).alias("mean"),
            (F.max(F.array_max(tokens)) if by_token else F.max(s)).alias("max"), (F.min(F.array_min(tokens)) if by_token else F.min(s)).alias("min"),
            F.when(total > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0).alias("std"),
            (flag(lambda v: v > upper) if by_token else high).alias("fraction_high"), (flag(below) if by_token else low).alias("fraction_low"),  # noqa: B023
            F.avg(s).alias("seq_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("seq_std"), F.max(s).alias("seq_max"), F.min(s).alias("seq_min"),
            F.max(F.abs(s)).alias("seq_max_deviation"), high.alias("seq_fraction_high"), low.alias("seq_fraction_low"),
        ))
    return rows.agg(F.array(*out).alias("_o")).select(F.explode("_o").alias("_o")).select("_o.*")


def weight_metrics(df: DataFrame, level: str, threshold: float) -> DataFrame:
    """Mean, extremes, deviation, effective sample size and shares of weights before the cut, by token and sequence."""
    rows = importance_weights(df, level, threshold)
    low = 1 / threshold
    n = F.sum(S.count_mask("mask")) + S.EPS
    mean = lambda c: F.sum(S.masked_sum(c, "mask")) / n
    clamped = F.transform("raw_weights", lambda w: S.clip(w, low, threshold))
    squares = F.transform(clamped, lambda w: w * w)
    flag = lambda f: F.transform("raw_weights", lambda w: F.when(f(w), 1.0).otherwise(0.0))
    live = S.compact("raw_weights", "mask")
    seq = S.masked_mean("raw_weights", "mask")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = {"mean": mean("raw_weights"), "std": F.sqrt(F.greatest(mean(squares) - mean(clamped) ** 2, F.lit(0.0))), "ess": 1 / (mean(squares) / (mean(clamped) + S.EPS) ** 2), "seq_mean": F.avg(seq), "seq_std": F.coalesce(F.stddev_samp(seq), F.lit(0.0)), "seq_max": F.max(seq), "seq_min": F.min(seq), "seq_max_deviation": F.max(F.abs(seq - 1)), "seq_fraction_high": share(seq > threshold), "seq_fraction_low": share(seq < low)}
    if level == "token":
        out |= {"fraction_high": mean(flag(lambda w: w > threshold)), "fraction_low": mean(flag(lambda w: w < low)), "max": F.max(F.array_max(live)), "min": F.min(F.array_min(live))}
    else:
        rows = ratio(rows)
        s = S.masked_sum("_r", "mask")
        out |= {"fraction_high": share(s > math.log(threshold)), "fraction_low": share(s < math.log(low)), "max": F.exp(F.least(F.max(s), F.lit(BOUND))), "min": F.exp(F.min(s))}
    return rows.agg(*[c.alias(k) for k, c in out.items()])


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """Perplexities of both policies, their ratio, divergences k1 and k3, chi-squared by token and sequence."""
    rows = ratio(df)
    n = F.sum(S.count_mask("mask")) + S.EPS
    mean = lambda c: F.sum(S.masked_sum(c, "mask")) / n
    own, other = -S.masked_mean("log_prob", "mask"), -S.masked_mean("rollout_log_prob", "mask")
    k3 = F.transform("_r", lambda x: F.exp(x) - x - 1)
    chi = F.transform("_r", lambda x: F.exp(bounded(x)) ** 2)
    return rows.agg(
        F.avg(F.exp(own)).alias("training_ppl"), F.avg(own).alias("training_log_ppl"), F.avg(F.exp(other)).alias("rollout_ppl"), F.avg(other).alias("rollout_log_ppl"),
        mean(F.transform("_r", lambda x: -x)).alias("kl"), mean(k3).alias("k3_kl"), F.avg(own - other).alias("log_ppl_diff"), F.avg(F.abs(own - other)).alias("log_ppl_abs_diff"), F.max(own - other).alias("log_ppl_diff_max"), F.min(own - other).alias("log_ppl_diff_min"), F.avg(F.exp(own - other)).alias("ppl_ratio"),
        (mean(chi) - 1).alias("chi2_token"), (F.avg(F.exp(bounded(S.masked_sum("_r", "mask"))) ** 2) - 1).alias("chi2_seq"),
    )


def correct(df: DataFrame, level: str | None = "token", threshold: float = 2.0, options: list[str] | None = None, thresholds=None, normalise: bool = False) -> DataFrame:
    """is_weights and kept_mask in one batch: weights on the given mask, then rejection."""
    rows = importance_weights(df, level, threshold, normalise) if level else df
    return rejection_mask(rows, options, thresholds) if options else rows.withColumn("kept_mask", F.col("mask")).withColumn("seq_kept", F.lit(True))
