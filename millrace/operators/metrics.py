"""Aggregates over verdicts, validation samples and training steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S


def share(c: Column) -> Column:
    """Mean of a condition; null for no rows."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def accuracy(df: DataFrame, correct: Column, *by: str) -> DataFrame:
    """correct, total and accuracy in percent; an error for no rows."""
    n = F.count("*")
    value = F.when(n == 0, F.raise_error(F.lit("no rows to score")).cast("double")).otherwise(100.0 * F.count_if(correct) / n)
    return (df.groupBy(*by) if by else df).agg(F.count_if(correct).alias("correct"), n.alias("total"), value.alias("accuracy"))


def accuracy_by_level(df: DataFrame, correct: Column, category: str) -> DataFrame:
    """Accuracy of each category, of what stands before its first slash, and of all; level says which."""
    rows = df.withColumn("_ok", F.when(correct, 1).otherwise(0)).withColumn("_c", F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("_s", F.trim(F.substring_index("_c", "/", 1)))
    out = rows.groupingSets([["_c"], ["_s"], []], "_c", "_s").agg(F.sum("_ok").alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "category").otherwise("super")
    return out.select(level.alias("level"), F.coalesce("_c", "_s", F.lit("")).alias("name"), "correct", "total", (100.0 * F.col("correct") / F.col("total")).alias("accuracy"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, gold: Column, correct: Column, *by: str) -> DataFrame:
    """tp and fn by gold yes; fp: gold no and wrong; all else is tn.  yes_ratio is that of the gold."""
    g = F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    kind = F.when((g == "yes") & correct, "tp").when((g == "no") & ~correct, "fp").when((g == "yes") & ~correct, "fn").otherwise("tn")
    rows = df.withColumn("_k", kind).withColumn("_g", g)
    counts = (rows.groupBy(*by) if by else rows).agg(*[F.count_if(F.col("_k") == k).alias(k) for k in ("tp", "fp", "fn", "tn")], F.count_if(F.col("_g") == "yes").alias("_yes"), F.count("*").alias("total"))
    d = lambda c: F.col(c).cast("double")
    p, r = ratio(d("tp"), d("tp") + d("fp")), ratio(d("tp"), d("tp") + d("fn"))
    return counts.select(*by, "tp", "fp", "fn", "tn", "total", ratio(d("tp") + d("tn"), d("total")).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(d("_yes"), d("total")).alias("yes_ratio"))


def macro(df: DataFrame, correct: Column, category: str, names: list[str], strict: bool = False) -> DataFrame:
    """Mean over the named categories of their accuracy; one without rows counts 0, or is refused."""
    one = lambda n: F.avg(F.when(F.col(category) == n, F.when(correct, 100.0).otherwise(0.0)))
    missing = lambda n: F.raise_error(F.lit(f"category {n} has no rows")).cast("double") if strict else F.lit(0.0)
    return df.agg((sum((F.coalesce(one(n), missing(n)) for n in names), F.lit(0.0)) / len(names)).alias("score"))


def benchmark_scores(df: DataFrame, correct: Column, benchmark: str) -> DataFrame:
    """Score of each benchmark to four places, and under "mean" that of the rounded scores."""
    each = accuracy(df, correct, benchmark).select(F.col(benchmark).alias("name"), F.bround("accuracy", 4).alias("score"), "correct", "total")
    return each.union(each.agg(F.lit("mean").alias("name"), F.avg("score").alias("score"), F.sum("correct"), F.sum("total")))


def pair_scores(df: DataFrame, pair: str, member: str, ok: Column, order: str) -> DataFrame:
    """Of pairs with both members (each by its last row): shares of both right and of one right, in percent."""
    last = df.groupBy(pair, member).agg(F.max_by(ok, order).alias("_ok"))
    side = lambda m: F.max(F.when(F.col(member) == m, F.col("_ok")))
    pairs = last.groupBy(pair).agg(side("A").alias("a"), side("B").alias("b")).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return pairs.agg(F.count("*").alias("pairs"), (100 * share(a)).alias("a_acc"), (100 * share(b)).alias("b_acc"), (100 * share(a & b)).alias("cwpa"), (100 * share(a != b)).alias("cwfr"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def count_accuracy(prediction: Column, references: Column) -> Column:
    """A third for each reference that equals the prediction, at most 1."""
    return F.least(F.size(F.filter(references, lambda r: r == prediction)) / F.lit(3.0), F.lit(1.0))


def mean_of_means(df: DataFrame, row: str, source: str, score: str) -> DataFrame:
    """Mean over responses by row, then by source."""
    return df.groupBy(source, row).agg(F.avg(score).alias("_m")).groupBy(source).agg(F.avg("_m").alias("score"), F.count("*").alias("rows"))


def sizes_up_to(n: Column) -> Column:
    """2, 4, 8, ... below n, then n."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2.0), k).cast("int")), lambda k: k < n)
    return F.array_union(powers, F.array(n.cast("int")))


def draws(n: int, k: int, times: int = 1000, seed: int = 42) -> np.ndarray:
    """The bootstrap's index matrix, the same for all groups of n: seeded anew for each call."""
    rng = np.random.RandomState(seed)
    return np.stack([rng.choice(n, size=k, replace=True) for _ in range(times)])


def bootstrap(df: DataFrame, by: list[str], order: str, value: str, times: int = 1000, seed: int = 42) -> DataFrame:
    """best@k and worst@k of each group for k in sizes_up_to(its size): mean and population deviation over resamples."""

    def each(pdf):
        import pandas as pd

        v = pdf.sort_values("_order")["_value"].to_numpy()
        n, out = len(v), []
        for k in [*(2**i for i in range(1, 31) if 2**i < n), n] if n > 1 else []:
            picked = v[draws(n, k, times, seed)]
            for name, x in (("best", picked.max(axis=1)), ("worst", picked.min(axis=1))):
                out.append((*pdf[by].iloc[0], f"{name}@{k}", float(x.mean()), float(x.std())))
        return pd.DataFrame(out, columns=[*by, "metric", "mean", "std"])

    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)
    rows = df.select(*by, F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    return rows.groupBy(*by).applyInPandas(each, f"{kinds}, metric string, mean double, std double")


def expected_best(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The exact expectation of the best of k draws with replacement (our own addition to the bootstrap)."""
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.count("*").over(w)
    part = F.col(value) * (F.pow(rank / n, F.lit(k)) - F.pow((rank - 1) / n, F.lit(k)))
    return df.select(*by, part.alias("_p")).groupBy(*by).agg(F.sum("_p").alias("expected_best"))


def majority(df: DataFrame, by: list[str], order: str, vote: str, value: str) -> DataFrame:
    """The most frequent vote (ties: the one seen first) and its first value."""
    votes = df.groupBy(*by, vote).agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("_v"))
    best = votes.groupBy(*by).agg(F.max_by(F.struct(F.col(vote).alias("vote"), F.col("_v").alias("v")), F.struct(F.col("_n"), -F.col("_first"))).alias("_b"))
    return best.select(*by, F.col("_b.vote").alias("vote"), F.col("_b.v").alias("value"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """mean@N and std@N (population) of each uid, averaged over the uids of a source."""
    each = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count("*").alias("n"))
    return each.groupBy(source).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.max("n").alias("n_max"))


def reducer(name: Column, value: str) -> Column:
    """By name: with "max" in it the maximum, else with "min" the minimum, else the mean."""
    return F.when(name.contains("max"), F.max(value)).when(name.contains("min"), F.min(value)).otherwise(F.avg(value))


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    return df.groupBy(name).agg(F.max(value).alias("_a"), F.min(value).alias("_i"), F.avg(value).alias("_m")).select(name, F.when(F.contains(F.col(name), F.lit("max")), F.col("_a")).when(F.contains(F.col(name), F.lit("min")), F.col("_i")).otherwise(F.col("_m")).alias(value))


def typed_metrics(df: DataFrame, name: str = "name", agg: str = "agg", value: str = "value") -> DataFrame:
    """Metrics by their declared aggregation; a name with two of them is refused."""
    rows = df.groupBy(name).agg(F.min(agg).alias("_k"), F.max(agg).alias("_k2"), F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    kind = F.when(F.col("_k") != F.col("_k2"), F.raise_error(F.concat(F.lit("two aggregations for "), F.col(name)))).otherwise(F.col("_k"))
    return rows.select(name, kind.alias(agg), F.when(kind == "mean", F.col("mean")).when(kind == "sum", F.col("sum")).when(kind == "min", F.col("min")).otherwise(F.col("max")).alias(value))


def aggregate_steps(df: DataFrame, last: list[str], summed: list[str], step: str = "step", name: str = "name", value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Over several steps (of each group `by`): listed names by their last value or sum; else timing_s/ summed, then by mean/avg, max, min, sum/total in the name; else the mean."""
    n = F.col(name)
    rows = df.groupBy(*(by or []), name).agg(F.max_by(value, step).alias("_last"), F.sum(value).alias("_sum"), F.avg(value).alias("_avg"), F.max(value).alias("_max"), F.min(value).alias("_min"))
    has = lambda *words: F.rlike(n, F.lit("|".join(words)))
    out = F.when(n.isin(last), F.col("_last")).when(n.isin(summed) | n.startswith("timing_s/"), F.col("_sum")).when(has("mean", "avg"), F.col("_avg")).when(has("max"), F.col("_max")).when(has("min"), F.col("_min")).when(has("sum", "total"), F.col("_sum")).otherwise(F.col("_avg"))
    return rows.select(*(by or []), name, out.alias(value))


def spread(x: Column, name: str) -> list[Column]:
    return [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]


def data_metrics(df: DataFrame, longest: int) -> DataFrame:
    """One row over a batch: scores, lengths, clipped and aborted shares, and over masked tokens advantages, returns,
    values and explained variance.  Columns rewards, mask, advantages, returns, values."""
    n = S.count_mask("mask")
    rows = df.agg(*spread(F.when(n > 0, S.total("rewards")), "score"), *spread(n.cast("double"), "length"), share(n == longest).alias("clip_ratio"), share(n == 0).alias("aborted_ratio"))
    z = F.arrays_zip(F.col("advantages").alias("a"), F.col("returns").alias("r"), F.col("values").alias("v"), F.col("mask").alias("m"))
    t = df.select(F.explode(F.filter(z, lambda x: x["m"] != 0)).alias("t")).select("t.*")
    explained = 1 - F.var_samp(F.col("r") - F.col("v")) / (F.var_samp("r") + 1e-5)
    tokens = t.agg(*spread(F.col("a"), "advantages"), *spread(F.col("r"), "returns"), *spread(F.col("v"), "values"), explained.alias("explained_variance"))
    return rows.crossJoin(F.broadcast(tokens))


def timing_metrics(timings: DataFrame, totals: DataFrame) -> DataFrame:
    """Milliseconds a token of each section: of response tokens for "gen", of all tokens else.  totals: response, whole."""
    return timings.crossJoin(F.broadcast(totals)).select("name", F.col("seconds"), (F.col("seconds") * 1000 / F.when(F.col("name") == "gen", F.col("response")).otherwise(F.col("whole"))).alias("ms_per_token"))


def probability_metrics(df: DataFrame) -> DataFrame:
    """Over masked tokens of two log-probability arrays: absolute differences of the probabilities and their correlation."""
    z = F.arrays_zip(F.col("log_prob").alias("a"), F.col("rollout_log_prob").alias("b"), F.col("mask").alias("m"))
    t = df.select(F.explode(F.filter(z, lambda x: x["m"] != 0)).alias("t")).select(F.exp("t.a").alias("a"), F.exp("t.b").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return t.agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.corr("a", "b").alias("pearson"))


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, extremes and the 50th, 95th and 99th percentile, by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = (df.groupBy(*by) if by else df).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), p.alias("_p"))
    return out.select(*by, "avg", "max", "min", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def staleness(df: DataFrame, current: int, version: str = "version") -> DataFrame:
    """Samples that lag one version at least, the longest lag, and how many versions there are."""
    lag = F.lit(current) - F.col(version)
    return df.agg(F.count("*").alias("samples"), F.count_if(lag >= 1).alias("stale"), F.max(lag).alias("longest"), F.countDistinct(version).alias("versions"))


def partial_rollouts(df: DataFrame, start: str, end: str) -> DataFrame:
    """Samples whose version changed on the way: number, share and widest change."""
    change = F.abs(F.col(end) - F.col(start))
    return df.agg(F.count_if(change > 0).alias("partial"), share(change > 0).alias("partial_ratio"), F.max(change).alias("max_span"))


def variance_proxies(df: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """Signal (the squared norm of the mean gradient, which the caller measures), total power - the mean of squared
    advantages times sequence weights W = sum(1 - 2 pi + sum_pi_squared) - and the noise between them, over rows less 1."""
    w = S.masked_sum(F.zip_with("old_log_probs", "sum_pi_squared", lambda x, s: 1 - 2 * F.exp(x) + s), "mask")
    a = S.masked_mean("advantages", "mask")
    signal = F.lit(0.0 if gradient_norm is None else float(gradient_norm) ** 2)
    power = F.avg(F.greatest(w, F.lit(0.0)) * a * a)
    noise = F.coalesce(F.greatest(F.try_divide(power - signal, F.count("*").cast("double") - 1), F.lit(0.0)), F.lit(0.0)) if gradient_norm is not None else F.lit(0.0)
    return df.agg(signal.alias("signal"), power.alias("power"), noise.alias("noise"), F.avg(a * a).alias("expected_a_squared"), F.avg(w).alias("expected_w"))
