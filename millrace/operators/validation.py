"""Validation samples as one long frame of metrics, and metrics that follow from others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import draws


def long_form(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """keep, variable and value: one row for each of the value columns; nulls go."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*").where("value is not null")


def means(df: DataFrame, source: str, uid: str, values: list[str]) -> DataFrame:
    """source, variable, metric, value: mean@N and, for N > 1, std@N (population) of each uid's N values, averaged
    over the uids that have as many."""
    each = long_form(df, [source, uid], values).groupBy(source, uid, "variable").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    named = lambda kind, c: F.struct(F.concat(F.lit(f"{kind}@"), F.col("n").cast("string")).alias("metric"), F.col(c).alias("value"))
    both = F.array(named("mean", "m"), F.when(F.col("n") > 1, named("std", "s")))
    rows = each.select(source, "variable", F.explode(both).alias("_x")).where("_x is not null").select(source, "variable", "_x.*")
    return rows.groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def majority_values(votes: np.ndarray, values: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """For each row of picked places: the first value of the most frequent vote, ties to the vote picked first."""
    names: dict = {}
    codes = np.array([names.setdefault(v, len(names)) for v in votes])[picked]
    in_row = codes + np.arange(len(picked))[:, None] * len(names)
    _, at, times = np.unique(in_row, return_inverse=True, return_counts=True)
    counts = times[at].reshape(picked.shape)  # how often each place's vote was picked in its row
    first = counts.argmax(axis=1)  # the first of the largest
    return values[picked[np.arange(len(picked)), first]]


def resampled(df: DataFrame, source: str, uid: str, order: str, values: list[str], vote: str | None = None, times: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value: best@k and worst@k, and with a vote maj@k, each as /mean and /std over
    resamples of a uid's N > 1 values (k: 2, 4, ... below N, then N), averaged over uids.  A uid is one
    prompt's responses: a group of one task."""
    votes = F.col(vote).cast("string") if vote else F.lit(None).cast("string")
    rows = long_form(df.withColumn("_vote", votes).withColumn("_order", F.col(order)), [source, uid, "_vote", "_order"], values)
    kinds = dict(df.dtypes)
    # one row a group, its values in order: groups of one size share their draws, and a batch holds many groups
    one = F.sort_array(F.collect_list(F.struct(F.col("_order").isNull().alias("_z"), "_order", "value", "_vote")))
    lists = rows.groupBy(source, uid, "variable").agg(one.alias("_l")).select(source, "variable", F.col("_l.value").alias("v"), F.col("_l._vote").alias("said")).where("size(v) > 1")

    def each(batches):
        drawn = {}  # of the group size that came last: sizes repeat, and large draws aren't kept
        for pdf in batches:
            out = []
            for place, n in sorted(enumerate(map(len, pdf["v"])), key=lambda x: x[1]):
                if n not in drawn:
                    drawn = {n: [(k, draws(n, k, times, seed)) for k in [*(2**i for i in range(1, 31) if 2**i < n), n]]}
                v, said = np.asarray(pdf["v"].iloc[place], dtype=float), pdf["said"].iloc[place]
                for k, picked in drawn[n]:
                    found = {"best": v[picked].max(axis=1), "worst": v[picked].min(axis=1)}
                    if vote:
                        found["maj"] = majority_values(said, v, picked)
                    for name, x in found.items():
                        out += [(pdf[source].iloc[place], pdf["variable"].iloc[place], f"{name}@{k}/mean", float(x.mean())), (pdf[source].iloc[place], pdf["variable"].iloc[place], f"{name}@{k}/std", float(x.std()))]
            yield pd.DataFrame(out, columns=[source, "variable", "metric", "value"])

    per_uid = lists.mapInPandas(each, f"`{source}` {kinds[source]}, variable string, metric string, value double")
    return per_uid.groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


#: Fixed names of the metrics that follow from others, and of what each needs.
SPREAD = ("global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min")
THROUGHPUT = ("perf/throughput", "perf/total_num_tokens", "perf/time_per_step")
IDLE = ("trainer/idle_ratio", "timing_s/gen", "timing_s/step")


def derived(metrics: DataFrame, workers: int) -> DataFrame:
    """name and value rows with the length spread and throughput (where named already) and the idle ratio computed from
    the others; a metric whose parts are missing stays as it is, a division by zero gives null."""
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    has = lambda *names: F.least(F.lit(1), *[F.coalesce(F.max((F.col("name") == n).cast("int")), F.lit(0)) for n in names]) == 1
    rules = [
        (SPREAD[0], has(*SPREAD), at(SPREAD[1]) - at(SPREAD[2])),
        (THROUGHPUT[0], has(*THROUGHPUT), F.try_divide(at(THROUGHPUT[1]), at(THROUGHPUT[2]) * workers)),
        (IDLE[0], has(*IDLE[1:]), F.try_divide(at(IDLE[1]), at(IDLE[2]))),
    ]
    one = metrics.agg(F.array(*[F.when(ok, F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, ok, v in rules]).alias("_new"))
    new = one.select(F.explode("_new").alias("_x")).where("_x is not null").select("_x.*")
    return metrics.select("name", "value").join(F.broadcast(new.select("name")), "name", "left_anti").unionByName(new)
