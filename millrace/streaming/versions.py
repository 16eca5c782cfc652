"""Counts of samples by the version they were made with: samples and versions are two streams that meet in one keyed state.

A pool's samples are started, done, cancelled, retried and taken; a version event publishes how many were started since the last
one and sets that count anew to those that are still about: in flight, cancelled or waiting.  The share of the time that the
pool was idle, from its first idle event to the version event, comes with it.

A pool's events are applied by time within a micro-batch; the result doesn't depend on how the streams are cut, as long as micro-batches
follow time.  State is six numbers a pool, and the pools of a part share one state of six arrays, so that Python is called once for each of PARTS
parts and not for each pool.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event changes: in flight, waiting, cancelled, started since the version.
CHANGES = {"start": (1, 0, 0, 1), "done": (-1, 1, 0, 0), "cancel": (-1, 0, 1, 0), "retry": (1, 0, -1, 0), "take": (0, -1, 0, 0)}
OUT = "pool long, at long, version long, stale long, kept long, idle_ratio double"
NUMBERS = ["active", "queued", "cancelled", "stale", "since", "idle"]
STATE = ", ".join(f"{c} array<long>" for c in ["pool", *NUMBERS])
#: Parts that pools are dealt over by hash.
PARTS = 1024


def step(key, frames, state: GroupState):
    held = {p: row for p, *row in zip(*state.get)} if state.exists else {}
    given = [f for f in frames if len(f)]
    rows, out = pd.concat(given).sort_values("at", kind="stable") if given else pd.DataFrame(columns=["pool", "at", "kind", "version"]), []
    for pool, at, kind, version in zip(*(rows[c].tolist() for c in ["pool", "at", "kind", "version"])):
        s = held.get(pool)
        if s is None:
            s = held[pool] = [0, 0, 0, 0, None, None]
        if kind in CHANGES:
            for i, change in enumerate(CHANGES[kind]):
                s[i] += change
        elif kind == "idle":
            s[5] = at if s[5] is None else s[5]
        elif kind == "version":
            active, queued, cancelled, stale, since, idle = s
            kept = active + cancelled + queued
            ratio = 1 - (idle - since) / (at - since) if idle is not None and since is not None and at > since else None
            out.append((pool, at, version, stale, kept, ratio))
            s[3:] = [kept, at, None]
    state.update(tuple(list(c) for c in zip(*([p, *row] for p, row in held.items()))) if held else ([],) * 7)
    if out:
        yield pd.DataFrame(out, columns=["pool", "at", "version", "stale", "kept", "idle_ratio"]).astype({"idle_ratio": "float64"})


def version_counts(samples: DataFrame, versions: DataFrame) -> DataFrame:
    """Streams of samples (pool, at, kind) and versions (pool, at, version) as a stream of one row a version event.  Unknown kinds change nothing."""
    one = samples.select(F.col("pool").cast("long").alias("pool"), F.col("at").cast("long").alias("at"), "kind", F.lit(-1).cast("long").alias("version"))
    two = versions.select(F.col("pool").cast("long").alias("pool"), F.col("at").cast("long").alias("at"), F.lit("version").alias("kind"), F.col("version").cast("long").alias("version"))
    return one.union(two).withColumn("part", F.pmod(F.hash("pool"), F.lit(PARTS))).groupBy("part").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
