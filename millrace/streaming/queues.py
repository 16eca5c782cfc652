"""Keyed stateful operators on streams: bounded queues, count windows, rate limits, staleness.

State is kept per key by Structured Streaming, in the state store and its checkpoint.  Order is arrival
order; to have one order on every run, rows of a micro-batch are taken by `order`.
Lateness is version lag, not event time; event-time windows are an extension of ours and set a
watermark, so that their state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sorted_rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = [p for p in parts if len(p)]
    return pd.concat(frames).sort_values("order", kind="stable") if frames else pd.DataFrame({"order": [], "item": []})


def keyed(df: DataFrame, key: str, order: str, item: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("order"), F.col(item).cast("double").alias("item"))


def bounded_queue(df: DataFrame, key: str, order: str, item: str, capacity: int) -> DataFrame:
    """A queue a key that drops its oldest element when full.  One row a key and micro-batch: how many were put and
    dropped so far, and what the queue holds (oldest first)."""

    def step(k, parts, state: GroupState):
        put, dropped, held = state.get if state.exists else (0, 0, [])
        rows = sorted_rows(parts)
        held = [*held, *rows["item"].tolist()]
        over = max(0, len(held) - capacity)
        put, dropped, held = put + len(rows), dropped + over, held[over:]
        state.update((put, dropped, held))
        yield pd.DataFrame({"key": [k[0]], "put": [put], "dropped": [dropped], "size": [len(held)], "oldest": [held[0] if held else None], "newest": [held[-1] if held else None]})

    return keyed(df, key, order, item).groupBy("key").applyInPandasWithState(step, "key long, put long, dropped long, size long, oldest double, newest double", "put long, dropped long, held array<double>", "update", GroupStateTimeout.NoTimeout)


def count_windows(df: DataFrame, key: str, order: str, item: str, size: int) -> DataFrame:
    """Batches of exactly `size` rows of a key; the incomplete rest stays in state and comes out of later input alone."""

    def step(k, parts, state: GroupState):
        number, held = state.get if state.exists else (0, [])
        held = [*held, *sorted_rows(parts)["item"].tolist()]
        out = []
        while len(held) >= size:
            batch, held = held[:size], held[size:]
            out.append((k[0], number, sum(batch), min(batch), max(batch)))
            number += 1
        state.update((number, held))
        yield pd.DataFrame(out, columns=["key", "window", "total", "low", "high"]).astype({"key": "int64", "window": "int64"})

    return keyed(df, key, order, item).groupBy("key").applyInPandasWithState(step, "key long, window long, total double, low double, high double", "number long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def token_bucket(df: DataFrame, key: str, order: str, item: str, rate: float, capacity: float) -> DataFrame:
    """Waits of requests of `item` tokens at second `order`: the bucket refills at `rate` up to `capacity`; a request
    larger than that goes into debt."""

    def step(k, parts, state: GroupState):
        level, last = state.get if state.exists else (capacity, None)
        out = []
        for at, need in sorted_rows(parts)[["order", "item"]].itertuples(index=False):
            level = min(capacity, level + rate * max(0.0, at - last)) if last is not None else level
            wait = max(0.0, (min(need, capacity) - level) / rate)
            level, last = level + rate * wait - need, at + wait
            out.append((k[0], int(at), float(need), float(wait)))
        state.update((float(level), float(last) if last is not None else None))
        yield pd.DataFrame(out, columns=["key", "second", "need", "wait"]).astype({"key": "int64", "second": "int64"})

    return keyed(df, key, order, item).groupBy("key").applyInPandasWithState(step, "key long, second long, need double, wait double", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def running_counts(df: DataFrame, key: str, stale: Column) -> DataFrame:
    """Rows and stale rows so far, a key."""
    return df.groupBy(key).agg(F.count("*").alias("samples"), F.count_if(stale).alias("stale"))


def event_windows(df: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """An extension of ours: tumbling windows of event time with a watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def required_samples(required: int, staleness: float, sync_steps: int) -> int:
    """How many samples may be out at once."""
    return int(required * (staleness + 1) * sync_steps)


def should_pause(queued: int, capacity: int, stale: int, budget: int) -> bool:
    """Generation rests while the queue is full or the stale budget is spent."""
    return queued >= capacity or stale >= budget


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over what there is; results as Parquet under folder/out, state under folder/state."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("epoch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/epoch={n}_"))
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
