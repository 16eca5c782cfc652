"""Batches of exactly N samples out of a stream, with their statistics, and metrics flushed every K batches.

Each micro-batch is one idempotent step: it reads what the step before left over (under its number), and overwrites what it
writes under its own.  A run that breaks off after writing is repeated with the same rows and the same start, so nothing is
counted twice; batches don't depend on how the stream was cut, as long as micro-batches follow the order of samples.

Left over are fewer than N samples and fewer than K batches' metrics; the numbers of samples come from sorted ranges, so that
no task holds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import aggregate_steps
from ..operators.records import numbered
from ..sources.files import delete, exists

LAST: list[str] = []


def batch_statistics(samples: DataFrame) -> DataFrame:
    """A row a batch of samples (batch, processing_time, tool_calls, version_start, version_end): times, calls, partial samples, versions."""
    t, calls, span = F.col("processing_time"), F.col("tool_calls"), F.abs(F.col("version_end") - F.col("version_start"))
    part = F.count_if(span != 0)
    return samples.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.avg(t).alias("processing_time/avg"), F.max(t).alias("processing_time/max"), F.min(t).alias("processing_time/min"),
        *[F.percentile(t, F.lit(p / 100)).alias(f"processing_time/tp{p}") for p in (50, 95, 99)],
        F.max(calls).alias("timing_s/tool_calls/max"), F.min(calls).alias("timing_s/tool_calls/min"), F.avg(calls).alias("timing_s/tool_calls/mean"),
        part.alias("partial/total_partial_num"), (part / F.count("*")).alias("partial/partial_ratio"), F.max(span).alias("partial/max_partial_span"),
        F.count_distinct("version_end").alias("version_diversity"),
    )


def long_metrics(statistics: DataFrame) -> DataFrame:
    """(step, name, value) of all statistics but the number of samples."""
    names = [c for c in statistics.columns if c not in ("batch", "n")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in names]))
    return statistics.select(F.col("batch").alias("step"), pairs.alias("m")).select("step", "m.name", "m.value")


def assembler(folder: str, size: int, every: int, order: str, statistics: Callable[[DataFrame], DataFrame] = batch_statistics, after: Callable[[int], None] | None = None):
    """The function for foreachBatch: complete batches go to folder/batches, their statistics to folder/statistics, metrics of `every` batches to
    folder/flushed; the rest waits under folder/left and folder/steps.  after(epoch) is called last, for tests that break a run off."""

    def step(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        at = lambda name, e=epoch: f"{folder}/{name}/epoch={e}"
        before = epoch > 0 and exists(spark, at("next", epoch - 1))
        base = spark.read.parquet(at("next", epoch - 1)).first()["batch"] if before else 0
        rows = spark.read.schema(df.schema).parquet(at("left", epoch - 1)).unionByName(df) if before else df
        rows = numbered(rows, order, name="_row")
        full = rows.count() // size
        done = rows.where(F.col("_row") < full * size).withColumn("batch", F.expr(f"{base} + _row div {size}")).drop("_row")
        done.write.mode("overwrite").parquet(at("batches"))
        rows.where(F.col("_row") >= full * size).drop("_row").write.mode("overwrite").parquet(at("left"))
        statistics(spark.read.parquet(at("batches"))).write.mode("overwrite").parquet(at("statistics"))
        steps = long_metrics(spark.read.parquet(at("statistics")))
        if before:
            steps = steps.unionByName(spark.read.parquet(at("steps", epoch - 1)))
        steps = steps.withColumn("version", F.expr(f"step div {every}"))
        ready = F.col("version") < (base + full) // every
        aggregate_steps(steps.where(ready), LAST, [], by=["version"]).write.mode("overwrite").parquet(at("flushed"))
        steps.where(~ready).drop("version").write.mode("overwrite").parquet(at("steps"))
        spark.range(1).select(F.lit(base + full).alias("batch")).write.mode("overwrite").parquet(at("next"))
        for name in ("left", "steps", "next"):
            delete(spark, at(name, epoch - 2))  # the step before stays until this one is committed
        if after:
            after(epoch)

    return step


def assemble(stream: DataFrame, folder: str, size: int, every: int, order: str, **more) -> None:
    """Runs what there is of a stream; goes on where the last run ended, or broke off."""
    stream.writeStream.foreachBatch(assembler(folder, size, every, order, **more)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
