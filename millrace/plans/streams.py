"""Queries that run a stream over the events table (survey block 2.12)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import queues as Q
from ..streaming.assembly import assemble
from ..streaming.versions import version_counts
from .catalog import query
from .tables import rounded, table


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under this machine's temporary folder if all tasks run here."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or f"file://{os.path.join(tempfile.gettempdir(), 'streams')}"
    return f"{base}/stream-{uuid.uuid4().hex}"


def streamed(spark, sf_dir, build, mode: str = "append"):
    schema = table(spark, sf_dir, "events").schema
    folder = shared_folder(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/event[s].parquet")  # a glob may name a file or a folder
    Q.run_to_table(build(source), folder, mode)
    return spark.read.parquet(f"{folder}/out")


@query(
    "stream_bounded_queue",
    """WITH r AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT key, max(n) AS put, greatest(max(n) - 5, 0) AS dropped, least(max(n), 5) AS size, round(max(value) FILTER (i = greatest(n - 4, 1)), 6) + 0.0 AS oldest, round(max(value) FILTER (i = n), 6) + 0.0 AS newest FROM r GROUP BY key""",
)
def stream_bounded_queue(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda s: Q.bounded_queue(s, "user_id", "event_id", "value", 5), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("put", "dropped", "size", "oldest", "newest"), "put").alias("r"))
    return last.select("key", "r.put", "r.dropped", "r.size", rounded(F.col("r.oldest")).alias("oldest"), rounded(F.col("r.newest")).alias("newest"))


@query(
    "stream_count_windows",
    """WITH r AS (SELECT user_id AS key, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS win FROM events)
    SELECT key, win, round(sum(value), 6) + 0.0 AS total, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM r GROUP BY key, win HAVING count(*) = 4""",
)
def stream_count_windows(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda s: Q.count_windows(s, "user_id", "event_id", "value", 4))
    return out.select("key", F.col("window").alias("win"), *[rounded(F.col(c)).alias(c) for c in ("total", "low", "high")])


@query("stream_token_bucket")
def stream_token_bucket(spark, sf_dir):
    """A recursion a key: no plain SQL."""
    return streamed(spark, sf_dir, lambda s: Q.token_bucket(s.withColumn("need", F.abs("value") % 50), "user_id", "event_id", "need", 0.5, 30.0))


@query("stream_staleness", "SELECT user_id, count(*) AS samples, count(*) FILTER (event_id % 10 < 8) AS stale FROM events GROUP BY user_id")
def stream_staleness(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda s: Q.running_counts(s, "user_id", 9 - F.col("event_id") % 10 > 1), "complete")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("samples", "stale"), "samples").alias("r"))
    return last.select("user_id", "r.samples", "r.stale")


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1")
def stream_event_windows(spark, sf_dir):
    """Complete output, so that the last, still open windows come too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = streamed(spark, sf_dir, lambda s: Q.event_windows(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 day", "1 hour"), "complete")
    last = out.groupBy("start").agg(F.max_by(F.struct("n", "total"), "epoch").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "r.n", rounded(F.col("r.total"), 4).alias("total"))


SAMPLES = {"event_id": "event_id", "processing_time": "abs(value)", "tool_calls": "CAST(event_id % 7 AS DOUBLE)", "version_start": "event_id {div} 700", "version_end": "event_id {div} 700 + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END"}
ASSEMBLED = f"""WITH s AS (SELECT {', '.join(f"{v.format(div='//')} AS {k}" for k, v in SAMPLES.items())}, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
 b AS (SELECT i // 100 AS batch, count(*) AS n, avg(processing_time) AS "processing_time/avg", max(processing_time) AS "processing_time/max", min(processing_time) AS "processing_time/min", quantile_cont(processing_time, 0.95) AS "processing_time/tp95",
   avg(tool_calls) AS "timing_s/tool_calls/mean", count(*) FILTER (version_end <> version_start) AS "partial/total_partial_num", max(abs(version_end - version_start)) AS "partial/max_partial_span", count(DISTINCT version_end) AS version_diversity FROM s GROUP BY 1 HAVING count(*) = 100)"""
PARTS = 4


def fed_in_parts(spark, sf_dir, run) -> str:
    """Events in PARTS parts by number: each is added to the source and run through before the next, on one checkpoint."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id").alias("n")).first()["n"] or 0
    for k in range(PARTS):
        events.where(F.expr(f"least(event_id * {PARTS} div {last + 1}, {PARTS - 1}) = {k}")).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), folder)
    return folder


def assembled(spark, sf_dir) -> str:
    columns = [F.expr(v.format(div="div")).alias(k) for k, v in SAMPLES.items()]
    return fed_in_parts(spark, sf_dir, lambda stream, folder: assemble(stream.select(*columns), folder, 100, 5, "event_id"))


STATS = ["processing_time/avg", "processing_time/max", "processing_time/min", "processing_time/tp95", "timing_s/tool_calls/mean", "partial/total_partial_num", "partial/max_partial_span", "version_diversity"]


@query("stream_exact_batches", f"""{ASSEMBLED} SELECT batch, n, {', '.join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in STATS)} FROM b""")
def stream_exact_batches(spark, sf_dir):
    """Batches of exactly 100 samples with their statistics, over four runs on one checkpoint."""
    out = spark.read.parquet(f"{assembled(spark, sf_dir)}/statistics")
    return out.select("batch", "n", *[rounded(F.col(f"`{c}`")).alias(c) for c in STATS])


RULES = {"processing_time/avg": "avg", "processing_time/max": "max", "processing_time/min": "min", "processing_time/tp95": "avg", "timing_s/tool_calls/mean": "sum", "partial/total_partial_num": "sum", "partial/max_partial_span": "max", "version_diversity": "avg"}


@query("stream_flushed_metrics", f"""{ASSEMBLED}, v AS (SELECT *, batch // 5 AS version FROM b), f AS (SELECT * FROM v WHERE version IN (SELECT version FROM v GROUP BY version HAVING count(*) = 5))
 {' UNION ALL '.join(f"SELECT version, '{name}' AS name, round({how}(" + '"' + name + '"' + "), 6) + 0.0 AS value FROM f GROUP BY version" for name, how in RULES.items())}""")
def stream_flushed_metrics(spark, sf_dir):
    """What the metrics of every five batches come to, by their names."""
    out = spark.read.parquet(f"{assembled(spark, sf_dir)}/flushed").where(F.col("name").isin(*RULES))
    return out.select("version", "name", rounded(F.col("value")).alias("value"))


KIND = "CASE event_id % 11 WHEN 0 THEN 'version' WHEN 1 THEN 'start' WHEN 2 THEN 'start' WHEN 3 THEN 'start' WHEN 4 THEN 'start' WHEN 5 THEN 'done' WHEN 6 THEN 'done' WHEN 7 THEN 'cancel' WHEN 8 THEN 'retry' WHEN 9 THEN 'take' ELSE 'idle' END"


@query(
    "stream_version_counts",
    f"""WITH e AS (SELECT user_id AS pool, event_id AS t, {KIND} AS kind FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'take' THEN -1 ELSE 0 END) OVER w AS kept, sum((kind = 'start')::INT) OVER w AS started, sum((kind = 'version')::INT) OVER w AS epoch FROM e WINDOW w AS (PARTITION BY pool ORDER BY t ROWS UNBOUNDED PRECEDING)),
    i AS (SELECT pool, epoch, min(t) AS idle FROM r WHERE kind = 'idle' GROUP BY ALL),
    v AS (SELECT pool, t, epoch, kept, started, lag(kept, 1, 0) OVER o AS old_kept, lag(started, 1, 0) OVER o AS old_started, lag(t) OVER o AS since FROM r WHERE kind = 'version' WINDOW o AS (PARTITION BY pool ORDER BY t))
    SELECT v.pool, v.t AS "at", v.t // 11 AS version, (old_kept + started - old_started)::BIGINT AS stale, kept::BIGINT AS kept, CASE WHEN since IS NOT NULL AND idle IS NOT NULL THEN round(1 - (idle - since) / (v.t - since), 6) + 0.0 END AS idle_ratio
    FROM v LEFT JOIN i ON i.pool = v.pool AND i.epoch = v.epoch - 1""",
)
def stream_version_counts(spark, sf_dir):
    """Samples and versions as two streams of the events, a pool a user, over four runs on one checkpoint."""

    def run(stream, folder):
        rows = stream.where("user_id is not null").select(F.col("user_id").alias("pool"), F.col("event_id").alias("at"), F.expr(KIND).alias("kind"))
        counts = version_counts(rows.where("kind <> 'version'"), rows.where("kind = 'version'").withColumn("version", F.expr("at div 11")))
        Q.run_to_table(counts, folder)

    out = spark.read.parquet(f"{fed_in_parts(spark, sf_dir, run)}/out")
    return out.select("pool", "at", "version", "stale", "kept", rounded(F.col("idle_ratio")).alias("idle_ratio"))
