"""Queries over validation frames, derived metrics, rejection statistics and balanced batches (survey blocks 2.4, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import correction as C
from ..operators import metrics as M
from ..operators import validation as V
from .accuracy import JUDGED, judged
from .catalog import query
from .tables import TOK, rounded, sequences, table


def samples(spark, sf_dir):
    """Verdicts as responses to prompts of eight neighbouring documents."""
    return judged(spark, sf_dir).select("lang", F.expr("doc_id div 8").alias("uid"), "doc_id", F.col("ok").cast("double").alias("acc"), (F.col("doc_id") % 17).cast("double").alias("len"), "gold")


@query(
    "val_frame",
    f"""WITH {JUDGED}, v AS (SELECT lang, doc_id // 8 AS uid, 'acc' AS variable, ok::INT::DOUBLE AS x FROM j UNION ALL SELECT lang, doc_id // 8, 'len', doc_id % 17 FROM j),
    u AS (SELECT lang, variable, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM v GROUP BY lang, uid, variable),
    f AS (SELECT lang, variable, 'mean@' || n AS metric, m AS x FROM u UNION ALL SELECT lang, variable, 'std@' || n, s FROM u WHERE n > 1)
    SELECT lang, variable, metric, round(avg(x), 6) + 0.0 AS value FROM f GROUP BY ALL""",
)
def val_frame(spark, sf_dir):
    return V.means(samples(spark, sf_dir), "lang", "uid", ["acc", "len"]).withColumn("value", rounded(F.col("value")))


@query("val_frame_resampled")
def val_frame_resampled(spark, sf_dir):
    """Best, worst and majority of k by a seeded NumPy generator, so there is no SQL; tests hold it against plain Python."""
    return V.resampled(samples(spark, sf_dir), "lang", "uid", "doc_id", ["acc", "len"], vote="gold", times=200)


NAMES = ["global_seqlen/max", "global_seqlen/min", "global_seqlen/minmax_diff", "perf/throughput", "perf/total_num_tokens", "perf/time_per_step", "timing_s/gen", "timing_s/step"]


@query(
    "metrics_derived",
    f"""WITH e AS (SELECT {NAMES!r}[event_id % 8 + 1] AS name, abs(value) + 1 AS value FROM events),
    a AS (SELECT name, CASE WHEN name LIKE 'timing_s/%' OR name LIKE '%total%' THEN sum(value) WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%/min' THEN min(value) ELSE avg(value) END AS value FROM e GROUP BY name),
    w AS (SELECT max(value) FILTER (name = 'global_seqlen/max') - max(value) FILTER (name = 'global_seqlen/min') AS d,
      max(value) FILTER (name = 'perf/total_num_tokens') / (max(value) FILTER (name = 'perf/time_per_step') * 16) AS t,
      max(value) FILTER (name = 'timing_s/gen') / max(value) FILTER (name = 'timing_s/step') AS i FROM a)
    SELECT name, round(CASE name WHEN 'global_seqlen/minmax_diff' THEN d WHEN 'perf/throughput' THEN t ELSE value END, 6) + 0.0 AS value FROM a, w UNION ALL SELECT 'trainer/idle_ratio', round(i, 6) FROM w""",
)
def metrics_derived(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    steps = table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("step"), name.alias("name"), (F.abs("value") + 1).alias("value"))
    return V.derived(M.aggregate_steps(steps, [], []), 16).withColumn("value", rounded(F.col("value")))


STATISTICS = "round({mean}, 6) + 0.0 AS mean, round({max}, 6) + 0.0 AS max, round({min}, 6) + 0.0 AS min, round(sqrt(greatest({squares} - {clamped} ** 2, 0)), 6) + 0.0 AS std, round({high}, 6) AS fraction_high, round({low}, 6) AS fraction_low"
BY_SEQUENCE = "round(avg(s), 6) + 0.0 AS seq_mean, round(stddev_samp(s), 6) AS seq_std, round(max(s), 6) + 0.0 AS seq_max, round(min(s), 6) + 0.0 AS seq_min, round(max(abs(s)), 6) AS seq_max_deviation, round(avg((s > {upper})::INT), 6) AS seq_fraction_high, round({low}, 6) + 0.0 AS seq_fraction_low FROM s"


@query(
    "is_option_metrics",
    f"""WITH {TOK}, x AS (SELECT row_id, old - lp AS k1, 0.5 * (lp - old) ** 2 AS k2 FROM tok WHERE m = 1),
    r AS (SELECT row_id, avg(k1) AS a, avg(k2) AS b, count(*) AS n FROM x GROUP BY row_id),
    t AS (SELECT avg(k1) AS mean, max(k1) AS max, min(k1) AS min, avg(least(greatest(k1, ln(0.55)), ln(1.45))) AS c, avg(least(greatest(k1, ln(0.55)), ln(1.45)) ** 2) AS q, avg((k1 > ln(1.45))::INT) AS high, avg((k1 < ln(0.55))::INT) AS low FROM x),
    u AS (SELECT sum(b * n) / sum(n) AS mean, max(b) AS max, min(b) AS min, sum(least(b, 0.0512345) * n) / sum(n) AS c, sum(least(b, 0.0512345) ** 2 * n) / sum(n) AS q, avg((b > 0.0512345)::INT) AS high FROM r)
    SELECT 'token_k1' AS option, {STATISTICS.format(mean='(SELECT mean FROM t)', max='(SELECT max FROM t)', min='(SELECT min FROM t)', squares='(SELECT q FROM t)', clamped='(SELECT c FROM t)', high='(SELECT high FROM t)', low='(SELECT low FROM t)')},
      {BY_SEQUENCE.format(upper='ln(1.45)', low='avg((s < ln(0.55))::INT)')[:-len(' FROM s')]} FROM (SELECT a AS s FROM r)
    UNION ALL
    SELECT 'seq_mean_k2', {STATISTICS.format(mean='(SELECT mean FROM u)', max='(SELECT max FROM u)', min='(SELECT min FROM u)', squares='(SELECT q FROM u)', clamped='(SELECT c FROM u)', high='(SELECT high FROM u)', low='0.0::DOUBLE')},
      {BY_SEQUENCE.format(upper='0.0512345', low='0.0::DOUBLE')[:-len(' FROM s')]} FROM (SELECT b AS s FROM r)""",
)
def is_option_metrics(spark, sf_dir):
    rows = sequences(spark, sf_dir, "mask", "log_prob", "old_log_prob").withColumnRenamed("old_log_prob", "rollout_log_prob")
    out = C.option_metrics(rows, ["token_k1", "seq_mean_k2"], "0.55_1.45,0.0512345")
    return out.select("option", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


PARTS = "o AS (SELECT o_orderkey // 512 AS batch, o_orderkey % 4 AS part, o_orderkey AS k, o_custkey % 50 AS c, o_custkey % 97 AS len FROM orders)"


def orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 512").alias("batch"), (k % 4).alias("part"), k.alias("k"), (F.col("o_custkey") % 50).alias("c"), (F.col("o_custkey") % 97).alias("len"))


@query(
    "balance_groups_whole",
    f"WITH {PARTS} SELECT batch, count(*) AS rows, count(DISTINCT c) AS groups, 0::BIGINT AS split, least(4, count(DISTINCT c))::BIGINT AS parts, sum(len)::BIGINT AS tokens FROM o GROUP BY batch",
)
def balance_groups_whole(spark, sf_dir):
    """Batches of 512 orders in four parts that keep customers' groups whole: what must hold of every such division."""
    out = B.grouped_parts(orders(spark, sf_dir).drop("part"), "batch", "c", "len", 4)
    groups = out.groupBy("batch", "c").agg(F.count("*").alias("n"), F.collect_set("part").alias("p"), F.sum("len").alias("t"))
    return groups.groupBy("batch").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.size("p") > 1).alias("split"), F.size(F.array_distinct(F.flatten(F.collect_set("p")))).cast("long").alias("parts"), F.sum("t").cast("long").alias("tokens"))


@query(
    "balance_interleaved",
    f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, part ORDER BY len, k) - 1 AS r, count(*) OVER (PARTITION BY batch, part) AS n FROM o)
    SELECT batch, k, row_number() OVER (PARTITION BY batch ORDER BY part, CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END) - 1 AS new_pos FROM r""",
)
def balance_interleaved(spark, sf_dir):
    return B.interleaved(orders(spark, sf_dir), "batch", "part", "k", "len").select("batch", "k", "new_pos")


@query("balance_restored", f"WITH {PARTS} SELECT batch, k, len * 2 AS result FROM o")
def balance_restored(spark, sf_dir):
    """Results of the reordered rows, brought back to their rows."""
    placed = B.interleaved(orders(spark, sf_dir), "batch", "part", "k", "len")
    return B.restored(placed.select("batch", "new_pos", (F.col("len") * 2).alias("result")), placed, "batch", "k")
