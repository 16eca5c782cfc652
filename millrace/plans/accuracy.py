"""Queries over verdicts and scores (survey block 2.4, first half)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .catalog import query
from .tables import TOK, rounded, sequences, table


@query(
    "pair_scores",
    """
    WITH pairs AS (
      SELECT doc_id // 2 AS pair_id,
             bool_or(quality = 1) FILTER (doc_id % 2 = 0) AS a,
             bool_or(quality = 1) FILTER (doc_id % 2 = 1) AS b
      FROM labels GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
    SELECT count(*) AS pairs, round(avg(a::int) * 100, 6) AS a_acc, round(avg(b::int) * 100, 6) AS b_acc,
           round(avg((a AND b)::int) * 100, 6) AS cwpa, round(avg((a <> b)::int) * 100, 6) AS cwfr,
           count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
           count(*) FILTER (NOT a AND NOT b) AS neither
    FROM pairs
    """,
)
def pair_scores(spark, sf_dir):
    """Pair consistency: both members, one member or neither right; pairs lacking a member don't count."""
    rows = table(spark, sf_dir, "labels").select(F.expr("doc_id div 2").alias("pair"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("member"), "doc_id", "quality")
    out = M.pair_scores(rows, "pair", "member", F.col("quality") == 1, "doc_id")
    return out.select(*[rounded(F.col(c)).alias(c) if c in ("a_acc", "b_acc", "cwpa", "cwfr") else F.col(c) for c in out.columns])


JUDGED = "j AS (SELECT doc_id, lang, source, quality = 1 AS ok, toxic = 1 AS bad, CASE WHEN toxic = 1 THEN ' Yes' WHEN doc_id % 3 = 0 THEN 'no ' ELSE 'maybe' END AS gold FROM labels JOIN documents USING (doc_id))"


def judged(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    gold = F.when(F.col("toxic") == 1, " Yes").when(F.col("doc_id") % 3 == 0, "no ").otherwise("maybe")
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("bad"), gold.alias("gold"))


def metric_query(name: str, sql: str, before: str = ""):
    """fn(judged rows) against SQL over `j`; doubles rounded."""

    def add(fn):
        def run(spark, sf_dir):
            out = fn(judged(spark, sf_dir))
            return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        return query(name, f"WITH {JUDGED}{before} {sql}")(run)

    return add


metric_query("acc_overall", "SELECT count(*) FILTER (ok) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM j")(lambda j: M.accuracy(j, F.col("ok")))
metric_query("acc_by_category", "SELECT lang, count(*) FILTER (ok) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM j GROUP BY lang")(lambda j: M.accuracy(j, F.col("ok"), "lang"))
metric_query(
    "acc_by_level",
    """, c AS (SELECT *, lang || '/' || source AS cat, lang AS sup FROM j)
    SELECT CASE grouping(cat, sup) WHEN 3 THEN 'all' WHEN 1 THEN 'category' ELSE 'super' END AS level, coalesce(cat, sup, '') AS name,
      count(*) FILTER (ok) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM c GROUP BY GROUPING SETS ((cat), (sup), ())""",
)(lambda j: M.accuracy_by_level(j.withColumn("cat", F.concat("lang", F.lit("/"), "source")), F.col("ok"), "cat").withColumn("correct", F.col("correct").cast("long")))
metric_query(
    "acc_confusion",
    """, k AS (SELECT lang, trim(lower(gold)) AS g, ok FROM j),
    n AS (SELECT lang, count(*) FILTER (g = 'yes' AND ok) AS tp, count(*) FILTER (g = 'no' AND NOT ok) AS fp, count(*) FILTER (g = 'yes' AND NOT ok) AS fn, count(*) FILTER (g = 'yes') AS y, count(*) AS total FROM k GROUP BY lang),
    r AS (SELECT *, total - tp - fp - fn AS tn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
    SELECT lang, tp, fp, fn, tn, total, round((tp + tn) / total, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(y / total, 6) AS yes_ratio FROM r""",
)(lambda j: M.confusion(j, F.col("gold"), F.col("ok"), "lang"))
metric_query("acc_macro", "SELECT round((coalesce(avg(CASE WHEN lang = 'en' THEN ok::INT * 100 END), 0) + coalesce(avg(CASE WHEN lang = 'de' THEN ok::INT * 100 END), 0) + coalesce(avg(CASE WHEN lang = 'xx' THEN ok::INT * 100 END), 0)) / 3, 6) AS score FROM j")(lambda j: M.macro(j, F.col("ok"), "lang", ["en", "de", "xx"]))
metric_query(
    "acc_benchmark_scores",
    """, e AS (SELECT source AS name, round_even(100.0 * count(*) FILTER (ok) / count(*), 4) AS score, count(*) FILTER (ok) AS correct, count(*) AS total FROM j GROUP BY source)
    SELECT name, score, correct, total FROM e UNION ALL SELECT 'mean', round(avg(score), 6), sum(correct)::BIGINT, sum(total)::BIGINT FROM e""",
)(lambda j: M.benchmark_scores(j, F.col("ok"), "source"))
metric_query("acc_counts", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM j GROUP BY lang")(lambda j: j.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")))
metric_query("acc_text", "SELECT count(*) FILTER (ok) || '/' || count(*) || ' = ' || format('{:.2f}', 100.0 * count(*) FILTER (ok) / count(*)) || '%' AS shown FROM j")(
    lambda j: M.accuracy(j, F.col("ok")).select(F.format_string("%d/%d = %.2f%%", "correct", "total", "accuracy").alias("shown"))
)
metric_query("acc_mean_of_means", "SELECT lang, round(avg(m), 6) AS score, count(*) AS rows FROM (SELECT lang, source, avg(ok::INT) AS m FROM j GROUP BY ALL) GROUP BY lang")(lambda j: M.mean_of_means(j.withColumn("s", F.col("ok").cast("double")), "source", "lang", "s"))
metric_query(
    "val_mean_std",
    "SELECT lang, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, max(n) AS n_max FROM (SELECT lang, source, avg(ok::INT) AS m, stddev_pop(ok::INT) AS s, count(*) AS n FROM j GROUP BY ALL) GROUP BY lang",
)(lambda j: M.validation(j.withColumn("s", F.col("ok").cast("double")), "lang", "source", "s"))
metric_query(
    "val_majority",
    "SELECT source, arg_min(lang, (-n, f)) AS vote, arg_min(v, (-n, f)) AS value FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f, arg_min(doc_id * 0.5::DOUBLE, doc_id) AS v FROM j GROUP BY ALL) GROUP BY source",
)(lambda j: M.majority(j.withColumn("v", F.col("doc_id") * 0.5), ["source"], "doc_id", "lang", "v"))
metric_query(
    "val_expected_best",
    """, r AS (SELECT source, doc_id % 17 + 0.0::DOUBLE AS v, rank() OVER (PARTITION BY source ORDER BY doc_id % 17, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM j)
    SELECT source, round(sum(v * ((i / n) ** 4 - ((i - 1) / n) ** 4)), 6) AS expected_best FROM r GROUP BY source""",
)(lambda j: M.expected_best(j.withColumn("v", (F.col("doc_id") % 17).cast("double")), ["source"], "v", 4))
metric_query("val_percentiles", "SELECT lang, round(avg(doc_id), 6) AS avg, max(doc_id)::DOUBLE AS max, min(doc_id)::DOUBLE AS min, round(quantile_cont(doc_id, 0.5), 6) AS p50, round(quantile_cont(doc_id, 0.95), 6) AS p95, round(quantile_cont(doc_id, 0.99), 6) AS p99 FROM j GROUP BY lang")(lambda j: M.percentiles(j.withColumn("v", F.col("doc_id").cast("double")), "v", "lang"))
metric_query("val_sizes", "SELECT source, n, array_to_string(list_distinct(list_concat(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512], lambda x: x < n), [n])), ',') AS sizes FROM (SELECT source, count(*) AS n FROM j GROUP BY 1)".replace("list_distinct(", "("))(
    lambda j: j.groupBy("source").agg(F.count("*").alias("n")).withColumn("sizes", F.array_join(F.transform(M.sizes_up_to(F.col("n")), lambda x: x.cast("string")), ","))
)


@query("val_bootstrap")
def val_bootstrap(spark, sf_dir):
    """Resampled best@k and worst@k: a seeded NumPy generator, so there is no SQL."""
    rows = judged(spark, sf_dir).withColumn("v", (F.col("doc_id") % 17).cast("double"))
    return M.bootstrap(rows, ["source"], "doc_id", "v")


STEPS = "s AS (SELECT event_id // 6 AS step, CASE event_id % 6 WHEN 0 THEN 'loss/max' WHEN 1 THEN 'timing_s/gen' WHEN 2 THEN 'reward/mean' WHEN 3 THEN 'len/min' WHEN 4 THEN 'tokens/total' ELSE 'lr' END AS name, value FROM events)"


def steps(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["loss/max", "timing_s/gen", "reward/mean", "len/min", "tokens/total", "lr"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.expr("event_id div 6").alias("step"), kind.alias("name"), "value")


def step_query(name: str, sql: str):
    def add(fn):
        def run(spark, sf_dir):
            out = fn(steps(spark, sf_dir))
            return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        return query(name, f"WITH {STEPS} {sql}")(run)

    return add


step_query("metrics_reduced_by_name", "SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM s GROUP BY name")(M.reduce_metrics)
step_query("metrics_typed", "SELECT name, agg, round(CASE agg WHEN 'mean' THEN avg(value) WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) ELSE max(value) END, 6) + 0.0 AS value FROM (SELECT *, CASE WHEN name LIKE '%max' THEN 'max' WHEN name LIKE '%min' THEN 'min' WHEN name LIKE '%total' THEN 'sum' ELSE 'mean' END AS agg FROM s) GROUP BY name, agg")(
    lambda s: M.typed_metrics(s.withColumn("agg", F.when(F.col("name").endswith("max"), "max").when(F.col("name").endswith("min"), "min").when(F.col("name").endswith("total"), "sum").otherwise("mean")))
)
step_query("metrics_over_steps", "SELECT name, round(CASE WHEN name = 'lr' THEN arg_max(value, step) WHEN name LIKE 'timing_s/%' THEN sum(value) WHEN name LIKE '%mean' THEN avg(value) WHEN name LIKE '%max' THEN max(value) WHEN name LIKE '%min' THEN min(value) ELSE sum(value) END, 6) + 0.0 AS value FROM s GROUP BY name")(
    lambda s: M.aggregate_steps(s, ["lr"], [])
)
step_query("metrics_timing", ", t AS (SELECT name, sum(abs(value)) AS seconds FROM (SELECT CASE name WHEN 'timing_s/gen' THEN 'gen' ELSE name END AS name, value FROM s) GROUP BY name) SELECT name, round(seconds, 6) AS seconds, round(seconds * 1000 / CASE name WHEN 'gen' THEN 200 ELSE 500 END, 6) AS ms_per_token FROM t")(
    lambda s: M.timing_metrics(s.groupBy(F.when(F.col("name") == "timing_s/gen", "gen").otherwise(F.col("name")).alias("name")).agg(F.sum(F.abs("value")).alias("seconds")), s.sparkSession.range(1).select(F.lit(200).alias("response"), F.lit(500).alias("whole")))
)
step_query("metrics_running", "SELECT step, name, round(sum(value) OVER (PARTITION BY name ORDER BY step), 6) + 0.0 AS running FROM s")(lambda s: s.withColumn("running", F.sum("value").over(Window.partitionBy("name").orderBy("step"))).drop("value"))


@query("metrics_staleness", "SELECT count(*) AS samples, count(*) FILTER (9 - event_id % 10 >= 1) AS stale, max(9 - event_id % 10) AS longest, count(DISTINCT event_id % 10) AS versions FROM events")
def metrics_staleness(spark, sf_dir):
    return M.staleness(table(spark, sf_dir, "events").withColumn("version", F.col("event_id") % 10), 9)


@query("metrics_partial_rollouts", "SELECT count(*) FILTER (user_id % 4 <> event_id % 4) AS partial, round(avg((user_id % 4 <> event_id % 4)::INT), 6) AS partial_ratio, max(abs(user_id % 4 - event_id % 4)) AS max_span FROM events")
def metrics_partial_rollouts(spark, sf_dir):
    out = M.partial_rollouts(table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("a"), (F.col("event_id") % 4).alias("b")), "b", "a")
    return out.withColumn("partial_ratio", rounded(F.col("partial_ratio")))


@query(
    "metrics_probability",
    f"WITH {TOK}, d AS (SELECT exp(lp) AS a, exp(old) AS b FROM tok WHERE m = 1) SELECT round(max(abs(a - b)), 6) AS max, round(avg(abs(a - b)), 6) AS mean, round(stddev_samp(abs(a - b)), 6) AS std, round(corr(a, b), 6) + 0.0 AS pearson FROM d",
)
def metrics_probability(spark, sf_dir):
    out = M.probability_metrics(sequences(spark, sf_dir, "mask", "log_prob", "old_log_prob").withColumnRenamed("old_log_prob", "rollout_log_prob"))
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(
    "metrics_data",
    f"""WITH {TOK}, live AS (SELECT * FROM seq WHERE len > 0), t AS (SELECT a, r, v FROM tok WHERE m = 1)
    SELECT round((SELECT avg(score) FROM live), 6) AS score_mean, (SELECT max(score) FROM live) AS score_max, (SELECT min(score) FROM live) AS score_min,
      round((SELECT avg(len) FROM seq), 6) AS length_mean, (SELECT max(len) FROM seq)::DOUBLE AS length_max, (SELECT min(len) FROM seq)::DOUBLE AS length_min,
      round((SELECT avg((len = 5)::INT) FROM seq), 6) AS clip_ratio, round((SELECT avg((len = 0)::INT) FROM seq), 6) AS aborted_ratio,
      round(avg(a), 6) + 0.0 AS advantages_mean, max(a) AS advantages_max, min(a) AS advantages_min, round(avg(r), 6) + 0.0 AS returns_mean, max(r) AS returns_max, min(r) AS returns_min,
      round(avg(v), 6) + 0.0 AS values_mean, round(max(v), 6) AS values_max, round(min(v), 6) AS values_min, round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) + 0.0 AS explained_variance FROM t""",
)
def metrics_data(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards", "mask", "advantages", "values").withColumn("returns", F.col("rewards"))
    out = M.data_metrics(rows, 5)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(
    "metrics_variance_proxies",
    f"""WITH {TOK}, w AS (SELECT sum((1 - 2 * exp(old) + exp(2 * old) / 2 + 0.1) * m) AS w, sum(a * m) / (sum(m) + 1e-8) AS a FROM tok GROUP BY row_id)
    SELECT 4.0::DOUBLE AS signal, round(avg(greatest(w, 0) * a * a), 6) AS power, round((avg(greatest(w, 0) * a * a) - 4) / (count(*) - 1), 6) AS noise, round(avg(a * a), 6) AS expected_a_squared, round(avg(w), 6) AS expected_w FROM w""",
)
def metrics_variance_proxies(spark, sf_dir):
    rows = sequences(spark, sf_dir, "advantages", "mask", "old_log_prob").withColumnRenamed("old_log_prob", "old_log_probs").withColumn("sum_pi_squared", F.transform("old_log_probs", lambda x: F.exp(2 * x) / 2 + 0.1))
    out = M.variance_proxies(rows, 2.0)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(
    "acc_reference_counts",
    """WITH r AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: trim(regexp_replace(lower(w), '[^a-z0-9]', '', 'g'))) AS refs, trim(regexp_replace(lower(string_split(text, ' ')[1]), '[^a-z0-9]', '', 'g')) AS pred FROM documents WHERE text IS NOT NULL),
    a AS (SELECT least(len(list_filter(refs, lambda x: x = pred)) / 3, 1) AS a FROM r WHERE pred NOT IN ('a', 'an', 'the'))
    SELECT round_even(a, 1) AS bin, count(*) AS n, round(avg(a), 6) AS mean FROM a GROUP BY 1""",
)
def acc_reference_counts(spark, sf_dir):
    """Counted agreement with references, by bins of a tenth."""
    plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9 ]", "")
    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = d.select(F.split(plain("text"), " ").alias("refs")).withColumn("pred", F.col("refs")[0]).where(~F.col("pred").isin("a", "an", "the"))
    a = rows.select(M.count_accuracy(F.col("pred"), F.col("refs")).alias("a"))
    return a.groupBy(F.bround("a", 1).alias("bin")).agg(F.count("*").alias("n"), rounded(F.avg("a")).alias("mean"))
