"""Queries over group-relative advantages (survey block 2.7) and token scans (2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import advantage as A
from ..operators import records as R
from .catalog import query
from .tables import TOK, exploded, rounded, sequences, table

#: Of many digits, so that no result lies halfway between two rounded ones.
GAMMA, LAMBDA = 0.8912345678, 0.8123456789
GROUPED = "grp AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS sd, sum(score) OVER w AS total, sum(len) OVER w AS lens, sum(len * score) OVER w AS ls FROM seq WINDOW w AS (PARTITION BY uid))"
WHITE = "(x - (SELECT sum(x * m) / (sum(m) + 1e-8) FROM src)) / sqrt((SELECT sum(m * (x - mu) ** 2) / (sum(m) + 1e-8) * sum(m) / (sum(m) - 1) FROM src, (SELECT sum(x * m) / (sum(m) + 1e-8) AS mu FROM src)) + 1e-8)"


def outcome(name: str, formula: str, estimator: str, **options):
    """An estimator that gives each masked token its row's value; formula: that value in SQL."""
    sql = f"WITH {TOK}, {GROUPED} SELECT t.row_id, t.pos, round(({formula}) * t.m, 6) + 0.0 AS advantages FROM tok t JOIN grp USING (row_id)"

    @query(name, sql)
    def run(spark, sf_dir):
        return exploded(A.compute_advantage(sequences(spark, sf_dir, "rewards", "mask"), estimator, **options), "advantages")

    return run


outcome("adv_grpo", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sd + 1e-6) END", "grpo")
outcome("adv_grpo_unnormalised", "CASE WHEN n = 1 THEN score ELSE score - mean END", "grpo", normalise=False)
outcome("adv_grpo_vectorized", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END", "grpo_vectorized")
outcome("adv_rloo", "CASE WHEN n = 1 THEN score ELSE (score - mean) * n / (n - 1) END", "rloo")
outcome("adv_rloo_vectorized", "CASE WHEN n = 1 THEN 0 ELSE (n * score - total) / (n - 1) END", "rloo_vectorized")
outcome("adv_opo", "CASE WHEN n = 1 THEN score ELSE score - ls / nullif(lens, 0) END", "opo")
outcome("adv_gpg", "(score - CASE WHEN n = 1 THEN 0 ELSE mean END) * (SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) FROM seq)", "gpg")


@query(
    "adv_grpo_passk",
    f"""WITH {TOK}, {GROUPED},
    big AS (SELECT * FROM grp WHERE n > 1),
    ranked AS (SELECT row_id, uid, score, sd, row_number() OVER w AS k, lead(score) OVER w AS second FROM big WINDOW w AS (PARTITION BY uid ORDER BY score DESC, row_id))
    SELECT t.row_id, t.pos, round(CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) * m ELSE 0 END, 6) + 0.0 AS advantages
    FROM tok t JOIN ranked USING (row_id)""",
)
def adv_grpo_passk(spark, sf_dir):
    rows = A.with_scores(sequences(spark, sf_dir, "rewards", "mask")).where("n > 1").drop("score", "n")
    return exploded(A.compute_advantage(rows, "grpo_passk"), "advantages")


@query(
    "adv_reinforce_plus_plus_baseline",
    f"""WITH {TOK}, {GROUPED},
    src AS (SELECT t.row_id, t.pos, t.m, (score - CASE WHEN n = 1 THEN 0 ELSE mean END) * t.m AS x FROM tok t JOIN grp USING (row_id))
    SELECT row_id, pos, round({WHITE} * m, 6) + 0.0 AS advantages FROM src""",
)
def adv_reinforce_plus_plus_baseline(spark, sf_dir):
    return exploded(A.compute_advantage(sequences(spark, sf_dir, "rewards", "mask"), "reinforce_plus_plus_baseline"), "advantages")


@query(
    "adv_remax",
    f"""WITH {TOK} SELECT row_id, pos, round(sum(r * m) OVER w - 10 * m, 6) + 0.0 AS advantages, round(sum(r * m) OVER w, 6) + 0.0 AS returns
    FROM tok WINDOW w AS (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def adv_remax(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards", "mask").withColumn("baseline", F.lit(10.0))
    return exploded(A.compute_advantage(rows, "remax"), "advantages", "returns")


#: A token's discounted return counts what follows up to the first masked token, that one included.
DISCOUNTED = f"""
src AS (
  SELECT t.row_id, t.pos, t.m, sum(u.r * power({GAMMA}, u.pos - t.pos)) AS x
  FROM tok t JOIN tok u ON u.row_id = t.row_id AND u.pos >= t.pos
  WHERE NOT EXISTS (SELECT 1 FROM tok z WHERE z.row_id = t.row_id AND z.pos > t.pos AND z.pos <= u.pos AND z.m = 0)
  GROUP BY t.row_id, t.pos, t.m)
"""


@query("adv_reinforce_plus_plus", f"WITH {TOK}, {DISCOUNTED} SELECT row_id, pos, round({WHITE} * m, 6) + 0.0 AS advantages, round(x, 6) + 0.0 AS returns FROM src")
def adv_reinforce_plus_plus(spark, sf_dir):
    return exploded(A.compute_advantage(sequences(spark, sf_dir, "rewards", "mask"), "reinforce_plus_plus", gamma=GAMMA), "advantages", "returns")


#: Masked tokens pass on the state behind them, so a token's advantage sums over the unmasked tokens from itself on.
GAE = f"""
nxt AS (SELECT *, sum(m) OVER (PARTITION BY row_id ORDER BY pos) AS k FROM tok),
live AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY row_id ORDER BY pos), 0) AS vn FROM nxt WHERE m = 1),
delta AS (SELECT row_id, k, r + {GAMMA} * vn - v AS d FROM live),
src AS (
  SELECT n.row_id, n.pos, n.m, n.v, coalesce(sum(d.d * power({GAMMA} * {LAMBDA}, d.k - (n.k + 1 - n.m))), 0) AS x
  FROM nxt n LEFT JOIN delta d ON d.row_id = n.row_id AND d.k >= n.k + 1 - n.m GROUP BY ALL)
"""


@query("adv_gae", f"WITH {TOK}, {GAE} SELECT row_id, pos, round({WHITE}, 6) + 0.0 AS advantages, round(x + v, 6) + 0.0 AS returns FROM src")
def adv_gae(spark, sf_dir):
    return exploded(A.compute_advantage(sequences(spark, sf_dir, "rewards", "values", "mask"), "gae", gamma=GAMMA, lam=LAMBDA), "advantages", "returns")


def weighed(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards", "mask", "old_log_prob").withColumnRenamed("old_log_prob", "old_log_probs")
    return rows.withColumn("sum_pi_squared", F.transform("old_log_probs", lambda x: F.exp(2 * x) / 2 + 0.1))


PATHS = """
path AS (
  SELECT *, sum(r * m) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
         sum((1 - 2 * exp(old) + exp(2 * old) / 2 + 0.1) * m) OVER (PARTITION BY row_id ORDER BY pos) AS w FROM tok),
"""


@query(
    "adv_optimal_token_baseline",
    f"""WITH {TOK}, {PATHS}
    sizes AS (SELECT uid, count(*) AS n FROM seq GROUP BY uid),
    base AS (SELECT uid, pos, sum(g * w * m) / (sum(w * m) + 1e-8) AS b FROM path GROUP BY uid, pos)
    SELECT row_id, pos, round((g - CASE WHEN n < 2 THEN 0 ELSE b END) * m, 6) + 0.0 AS advantages
    FROM path JOIN sizes USING (uid) JOIN base USING (uid, pos)""",
)
def adv_optimal_token_baseline(spark, sf_dir):
    return exploded(A.compute_advantage(weighed(spark, sf_dir), "optimal_token_baseline"), "advantages")


@query(
    "adv_tir_optimal_token_baseline",
    f"""WITH {TOK}, {PATHS}
    live AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS k FROM path WHERE m = 1),
    ranked AS (SELECT row_id, uid, len, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY len DESC, row_id) AS rank FROM seq WHERE len > 0),
    sizes AS (SELECT uid, max(n) AS n, max(len) AS l1, max(len) FILTER (rank = 2) AS l2 FROM ranked GROUP BY uid),
    base AS (SELECT uid, k, sum(g * w) / (sum(w) + 1e-8) AS b FROM live GROUP BY uid, k),
    done AS (SELECT l.row_id, l.pos, l.g - CASE WHEN n < 2 OR (s.len = l1 AND l1 > l2 AND k >= l2) THEN 0 ELSE b END AS x
             FROM live l JOIN sizes USING (uid) JOIN base USING (uid, k) JOIN seq s ON s.row_id = l.row_id)
    SELECT p.row_id, p.pos, round(coalesce(x, 0), 6) + 0.0 AS advantages FROM path p LEFT JOIN done USING (row_id, pos)""",
)
def adv_tir_optimal_token_baseline(spark, sf_dir):
    return exploded(A.compute_advantage(weighed(spark, sf_dir), "tir_optimal_token_baseline"), "advantages")


@query("pf_reweight_resample")
def pf_reweight_resample(spark, sf_dir):
    """Random: as many rows as there are, drawn by squared score."""
    rows = sequences(spark, sf_dir, "rewards").withColumn("score", S.total("rewards"))
    drawn = A.weighted_resample(rows, F.pow(F.abs("score"), 2) + 1e-8, rows.count(), seed=7)
    return drawn.select("draw", "row_id", rounded(F.col("score")).alias("score"))


@query(
    "group_mean_std",
    f"WITH {TOK} SELECT uid, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(sqrt(greatest(var_samp(score), 1e-6)), 1), 6) AS std FROM seq GROUP BY uid",
)
def group_mean_std(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards").withColumn("score", S.total("rewards"))
    std = F.coalesce(F.sqrt(F.greatest(F.var_samp("score"), F.lit(1e-6))), F.lit(1.0))
    return rows.groupBy("uid").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(F.when(F.count("*") == 1, 1.0).otherwise(std)).alias("std"))


def row_query(name: str, select: str, columns, *needs: str):
    """One rounded value a sequence; select: the same from `tok` grouped by row_id."""

    @query(name, f"WITH {TOK} SELECT row_id, {select} FROM tok GROUP BY row_id")
    def run(spark, sf_dir):
        return sequences(spark, sf_dir, *needs).select("row_id", *[rounded(c).alias(n) for n, c in columns().items()])

    return run


row_query("seq_masked_sum_mean", "round(sum(r * m), 6) + 0.0 AS total, round(sum(r * m) / (sum(m) + 1e-8), 6) + 0.0 AS mean", lambda: {"total": S.masked_sum("rewards", "mask"), "mean": S.masked_mean("rewards", "mask")}, "rewards", "mask")
row_query("seq_log_sum_exp", "round(max(r) + ln(sum(exp(r - (SELECT 0)))) - max(r), 6) + 0.0 AS lse", lambda: {"lse": S.log_sum_exp("rewards")}, "rewards")
row_query("seq_sum_pi_squared", "round(sum(exp(2 * lp)) / (sum(exp(lp)) * sum(exp(lp))), 6) + 0.0 AS spi", lambda: {"spi": S.sum_pi_squared("log_prob")}, "log_prob")
row_query("seq_entropy", "round(ln(sum(exp(lp))) - sum(exp(lp) * lp) / sum(exp(lp)), 6) + 0.0 AS entropy", lambda: {"entropy": S.entropy("log_prob")}, "log_prob")
row_query("seq_bias_corrected_kl", "round(sum(exp(lp) * (lp - ref) + exp(ref) - exp(lp)), 6) + 0.0 AS kl", lambda: {"kl": S.bias_corrected_kl("log_prob", "ref_log_prob")}, "log_prob", "ref_log_prob")
row_query("seq_gather_first", "round(max(r) FILTER (pos = 0), 6) + 0.0 AS first, count(*)::DOUBLE AS size", lambda: {"first": S.gather("rewards", F.lit(0)), "size": F.size("rewards")}, "rewards")
row_query("seq_overlong_penalty", "round(least(-(count(*) - (6 - 4)) / 4.0 * 0.5, 0), 6) + 0.0 AS penalty", lambda: {"penalty": S.overlong_penalty(F.size("mask"), 6, 4, 0.5)}, "mask")
row_query("seq_workload", "(24576 * count(*) + count(*) * count(*))::DOUBLE AS workload, (ceil(count(*) / 4) * 4)::DOUBLE AS rounded_up", lambda: {"workload": S.workload(F.size("mask")), "rounded_up": S.round_up(F.size("mask"), 4)}, "mask")
row_query("seq_token_diff", "count(*) FILTER (m = 1 AND r <> v)::DOUBLE AS differing", lambda: {"differing": S.differing("rewards", "values", "mask")}, "rewards", "values", "mask")
row_query("seq_masked_var_guarded", "round(CASE WHEN sum(m) > 1 THEN var_samp(r) FILTER (m = 1) * (sum(m) / (sum(m) + 1e-8)) END, 4) + 0.0 AS variance", lambda: {"variance": F.when(S.count_mask("mask") > 1, F.round(S.masked_var("rewards", "mask"), 4))}, "rewards", "mask")


def token_query(name: str, select: str, columns, *needs: str, window: str = ""):
    """One rounded value a token; select: the same from `tok`."""

    @query(name, f"WITH {TOK} SELECT row_id, pos, {select} FROM tok {window}")
    def run(spark, sf_dir):
        rows = sequences(spark, sf_dir, *needs)
        return exploded(rows.select("row_id", *[c.alias(n) for n, c in columns().items()]), *columns())

    return run


FORWARD = "WINDOW w AS (PARTITION BY row_id ORDER BY pos), whole AS (PARTITION BY row_id)"
token_query("tok_reward_to_go", "round(sum(r * m) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS togo", lambda: {"togo": S.reward_to_go("rewards", "mask")}, "rewards", "mask")
token_query("tok_running_sum", "round(sum(r * m) OVER w, 6) + 0.0 AS running", lambda: {"running": S.running_sum(S.masked("rewards", "mask"))}, "rewards", "mask", window=FORWARD)
token_query("tok_response_mask", "(CASE WHEN coalesce(min(CASE WHEN id = 2 THEN pos END) OVER whole, pos) >= pos THEN 1 ELSE 0 END)::DOUBLE AS keep", lambda: {"keep": S.response_mask("ids", 2)}, "ids", window=FORWARD)
token_query("tok_position_ids", "greatest(sum(m) OVER w - 1, 0)::DOUBLE AS position", lambda: {"position": S.position_ids("mask")}, "mask", window=FORWARD)
token_query("tok_kl_estimators", "round(lp - ref, 6) + 0.0 AS k1, round(abs(lp - ref), 6) + 0.0 AS ka, round(0.5 * (lp - ref) ** 2, 6) + 0.0 AS k2, round(least(greatest(exp(ref - lp) - (ref - lp) - 1, -10), 10), 6) + 0.0 AS k3", lambda: {"k1": S.kl_penalty("log_prob", "ref_log_prob", "k1"), "ka": S.kl_penalty("log_prob", "ref_log_prob", "abs"), "k2": S.kl_penalty("log_prob", "ref_log_prob", "k2"), "k3": S.kl_penalty("log_prob", "ref_log_prob", "k3")}, "log_prob", "ref_log_prob")
token_query("tok_kl_rewards", "round(r - 0.1 * (lp - ref) * m, 6) + 0.0 AS reward", lambda: {"reward": S.kl_rewards("rewards", S.kl_penalty("log_prob", "ref_log_prob", "kl"), "mask", 0.1)}, "rewards", "log_prob", "ref_log_prob", "mask")
token_query("tok_token_rewards", "round(r - (old - ref) * 0.5, 6) + 0.0 AS reward", lambda: {"reward": S.token_rewards("rewards", "old_log_prob", "ref_log_prob", 0.5)}, "rewards", "old_log_prob", "ref_log_prob")
token_query("tok_log_softmax", "round(lp - ln(sum(exp(lp)) OVER whole), 6) + 0.0 AS lsm, round(lp - avg(lp) OVER whole, 6) + 0.0 AS centred", lambda: {"lsm": S.log_softmax("log_prob"), "centred": S.centred("log_prob")}, "log_prob", window=FORWARD)
token_query("tok_sft_loss_mask", "(CASE WHEN pos < 2 - 1 OR pos = sum(m) OVER whole - 1 THEN 0 ELSE m END)::DOUBLE AS keep", lambda: {"keep": S.sft_loss_mask(F.lit(2), "mask")}, "mask", window=FORWARD)
token_query("tok_reward_placement", "(CASE WHEN pos = sum(m) OVER whole - 1 THEN 5 ELSE 0 END)::DOUBLE AS reward", lambda: {"reward": S.at_last_valid("mask", F.lit(5.0))}, "mask", window=FORWARD)
token_query("tok_clip", "round(greatest(least(r, 40), 10), 6) + 0.0 AS clipped", lambda: {"clipped": F.transform("rewards", lambda x: S.clip(x, 10.0, 40.0))}, "rewards")
token_query("tok_tempered_softmax", "round(exp(lp / 0.5) / sum(exp(lp / 0.5)) OVER whole, 6) + 0.0 AS p", lambda: {"p": S.tempered_softmax("log_prob", 0.5)}, "log_prob", window=FORWARD)


@query(
    "tok_whiten",
    f"WITH {TOK}, src AS (SELECT row_id, pos, m, r AS x FROM tok) SELECT row_id, pos, round({WHITE}, 6) + 0.0 AS white FROM src",
)
def tok_whiten(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards", "mask").withColumnRenamed("rewards", "white")
    return exploded(A.whitened(rows, "white"), "white")


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")


def list_query(name: str, sql: str, columns, *needs: str):
    """Arrays of whole numbers a sequence, joined by commas; sql: from `lists` (ids, m, n a row)."""
    lists = "lists AS (SELECT row_id, list(id ORDER BY pos) AS ids, list(m ORDER BY pos) AS m, count(*) AS n, sum(m)::INT AS k FROM tok GROUP BY row_id)"

    @query(name, f"WITH {TOK}, {lists} SELECT row_id, {sql} FROM lists")
    def run(spark, sf_dir):
        return sequences(spark, sf_dir, *needs).select("row_id", *[joined(c).alias(n) for n, c in columns().items()])

    return run


list_query("list_pad", "array_to_string(list_concat(ids, list_transform(range(greatest(8 - n, 0)), lambda i: 9)), ',') AS on_right, array_to_string(list_concat(list_transform(range(greatest(8 - n, 0)), lambda i: 9), ids), ',') AS on_left", lambda: {"on_right": S.pad("ids", 8, 9), "on_left": S.pad("ids", 8, 9, left=True)}, "ids")
list_query("list_truncate", "array_to_string(ids[1:3], ',') AS head, array_to_string(CASE WHEN n > 3 THEN ids[n - 2:n] ELSE ids END, ',') AS tail, array_to_string(CASE WHEN n > 3 THEN list_concat(ids[1:1], ids[n - 1:n]) ELSE ids END, ',') AS middle", lambda: {"head": S.truncate("ids", 3), "tail": S.truncate("ids", 3, "left"), "middle": S.truncate("ids", 3, "middle")}, "ids")
list_query("list_remove_padding", "array_to_string(CASE WHEN k > 0 THEN ids[n - k + 1:n] ELSE [] END, ',') AS kept, array_to_string(list_transform(list_filter(list_zip(ids, m), lambda z: z[2] <> 0), lambda z: z[1]), ',') AS compacted", lambda: {"kept": S.drop_padding("ids", "mask"), "compacted": S.compact("ids", "mask")}, "ids", "mask")
list_query("list_union_support", "array_to_string(list_sort(list_distinct(list_concat(ids, [1, 3, 9]))), ',') AS support", lambda: {"support": S.union_support("ids", F.array(*[F.lit(x).cast("long") for x in (1, 3, 9)]))}, "ids")


@query(
    "adaptive_kl_controller",
    """WITH k AS (SELECT event_id, 1 + greatest(least(abs(value) % 10 / 6 - 1, 0.2), -0.2) * 16 / 10000 AS f FROM events)
    SELECT row_number() OVER (ORDER BY event_id) AS step, round(0.2 * exp(sum(ln(f)) OVER (ORDER BY event_id)), 6) + 0.0 AS coefficient FROM k""",
)
def adaptive_kl_controller(spark, sf_dir):
    """The coefficient after each event."""
    kls = R.numbered(table(spark, sf_dir, "events").select("event_id", (F.abs("value") % 10).alias("kl")), "event_id")
    out = A.adaptive_kl_path(kls, "event_id", "kl", F.lit(16.0), 0.2, 6.0, 10000.0)
    return out.select((F.col("row_id") + 1).alias("step"), rounded(F.col("coefficient")).alias("coefficient"))
