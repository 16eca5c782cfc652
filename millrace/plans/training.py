"""Queries over losses and rollout correction (survey block 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import correction as C
from ..operators import losses as L
from .catalog import query
from .tables import TOK, rounded, sequences, table

NEEDS = ("mask", "log_prob", "old_log_prob", "advantages")


def one_row(df):
    """All columns of a one-row result, rounded."""
    return df.select(*[rounded(F.col(c)).alias(c) for c in df.columns])


def listed(names: dict[str, str]) -> str:
    return ", ".join(f"(round({sql}, 6) + 0.0)::DOUBLE AS {n}" for n, sql in names.items())


MEAN = "sum(({x}) * m) / (sum(m) + 1e-8)"
#: The four aggregations of token losses l over rows.
MODES = {
    "token-mean": "sum(l * m) / sum(m)",
    "seq-mean-token-sum": "(SELECT sum(s) / count(*) FROM (SELECT sum(l * m) AS s FROM tl GROUP BY row_id HAVING sum(m) > 0))",
    "seq-mean-token-mean": "(SELECT sum(s) / count(*) FROM (SELECT sum(l * m) / (sum(m) + 1e-8) AS s FROM tl GROUP BY row_id HAVING sum(m) > 0))",
    "seq-mean-token-sum-norm": "sum(l * m) / (SELECT max(n) FROM (SELECT count(*) AS n FROM tl GROUP BY row_id))",
}
RATIO = "ra AS (SELECT *, greatest(least(lp - old, 20), -20) AS k, exp(greatest(least(lp - old, 20), -20)) AS e FROM tok)"


def policy(name: str, loss: str, metrics: dict[str, str], mode: str = "token-mean", before: str = RATIO, source: str = "ra", query_name: str | None = None, pass_mode: bool = False, **options):
    if pass_mode:
        options["mode"] = mode
    sql = f"WITH {TOK}, {before}, tl AS (SELECT *, {loss} AS l FROM {source}) SELECT {listed({'loss': MODES[mode]} | metrics)} FROM tl"

    @query(query_name or f"loss_{name}", sql)
    def run(spark, sf_dir):
        return one_row(L.policy_loss(sequences(spark, sf_dir, *NEEDS), name, **options))

    return run


CLIPPED = "greatest(-a * e, -a * greatest(least(e, 1.2), 0.8))"
STANDARD = {"ppo_kl": MEAN.format(x="-k"), "pg_clipfrac_lower": "0"}
CLIPFRAC = {"pg_clipfrac": MEAN.format(x="CASE WHEN -a * greatest(least(e, 1.2), 0.8) > -a * e THEN 1 ELSE 0 END")}
for mode in MODES:
    policy(
        "vanilla",
        f"CASE WHEN a < 0 THEN least(-a * 3, {CLIPPED}) ELSE {CLIPPED} END",
        CLIPFRAC | {"ppo_kl": MEAN.format(x="-k"), "pg_clipfrac_lower": MEAN.format(x=f"CASE WHEN a < 0 AND {CLIPPED} > -a * 3 THEN 1 ELSE 0 END")},
        mode,
        query_name="loss_vanilla_" + mode.replace("-", "_"),
        pass_mode=True,
    )
GSPO = "ra AS (SELECT *, lp - old AS k, exp(least(sum((lp - old) * m) OVER w / greatest(sum(m) OVER w, 1), 10)) AS e FROM tok WINDOW w AS (PARTITION BY row_id))"
policy("gspo", CLIPPED, CLIPFRAC | STANDARD, "seq-mean-token-mean", GSPO)
policy("sapo", "-a * (1 / (1 + exp(-(CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END) * (e - 1)))) * (4 / CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END)", {"pg_clipfrac": "0"} | STANDARD, "seq-mean-token-mean")
policy("gpg", "-lp * a", {})
policy("cispo", "-greatest(least(e, 1.2), 0.8) * a * lp", {"pg_clipfrac": MEAN.format(x="CASE WHEN e > 1.2 OR e < 0.8 THEN 1 ELSE 0 END")} | STANDARD)


@query(
    "loss_geo_mean",
    f"""WITH {TOK},
    k AS (SELECT *, lp - old AS x, greatest(least(lp - old, 0.2), -0.2) AS c, sign(a) AS s FROM tok),
    rows_ AS (SELECT row_id, -(sum(a * m) / (sum(m) + 1e-8)) * exp(sum(s * least(s * x, s * c) * m) / (sum(m) + 1e-8)) AS l FROM k GROUP BY row_id)
    SELECT (SELECT round(avg(l), 6) + 0.0 FROM rows_) AS loss,
      {listed({"pg_clipfrac": MEAN.format(x="CASE WHEN x <> c AND a > 0 THEN 1 ELSE 0 END"), "ppo_kl": MEAN.format(x="-x"), "pg_clipfrac_lower": MEAN.format(x="CASE WHEN x <> c AND a < 0 THEN 1 ELSE 0 END")})} FROM k""",
)
def loss_geo_mean(spark, sf_dir):
    return one_row(L.policy_loss(sequences(spark, sf_dir, *NEEDS), "geo_mean"))


@query(
    "loss_kl_cov",
    f"""WITH {TOK},
    c AS (SELECT *, (a - (SELECT avg(a) FROM tok WHERE m = 1)) * (lp - (SELECT avg(lp) FROM tok WHERE m = 1)) AS cov FROM tok),
    ranked AS (SELECT *, CASE WHEN m = 1 THEN row_number() OVER (PARTITION BY m ORDER BY cov DESC, row_id, pos) END AS rank FROM c),
    tl AS (SELECT *, -a * exp(lp - old) + CASE WHEN rank <= greatest(floor((SELECT sum(m) FROM tok) * 0.0002), 1) THEN abs(lp - old) ELSE 0 END AS l FROM ranked)
    SELECT {listed({"loss": MODES["token-mean"], "ppo_kl": MEAN.format(x="abs(lp - old)")})} FROM tl""",
)
def loss_kl_cov(spark, sf_dir):
    return one_row(L.policy_loss(sequences(spark, sf_dir, *NEEDS), "kl_cov"))


@query("loss_clip_cov")
def loss_clip_cov(spark, sf_dir):
    """Random: a share of the tokens between the bounds is taken out."""
    return one_row(L.policy_loss(sequences(spark, sf_dir, *NEEDS), "clip_cov", seed=3, lb=0.1, share=0.01))


@query(
    "loss_value",
    f"""WITH {TOK}, c AS (SELECT *, greatest(least(v, r / 10 + 0.5), r / 10 - 0.5) AS cl FROM tok),
    tl AS (SELECT *, greatest((v - r) ** 2, (cl - r) ** 2) AS l FROM c)
    SELECT {listed({"loss": "0.5 * sum(l * m) / sum(m)", "clipfrac": MEAN.format(x="CASE WHEN (cl - r) ** 2 > (v - r) ** 2 THEN 1 ELSE 0 END")})} FROM tl""",
)
def loss_value(spark, sf_dir):
    rows = sequences(spark, sf_dir, "rewards", "values", "mask").withColumn("old_values", F.transform("rewards", lambda x: x / 10)).withColumnRenamed("rewards", "returns")
    return one_row(L.value_loss(rows))


@query(
    "loss_entropy",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
    h AS (SELECT vec_id, ln(sum(exp(x))) - sum(exp(x) * x) / sum(exp(x)) AS h FROM e GROUP BY vec_id)
    SELECT round(sum(h) FILTER (vec_id % 3 <> 0) / count(*) FILTER (vec_id % 3 <> 0), 6) AS loss FROM h""",
)
def loss_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.array(F.col("embedding").cast("array<double>")).alias("logits"), F.array(F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0)).alias("mask"))
    return one_row(L.entropy_loss(rows, "logits"))


def worlds(spark, sf_dir):
    """Two vectors as student and teacher over eight slots: log-softmax of slices of one embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    cut = lambda k: S.log_softmax(F.slice("e", 8 * k + 1, 8))
    return e.select(
        F.col("vec_id").alias("row_id"), F.array(F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0)).alias("mask"),
        F.array(cut(0)).alias("student"), F.array(cut(1)).alias("teacher"), F.array(cut(2)).alias("third"), F.array(cut(3)).alias("fourth"),
    )


WORLDS = """
raw AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
cut AS (SELECT row_id, m, i // 8 AS part, i % 8 AS slot, x - ln(sum(exp(x)) OVER (PARTITION BY row_id, i // 8)) AS x FROM raw),
w AS (SELECT row_id, m, slot, max(x) FILTER (part = 0) AS s, max(x) FILTER (part = 1) AS t, max(x) FILTER (part = 2) AS s2, max(x) FILTER (part = 3) AS t2 FROM cut GROUP BY ALL)
"""


def distilled(name: str, per_slot: str, before: str = "", source: str = "w", **options):
    """A self-distillation loss: per_slot sums to a token's divergence."""
    sql = f"WITH {WORLDS}{before}, tl AS (SELECT row_id, m, sum({per_slot}) AS l FROM {source} GROUP BY row_id, m) SELECT {listed({'loss': 'sum(l * m) / sum(m)', 'raw_token_mean': 'sum(l * m) / greatest(sum(m), 1)', 'tokens': 'sum(m)'})} FROM tl"

    @query(name, sql)
    def run(spark, sf_dir):
        return one_row(L.self_distillation_loss(worlds(spark, sf_dir).select("mask", "student", "teacher"), **options).select("loss", "raw_token_mean", "tokens"))


distilled("distil_forward_kl", "exp(t) * (t - s)", alpha=0.0)
distilled("distil_reverse_kl", "exp(s) * (s - t)", alpha=1.0)
distilled("distil_jsd", "0.7 * exp(s) * (s - ln(0.7 * exp(s) + 0.3 * exp(t))) + 0.3 * exp(t) * (t - ln(0.7 * exp(s) + 0.3 * exp(t)))", alpha=0.3)
distilled("distil_corrected", "exp(s) * (s - t) + exp(t) - exp(s)", support="corrected")
TOP = ", top AS (SELECT row_id, m, slot, s, t FROM w WHERE slot < 4)"
distilled("distil_renorm", "exp(s - zs) / 1 * ((s - zs) - (t - zt))", TOP + ", z AS (SELECT *, ln(sum(exp(s)) OVER r) AS zs, ln(sum(exp(t)) OVER r) AS zt FROM top WINDOW r AS (PARTITION BY row_id))", "z", alpha=1.0, support="renorm")
distilled("distil_tail", "exp(s) * (s - t)", TOP + ", z AS (SELECT * FROM top UNION ALL SELECT row_id, m, 4, ln(1 - sum(exp(s))), ln(1 - sum(exp(t))) FROM top GROUP BY row_id, m)", "z", alpha=1.0, support="tail")


def top_worlds(spark, sf_dir):
    cut = lambda c: F.transform(c, lambda x: F.slice(x, 1, 4)).alias(c)
    return worlds(spark, sf_dir).select("mask", cut("student"), cut("teacher"))


def rebind(name, **options):
    """The top-k forms read the first four slots."""
    from .catalog import QUERIES

    QUERIES[name] = lambda spark, sf_dir: one_row(L.self_distillation_loss(top_worlds(spark, sf_dir), **options).select("loss", "raw_token_mean", "tokens"))


rebind("distil_renorm", alpha=1.0, support="renorm")
rebind("distil_tail", alpha=1.0, support="tail")


@query(
    "loss_cross_world",
    f"""WITH {WORLDS},
    c AS (SELECT *, (s - avg(s) OVER r) - (s2 - avg(s2) OVER r) AS ds, (t - avg(t) OVER r) - (t2 - avg(t2) OVER r) AS dt FROM w WINDOW r AS (PARTITION BY row_id)),
    u AS (SELECT * FROM c WHERE slot <= 5 OR slot >= 4),
    p AS (SELECT *, exp(ds / 0.5) / sum(exp(ds / 0.5)) OVER r AS ps, exp(dt / 0.5) / sum(exp(dt / 0.5)) OVER r AS pt FROM u WINDOW r AS (PARTITION BY row_id)),
    tl AS (SELECT row_id, m, sum(exp(s) * (s - t) + exp(t) - exp(s)) FILTER (slot <= 5) AS a, sum(exp(s2) * (s2 - t2) + exp(t2) - exp(s2)) FILTER (slot >= 4) AS b,
                  sum(ps * (ln(ps) - ln(pt)) + pt - ps) AS c FROM p GROUP BY row_id, m)
    SELECT {listed({"loss": "sum((a + b + 0.8 * c) * m) / sum(m)", "world_a": "sum(a * m) / sum(m)", "world_b": "sum(b * m) / sum(m)", "trans": "sum(c * m) / sum(m)", "tokens": "sum(m)"})} FROM tl""",
)
def loss_cross_world(spark, sf_dir):
    w = worlds(spark, sf_dir)
    member = lambda f: F.array(F.transform(F.sequence(F.lit(0), F.lit(7)), f))
    rows = w.select("mask", F.col("student").alias("student_a"), F.col("third").alias("student_b"), F.col("teacher").alias("teacher_a"), F.col("fourth").alias("teacher_b"), member(lambda i: i <= 5).alias("member_a"), member(lambda i: i >= 4).alias("member_b"))
    return one_row(L.cross_world_loss(rows, 0.5, 0.8).select("loss", "world_a", "world_b", "trans", "tokens"))


def rollouts(spark, sf_dir):
    return sequences(spark, sf_dir, "mask", "log_prob", "old_log_prob").withColumnRenamed("old_log_prob", "rollout_log_prob")


GAP = "g AS (SELECT *, greatest(least(lp - old, 20), -20) AS x, sum((lp - old) * m) OVER (PARTITION BY row_id) AS sx FROM tok)"


@query(
    "rollout_is_token",
    f"WITH {TOK}, {GAP} SELECT row_id, pos, round(least(exp(x) * m, 1.5), 6) + 0.0 AS is_weights FROM g",
)
def rollout_is_token(spark, sf_dir):
    from .tables import exploded

    return exploded(C.importance_weights(rollouts(spark, sf_dir), "token", 1.5), "is_weights")


@query(
    "rollout_is_sequence_normalised",
    f"""WITH {TOK}, {GAP}, w AS (SELECT *, least(exp(greatest(least(sx, 20), -20)) * m, 2) AS w FROM g),
    mean AS (SELECT sum(s) / greatest(count(*), 1e-8) AS mean FROM (SELECT sum(w * m) / (sum(m) + 1e-8) AS s FROM w GROUP BY row_id HAVING sum(m) > 0))
    SELECT row_id, pos, round(w / mean, 6) + 0.0 AS is_weights FROM w, mean""",
)
def rollout_is_sequence_normalised(spark, sf_dir):
    from .tables import exploded

    return exploded(C.importance_weights(rollouts(spark, sf_dir), "sequence", 2.0, normalise=True), "is_weights")


#: Statistics of the options by token or row, and the thresholds of the queries below.
RS = {
    "token_k1": ("-x", "2"), "token_k2": ("0.5 * x * x", "0.05"), "token_k3": ("exp(x) - 1 - x", "0.05"),
    "seq_sum_k1": ("sum(-x * m) OVER w", "0.5_3"), "seq_sum_k2": ("sum(0.5 * x * x * m) OVER w", "0.2"), "seq_sum_k3": ("sum((exp(x) - 1 - x) * m) OVER w", "0.2"),
    "seq_mean_k1": ("sum(-x * m) OVER w / (sum(m) OVER w + 1e-8)", "1.3"), "seq_mean_k2": ("sum(0.5 * x * x * m) OVER w / (sum(m) OVER w + 1e-8)", "0.03"), "seq_mean_k3": ("sum((exp(x) - 1 - x) * m) OVER w / (sum(m) OVER w + 1e-8)", "0.03"),
    "seq_max_k2": ("coalesce(max(CASE WHEN m = 1 THEN 0.5 * x * x END) OVER w, 0)", "0.1"), "seq_max_k3": ("coalesce(max(CASE WHEN m = 1 THEN exp(x) - 1 - x END) OVER w, 0)", "0.1"),
}


def rejection(option: str):
    stat, spec = RS[option]
    low, high = C.parse_thresholds([option], spec)[option]
    test = f"st BETWEEN ln({low!r}) AND ln({high!r})" if option.endswith("k1") else f"st <= {high!r}"
    sql = f"""WITH {TOK}, {GAP}, s AS (SELECT *, {stat} AS st FROM g WINDOW w AS (PARTITION BY row_id)),
    k AS (SELECT row_id, m, CASE WHEN {test} THEN m ELSE 0 END AS k FROM s)
    SELECT {listed({"masked_fraction": "(sum(m) - sum(k)) / (sum(m) + 1e-8)", "seq_masked_fraction": "(SELECT avg(CASE WHEN a = b THEN 0 ELSE 1 END) FROM (SELECT sum(m) AS a, sum(k) AS b FROM k GROUP BY row_id))"})} FROM k"""

    @query(f"rollout_rs_{option}", sql)
    def run(spark, sf_dir):
        return one_row(C.rejection_metrics(rollouts(spark, sf_dir), [option], spec))


for option in RS:
    rejection(option)


@query(
    "rollout_rs_combined",
    f"""WITH {TOK}, {GAP}, s AS (SELECT *, sum((exp(x) - 1 - x) * m) OVER w / (sum(m) OVER w + 1e-8) AS st FROM g WINDOW w AS (PARTITION BY row_id))
    SELECT row_id, pos, (CASE WHEN -x BETWEEN ln(0.5) AND ln(2) AND st <= 0.05 THEN m ELSE 0 END)::DOUBLE AS kept_mask FROM s""",
)
def rollout_rs_combined(spark, sf_dir):
    from .tables import exploded

    return exploded(C.correct(rollouts(spark, sf_dir), "token", 2.0, ["token_k1", "seq_mean_k3"], "2,0.05"), "kept_mask")




@query(
    "rollout_is_metrics",
    f"""WITH {TOK}, {GAP}, w AS (SELECT *, exp(x) * m AS w, greatest(least(exp(x) * m, 1.5), 1 / 1.5) AS c FROM g),
    q AS (SELECT sum(w * m) / (sum(m) + 1e-8) AS s FROM w GROUP BY row_id)
    SELECT {listed({
        "mean": MEAN.format(x="w"), "std": f"sqrt(greatest({MEAN.format(x='c * c')} - ({MEAN.format(x='c')}) ** 2, 0))",
        "ess": f"1 / (({MEAN.format(x='c * c')}) / ({MEAN.format(x='c')} + 1e-8) ** 2)",
        "fraction_high": MEAN.format(x="CASE WHEN w > 1.5 THEN 1 ELSE 0 END"), "fraction_low": MEAN.format(x="CASE WHEN w < 1 / 1.5 THEN 1 ELSE 0 END"),
        "max": "max(w) FILTER (m = 1)", "min": "min(w) FILTER (m = 1)",
        "seq_mean": "(SELECT avg(s) FROM q)", "seq_std": "(SELECT stddev_samp(s) FROM q)", "seq_max": "(SELECT max(s) FROM q)", "seq_min": "(SELECT min(s) FROM q)",
        "seq_max_deviation": "(SELECT max(abs(s - 1)) FROM q)", "seq_fraction_high": "(SELECT avg((s > 1.5)::INT) FROM q)", "seq_fraction_low": "(SELECT avg((s < 1 / 1.5)::INT) FROM q)"})} FROM w""",
)
def rollout_is_metrics(spark, sf_dir):
    return one_row(C.weight_metrics(rollouts(spark, sf_dir), "token", 1.5))


@query(
    "offpolicy_metrics",
    f"""WITH {TOK}, {GAP}, p AS (SELECT row_id, -sum(lp * m) / (sum(m) + 1e-8) AS own, -sum(old * m) / (sum(m) + 1e-8) AS other, max(greatest(least(sx, 20), -20)) AS sx FROM g GROUP BY row_id)
    SELECT {listed({
        "training_ppl": "(SELECT avg(exp(own)) FROM p)", "training_log_ppl": "(SELECT avg(own) FROM p)", "rollout_ppl": "(SELECT avg(exp(other)) FROM p)", "rollout_log_ppl": "(SELECT avg(other) FROM p)",
        "kl": MEAN.format(x="old - lp"), "k3_kl": MEAN.format(x="exp(lp - old) - (lp - old) - 1"),
        "log_ppl_diff": "(SELECT avg(own - other) FROM p)", "log_ppl_abs_diff": "(SELECT avg(abs(own - other)) FROM p)", "log_ppl_diff_max": "(SELECT max(own - other) FROM p)", "log_ppl_diff_min": "(SELECT min(own - other) FROM p)", "ppl_ratio": "(SELECT avg(exp(own - other)) FROM p)",
        "chi2_token": MEAN.format(x="exp(x) ** 2") + " - 1", "chi2_seq": "(SELECT avg(exp(2 * sx)) FROM p) - 1"})} FROM g""",
)
def offpolicy_metrics(spark, sf_dir):
    return one_row(C.offpolicy_metrics(rollouts(spark, sf_dir)))


policy("reinforce", "-a * lp", {"ppo_kl": MEAN.format(x="-k")})


@query(
    "loss_bypass_reinforce",
    f"""WITH {TOK}, {GAP}, tl AS (SELECT row_id, CASE WHEN -x BETWEEN ln(0.5) AND ln(2) THEN m ELSE 0 END AS m, -a * lp * least(exp(x) * m, 2) AS l, x AS k FROM g)
    SELECT {listed({"loss": MODES["token-mean"], "ppo_kl": MEAN.format(x="-k")})} FROM tl""",
)
def loss_bypass_reinforce(spark, sf_dir):
    return one_row(L.policy_loss(sequences(spark, sf_dir, *NEEDS), "bypass_mode", options=["token_k1"], thresholds="2"))


@query(
    "loss_sft",
    f"""WITH {TOK}, o AS (SELECT *, row_number() OVER (ORDER BY row_id, pos) AS i FROM tok),
    s AS (SELECT lp, coalesce(lead(m) OVER (ORDER BY i), (SELECT m FROM o WHERE i = 1)) AS m FROM o)
    SELECT round(-sum(lp * m) / sum(m), 6) + 0.0 AS loss FROM s""",
)
def loss_sft(spark, sf_dir):
    return one_row(L.sft_loss(sequences(spark, sf_dir, "mask", "log_prob")))
