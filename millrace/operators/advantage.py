"""Group-relative advantage estimators: DataFrame in, the same rows with advantages and returns out.

A row is a sampled sequence: `uid` names its group, `rewards` and `mask` hold one value a token.
Group statistics are windows over uid, all of one estimator over one exchange; statistics of the
whole batch are one-row aggregates, joined as a broadcast of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from .records import accumulated
from .registry import Registry

ESTIMATORS = Registry("advantage estimator")
EPSILON = 1e-6


def group(uid: str = "uid"):
    return Window.partitionBy(uid)


def spread_over(score: Column, mask="mask") -> Column:
    """The row's score at each masked token."""
    return F.transform(S.col(mask), lambda m: score * m)


def with_scores(df: DataFrame) -> DataFrame:
    """score: the sum of the row's rewards; n: the size of its group."""
    return df.withColumn("score", S.total("rewards")).withColumn("n", F.count("*").over(group()))


def both(df: DataFrame, advantage: Column, drop=("score", "n")) -> DataFrame:
    """Outcome estimators: the advantages are the returns too."""
    return df.withColumn("advantages", advantage).withColumn("returns", F.col("advantages")).drop(*drop)


def whitened(df: DataFrame, column: str, shift_mean: bool = True) -> DataFrame:
    """The column less its mean over all masked tokens of the batch, by the deviation: (v - mean) / sqrt(var + 1e-8)."""
    tokens = df.select(F.explode(S.compact(column, "mask")).alias("v"))
    stats = tokens.agg(F.count("*").alias("k"), F.avg("v").alias("a"), F.var_samp("v").alias("s"))
    n = F.col("k").cast("double")
    # the mean divides by n + 1e-8; the squares are taken about that mean
    mean = F.col("a") * n / (n + S.EPS)
    var = (F.col("s") * (n - 1) / n + (F.col("a") - mean) ** 2) * n / (n + S.EPS) * n / (n - 1)
    one = stats.select(mean.alias("_mean"), F.when(F.col("k") < 2, F.raise_error(F.lit("the mask must cover two values at least")).cast("double")).otherwise(var).alias("_var"))
    white = lambda v: (v - F.col("_mean")) / F.sqrt(F.col("_var") + S.EPS) + (F.lit(0.0) if shift_mean else F.col("_mean"))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.transform(column, white)).drop("_mean", "_var")


@ESTIMATORS.register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    out = df.withColumn("advantages", S.gae("rewards", "values", "mask", gamma, lam))
    out = out.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whitened(out, "advantages")


def group_moments(singleton_mean: float = 0.0, singleton_std: float = 1.0) -> tuple[Column, Column]:
    """Mean and sample deviation of the group; a group of one has the given ones."""
    w = group()
    return F.when(F.col("n") == 1, F.lit(singleton_mean)).otherwise(F.avg("score").over(w)), F.when(F.col("n") == 1, F.lit(singleton_std)).otherwise(F.stddev_samp("score").over(w))


@ESTIMATORS.register("grpo")
def grpo(df: DataFrame, normalise: bool = True, epsilon: float = EPSILON) -> DataFrame:
    mean, std = group_moments()
    score = F.col("score") - mean
    return both(with_scores(df).withColumn("a", score / (std + epsilon) if normalise else score), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, normalise: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """As grpo, with the variance floored at epsilon before the root."""
    w = group()
    var = F.greatest(F.coalesce(F.var_samp("score").over(w), F.lit(0.0)), F.lit(epsilon))
    mean, std = F.when(F.col("n") == 1, 0.0).otherwise(F.avg("score").over(w)), F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt(var))
    score = F.col("score") - mean
    return both(with_scores(df).withColumn("a", score / (std + epsilon) if normalise else score), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("grpo_passk")
def grpo_passk(df: DataFrame, normalise: bool = True, epsilon: float = EPSILON, order: str = "row_id") -> DataFrame:
    """The best row of a group gets its lead over the second; of equal ones the first by `order`.  Groups of one are refused."""
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), order)
    lead = F.col("score") - F.lead("score").over(ranked)
    std = F.stddev_samp("score").over(group())
    best = F.when(F.row_number().over(ranked) == 1, lead / (std + epsilon) if normalise else lead).otherwise(0.0)
    checked = F.when(F.col("n") < 2, F.raise_error(F.concat(F.lit("pass@k needs two rows in group "), F.col("uid").cast("string"))).cast("double")).otherwise(best)
    return both(with_scores(df).withColumn("a", checked), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    mean, _ = group_moments()
    out = whitened(with_scores(df).withColumn("a", F.col("score") - mean).withColumn("advantages", spread_over(F.col("a"))), "advantages")
    return both(out, S.masked("advantages", "mask"), ("score", "n", "a"))


@ESTIMATORS.register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Less the mean of the others; a group of one keeps its score."""
    n = F.col("n")
    a = F.when(n > 1, (F.col("score") - F.avg("score").over(group())) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col("score"))
    return both(with_scores(df).withColumn("a", a), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """Less the mean of the others; a group of one gets zero."""
    n = F.col("n")
    a = F.when(n > 1, (n * F.col("score") - F.sum("score").over(group())) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    return both(with_scores(df).withColumn("a", a), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Less the group's mean weighted by length; a group of one has baseline zero."""
    length = S.count_mask("mask").cast("double")
    w = group()
    base = F.when(F.col("n") == 1, 0.0).otherwise(F.try_divide(F.sum(length * F.col("score")).over(w), F.sum(length).over(w)))
    return both(with_scores(df).withColumn("a", F.col("score") - base), spread_over(F.col("a")), ("score", "n", "a"))


@ESTIMATORS.register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    out = df.withColumn("returns", S.discounted_return("rewards", "mask", gamma)).withColumn("advantages", F.col("returns"))
    return whitened(out, "advantages").withColumn("advantages", S.masked("advantages", "mask"))


@ESTIMATORS.register("remax")
def remax(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Reward to go less the row's baseline under the mask."""
    out = df.withColumn("returns", S.reward_to_go("rewards", "mask"))
    return out.withColumn("advantages", F.zip_with("returns", "mask", lambda r, m: r - F.col(baseline) * m))


@ESTIMATORS.register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Scores less the group's mean, scaled by rows to rows with a score other than zero."""
    scored = with_scores(df)
    alpha = scored.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha"))
    mean, _ = group_moments()
    return both(scored.withColumn("a", F.col("score") - mean).crossJoin(F.broadcast(alpha)), spread_over(F.col("alpha") * F.col("a") / f_norm), ("score", "n", "a", "alpha"))


def optimal_baseline(df: DataFrame, compacted: bool, zero_tail: bool, epsilon: float) -> DataFrame:
    """Per group and position, the baseline sum(R W) / (sum(W) + epsilon): W is the running sum of
    1 - 2 pi + sum_pi_squared under the mask, R the reward to go.  compacted: positions count masked tokens alone.

    Tokens are summed by group and position before they meet the rows again; null groups are one group.  The join is
    null-safe, so that no filter on uid tells the plans below its sides apart and they share their exchanges."""
    weight = F.zip_with(F.transform("old_log_probs", lambda x: 1 - 2 * F.exp(x)), "sum_pi_squared", lambda a, b: a + b)
    if "is_weights" in df.columns:
        weight = F.zip_with(weight, "is_weights", lambda a, b: a * b * b)
    masked = lambda v, m: F.when(m != 0, v).otherwise(F.lit(0.0)) * m
    path = F.arrays_zip(F.col("rewards").alias("r"), F.col("mask").alias("m"), weight.alias("w"))
    if compacted:
        path = F.filter(path, lambda t: t["m"] != 0)
    to_go = S.reverse_running("_path", lambda s, t: s + masked(t["r"], t["m"]), F.lit(0.0))
    weights = S.running("_path", lambda s, t: s + masked(t["w"], t["m"]), F.lit(0.0))
    triple = F.arrays_zip(to_go.alias("r"), weights.alias("w"), F.transform("_path", lambda t: F.lit(1) if compacted else t["m"]).alias("m"))
    # a row without tokens counts as one of its group unless compacted: it stands at no position
    explode = F.posexplode if compacted else F.posexplode_outer
    tokens = df.select("uid", path.alias("_path")).select("uid", explode(triple).alias("pos", "t"))
    w = F.col("t.w") * F.col("t.m")
    base = tokens.groupBy("uid", "pos").agg((F.sum(F.col("t.r") * w) / (F.sum(w) + epsilon)).alias("b"), F.count("*").alias("c"))
    if compacted and zero_tail:  # beyond the second longest row's end the longest one is alone
        base = base.withColumn("b", F.when(F.col("c") < 2, 0.0).otherwise(F.col("b")))
    at = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "b"))))
    n = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("c")))
    base = base.groupBy(F.col("uid").alias("_uid")).agg(n.alias("_n"), F.transform(at, lambda t: t["b"]).alias("_base"))
    tail = lambda place: F.lit(False)
    rows = df
    if zero_tail and not compacted:
        w = group()
        ordered = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("_len"), "row_id"))
        rows = rows.withColumn("_len", S.count_mask("mask")).withColumn("_k", ordered)
        rows = rows.withColumn("_l1", F.max("_len").over(w)).withColumn("_l2", F.max(F.when(F.col("_k") == 2, F.col("_len"))).over(w))
        tail = lambda place: (F.col("_len") == F.col("_l1")) & (F.col("_l1") > F.col("_l2")) & (place >= F.col("_l2"))
    rows = rows.join(base, F.col("uid").eqNullSafe(F.col("_uid")), "left")
    alone = F.coalesce("_n", F.lit(0)) < 2

    def less(value, mask_, place):
        b = F.when(alone | tail(place), 0.0).otherwise(F.coalesce(F.get("_base", place), F.lit(0.0)))
        return (value - b) * mask_

    if compacted:
        # from the right: the reward to go, and the place among the masked tokens
        end = F.struct(F.lit(0.0).alias("r"), F.size(F.filter("mask", lambda m: m != 0)).alias("at"))
        step = lambda s, t: F.struct((s["r"] + masked(t["r"], t["m"])).alias("r"), (s["at"] - F.when(t["m"] != 0, 1).otherwise(0)).alias("at"))
        pairs = F.arrays_zip(F.col("rewards").alias("r"), F.col("mask").alias("m"))
        rows = rows.withColumn("_path", S.reverse_running(pairs, step, end)).withColumn("returns", F.transform("_path", lambda s: s["r"]))
        adv = F.zip_with("_path", "mask", lambda s, m: F.when(m != 0, less(s["r"], m, s["at"])).otherwise(0.0))
    else:
        rows = rows.withColumn("returns", S.reward_to_go("rewards", "mask"))
        adv = F.transform(F.arrays_zip(F.col("returns").alias("r"), F.col("mask").alias("m")), lambda t, i: less(t["r"], t["m"], i))
    return rows.withColumn("advantages", adv).drop("_path", "_len", "_k", "_l1", "_l2", "_n", "_uid", "_base")


@ESTIMATORS.register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, zero_tail: bool = False, epsilon: float = 1e-8) -> DataFrame:
    return optimal_baseline(df, False, zero_tail, epsilon)


@ESTIMATORS.register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df: DataFrame, zero_tail: bool = True, epsilon: float = 1e-8) -> DataFrame:
    return optimal_baseline(df, True, zero_tail, epsilon)


def compute_advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    """The estimator of that name over the batch."""
    return ESTIMATORS.get(estimator)(df, **options)


def adaptive_kl_path(df: DataFrame, order: str, kl: str, steps: Column, start: float, target: float, horizon: float) -> DataFrame:
    """coefficient: the adaptive controller's after each row, of any number of rows.

    Each step multiplies it by a factor above zero, so it is a running sum of logarithms."""
    factor = 1 + F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2)) * steps / horizon
    return accumulated(df, order, value=F.log(factor), name="coefficient").withColumn("coefficient", start * F.exp("coefficient"))


def weighted_resample(df: DataFrame, weight: Column, draws: int, seed: int = 0, order: str = "row_id") -> DataFrame:
    """`draws` rows with replacement, each row with a chance in proportion to its weight.

    Rows cover stretches of 0..1 (running sums of the weights); draws are uniform numbers.  Both are
    cut into buckets and meet in an equi-join on the bucket, refined by the range condition.
    """
    spark, buckets = df.sparkSession, max(1, draws)
    total = df.agg(F.sum(weight).alias("_total"))
    shares = df.crossJoin(F.broadcast(total)).withColumn("_w", weight / F.col("_total"))
    spans = accumulated(shares, order, value=F.col("_w"), name="_hi")
    top = spans.agg(F.max("_hi").alias("_top"), F.max(F.when(F.col("_w") > 0, F.col(order))).alias("_end"))
    spans = spans.withColumn("_lo", F.col("_hi") - F.col("_w")).crossJoin(F.broadcast(top)).withColumn("_last", F.col(order) == F.col("_end")).drop("_top", "_end")
    floor = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(floor(F.col("_lo")), F.when(F.col("_last"), F.lit(buckets - 1)).otherwise(floor(F.col("_hi"))))))
    points = spark.range(draws).select(F.col("id").alias("draw"), F.rand(seed).alias("_u")).withColumn("_bucket", floor(F.col("_u")))
    # the last span is open: running sums may end below 1 by rounding
    hit = points.join(spans, "_bucket").where("_u >= _lo and (_u < _hi or _last)")
    return hit.drop("_last").drop("_bucket", "_u", "_lo", "_hi", "_w", "_total")
