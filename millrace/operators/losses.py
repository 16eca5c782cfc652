"""Forward values of policy, value and distillation losses.

Rows are sequences with arrays log_prob, old_log_prob, advantages, mask (and, where an
operator says so, more).  Token losses are higher-order functions; a loss is one row of
aggregates, with its metrics beside it.  Statistics over all tokens that a token's loss needs
are one-row aggregates, joined as a broadcast of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .records import accumulated, numbered
from .registry import Registry

LOSSES = Registry("policy loss")
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def agg_loss(loss, mask, mode: str = "token-mean", scale: float | None = None) -> Column:
    """The aggregate of token losses (an array column) in one of MODES."""
    row, n = S.masked_sum(loss, mask), S.count_mask(mask)
    some = F.when(n > 0, 1.0).otherwise(0.0)
    if mode == "token-mean":
        return F.try_divide(F.sum(row), F.sum(n).cast("double"))
    if mode == "seq-mean-token-sum":
        return F.try_divide(F.sum(row * some), F.sum(some))
    if mode == "seq-mean-token-mean":
        return F.try_divide(F.sum(row / (n + S.EPS) * some), F.sum(some))
    if mode == "seq-mean-token-sum-norm":
        return F.sum(row) / (F.lit(float(scale)) if scale else F.max(F.size(S.col(mask))).cast("double"))
    raise ValueError(f"no aggregation {mode}; there are {', '.join(MODES)}")


def mean_over(values, mask="mask") -> Column:
    """Masked mean over all tokens of the batch."""
    return F.sum(S.masked_sum(values, mask)) / (F.sum(S.count_mask(mask)) + S.EPS)


def zipped(df: DataFrame, **more) -> Column:
    fields = {"lp": "log_prob", "old": "old_log_prob", "a": "advantages", "m": "mask"} | more
    return F.arrays_zip(*[S.col(c).alias(k) for k, c in fields.items()])


def log_ratio(t: Column, bound: float | None = 20.0) -> Column:
    x = t["lp"] - t["old"]
    return x if bound is None else S.clip(x, -bound, bound)


def finish(df: DataFrame, token, mode: str, metrics: dict[str, Column], weights: str | None, scale: float | None = None) -> DataFrame:
    """One row: loss and metrics.  token: array of structs with l (and what metrics read), in the column _t."""
    t = df.withColumn("_t", token)
    loss = F.transform("_t", lambda x: x["l"])
    if weights:
        loss = F.zip_with(loss, weights, lambda a, w: a * w)
    return t.withColumn("_l", loss).agg(agg_loss("_l", "mask", mode, scale).alias("loss"), *[c.alias(n) for n, c in metrics.items()])


def field(name: str) -> Column:
    return F.transform("_t", lambda x: x[name])


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def standard_metrics(lower: bool = False) -> dict[str, Column]:
    return {"pg_clipfrac": mean_over(field("c")), "ppo_kl": mean_over(F.transform(field("k"), lambda k: -k)), "pg_clipfrac_lower": mean_over(field("d")) if lower else F.lit(0.0)}


@LOSSES.register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Clipped ratio with a second clip for negative advantages."""
    if dual <= 1:
        raise ValueError("the dual clip must be above 1")

    def token(t):
        k = log_ratio(t)
        r = F.exp(k)
        one, two, three = -t["a"] * r, -t["a"] * S.clip(r, 1 - low, 1 + high), -t["a"] * dual
        top = F.greatest(one, two)
        loss = F.when(t["a"] < 0, F.least(three, top)).otherwise(top)
        return F.struct(loss.alias("l"), k.alias("k"), flag(two > one).alias("c"), flag((top > three) & (t["a"] < 0)).alias("d"))

    return finish(df, F.transform(zipped(df), token), mode, standard_metrics(True), weights)


@LOSSES.register("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2, weights: str | None = None) -> DataFrame:
    """The ratio is the sequence's geometric mean; always averaged by sequence."""
    gap = F.zip_with("log_prob", "old_log_prob", lambda a, b: a - b)
    row = S.masked_sum(gap, "mask") / F.greatest(S.count_mask("mask"), F.lit(1))
    rows = df.withColumn("_s", F.exp(F.least(row, F.lit(10.0))))

    def token(t):
        one, two = -t["a"] * F.col("_s"), -t["a"] * S.clip(F.col("_s"), 1 - low, 1 + high)
        return F.struct(F.greatest(one, two).alias("l"), log_ratio(t, None).alias("k"), flag(two > one).alias("c"))

    return finish(rows, F.transform(zipped(df), token), "seq-mean-token-mean", standard_metrics(), weights)


@LOSSES.register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, weights: str | None = None) -> DataFrame:
    """A sigmoid gate on the ratio, steeper or flatter by the advantage's sign."""

    def token(t):
        k = log_ratio(t)
        tau = F.when(t["a"] > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
        gate = 1 / (1 + F.exp(-tau * (F.exp(k) - 1))) * (4 / tau)
        return F.struct((-gate * t["a"]).alias("l"), k.alias("k"), F.lit(0.0).alias("c"))

    return finish(df, F.transform(zipped(df), token), "seq-mean-token-mean", standard_metrics(), weights)


@LOSSES.register("gpg")
def gpg(df: DataFrame, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    return finish(df, F.transform(zipped(df), lambda t: F.struct((-t["lp"] * t["a"]).alias("l"))), mode, {}, weights)


def covariance(df: DataFrame, mean_eps: float) -> DataFrame:
    """_ma, _ml: means over masked tokens of advantages and log-probabilities; _n: their number."""
    n = F.sum(S.count_mask("mask")).cast("double")
    one = df.agg((F.sum(S.masked_sum("advantages", "mask")) / (n + mean_eps)).alias("_ma"), (F.sum(S.masked_sum("log_prob", "mask")) / (n + mean_eps)).alias("_ml"), n.alias("_n"))
    return df.crossJoin(F.broadcast(one))


def chosen_tokens(rows: DataFrame, wanted: Column, score: Column, share: float, order) -> DataFrame:
    """rows with _pick: the positions of the tokens that a share of all (one at least) takes, first by `order`; ranks come
    from ranges of that order, so that no task sorts more than its range."""
    cov = F.transform(zipped(rows), lambda t, i: F.struct(i.alias("i"), t["m"].alias("m"), wanted(t).alias("w"), score(t).alias("s")))
    tokens = rows.select("row_id", "_n", F.explode(F.filter(cov, lambda t: (t["m"] != 0) & t["w"])).alias("t"))
    ranked = accumulated(tokens.select("row_id", "_n", F.col("t.i").alias("i"), F.col("t.s").alias("s")), *order, value=F.lit(1), name="_rank")
    picked = ranked.where(F.col("_rank") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1)))
    return rows.join(picked.groupBy("row_id").agg(F.collect_set("i").alias("_pick")), "row_id", "left").withColumn("_pick", F.coalesce("_pick", F.array().cast("array<int>")))


@LOSSES.register("clip_cov")
def clip_cov(df: DataFrame, low: float = 0.2, high: float = 0.2, share: float = 0.0002, lb: float = 1.0, ub: float = 5.0, seed: int = 0, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Takes out a share of the tokens whose covariance lies between the bounds, drawn by a hash of seed, row and position."""
    rows = covariance(df, S.EPS)
    cov = lambda t: (t["a"] - F.col("_ma")) * (t["lp"] - F.col("_ml"))
    clipped = lambda t: -t["a"] * S.clip(F.exp(log_ratio(t, None)), 1 - low, 1 + high) > -t["a"] * F.exp(log_ratio(t, None))
    rows = chosen_tokens(rows, lambda t: ~clipped(t) & (cov(t) < ub) & (cov(t) > lb), cov, share, (F.xxhash64(F.lit(seed), "row_id", "i"), "row_id", "i"))

    def token(t, i):
        k = log_ratio(t, None)
        out = F.array_contains("_pick", i)
        top = F.greatest(-t["a"] * F.exp(k), -t["a"] * S.clip(F.exp(k), 1 - low, 1 + high))
        return F.struct(F.when(out, 0.0).otherwise(top).alias("l"), k.alias("k"), flag(out).alias("c"))

    return finish(rows, F.transform(zipped(df), token), mode, {k: v for k, v in standard_metrics().items() if k != "pg_clipfrac_lower"}, weights)


@LOSSES.register("kl_cov")
def kl_cov(df: DataFrame, share: float = 0.0002, coefficient: float = 1.0, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Adds the absolute log ratio to the tokens of largest covariance (ties: by row, then position)."""
    rows = covariance(df, 0.0)
    cov = lambda t: (t["a"] - F.col("_ma")) * (t["lp"] - F.col("_ml"))
    rows = chosen_tokens(rows, lambda t: F.lit(True), cov, share, (F.desc("s"), "row_id", "i"))

    def token(t, i):
        k = log_ratio(t, None)
        extra = F.when(F.array_contains("_pick", i), coefficient * F.abs(k)).otherwise(0.0)
        return F.struct((-t["a"] * F.exp(k) + extra).alias("l"), F.abs(k).alias("k"))

    return finish(rows, F.transform(zipped(df), token), mode, {"ppo_kl": mean_over(field("k"))}, weights)


@LOSSES.register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Geometric mean of signed, clamped ratios times the sequence's mean advantage."""

    def token(t):
        k = log_ratio(t, None)
        c, sign = S.clip(k, -low, high), F.signum(t["a"])
        return F.struct((sign * F.least(sign * k, sign * c)).alias("l"), k.alias("k"), flag((k != c) & (t["a"] > 0)).alias("c"), flag((k != c) & (t["a"] < 0)).alias("d"))

    rows = df.withColumn("_t", F.transform(zipped(df), token))
    n = S.count_mask("mask") + S.EPS
    row = -(S.masked_sum("advantages", "mask") / n) * F.exp(S.masked_sum(field("l"), "mask") / n)
    return rows.agg(F.avg(row).alias("loss"), *[c.alias(n) for n, c in standard_metrics(True).items()])


@LOSSES.register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    def token(t):
        k = log_ratio(t)
        r = F.exp(k)
        c = S.clip(r, 1 - low, 1 + high)
        return F.struct((-c * t["a"] * t["lp"]).alias("l"), k.alias("k"), flag(r != c).alias("c"))

    return finish(df, F.transform(zipped(df), token), mode, standard_metrics(), weights)


@LOSSES.register("reinforce")
def reinforce(df: DataFrame, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Minus log-probability times advantage, with importance weights if there are any."""
    return finish(df, F.transform(zipped(df), lambda t: F.struct((-t["a"] * t["lp"]).alias("l"), log_ratio(t).alias("k"))), mode, {"ppo_kl": mean_over(F.transform(field("k"), lambda k: -k))}, weights)


@LOSSES.register("bypass_mode")
def bypass_mode(df: DataFrame, kind: str = "reinforce", level: str | None = "token", threshold: float = 2.0, options: list[str] | None = None, thresholds=None, mode: str = "token-mean", **more) -> DataFrame:
    """The old log-probabilities are the rollout's: weights and rejection against them, then reinforce (weighted) or ppo_clip
    (whose ratio is the weight already)."""
    from .correction import correct

    rows = correct(df.withColumn("rollout_log_prob", F.col("old_log_prob")), level, threshold, options, thresholds)
    rows = rows.withColumn("mask", F.col("kept_mask"))
    if kind == "reinforce":
        return reinforce(rows, mode, "is_weights" if level else None)
    if kind == "ppo_clip":
        return vanilla(rows, mode=mode, **more)
    raise ValueError(f"no kind {kind}")


def sft_loss(df: DataFrame) -> DataFrame:
    """Minus the mean log-probability of the tokens whose successor is in the loss mask: the mask, rolled left by one over
    the rows laid end to end, so that a row's last place takes the next row's first, and the last row's that of the first."""
    rows = numbered(df, "row_id", name="_i")
    size = rows.agg(F.count("*").alias("_size"))
    first = rows.crossJoin(F.broadcast(size)).select(F.pmod(F.col("_i") - 1, F.col("_size")).alias("_i"), F.col("mask")[0].alias("_next"))
    rows = rows.join(first, "_i").withColumn("_m", F.concat(F.slice("mask", 2, F.greatest(F.size("mask") - 1, F.lit(0))), F.array("_next")))
    return rows.agg((-F.sum(S.masked_sum("log_prob", "_m")) / F.sum(S.count_mask("_m"))).alias("loss"))


def value_loss(df: DataFrame, clip_range: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger of clipped and plain squared errors.  Columns values, old_values, returns, mask."""

    def token(t):
        c = S.clip(t["v"], t["o"] - clip_range, t["o"] + clip_range)
        plain, clipped = (t["v"] - t["r"]) ** 2, (c - t["r"]) ** 2
        return F.struct(F.greatest(plain, clipped).alias("l"), flag(clipped > plain).alias("c"))

    z = F.arrays_zip(F.col("values").alias("v"), F.col("old_values").alias("o"), F.col("returns").alias("r"))
    rows = df.withColumn("_t", F.transform(z, token)).withColumn("_l", field("l"))
    return rows.agg((0.5 * agg_loss("_l", "mask", mode)).alias("loss"), mean_over(field("c")).alias("clipfrac"))


def entropy_loss(df: DataFrame, logits: str, mode: str = "token-mean") -> DataFrame:
    """Aggregate entropy of arrays of logits, one a token."""
    return df.withColumn("_l", F.transform(logits, S.entropy)).agg(agg_loss("_l", "mask", mode).alias("loss"))


def clipped_is(ratio_from: Column, clip_at: float) -> Column:
    return F.least(F.exp(S.clip(ratio_from, -20.0, 20.0)), F.lit(clip_at))


def cross_world_loss(df: DataFrame, tau: float, lam: float, is_clip: float | None = None, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Divergences in two worlds, each on its own support, plus that of the belief transitions on the union.

    student_a, student_b, teacher_a, teacher_b: for each token the log-probabilities on the union of supports;
    member_a, member_b: which slots are each world's.  Tokens whose distillation mask is 0 count for nothing.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    names = {"sa": "student_a", "sb": "student_b", "ta": "teacher_a", "tb": "teacher_b", "ma": "member_a", "mb": "member_b", "lp": "log_prob", "old": "old_log_prob"}
    z = F.arrays_zip(*[F.col(c).alias(k) for k, c in names.items() if c in df.columns])

    def only(x, keep):
        """The slots that are kept, in one pass; a slot without a log-probability is in no support."""
        return F.array_compact(F.zip_with(x, keep, lambda v, k: F.when(k, v)))

    def token(t):
        a = S.bias_corrected_kl(only(t["sa"], t["ma"]), only(t["ta"], t["ma"]))
        b = S.bias_corrected_kl(only(t["sb"], t["mb"]), only(t["tb"], t["mb"]))
        valid = F.zip_with(t["ma"], t["mb"], lambda x, y: x | y)
        turn = lambda x, y: F.transform(S.tempered_softmax(only(F.zip_with(S.centred(x), S.centred(y), lambda u, v: u - v), valid), tau), lambda p: F.log(F.greatest(p, F.lit(1e-30))))
        c = S.bias_corrected_kl(turn(t["sa"], t["sb"]), turn(t["ta"], t["tb"]))
        raw = a + b + lam * c
        loss = raw * clipped_is(t["lp"] - t["old"], is_clip) if is_clip is not None else raw
        return F.struct(loss.alias("l"), raw.alias("raw"), a.alias("a"), b.alias("b"), c.alias("c"))

    distil = F.col("distillation_mask") if "distillation_mask" in df.columns else F.lit(1)
    rows = df.withColumn("_d", distil).withColumn("mask", F.transform("mask", lambda m: m * F.col("_d")))
    n = F.greatest(F.sum(S.count_mask("mask")).cast("double"), F.lit(1.0))
    share = lambda c: F.sum(S.masked_sum(c, "mask")) / n
    metrics = {"world": share(F.transform("_t", lambda x: x["a"] + x["b"])), "world_a": share(field("a")), "world_b": share(field("b")), "trans": share(field("c")), "total": share(field("raw")), "weighted": share(field("l")), "mask_mean": F.avg("_d"), "tokens": F.sum(S.count_mask("mask")).cast("double")}
    return finish(rows, F.transform(z, token), mode, metrics, weights)


def self_distillation_loss(df: DataFrame, alpha: float = 0.5, support: str = "full", is_clip: float | None = None, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """Divergence of student and teacher at each token.

    alpha 0: forward, 1: reverse, between: generalised Jensen-Shannon.  support: full (arrays student, teacher
    of all log-probabilities), tail (top-k with a slot for the rest), renorm (top-k made to sum to 1),
    corrected (top-k, bias-corrected reverse) or sampled (log_prob and teacher_log_prob of the sampled token)."""
    names = {"s": "student", "t": "teacher", "lp": "log_prob", "old": "old_log_prob", "tlp": "teacher_log_prob"}
    z = F.arrays_zip(*[F.col(c).alias(k) for k, c in names.items() if c in df.columns])
    kl = lambda target, other: F.zip_with(target, other, lambda p, q: F.exp(p) * (p - q))

    def divergence(t):
        if support == "sampled":
            if alpha != 1.0:
                raise ValueError("the sampled token gives the reverse divergence alone")
            return (t["lp"] - t["tlp"]) * t["lp"]
        if support == "corrected":
            return S.bias_corrected_kl(t["s"], t["t"])
        change = {"full": lambda x: x, "tail": S.add_tail, "renorm": S.renormalised}[support]
        s, q = change(t["s"]), change(t["t"])
        if alpha == 0.0:
            return S.total(kl(q, s))
        if alpha == 1.0:
            return S.total(kl(s, q))
        mix = F.zip_with(s, q, lambda x, y: S.log_sum_exp(F.array(x + F.log(F.lit(1 - alpha)), y + F.log(F.lit(alpha)))))
        return (1 - alpha) * S.total(kl(s, mix)) + alpha * S.total(kl(q, mix))

    def token(t):
        raw = divergence(t)
        loss = raw * clipped_is(t["lp"] - t["old"], is_clip) if is_clip is not None else raw
        return F.struct(loss.alias("l"), raw.alias("raw"))

    distil = F.col("distillation_mask") if "distillation_mask" in df.columns else F.lit(1)
    rows = df.withColumn("_d", distil).withColumn("mask", F.transform("mask", lambda m: m * F.col("_d")))
    n = F.greatest(F.sum(S.count_mask("mask")).cast("double"), F.lit(1.0))
    metrics = {"raw_token_mean": F.sum(S.masked_sum(field("raw"), "mask")) / n, "weighted_token_mean": F.sum(S.masked_sum(field("l"), "mask")) / n, "mask_mean": F.avg("_d"), "tokens": F.sum(S.count_mask("mask")).cast("double")}
    return finish(rows, F.transform(z, token), mode, metrics, weights)


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    return LOSSES.get(name)(df, **options)
