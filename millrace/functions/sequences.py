"""Sequence math on array columns: one row is a sequence, its columns hold one value a token.

All functions take and give Columns and stay in built-in higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .braces import bound

EPS = 1e-8
#: States of a fold that are gathered at once.
BLOCK = 64


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def count_mask(mask) -> Column:
    return F.aggregate(col(mask), F.lit(0), lambda a, v: a + v.cast("int"))


def masked(values, mask) -> Column:
    """Values times mask, where what stands under a mask of 0 may be anything, NaN included."""
    return F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, v).otherwise(F.lit(0.0)) * m)


def masked_sum(values, mask) -> Column:
    return total(masked(values, mask))


def masked_mean(values, mask) -> Column:
    return masked_sum(values, mask) / (count_mask(mask) + EPS)


def masked_var(values, mask) -> Column:
    """Sample variance of the values under the mask; an error for a mask sum below 2."""
    n = count_mask(mask)
    squares = lambda mean: F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, (v - mean) * (v - mean)).otherwise(F.lit(0.0)))
    raw = bound(masked_mean(values, mask), lambda mean: total(squares(mean))) / (n + EPS)
    return F.when(n < 2, F.raise_error(F.lit("the mask must cover two values at least")).cast("double")).otherwise(raw * n / (n - 1))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def log_sum_exp(x) -> Column:
    above = lambda x, top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return bound(col(x), lambda x: bound(F.array_max(x), lambda top: above(x, top)))


def log_softmax(x) -> Column:
    return bound(col(x), lambda x: bound(log_sum_exp(x), lambda lse: F.transform(x, lambda v: v - lse)))


def softmax(x) -> Column:
    return F.transform(log_softmax(x), lambda v: F.exp(v))


def entropy(logits) -> Column:
    mean = lambda x, lse: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - lse) * v)
    return bound(col(logits), lambda x: bound(log_sum_exp(x), lambda lse: lse - mean(x, lse)))


def sum_pi_squared(logits) -> Column:
    return F.exp(log_sum_exp(F.transform(col(logits), lambda v: v * 2)) - 2 * log_sum_exp(logits))


def gather(x, label) -> Column:
    """The element at a label counted from 0."""
    return F.element_at(col(x), col(label).cast("int") + 1)


def pad(x, length: int, value, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(col(x)), F.lit(0)))
    return F.concat(fill, col(x)) if left else F.concat(col(x), fill)


def truncate(x, length: int, mode: str = "right") -> Column:
    """right keeps the head, left the tail, middle both ends (half the length, rounded down, of the head); error refuses."""
    x, n = col(x), F.size(col(x))
    if mode == "right":
        cut = F.slice(x, 1, length)
    elif mode == "left":
        cut = F.slice(x, n - length + 1, F.lit(length))
    elif mode == "middle":
        head = length // 2
        cut = F.concat(F.slice(x, 1, head), F.slice(x, n - (length - head) + 1, F.lit(length - head)))
    elif mode == "error":
        cut = F.filter(x, lambda _: F.raise_error(F.lit(f"a sequence is longer than {length}")).cast("boolean"))
    else:
        raise ValueError(f"unknown truncation: {mode}")
    return F.when(n > length, cut).otherwise(x)


def drop_padding(ids, mask) -> Column:
    n = count_mask(mask)
    return F.when(n > 0, F.slice(col(ids), F.size(col(ids)) - n + 1, F.greatest(n, F.lit(1)))).otherwise(F.slice(col(ids), 1, 0))


def compact(values, mask) -> Column:
    """The values under the mask, in order."""
    return F.transform(F.filter(F.arrays_zip(col(values).alias("v"), col(mask).alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])


def response_mask(ids, eos: int) -> Column:
    """1 up to and including the first end token."""
    at = F.array_position(col(ids), F.lit(eos))
    return F.transform(col(ids), lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask) -> Column:
    """The running sum of the mask less 1, at least 0."""
    return F.transform(running_sum(mask), lambda v: F.greatest(v - 1, F.lit(0)))


def running(x, step, start: Column, out=None) -> Column:
    """Every state of a fold from the left.

    Arrays are copied whenever they grow, so states of more than BLOCK values are gathered in blocks: of n values, n * BLOCK / 2
    are copied and not the square of n.  What is named twice is bound, as interpreted lambdas work it out each time."""
    add = lambda a, v: F.array_append(a, step(F.element_at(a, -1), v))
    behind = lambda states: F.slice(states, F.lit(2), F.size(states) - 1)
    none = F.slice(F.array(F.array(start)), 1, 0)

    def over(acc, block):
        put = lambda states: F.struct(F.element_at(states, -1).alias("state"), F.array_append(acc["out"], behind(states)).alias("out"))
        return bound(F.aggregate(block, F.array(acc["state"]), add), put)

    def states(x):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        long = F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), over, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(x) > BLOCK, long).otherwise(bound(F.aggregate(x, F.array(start), add), behind))

    every = bound(col(x), states)
    return every if out is None else F.transform(every, out)


def running_sum(x) -> Column:
    return running(F.transform(col(x), lambda v: v.cast("double")), lambda s, v: s + v, F.lit(0.0))


def reverse_running(x, step, start: Column, out=None) -> Column:
    """Every state of a fold from the right, at its place."""
    return F.reverse(running(F.reverse(col(x)), step, start, out))


def reward_to_go(rewards, mask) -> Column:
    return reverse_running(masked(rewards, mask), lambda s, v: s + v, F.lit(0.0))


def discounted_return(rewards, mask, gamma: float) -> Column:
    """Running return from the right, set back to 0 behind a masked token."""
    pairs = F.arrays_zip(col(rewards).alias("r"), col(mask).alias("m"))
    zero = F.struct(F.lit(0.0).alias("ret"), F.lit(0.0).alias("run"))

    def step(s, z):
        ret = z["r"] + gamma * s["run"]
        return F.struct(ret.alias("ret"), (ret * z["m"]).alias("run"))

    return reverse_running(pairs, step, zero, lambda s: s["ret"])


def gae(rewards, values, mask, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening; masked tokens pass on what lies behind them."""
    triples = F.arrays_zip(col(rewards).alias("r"), col(values).alias("v"), col(mask).alias("m"))
    zero = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("adv"))

    def step(s, z):
        adv = z["r"] + gamma * s["value"] - z["v"] + gamma * lam * s["adv"]
        keep = z["m"] != 0
        return F.struct(F.when(keep, z["v"]).otherwise(s["value"]).alias("value"), F.when(keep, adv).otherwise(s["adv"]).alias("adv"))

    return reverse_running(triples, step, zero, lambda s: s["adv"])


def token_rewards(scores, old, ref, ratio: float) -> Column:
    """score - (old - ref) * ratio"""
    gap = F.zip_with(col(old), col(ref), lambda a, b: (a - b) * ratio)
    return F.zip_with(col(scores), gap, lambda s, g: s - g)


def kl_value(log_prob: Column, ref: Column, kind: str) -> Column:
    """Estimators k1, abs, k2 (mse) and k3 (low_var_kl) of the divergence at one token."""
    x = log_prob - ref
    if kind in ("k1", "kl"):
        return x
    if kind == "abs":
        return F.abs(x)
    if kind in ("k2", "mse"):
        return 0.5 * x * x
    if kind in ("k3", "low_var_kl"):
        y = clip(-x, -20.0, 20.0)
        return clip(F.exp(y) - y - 1, -10.0, 10.0)
    raise NotImplementedError(f"no estimator {kind}")


def kl_penalty(log_prob, ref, kind: str) -> Column:
    return F.zip_with(col(log_prob), col(ref), lambda a, b: kl_value(a, b, kind))


def kl_rewards(scores, kl, mask, beta: float) -> Column:
    """Rewards with the masked divergence taken off."""
    return F.zip_with(col(scores), masked(kl, mask), lambda s, k: s - beta * k)


def adaptive_kl(start: float, kls, steps, target: float, horizon: float) -> Column:
    """The coefficients of the adaptive controller after each step, from arrays of divergences and step sizes."""
    pairs = F.arrays_zip(col(kls).alias("k"), col(steps).alias("n"))
    return running(pairs, lambda b, z: b * (1 + clip(z["k"] / target - 1, -0.2, 0.2) * z["n"] / horizon), F.lit(float(start)))


def bias_corrected_kl(student, teacher) -> Column:
    """Sum of p_s (log p_s - log p_t) - p_s + p_t over the slots."""
    return total(F.zip_with(col(student), col(teacher), lambda s, t: F.exp(s) * (s - t) + F.exp(t) - F.exp(s)))


def centred(x) -> Column:
    return bound(col(x), lambda x: bound(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))


def add_tail(log_probs) -> Column:
    """Appends the log of the probability that the slots leave over."""
    lse = F.least(log_sum_exp(log_probs), F.lit(-1e-7))
    return F.concat(col(log_probs), F.array(F.log(-F.expm1(lse))))


def renormalised(log_probs) -> Column:
    return log_softmax(log_probs)


def union_support(a, b) -> Column:
    """Sorted distinct union of two id lists."""
    return F.array_sort(F.array_union(col(a), col(b)))


def members(union, own) -> Column:
    return F.transform(col(union), lambda v: F.array_contains(col(own), v))


def tempered_softmax(delta, tau: float) -> Column:
    return softmax(F.transform(col(delta), lambda v: v / tau))


def at_last_valid(mask, reward: Column) -> Column:
    """A row's reward at its last valid position, zero elsewhere."""
    n = count_mask(mask)
    return F.transform(col(mask), lambda _, i: F.when(i == n - 1, reward).otherwise(F.lit(0.0)))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def sft_loss_mask(prompt_length, attention) -> Column:
    """Loss on all but the prompt's tokens before its last, and not on the final valid token."""
    n, p = count_mask(attention), col(prompt_length)
    return F.transform(col(attention), lambda m, i: F.when((i < p - 1) | (i == n - 1), 0).otherwise(m))


def workload(length: Column) -> Column:
    return 24576 * length + length * length


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def round_up(a: Column, b: int) -> Column:
    return ceil_div(a, b) * b


def expand_to(x: Column, like) -> Column:
    """A row's scalar, repeated to the length of an array."""
    return F.array_repeat(x, F.size(col(like)))


def differing(a, b, mask) -> Column:
    """How many masked tokens of two lists differ."""
    z = F.arrays_zip(col(a).alias("a"), col(b).alias("b"), col(mask).alias("m"))
    return F.size(F.filter(z, lambda t: (t["m"] != 0) & ~t["a"].eqNullSafe(t["b"])))
