import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import sequences as S
from millrace.functions import text as T
from millrace.operators import advantage as A
from millrace.operators import balance as B
from millrace.operators import correction as C
from millrace.operators import losses as L
from millrace.operators import metrics as M
from millrace.operators import records as R
from millrace.operators.registry import Registry
from millrace.streaming import queues as Q


def batch(spark, rows):
    """(uid, row_id, rewards) with a full mask."""
    df = spark.createDataFrame(rows, "uid string, row_id long, rewards array<double>")
    return df.withColumn("mask", F.transform("rewards", lambda _: F.lit(1)))


def first_values(df):
    return {r.row_id: r.advantages[0] for r in df.collect()}


def test_group_of_one(spark):
    one = batch(spark, [("a", 0, [5.0])])
    assert first_values(A.compute_advantage(one, "grpo"))[0] == pytest.approx(5 / (1 + 1e-6))
    assert first_values(A.compute_advantage(one, "rloo"))[0] == 5
    assert first_values(A.compute_advantage(one, "rloo_vectorized"))[0] == 0
    with pytest.raises(Exception, match="pass@k"):
        A.compute_advantage(one, "grpo_passk").collect()


def test_small_groups(spark):
    pair = batch(spark, [("a", 0, [1.0]), ("a", 1, [3.0])])
    assert first_values(A.compute_advantage(pair, "rloo")) == {0: -2, 1: 2}
    longer = spark.createDataFrame([("a", 0, [1.0], [1]), ("a", 1, [1.0, 1.0, 1.0], [1, 1, 1])], "uid string, row_id long, rewards array<double>, mask array<int>")
    assert first_values(A.compute_advantage(longer, "opo")) == {0: -1.5, 1: 0.5}
    assert first_values(A.compute_advantage(batch(spark, [("a", 0, [0.0]), ("a", 1, [2.0])]), "gpg")) == {0: -2, 1: 2}
    assert first_values(A.compute_advantage(batch(spark, [("a", 0, [1.0]), ("a", 1, [4.0]), ("a", 2, [2.0])]), "grpo_passk", normalise=False)) == {0: 0, 1: 2, 2: 0}
    # labels are equal as they are: "1" and "01" are two groups
    assert first_values(A.compute_advantage(batch(spark, [("1", 0, [1.0]), ("01", 1, [3.0])]), "rloo")) == {0: 1, 1: 3}
    with pytest.raises(ValueError, match="no advantage estimator"):
        A.compute_advantage(pair, "unknown")


def test_sequence_functions(spark):
    row = spark.range(1)
    value = lambda c: row.select(c.alias("x")).first().x
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    assert value(S.response_mask(ints(5, 2, 7), 2)) == [1, 1, 0]
    assert value(S.truncate(ints(1, 2, 3, 4, 5), 3, "middle")) == [1, 4, 5]
    assert value(S.workload(F.lit(10))) == 245860
    assert value(S.masked_sum(ints(1.0, float("nan")), ints(1, 0))) == 1.0
    with pytest.raises(Exception, match="longer than 3"):
        value(S.truncate(ints(1, 2, 3, 4, 5), 3, "error"))
    with pytest.raises(Exception, match="two values"):
        value(S.masked_var(ints(1.0, 2.0), ints(1, 0)))
    assert value(S.add_tail(F.array(F.log(F.lit(0.25)), F.log(F.lit(0.5)))))[-1] == pytest.approx(math.log(0.25))


def test_gae_against_a_loop(spark):
    rng = np.random.default_rng(3)
    r, v, m = rng.normal(size=9), rng.normal(size=9), rng.integers(0, 2, 9)
    want, nextvalue, last = [], 0.0, 0.0
    for t in reversed(range(9)):
        if m[t]:
            last = r[t] + 0.9 * nextvalue - v[t] + 0.9 * 0.8 * last
            nextvalue = v[t]
        want.append(last)
    df = spark.createDataFrame([(r.tolist(), v.tolist(), m.tolist())], "r array<double>, v array<double>, m array<int>")
    assert df.select(S.gae("r", "v", "m", 0.9, 0.8).alias("x")).first().x == pytest.approx(want[::-1])


def test_long_folds(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 129, 3000):
        x = rng.normal(size=n)
        df = spark.createDataFrame([(x.tolist(), [1] * n)], "x array<double>, m array<int>")
        got = df.select(S.running_sum("x").alias("a"), S.reward_to_go("x", "m").alias("b")).first()
        assert got.a == pytest.approx(np.cumsum(x).tolist()) and got.b == pytest.approx(np.cumsum(x[::-1])[::-1].tolist())


def test_losses(spark):
    df = spark.createDataFrame([(0, [-0.5, -1.0], [-0.7, -0.6], [1.0, -2.0], [1, 1])], "row_id long, log_prob array<double>, old_log_prob array<double>, advantages array<double>, mask array<int>")
    got = L.policy_loss(df, "vanilla").first()
    a = max(-math.exp(0.2), -1.2)
    b = min(6.0, max(2 * math.exp(-0.4), 2 * 0.8))
    assert got.loss == pytest.approx((a + b) / 2)
    same = spark.createDataFrame([([[-0.5, -1.0]], [[-0.5, -1.0]], [1])], "student array<array<double>>, teacher array<array<double>>, mask array<int>")
    for support, alpha in (("full", 0.0), ("tail", 1.0), ("renorm", 0.4), ("corrected", 0.5)):
        assert L.self_distillation_loss(same, alpha, support).first().loss == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError, match="tau"):
        L.cross_world_loss(df, 0, 1.0)


def test_thresholds():
    assert C.parse_thresholds(["token_k1"], "2") == {"token_k1": (0.5, 2.0)}
    assert C.parse_thresholds(["seq_sum_k1", "token_k3"], "0.5_3, 4") == {"seq_sum_k1": (0.5, 3.0), "token_k3": (None, 4.0)}
    for options, spec in ((["token_k2"], "1_2"), (["token_k2"], "-1"), (["token_k2"], "x"), (["token_k1", "token_k2", "token_k3"], "1,2")):
        with pytest.raises(ValueError):
            C.parse_thresholds(options, spec)
    with pytest.raises(TypeError):
        C.parse_thresholds(["token_k2"], [1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=4, max_size=40), st.integers(1, 4))
def test_partitions_cover_each_row_once(lengths, k):
    for parts in (B.differencing(lengths, k), B.least_loaded(lengths, k)):
        assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    if len(lengths) % k == 0:
        for parts in (B.differencing(lengths, k, True), B.least_loaded(lengths, k, True)):
            assert {len(p) for p in parts} == {len(lengths) // k}
            assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    sums = [sum(lengths[i] for i in p) for p in B.differencing(lengths, k)]
    assert max(sums) - min(sums) <= max(lengths)


def test_micro_batches():
    assert B.micro_batch_count(100, 30, 40, 10) == 3
    assert B.micro_batch_count(100, 30, 40, 10, multiple=4) == 4
    with pytest.raises(ValueError, match="batches of"):
        B.micro_batch_count(100, 50, 40, 10)
    assert B.heavy_in_the_middle([[0], [1], [2]], [5, 1, 3]) == [[1], [0], [2]]


def test_records_round_trips(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("v"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(R.unpad(R.pad_to(df, 4))) == rows(df)
    assert R.pad_to(df, 4).count() == 12
    assert rows(R.unfold(R.fold(df, 5).select("row_id", "v"), 5, "v").select("row_id", F.col("v")[0].alias("v"))) == rows(df)
    back = df.select("row_id", (9 - F.col("row_id")).alias("new_pos"))
    assert rows(R.reorder(R.reorder(df, back), back)) == rows(df)
    with pytest.raises(ValueError, match="divide"):
        R.chunk(df, 3)
    with pytest.raises(Exception, match="differs"):
        R.union_columns(df, df.withColumn("v", F.col("v") + 1)).collect()
    nan = spark.createDataFrame([(0, float("nan")), (1, None)], "row_id long, v double")
    assert R.union_columns(nan, nan).count() == 2
    with pytest.raises(Exception, match="no usable hint"):
        R.with_hints(df, df.limit(3).select("row_id", F.lit(1).alias("order"), F.lit("R" * 120).alias("hint"))).collect()


def test_dual_world(spark):
    rows = spark.createDataFrame([(0, 7, "a"), (1, 8, "b")], "row_id long, item long, image string")
    edits = spark.createDataFrame([(7, "e7"), (8, "e8")], "item long, edit string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item long")
    flags = lambda d: [r.has_edit for r in d.orderBy("idx").collect()]
    assert flags(R.dual_world(rows, edits)) == [True, True]
    assert flags(R.dual_world(rows, edits.where("false"))) == [False, False]
    assert flags(R.dual_world(rows, edits, good=ids(8))) == [False, True]
    assert [(r.idx, r.item) for r in R.dual_world(rows, edits, only=ids(8)).collect()] == [(0, 8)]
    assert R.build_summary(R.dual_world(rows, edits, only=ids(8)), edits).first().asDict() == {"with_edit": 1, "fallback": 0, "unmatched": 1}


def test_scores(spark):
    judged = spark.createDataFrame([("Yes", "Easy"), ("No", "Easy"), ("Yes", "Medium"), ("Yes", "Hard")], "judge string, category string")
    assert M.macro(judged, T.is_correct("judge"), "category", ["Easy", "Medium", "Hard"]).first().score == pytest.approx(250 / 3)
    assert M.accuracy(judged.limit(2), T.is_correct("judge")).first().accuracy == 50
    with pytest.raises(Exception, match="no rows"):
        M.macro(judged, T.is_correct("judge"), "category", ["Other"], strict=True).collect()
    with pytest.raises(Exception, match="no rows"):
        M.accuracy(judged.where("false"), T.is_correct("judge")).collect()
    votes = spark.createDataFrame([(0, "A", 0.9), (1, "B", 0.8), (2, "A", 0.7)], "o long, vote string, v double").withColumn("g", F.lit(1))
    assert M.majority(votes, ["g"], "o", "vote", "v").first().value == 0.9
    tie = spark.createDataFrame([(0, "B", 1.0), (1, "A", 2.0), (2, "A", 3.0), (3, "B", 4.0)], "o long, vote string, v double").withColumn("g", F.lit(1))
    assert M.majority(tie, ["g"], "o", "vote", "v").first().vote == "B"
    steps = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("accuracy", 0.8), ("accuracy", 0.9), ("accuracy", 0.7)], "name string, value double")
    assert {r.name: r.value for r in M.reduce_metrics(steps).collect()} == {"loss": 2.0, "accuracy": pytest.approx(0.8)}
    with pytest.raises(Exception, match="two aggregations"):
        M.typed_metrics(steps.withColumn("agg", F.when(F.col("value") > 1, "sum").otherwise("mean"))).collect()


def test_bootstrap_is_near_the_expectation(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "g long, o long, v double")
    got = {r.metric: r["mean"] for r in M.bootstrap(df, ["g"], "o", "v").collect()}
    assert set(got) == {f"{n}@{k}" for n in ("best", "worst") for k in (2, 4, 8)}
    assert got["best@4"] == pytest.approx(M.expected_best(df, ["g"], "v", 4).first().expected_best, abs=0.15)


def test_sizes_double_up_to_any_group(spark):
    sizes = lambda n: spark.range(1).select(M.sizes_up_to(F.lit(n).cast("long")).alias("s")).first().s
    assert sizes(7443)[-5:] == [512, 1024, 2048, 4096, 7443]
    assert sizes(3_000_000)[-3:] == [2**20, 2**21, 3_000_000] and sizes(8) == [2, 4, 8] and sizes(1) == [1]


def test_extractors(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda c, s: value(c(F.lit(s)))
    assert lit(T.predicted_letter, "A cat, so B") == "A"
    assert lit(T.unwrap, "<think>x</think><answer>1</answer><answer> Answer: B </answer>") == "B"
    assert lit(T.judged_part, "Answer: B") == "Answer: B" and lit(T.first_option, "Answer: B") == "A"
    assert lit(T.yes_no, "**Answer: No**") == "no" and lit(T.two_choice, "it is b.") == "(b)"
    assert lit(T.number_answer, "x #### -1,200.5 y") == "-1200.5"
    assert lit(T.options_of, "Pick. A. one, B) two; C. three") == {"A": "one", "B": "two", "C": "three"}
    assert lit(T.outer_json, "x {a {b} c} d") == "{a {b} c}"


def test_registry():
    r = Registry("thing")
    f = r.register("x")(lambda: 1)
    assert r.register("x")(f) is f and r.get("x") is f
    with pytest.raises(ValueError, match="registered"):
        r.register("x")(lambda: 2)


def test_queue_rules():
    assert Q.required_samples(10, 0.5, 2) == 30
    assert Q.should_pause(5, 5, 0, 1) and Q.should_pause(0, 5, 1, 1) and not Q.should_pause(4, 5, 0, 1)
