import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import balance as B
from millrace.operators import correction as C
from millrace.operators import managers as G
from millrace.operators import validation as V


def test_managers(spark):
    rows = spark.createDataFrame([(0, "#### 4", "4", [1, 1, 1, 1], None), (1, "#### 4", "5", [1, 1, 0, 0], 0.5), (2, "#### 4", "4", [0, 0, 0, 0], None)], "i long, response string, gold string, mask array<int>, given_score double")
    rows = rows.withColumn("data_source", F.lit("s"))
    got = {r.i: r for r in G.rewarded(rows, "dapo", routes={"s": "gsm8k"}, longest=4, buffer=2, factor=1.0).collect()}
    assert got[0].rewards == [0, 0, 0, 0.0] and got[0].overlong and got[0].overlong_reward == -1
    assert got[1].rewards == [0, 0.5, 0, 0] and not got[1].overlong and sum(got[2].rewards) == 0
    assert [r.score for r in G.rewarded(rows, "naive", reward_free=True).orderBy("i").collect()] == [0, 0.5, 0]
    with pytest.raises(ValueError, match="no reward manager"):
        G.rewarded(rows, "none")
    with pytest.raises(ValueError, match="buffer"):
        G.rewarded(rows, "dapo", routes={}, longest=4, buffer=0)

    def fails(pdf):
        if (pdf["i"] == 0).any():
            raise ValueError("no")
        return pdf["i"] * 1.0

    assert [r.score for r in G.rewarded(rows, "prime", function=fails).orderBy("i").collect()] == [0, 0.5, 2]
    with pytest.raises(Exception, match="no"):
        G.rewarded(rows, "batch", function=fails).collect()
    assert G.rewarded(rows.where("false"), "prime", function=fails).count() == 0


def test_resampled_takes_many_groups_at_once(spark):
    """Groups share their size's draws in one batch; a call of Python for each group took longer than its work."""
    df = spark.createDataFrame([("s", g, o, float(g + o), "v") for g in range(30) for o in range(1 + g % 3)], "src string, uid long, o long, x double, vote string")
    out = V.resampled(df, "src", "uid", "o", ["x"], "vote", times=20)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert {r.metric.split("/")[0] for r in out.collect()} == {f"{name}@{k}" for name in ("best", "worst", "maj") for k in (2, 3)}


def test_resampled_is_what_plain_python_gives(spark):
    votes, values = ["b", "a", "a", "b", "c"], [0.0, 1.0, 2.0, 3.0, 9.0]
    df = spark.createDataFrame([("s", 1, i, v, x) for i, (v, x) in enumerate(zip(votes, values))] + [("s", 2, 9, "z", 4.0)], "src string, uid long, o long, vote string, x double")
    got = {r.metric: r.value for r in V.resampled(df, "src", "uid", "o", ["x"], "vote", times=50).collect()}
    want = {}
    for k in (2, 4, 5):
        rng = np.random.RandomState(42)
        picks = [rng.choice(5, size=k, replace=True) for _ in range(50)]
        majority = []
        for p in picks:
            said = [votes[i] for i in p]
            best = sorted(set(said), key=lambda v: (-said.count(v), said.index(v)))[0]
            majority.append(values[p[said.index(best)]])
        for name, x in (("best", [max(values[i] for i in p) for p in picks]), ("worst", [min(values[i] for i in p) for p in picks]), ("maj", majority)):
            want |= {f"{name}@{k}/mean": np.mean(x), f"{name}@{k}/std": np.std(x)}
    assert got == pytest.approx(want)
    means = {r.metric: r.value for r in V.means(df, "src", "uid", ["x"]).collect()}
    assert means == pytest.approx({"mean@5": 3.0, "std@5": np.std(values), "mean@1": 4.0})


def test_derived_needs_its_parts(spark):
    some = spark.createDataFrame([("perf/throughput", 3.0), ("perf/total_num_tokens", 8.0), ("timing_s/gen", 1.0), ("timing_s/step", 4.0)], "name string, value double")
    assert {r.name: r.value for r in V.derived(some, 2).collect()} == {"perf/throughput": 3.0, "perf/total_num_tokens": 8.0, "timing_s/gen": 1.0, "timing_s/step": 4.0, "trainer/idle_ratio": 0.25}
    all_ = some.union(spark.createDataFrame([("perf/time_per_step", 2.0)], some.schema))
    assert {r.name: r.value for r in V.derived(all_, 2).collect()}["perf/throughput"] == 2.0
    assert V.derived(some.where("false"), 2).count() == 0


def test_groups_stay_whole_and_rows_come_back(spark):
    df = spark.createDataFrame([(0, i % 7, i, (i * 13) % 11) for i in range(40)], "b long, g long, r long, n long")
    parts = B.grouped_parts(df, "b", "g", "n", 3)
    assert parts.groupBy("g").agg(F.countDistinct("part").alias("p")).where("p > 1").count() == 0 and parts.count() == 40
    sums = [r.s for r in parts.groupBy("part").agg(F.sum("n").alias("s")).collect()]
    assert len(sums) == 3 and max(sums) - min(sums) <= df.groupBy("g").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0]
    placed = B.interleaved(parts, "b", "part", "r", "n")
    assert sorted(r.new_pos for r in placed.collect()) == list(range(40))
    lengths = [r.n for r in placed.where("part = 0").orderBy("new_pos").collect()]
    top = lengths.index(max(lengths))
    assert lengths[: top + 1] == sorted(lengths[: top + 1]) and lengths[top:] == sorted(lengths[top:], reverse=True)
    back = B.restored(placed.select("b", "new_pos", "n"), placed, "b", "r")
    assert {(r.r, r.n) for r in back.collect()} == {(r.r, r.n) for r in df.collect()}
    with pytest.raises(Exception, match="without a group"):
        B.grouped_parts(df.withColumn("g", F.when(F.col("r") > 0, F.col("g"))), "b", "g", "n", 3).collect()


def test_option_metrics_refuse_a_batch_without_tokens(spark):
    df = spark.createDataFrame([([-1.0], [-1.5], [0])], "log_prob array<double>, rollout_log_prob array<double>, mask array<int>")
    with pytest.raises(Exception, match="without tokens"):
        C.option_metrics(df, ["token_k2"], "1").collect()


def test_channel_calls(spark):
    call = "<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{not json<|call|>"
    said = f"<|channel|>analysis<|message|>x {call}\n<|end|>a{call}b"
    row = spark.createDataFrame([(said,), (None,), ("plain",)], "s string").select(T.channel_calls("s").alias("c"), T.without_channel_calls("s").alias("t")).collect()
    assert [tuple(c) for c in row[0].c] == [("f", "{not json")] and row[0].t == "ab"
    assert row[1].c == [] and row[1].t == "" and row[2].t == "plain"


def test_given_scores_are_nobody_elses(spark):
    rows = spark.createDataFrame([(0, None, [1] * 7), (1, 0.25, [1] * 7), (2, None, [1, 0, 0, 0, 0, 0, 0])], "i int, given_score double, mask array<int>").withColumn("data_source", F.lit("gsm8k")).withColumn("response", F.lit("#### 5")).withColumn("gold", F.lit("5"))
    got = {r.i: (r.score, r.overlong_reward, r.overlong, sum(r.rewards)) for r in G.rewarded(rows, "dapo", routes={"gsm8k": "gsm8k"}, longest=7, buffer=4).collect()}
    assert got == {0: (1.0, -1.0, True, 0.0), 1: (0.25, 0.0, False, 0.25), 2: (1.0, 0.0, False, 1.0)}

    def refuses(pdf):
        if pdf["given_score"].notna().any():
            raise ValueError("asked for a given row")
        return pdf["i"] * 2.0

    for name in ("batch", "prime"):
        assert [r.score for r in G.rewarded(rows, name, function=refuses).orderBy("i").collect()] == [0.0, 0.25, 4.0]


def test_remote_scorers_have_limits(spark):
    import time

    rows = spark.createDataFrame([(i, 0.5 if i == 9 else None, [1, 1]) for i in range(12)], "i int, given_score double, mask array<int>").coalesce(1)

    def slow(record):
        if record["i"] == 3:
            time.sleep(8)
        if record["i"] == 4:
            raise KeyError("no")
        assert record["i"] != 9
        return record["i"]

    async def later(record):
        import asyncio

        await asyncio.sleep(8 if record["i"] == 3 else 0.01)
        return slow({"i": record["i"] if record["i"] != 3 else 0})

    for call in (slow, later):
        began = time.time()
        got = {r.i: (r.score, r.status, sum(r.rewards)) for r in G.rewarded(rows, "limited", call=call, at_once=4, seconds=1.0, default=-1.0).collect()}
        assert got[3] == (-1.0, "timeout", -1.0) and got[4][:2] == (-1.0, "error") and got[9] == (0.5, "given", 0.5)
        assert all(got[i] == (float(i), "ok", float(i)) for i in (0, 1, 2, 5, 11))
        assert call is slow or time.time() - began < 7
    began = time.time()
    got = G.rewarded(rows, "limited", call=lambda r: 1.0, calls_a_minute=240.0).collect()  # four a second: the first four at once
    assert len(got) == 12 and time.time() - began >= 1.5
    assert [r.score for r in G.rewarded(rows, "prime", function=lambda pdf: pdf["i"].map(lambda i: time.sleep(5) or 1.0 if i == 1 else 1.0), seconds=1.0).orderBy("i").collect()][:3] == [1.0, 0.0, 1.0]
    assert G.rewarded(rows.where("false"), "limited", call=slow).count() == 0
