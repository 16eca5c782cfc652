import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming.assembly import assemble, assembler
from millrace.streaming.queues import run_to_table
from millrace.streaming.versions import CHANGES, version_counts

SCHEMA = "event_id long, processing_time double, tool_calls double, version_start long, version_end long"


def samples(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.random(), float(rnd.randint(0, 3)), i // 10, i // 10 + rnd.choice([0, 0, 1])) for i in range(n)]


def feed(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(path)


def table(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).drop("epoch").collect()))


@pytest.mark.parametrize("cuts", [[47], [3, 0, 17, 27], [20, 20, 7]])
def test_same_batches_however_the_stream_is_cut(spark, tmp_path, cuts):
    rows, at = samples(47), 0
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for n in cuts:
        feed(spark, f"{tmp_path}/in", rows[at : at + n])
        at += n
        assemble(stream(), str(tmp_path), 10, 2, "event_id")
    got = spark.read.parquet(f"{tmp_path}/statistics").orderBy("batch").collect()
    assert [(r.batch, r.n) for r in got] == [(k, 10) for k in range(4)]
    for r in got:
        own = rows[r.batch * 10 : r.batch * 10 + 10]
        assert r["processing_time/avg"] == pytest.approx(st.mean(x[1] for x in own)) and r["processing_time/tp50"] == pytest.approx(st.median(x[1] for x in own))
        assert r["partial/total_partial_num"] == sum(x[4] != x[3] for x in own)
    flushed = {(r.version, r.name): r.value for r in spark.read.parquet(f"{tmp_path}/flushed").collect()}
    assert {v for v, _ in flushed} == {0, 1}
    assert flushed[1, "processing_time/max"] == max(x[1] for x in rows[20:40]) and flushed[0, "partial/total_partial_num"] == sum(x[4] != x[3] for x in rows[:20])
    ids = [r.event_id for r in spark.read.parquet(f"{tmp_path}/batches").collect()]
    assert sorted(ids) == list(range(40))


def test_a_run_that_breaks_off_is_repeated(spark, tmp_path):
    rows = samples(60, 2)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    feed(spark, f"{tmp_path}/in", rows[:25])
    assemble(stream(), str(tmp_path), 10, 2, "event_id")
    feed(spark, f"{tmp_path}/in", rows[25:])

    def killed(epoch):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        assemble(stream(), str(tmp_path), 10, 2, "event_id", after=killed)
    assemble(stream(), str(tmp_path), 10, 2, "event_id")
    got = table(spark, f"{tmp_path}/batches")
    assert [r[:5] for r in got] == [(*r,) for r in rows] and {r[5] for r in got} == set(range(6))
    assert spark.read.parquet(f"{tmp_path}/flushed").select("version").distinct().count() == 3


def test_nothing_and_too_little(spark, tmp_path):
    step = assembler(str(tmp_path), 10, 2, "event_id")
    step(spark.createDataFrame([], SCHEMA), 0)
    step(spark.createDataFrame(samples(9), SCHEMA), 1)
    assert spark.read.parquet(f"{tmp_path}/batches/epoch=1").count() == 0 and spark.read.parquet(f"{tmp_path}/left/epoch=1").count() == 9


def plain(events):
    out, pools = [], {}
    for pool, at, kind, version in sorted(events, key=lambda e: e[1]):
        s = pools.setdefault(pool, {"a": 0, "q": 0, "c": 0, "stale": 0, "since": None, "idle": None})
        if kind == "version":
            kept = s["a"] + s["q"] + s["c"]
            ratio = None if s["idle"] is None or s["since"] is None else 1 - (s["idle"] - s["since"]) / (at - s["since"])
            out.append((pool, at, version, s["stale"], kept, ratio))
            s.update(stale=kept, since=at, idle=None)
        elif kind == "idle":
            s["idle"] = at if s["idle"] is None else s["idle"]
        elif kind in CHANGES:
            for f, d in zip(("a", "q", "c", "stale"), CHANGES[kind]):
                s[f] += d
    return out


@pytest.mark.parametrize("cuts", [[300], [10, 150, 1, 139]])
def test_versions_meet_samples(spark, tmp_path, cuts):
    rnd = random.Random(4)
    events = [(rnd.randint(0, 4), i, rnd.choice([*CHANGES, "idle", "other", "version"]), i) for i in range(300)]
    at = 0
    for n in cuts:
        part = events[at : at + n]
        feed(spark, f"{tmp_path}/samples", [e[:3] for e in part if e[2] != "version"], "pool long, at long, kind string")
        feed(spark, f"{tmp_path}/versions", [(e[0], e[1], e[3]) for e in part if e[2] == "version"], "pool long, at long, version long")
        at += n
        one = spark.readStream.schema("pool long, at long, kind string").parquet(f"{tmp_path}/samples")
        two = spark.readStream.schema("pool long, at long, version long").parquet(f"{tmp_path}/versions")
        run_to_table(version_counts(one, two), str(tmp_path))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted(plain(events), key=str)


def test_pools_share_states(spark, tmp_path):
    """Groups of the state are parts of pools, not pools: a call of Python for each pool and run took longer than its events."""
    one = spark.readStream.schema("pool long, at long, kind string").parquet(f"{tmp_path}")
    two = spark.readStream.schema("pool long, at long, version long").parquet(f"{tmp_path}")
    out = version_counts(one, two)
    assert "[part#" in next(line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "WithState" in line)


def test_replacement_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.range(5)
    files.replace_table(one, path)
    files.replace_table(spark.read.parquet(path).where("id > 1"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]

    def killed():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        files.replace_table(spark.range(9), path, between=killed)
    assert not files.exists(spark, path)
    files.recover(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4] and not files.exists(spark, f"{path}.new")


def test_resume(spark, tmp_path):
    path = f"{tmp_path}/answers"
    todo = spark.createDataFrame([(f"u{i}", i) for i in range(10)], "uid string, n int")
    assert files.left_to_do(todo, path, "uid").count() == 10
    bad = lambda: F.col("model_answer").startswith("[API_ERROR]")
    answer = lambda df, at, ok: df.select("uid", F.when(F.expr(ok), "fine").otherwise("[API_ERROR] x").alias("model_answer"), F.lit(at).alias("at"))
    answer(todo.where("n < 6"), 1, "n < 4").write.mode("append").json(path)
    rest = files.left_to_do(todo, path, "uid", ~bad())
    assert sorted(r.n for r in rest.collect()) == [4, 5, 6, 7, 8, 9]
    answer(rest, 2, "n <> 9").write.mode("append").json(path)
    answer(todo.where("n = 0"), 3, "false").write.mode("append").json(path)
    files.compact_answers(spark, path, "uid", "uid string, model_answer string, at long", bad())
    got = {r.uid: (r.model_answer, r.at) for r in spark.read.json(path).collect()}
    assert len(got) == 10 and got["u0"] == ("fine", 1) and got["u5"] == ("fine", 2) and got["u9"][1] == 2
