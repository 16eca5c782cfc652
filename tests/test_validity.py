import pytest
from pyspark.sql import functions as F

from millrace.operators import answers as S
from millrace.operators import conversations as C
from millrace.operators import gates as G
from millrace.operators import validity as V

ENTRY = "struct<image:string,path:string>"
SCHEMA = f"row_id long, prompt array<struct<role:string,content:string>>, images array<{ENTRY}>, teacher_images array<{ENTRY}>, task string"


def test_problems_of_rows(spark):
    user = lambda c: [("user", c)]
    one, two = [("a.png", None)], [(None, "/x/t.png")]
    rows = [
        (0, user("<image> q"), one, two, "mcq"), (1, user("q"), one, two, "mcq"), (2, [("user", "<image>"), ("user", "x")], one, two, "mcq"), (3, [("system", "<image>")], one, two, None), (4, user("<image> RED bounding BOX"), one, two, "open"), (5, None, one, two, "open"),
        (6, user("<image>"), [], two, "open"), (7, user("<image>"), one, [("", "")], "open"), (8, user("<image>"), [("gone.png", None)], two, "open"), (9, user("<image>"), one, [("t2.png", None)], "open"), (10, user("<image>"), None, None, "open"), (11, user("<image>"), [("b.png", None)], two, "open"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    files = spark.createDataFrame([("/d/a.png", 50, 1), ("/x/t.png", 101, 1), ("/d/t2.png", 104, 3), ("/d/b.png", None, None)], "path string, width int, height int")
    got = {r.row_id: r.problems for r in V.row_problems(df, files, "/d/").collect()}
    assert got == {
        0: [], 1: [V.ONE_IMAGE], 2: [V.ONE_MESSAGE], 3: [V.ONE_IMAGE], 4: [V.OBSOLETE], 5: [V.ONE_MESSAGE], 6: ["images must contain exactly one image"], 7: ["teacher_images has no image path"], 8: ["missing image file: /d/gone.png"],
        9: ["student=(50, 1), teacher=(104, 3), expected~=(52, 1)"], 10: ["images must contain exactly one image"], 11: [],
    }
    quick = {r.row_id: r.problems for r in V.row_problems(df, files, "/d", ratio=False, quick=8).collect()}
    assert quick[7] and quick[8] == quick[9] == quick[10] == [] and quick[1] == [V.ONE_IMAGE]
    r = V.row_report(V.row_problems(df, files, "/d"), F.col("task"), most=2).first()
    assert (r.rows, r.bad_rows, r.portable_paths) == (12, 10, False) and [(p.row, p.problem) for p in r.first_problems] == [(1, V.ONE_IMAGE), (2, V.ONE_MESSAGE)]
    assert [(t.task, t.n) for t in r.tasks] == [("", 1), ("mcq", 3), ("open", 8)]
    empty = V.row_report(V.row_problems(df.where("false"), files, "/d"), F.col("task")).first()
    assert (empty.rows, empty.first_problems, empty.tasks) == (0, [], [])


def test_teacher_messages(spark):
    messages = "messages array<struct<role:string,content:string>>, images array<string>"
    df = spark.createDataFrame([([("system", "a<image>"), ("user", "<image><image>b"), ("user", None)], ["x", "y", "z"])], messages)
    row = df.select(C.hinted_messages(C.templated_messages(F.col("messages"), F.col("images")), F.lit("4"), " H{answer}").alias("m")).first()
    shown = [(m.role, [(p.type, p.text, p.image) for p in m.content]) for m in row.m]
    assert shown == [("system", [("text", "a", None), ("image", None, "x")]), ("user", [("image", None, "y"), ("image", None, "z"), ("text", "b", None)]), ("user", [("text", " H4", None)])]
    for images in (["x"], ["x", "y", "z", "w"], None):
        with pytest.raises(Exception, match="teacher images"):
            spark.createDataFrame([([("user", "<image><image>")], images)], messages).select(C.templated_messages(F.col("messages"), F.col("images"))).collect()
    cases = [("p", "s", "f"), ("p", None, "f"), ("p", "{feedback}", None), ("p", None, None)]
    rows = spark.createDataFrame([(i, [("system", "S"), ("user", "old")], *c) for i, c in enumerate(cases)], "i int, messages array<struct<role:string,content:string>>, p string, s string, f string")
    for only, want in ((False, ["p|<s>|[f]", "p||[f]", "p|<{feedback}>|", "p"]), (True, ["p|<s>|", "p||[f]", "p|<{feedback}>|", "p"])):
        m = C.reprompted_messages(F.col("messages"), F.col("p"), F.col("s"), F.col("f"), "{prompt}|{solution}|{feedback}", "<{successful_previous_attempt}>", "[{feedback_raw}]", only)
        got = rows.select("i", m.alias("m")).orderBy("i").collect()
        assert [[(x.role, x.content) for x in r.m] for r in got] == [[("system", "S"), ("user", w)] for w in want]


def test_cascade(spark):
    cases = [
        ("pope", "<answer>Yes, it is</answer>", "yes", "pope_exact"), ("pope", "no", "yes", "llm"), ("pope", "B", "b", "mathruler"), ("mmvp", "it is (A)", "(a)", "mmvp_option"), ("mmvp", "(b)", "(a)", "llm"), ("mcq", "B) that", "B", "first letter"),
        ("open", "B) that", "B", "llm"), ("open", "\\frac{1}{2}", "0.5", "mathruler"), ("mcq", "Answer: 1,000", "1000", "llm"), ("open", None, "x", "llm"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, kind string, answer string, gold string")
    got = S.rule_cascade(df, "kind", "answer", "gold").orderBy("i").collect()
    assert [r.judge_source for r in got] == [c[3] for c in cases]
    assert all((r.judge == "Yes") == (r.judge_source != "llm") and r.to_model == (r.judge_source == "llm") for r in got)
    again = S.rule_cascade(df, "kind", "answer", "gold", judged_again=True).orderBy("i").collect()
    assert [r.to_model for r in again] == [c[3] in ("llm", "pope_exact", "mmvp_option") for c in cases]


def test_shown_generations(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as input", "id")
    one, two = ([(r.place, r.input) for r in G.shown_generations(d, 10, 1).orderBy("place").collect()] for d in (df.repartition(7), df.repartition(2)))
    assert one == two and [p for p, _ in one] == list(range(10))
    assert {i for _, i in one} != {r.input for r in G.shown_generations(df, 10, 2).collect()}
    drawn = [int(r.input) for s in range(30) for r in G.shown_generations(df, 10, s).collect()]
    assert 400 < sum(drawn) / len(drawn) < 600
    assert G.shown_generations(df.where("false"), 10).count() == 0 and G.shown_generations(df.limit(3), 10).count() == 3


def test_lists_and_runs(spark):
    from millrace.operators import grading, records

    df = spark.createDataFrame([(0, [{"a": 1, "b": 2}, {"a": 3, "b": 4}]), (1, [])], "row_id long, m array<map<string,int>>")
    assert [tuple(r) for r in records.list_to_columns(df, "m", ["a", "b"]).orderBy("row_id").collect()] == [(0, [1, 3], [2, 4]), (1, [], [])]
    for wrong in ({"a": 1}, {"a": 1, "b": 2, "c": 3}, {"a": 1, "c": 2}):
        with pytest.raises(Exception, match="keys"):
            records.list_to_columns(spark.createDataFrame([(0, [wrong])], df.schema), "m", ["a", "b"]).collect()
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, "y")], "i int, b string")
    assert sorted(map(tuple, grading.merged_validation(a, b).collect())) == [(1, "x", None), (2, None, "y")]


def test_draws_and_buckets(spark):
    import numpy as np


    df = spark.range(200).select(F.col("id").alias("row_id"))
    want = set(np.random.default_rng(1).choice(200, size=50, replace=False).tolist())
    assert {r.row_id for r in G.sampled(df, 50, seed=1).collect()} == want and G.sampled(df, 500, seed=1).count() == 200
    assert sorted(r.row_id for r in G.sampled(df, 3).collect()) == [0, 1, 2]


def test_token_bucket_waits(spark, tmp_path):
    from millrace.streaming.queues import run_to_table, token_bucket

    rows = [(1, 0, 20.0), (1, 1, 20.0), (1, 100, 5.0), (2, 0, 70.0), (2, 10, 1.0)]
    spark.createDataFrame(rows, "k long, at long, need double").coalesce(1).write.parquet(f"{tmp_path}/in")
    run_to_table(token_bucket(spark.readStream.schema("k long, at long, need double").parquet(f"{tmp_path}/in"), "k", "at", "need", 0.5, 30.0), str(tmp_path))
    want = []
    for key in (1, 2):
        level, last = 30.0, None
        for k, at, need in rows:
            if k == key:
                level = min(30.0, level + 0.5 * max(0.0, at - last)) if last is not None else level
                wait = max(0.0, (min(need, 30.0) - level) / 0.5)
                level, last = level + 0.5 * wait - need, at + wait
                want.append((k, at, need, wait))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want and {w[3] for w in want} != {0.0}
