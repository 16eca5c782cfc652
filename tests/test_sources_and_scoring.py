import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import grading, scoring
from millrace.sources import files as S


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_rows_and_records(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", [{"x": 1}, {"x": 2, "y": "z"}])
    assert sorted(r.x for r in S.load_rows(spark, p).collect()) == [1, 2]
    with pytest.raises(ValueError, match="no rows"):
        S.load_rows(spark, lines(tmp_path / "none.jsonl", []), "x long")
    array = tmp_path / "b.json"
    array.write_text('[\n {"x": 1},\n {"x": 5}]')
    assert sorted(r.x for r in S.load_records(spark, str(array)).collect()) == [1, 5]
    assert sorted(r.x for r in S.load_records(spark, p).collect()) == [1, 2]
    with pytest.raises(ValueError, match="neither"):
        S.load_files(spark, ["x.csv"])
    assert S.load_files(spark, [p, p]).count() == 4


def test_id_list(spark, tmp_path):
    p = lines(tmp_path / "ids.jsonl", [{"idx": 7}, {"psr": 8}, {"idx": 7}])
    assert sorted(r.id for r in S.id_list(spark, p, "psr").collect()) == ["7", "8"]
    with pytest.raises(ValueError, match="neither"):
        S.id_list(spark, lines(tmp_path / "bad.jsonl", [{"a": 1}]), "psr")


def test_edit_index_and_checksums(spark, tmp_path):
    (tmp_path / "e").mkdir()
    for n in ("idx7_edited.png", "idx12_edited.png", "other.txt"):
        (tmp_path / "e" / n).write_bytes(b"abc")
    got = {r.id for r in S.edit_index(spark, str(tmp_path / "e"), r"idx(\d+?)_edited").collect()}
    assert got == {"7", "12"}
    assert {r.sha256 for r in S.checksums(spark, str(tmp_path / "e")).collect()} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}


def test_merge_hints(spark, tmp_path):
    good = "R" * 120
    lines(tmp_path / "h_s0.jsonl", [{"idx": 0, "reasoning": good + "old"}, "{broken", {"idx": 1, "reasoning": "[ERR:x]" + good}])
    lines(tmp_path / "h_s1.jsonl", [{"idx": 0, "reasoning": good + "new"}, {"idx": 2, "reasoning": "short"}])
    hints, counts = S.merge_hints(spark, str(tmp_path / "h_s*.jsonl"), 3)
    assert [(r.idx, r.reasoning[-3:]) for r in hints.collect()] == [(0, "new")]
    assert counts.first().asDict() == {"bad": 1, "refused": 2, "missing": 2}


def test_cache_log_and_summary(spark, tmp_path):
    calls = []
    key = S.cache_key("a", 1)
    for _ in range(2):
        assert S.cached(spark, str(tmp_path), key, lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1] and len(key) == 16 and key != S.cache_key("a", 2)
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 0.5)], "step long, name string, value double")
    assert S.metrics_line(rows).first().line == "step:1 - a:0.500 - b:2.000"
    S.log_metrics(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().data.asDict() == {"a": 0.5, "b": 2.0}
    assert S.summary(rows.agg(F.count("*").alias("n"), F.max("step").alias("m"))) == '{"m": 1, "n": 2}'


def test_responses_sizes_and_nested(spark, tmp_path):
    prompts = spark.createDataFrame([(0, "p"), (1, "q")], "row_id long, prompt string")
    answers = spark.createDataFrame([(0, 1, "b"), (0, 0, "a")], "row_id long, sample int, text string")
    S.write_responses(prompts, answers, str(tmp_path / "r.parquet"))
    assert {r.row_id: r.responses for r in spark.read.parquet(str(tmp_path / "r.parquet")).collect()} == {0: ["a", "b"], 1: None}
    got = spark.range(1).select(S.fit_size(F.lit(400), F.lit(100), 10_000).alias("s")).first().s
    assert (got.width, got.height) == (200, 50)
    df = spark.createDataFrame([((1,),)], "a struct<b:int>")
    assert df.select(S.nested(df, "a.b").alias("x"), S.nested(df, "a.c").alias("y")).first() == (1, None)


def test_service_retries(spark):
    def client(x):
        if x == "bad":
            raise OSError("no")
        return x.upper()

    got = {r.q: (r.reply, r.error) for r in S.call_service(spark.createDataFrame([("a",), ("bad",)], "q string"), "q", client).collect()}
    assert got == {"a": ("A", None), "bad": (None, "OSError: no")}


def test_scorers(spark):
    rows = [("g", "#### 1,234", "1234", None), ("m", "<answer>\nB\n</answer>", "B", None), ("m", "B", "B", None), ("p", "the answer is (C)", "C", None), ("g", "none", "1", 0.25), ("l", "Answer: 12", "x=12", None)]
    df = spark.createDataFrame(rows, "data_source string, response string, gold string, given_score double")
    got = [(r.result.score, r.result.incorrect_format) for r in scoring.score(df, {"g": "gsm8k", "m": "mcq", "p": "mmlu_pro", "l": "math_line"}).collect()]
    assert got == [(1.0, None), (1.0, False), (1.0, True), (1.0, False), (0.25, None), (1.0, None)]
    with pytest.raises(Exception, match="no scorer"):
        scoring.score(df, {"g": "gsm8k"}).collect()
    own = scoring.score_with(df, lambda pdf: pdf["gold"].astype(float), "s")
    assert [r.s for r in own.collect()] == [1234.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_token_rewards(spark):
    df = spark.createDataFrame([(1.0, [1, 1, 1, 0])], "score double, mask array<int>")
    assert scoring.token_rewards(df).first().rewards == [0.0, 0.0, 1.0, 0.0]
    assert scoring.token_rewards(df, longest=4, buffer=2, factor=1.0).first().rewards == [0.0, 0.0, 0.5, 0.0]


def test_grading(spark, tmp_path):
    from millrace.operators import grading as G

    rows = spark.createDataFrame([("llm",)] * 9 + [("llm_error",)], "judge_source string")
    assert G.gated(rows, 0.2).count() == 10
    with pytest.raises(Exception, match="10.0% of the calls failed"):
        G.gated(rows).collect()
    (tmp_path / "own.py").write_text("def score(answer, gold, bonus=0.0):\n    return float(answer == gold) + bonus\n")
    own = G.function_from_file(str(tmp_path / "own.py"), "score", bonus=0.5)
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "answer string, gold string")
    from millrace.operators.gates import python_score

    assert [r.score for r in python_score(df, own, "answer", "gold").collect()] == [1.5, 0.5]
    with pytest.raises(AttributeError, match="has no"):
        G.function_from_file(str(tmp_path / "own.py"), "other")


def test_failing_tests_are_ordered_by_input_and_output(spark):
    """An input of two characters with an output of one is longer than another of two without any; of equal ones the first comes first."""
    one = "struct<input:string,expected:string,actual:string,error:string,passed:boolean>"
    rows = [[("A.", "y", "x", None, False), ("in", "y", "", "bad", False)], [("A", "y", "x", None, False), ("in", "y", "", "bad", False)], [(None, "y", None, None, False), ("", "y", "", "bad", False)]]
    got = spark.createDataFrame([(r,) for r in rows], f"t array<{one}>").coalesce(1).select(grading.failing_tests(F.col("t")).alias("r")).collect()
    wrong, broke = "Input\n{}\nOutput\n{}\nExpected\ny", "Error: bad\nLast input\n{}"
    assert [r.r for r in got] == [f"{broke.format('in')}\n\n{wrong.format('A.', 'x')}", f"{wrong.format('A', 'x')}\n\n{broke.format('in')}", f"{wrong.format('', '')}\n\n{broke.format('')}"]
