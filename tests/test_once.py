"""A text's rules work out each step once: a step that an expression names again is done again for the whole text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import latex as X
from millrace.functions import sequences as S
from millrace.functions import text as T
from millrace.operators import advantage as V


def times(part, expression):
    return str(expression).count(part)


def test_plain_latex_and_grade_name_their_text_once(spark):
    assert times("said", X.plain_latex("said")) == 1
    assert times("said", X.grade("said", F.lit("1/2"))) == 1
    odd = ["x=1/2", "xy=.5", "xyz=1", "=a", "a=b=c", "\\frac12", "\\dfrac{1}2", ".5", "0.5", "1/2", "\\sqrt3 \\text{ cm}", "", None, "é=1", "=="]
    got = [r.f for r in spark.createDataFrame([(s,) for s in odd], "s string").coalesce(1).select(X.plain_latex("s").alias("f")).collect()]
    assert got == ["\\frac{1}{2}", ".5", "xyz=1", "a", "a=b=c", "\\frac{1}{2}", "\\frac{1}2", "\\frac{1}{2}", "\\frac{1}{2}", "\\frac{1}{2}", "\\sqrt{3}", "", "", "1", "=="]


def test_yes_or_no_names_its_text_once(spark):
    assert times("said", T.yes_no("said")) == 1 and times("said", T.two_choice("said")) == 1
    said = ["**Yes**", "Answer: no.", "ANSWER:: **yes", "it is yes.", "İ answer", "maybe no**.", "", None]
    got = [r.f for r in spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(T.yes_no("s").alias("f")).collect()]
    assert got == ["yes", "no", "yes", "yes", "İ answer", "no", "", ""]


def test_answer_grade_names_texts_and_entries_once(spark):
    grade = A.answer_grade("said", F.lit("0.5"))
    assert times("said", grade) == 1 and times("[0-9]+.?/0*", grade) == 2  # an entry and its gold entry
    rows = [("(1,000,2)", "(1000.0,2)"), ("(1/2,3)", "(1/2,3)"), ("2/4", "1/2"), ("1/2", "1/2"), (None, ""), ("", None), ("1,234,567", "1234567"), ("12 meters", "12")]
    got = [r.g for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(A.answer_grade("a", F.col("b")).alias("g")).collect()]
    assert got == ["right", "right", "wrong", "right", "wrong", "right", "right", "right"]


def test_structure_grade_reads_each_structure_once(spark):
    assert times("matrix", A.structure_grade("said", F.lit("0.5"))) <= 8  # two signs of a matrix, each looked for and read, in both answers


def test_markers_are_looked_for_before_a_text_is_turned_round(spark):
    assert times("contains", A.marked_answer("said")) >= 6  # before: three, of boxes alone
    said = "so the ANSWER is 5 Is The Answer. is x"
    got = spark.createDataFrame([(said,)], "s string").select(A.marked_answer("s").alias("m")).first().m
    assert (got.answer, got.steps) == ("5", ["answer is", "is the answer"])


def test_a_fold_works_its_values_out_once(spark):
    assert times("said", S.running_sum("said")) == 1 and times("exp(", S.running(F.transform("said", F.exp), lambda s, v: s + v, F.lit(0.0))) == 1
    sizes = [0, 1, 2, 63, 64, 65, 128, 129, 200]
    rows = [(n, [float(v % 7) for v in range(n)]) for n in sizes] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, x array<double>").select("n", S.running_sum("x").alias("up"), S.reverse_running("x", lambda s, v: s + v, F.lit(0.0)).alias("down"))
    for n, up, down in df.collect():
        x = dict(rows)[n]
        assert (up, down) == ((None, None) if x is None else ([sum(x[: i + 1]) for i in range(n)], [sum(x[i:]) for i in range(n)]))


def test_token_baselines_shuffle_their_rows_once(spark, tmp_path):
    rows = [(i, i // 3, [float(i + k) for k in range(i % 5)], [(i + k) % 2 for k in range(i % 5)]) for i in range(40)] + [(40, None, [3.0], [1])]
    spark.createDataFrame(rows, "id long, uid long, rewards array<double>, mask array<int>").write.parquet(str(tmp_path / "rows"))
    for name in ("optimal_token_baseline", "tir_optimal_token_baseline"):
        df = spark.read.parquet(str(tmp_path / "rows")).groupBy(F.col("id").alias("row_id")).agg(*[F.first(c).alias(c) for c in ("uid", "rewards", "mask")])
        df = df.withColumn("old_log_probs", F.transform("rewards", lambda _: F.lit(-1.5))).withColumn("sum_pi_squared", F.transform("rewards", lambda _: F.lit(0.25)))
        out = V.compute_advantage(df, name)
        got = {r.row_id: r for r in out.collect()}
        assert len(got) == 41 and got[40].advantages == [3.0] and all(len(r.advantages) == len(r.mask) for r in got.values())
        ran = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert ran.count("Scan parquet") == 1  # before: the rows were read and shuffled again to sum their tokens


def test_token_baselines_against_the_reference_formula(spark):
    lengths = {0: [3, 70, 66], 1: [5], 2: [4, 4], 3: [0, 6], 4: [0, 0, 2, 131]}
    rows, rnd = [], random.Random(5)
    for uid, sizes in lengths.items():
        for n in sizes:
            mask = [1] * n + [0] * 3
            rnd.shuffle(mask)
            rows.append((len(rows), uid, [rnd.random() for _ in mask], mask, [-rnd.random() for _ in mask], [rnd.random() for _ in mask]))
    df = spark.createDataFrame(rows, "row_id long, uid long, rewards array<double>, mask array<int>, old_log_probs array<double>, sum_pi_squared array<double>")
    for zero_tail in (False, True):
        want = {}
        for uid in lengths:
            live = {}
            for i, _, r, m, p, s in (r for r in rows if r[1] == uid):
                at = [k for k, x in enumerate(m) if x]
                live[i] = [(k, sum(r[j] for j in at if j >= k), sum(1 - 2 * math.exp(p[j]) + s[j] for j in at if j <= k)) for k in at]
                want[i] = [0.0] * len(m)
            full = sorted((len(t) for t in live.values() if t), reverse=True)
            for i, tokens in live.items():
                for place, (k, g, _) in enumerate(tokens):
                    here = [t[place] for t in live.values() if len(t) > place]
                    b = sum(g * w for _, g, w in here) / (sum(w for *_, w in here) + 1e-8)
                    alone = len(full) < 2 or (zero_tail and len(tokens) == full[0] > full[1] <= place)
                    want[i][k] = g - (0.0 if alone else b)
        out = V.compute_advantage(df, "tir_optimal_token_baseline", zero_tail=zero_tail)
        assert {r.row_id: r.advantages for r in out.collect()} == {i: pytest.approx(v, abs=1e-9) for i, v in want.items()}
