"""Scores of mathematical answers over a table: by markers, and by the box at a text's end with feedback.

Each step is a column of its own, so that later ones refer to it by name instead of holding its expression again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..functions.text import text

# What is said about an answer.
FORMAT_FEEDBACK = "Your answer had the wrong format. The solution must be given in the format: \\boxed{your_answer}."
TRUNCATED_FEEDBACK = "Your response was truncated because it exceeded the maximum length."
WRONG_FEEDBACK = "Your answer is incorrect. The correct answer is "


def marked_scores(df: DataFrame, answer: str, gold: str) -> DataFrame:
    r"""df with pred, pred_steps, grade and good_format: the answer behind its markers, by the rules for answers, else by structure.

    Where pi is named, both of its values count.  The format is good where the grade is right, or with "Step 2:" and a box."""
    inner = ["_found", "_rules", "_exact", "_rough"]
    with_pi = F.contains("pred", F.lit("\\pi")) | F.contains(text(gold), F.lit("\\pi"))
    grades = F.array_compact(F.array("_rules", "_exact", "_rough"))
    best = F.when(F.array_contains(grades, A.RIGHT), A.RIGHT).when(F.array_contains(grades, A.OPEN), A.OPEN).otherwise(A.WRONG)
    out = df.withColumn("_found", A.marked_answer(answer)).withColumns({"pred": F.col("_found.answer"), "pred_steps": F.col("_found.steps")})
    out = out.withColumn("_rules", A.answer_grade("pred", text(gold))).withColumn("_exact", A.structure_grade("pred", gold))
    out = out.withColumn("_rough", F.when(with_pi, A.structure_grade("pred", gold, pi="3.14"))).withColumn("grade", best)
    fits = F.contains(text(answer), F.lit("Step 2:")) & F.contains(text(answer), F.lit("\\box"))
    return out.withColumn("good_format", (F.col("grade") == A.RIGHT) | fits).drop(*inner)


def feedback_scores(df: DataFrame, answer: str, gold: str, split: Column | None = None, truncated: Column | None = None, tail: int = 100, penalty: float = 0.0, format_feedback: bool = True, correctness_feedback: bool = False) -> DataFrame:
    """df with score, acc, pred, incorrect_format, truncated, truncated_and_missing_answer and feedback, of the box in a text's end.

    A box that holds the gold answer as it is, or one that the grades call right, scores 1; `penalty` is taken off in
    training for an answer without a closed box that wasn't cut off.  Unresolved answers score 0."""
    false = F.lit(False)
    cut_off = F.coalesce(truncated, false) if truncated is not None else false
    training = F.coalesce(split == "train", false) if split is not None else false
    out = df.withColumn("pred", F.coalesce(A.boxed_strictly(F.right(text(answer), F.lit(tail))), F.lit(""))).withColumn("_cut", cut_off).withColumn("_training", training)
    out = out.withColumn("_rules", A.answer_grade("pred", text(gold))).withColumn("_structure", A.structure_grade("pred", gold))
    missing, flag = F.col("pred") == "", lambda c: F.when(c, 1).otherwise(0)
    right = (F.col("pred") == text(gold)) | (~missing & ((F.col("_rules") == A.RIGHT) | (F.col("_structure") == A.RIGHT)))
    out = out.withColumn("acc", F.when(right, 1.0).otherwise(0.0))
    said = F.when(missing & ~F.col("_cut") & F.lit(format_feedback), F.lit(FORMAT_FEEDBACK)).when(F.col("_cut") & F.lit(format_feedback), F.lit(TRUNCATED_FEEDBACK))
    said = said.when((F.col("acc") == 0) & F.lit(correctness_feedback), F.concat(F.lit(WRONG_FEEDBACK), text(gold), F.lit("."))).otherwise("")
    return out.withColumns({
        "score": F.col("acc") - F.when(F.col("_training") & missing & ~F.col("_cut"), penalty).otherwise(0.0),
        "incorrect_format": flag(missing), "truncated": flag(F.col("_cut")), "truncated_and_missing_answer": flag(missing & F.col("_cut")), "feedback": said,
    }).drop("_cut", "_training", "_rules", "_structure")


def rule_cascade(df: DataFrame, kind: str, answer: str, gold: str, judged_again: bool = False) -> DataFrame:
    """df with extracted_answer, judge ("Yes" or null), judge_source and to_model: the rules in turn, and what is left to a model.

    A yes-no answer ("pope"), then a choice of two ("mmvp"), then the rules for answers, then the first letter ("mcq"), each for rows of its kind but the
    rules for answers, which are for all; a rule that doesn't say yes leaves the row to the next.  judged_again: rows that the first two rules
    decide go to the model as well, whose verdict then stands."""
    k, own = F.lower(text(kind)), F.col("extracted_answer")
    out = df.withColumn("extracted_answer", T.judged_part(answer)).withColumn("_math", A.answer_grade("extracted_answer", text(gold)))
    yes = (k == "pope") & (T.yes_no(own) == F.lower(T.strip(text(gold))))
    two = (k == "mmvp") & (T.two_choice(own) != "") & (T.two_choice(own) == F.lower(T.strip(text(gold))))
    source = F.when(yes, "pope_exact").when(two, "mmvp_option").when(F.col("_math") == A.RIGHT, "mathruler").when((k == "mcq") & T.letter_match(F.col(gold), own), "first letter").otherwise("llm")
    out = out.withColumn("judge_source", source).withColumn("judge", F.when(F.col("judge_source") != "llm", "Yes"))
    again = F.lit(judged_again) & F.col("judge_source").isin("pope_exact", "mmvp_option")
    return out.withColumn("to_model", (F.col("judge_source") == "llm") | again).drop("_math")
