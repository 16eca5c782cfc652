"""Queries over model grading and helpers around scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C
from ..operators import grading as G
from .catalog import query
from .tables import rounded, table
from .texts import YN, stripped


@query("grade_prompts", "SELECT page_id, 'Q: ' || url || ' A: ' || (page_id % 7) || ' R: ' || html AS prompt FROM pages")
def grade_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<image>"), "url").alias("query"), (F.col("page_id") % 7).cast("string").alias("response"), F.col("html").alias("extracted_answer"))
    return G.judge_prompts(rows, "Q: {question} A: {gt} R: {response}").select("page_id", "prompt")


#: A verdict in a page's whole text, in SQL.
VERDICT = f"CASE WHEN regexp_matches(t, '{YN}') THEN CASE lower(regexp_extract(t, '{YN}', 1)) WHEN 'yes' THEN 'Yes' ELSE 'No' END ELSE {stripped('t')} END"


def page_reply():
    """A reply that thinks, then says yes or no a page's length tells which, before the whole page."""
    return F.concat(F.lit("<think>no?</think> "), F.when(F.length("html") % 3 == 0, "YES, ").when(F.length("html") % 3 == 1, "no: ").otherwise(""), "html")


REPLY = "(SELECT page_id, ' ' || CASE length(html) % 3 WHEN 0 THEN 'YES, ' WHEN 1 THEN 'no: ' ELSE '' END || html AS t FROM pages)"


@query("grade_replies", f"SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'ERROR' ELSE md5({VERDICT}) END AS judge, CASE WHEN page_id % 50 = 0 THEN 'llm_error' ELSE 'llm' END AS judge_source FROM {REPLY}")
def grade_replies(spark, sf_dir):
    """Whole pages as replies; some calls failed.  What is neither yes nor no stays as it is."""
    rows = table(spark, sf_dir, "pages").select("page_id", page_reply().alias("reply"), F.when(F.col("page_id") % 50 == 0, "timeout").alias("error"))
    judge = F.when(F.col("judge") == "ERROR", F.col("judge")).otherwise(F.md5("judge"))
    return G.gated(G.graded_by_model(rows)).select("page_id", judge.alias("judge"), "judge_source")


@query("grade_retries", f"SELECT page_id, md5({VERDICT}) AS judge FROM {REPLY}")
def grade_retries(spark, sf_dir):
    """Calls that failed are made again, with the same page as their reply."""
    rows = table(spark, sf_dir, "pages").select("page_id", page_reply().alias("reply"), F.when(F.col("page_id") % 10 == 0, "timeout").alias("error"))
    first = G.graded_by_model(rows)
    return G.regraded(first, lambda df: G.graded_by_model(df.withColumn("error", F.lit(None).cast("string")))).select("page_id", F.md5("judge").alias("judge"))


@query("grade_question_text", "SELECT conv_id, coalesce(arg_min(trim(text, ' ' || chr(10)), turn) FILTER (trim(coalesce(text, ''), ' ' || chr(10)) <> ''), '') AS question FROM conversations GROUP BY conv_id")
def grade_question_text(spark, sf_dir):
    return C.messages(table(spark, sf_dir, "conversations")).select("conv_id", G.question_text(F.col("messages")).alias("question"))


@query("grade_clean_hints", "SELECT doc_id, CASE WHEN length(h) < 100 THEN '[ERR:too-short:' || length(h) || ']' ELSE h END AS hint FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS h FROM documents)")
def grade_clean_hints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.clean_hint(F.concat(F.lit("<think>x</think>assistant\n"), "text")).alias("hint"))


@query(
    "grade_boxed_format",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\{}]', '', 'g') AS bare FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE CASE WHEN replace(replace(bare, chr(10), ''), ' ', '') = '0.5' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END END AS score FROM t""",
)
def grade_boxed_format(spark, sf_dir):
    """Whole texts as thoughts before a box, and in it."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\{}]", "")
    k = F.col("doc_id") % 4
    thought = F.concat(F.lit("<think>"), bare, F.lit("</think>"))
    said = F.when(k == 0, F.concat(thought, F.lit(" \\boxed{\\frac12}"))).when(k == 1, F.concat(bare, F.lit("\\boxed{0.5}"))).when(k == 2, F.concat(thought, F.lit("\\boxed{3}"))).otherwise(F.concat(F.lit("<think>a</think> \\boxed{"), bare, F.lit("}")))
    return table(spark, sf_dir, "documents").select("doc_id", rounded(G.boxed_with_format(said, F.lit("1/2"))).alias("score"))


@query(
    "grade_failing_tests",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 2 = 0 AS ok FROM documents), c AS (SELECT *, CASE WHEN length(text) > 250 THEN left(text, 250) || '...' ELSE text END AS cut FROM t),
    two AS (SELECT *, 'Input' || chr(10) || cut || chr(10) || 'Output' || chr(10) || 'x' || chr(10) || 'Expected' || chr(10) || cut AS wrong, 'Error: ' || cut || chr(10) || 'Last input' || chr(10) || 'in' AS broke FROM c)
    SELECT doc_id, CASE WHEN ok THEN '' WHEN length(text) < 2 THEN wrong || chr(10) || chr(10) || broke ELSE broke || chr(10) || chr(10) || wrong END AS report FROM two""",
)
def grade_failing_tests(spark, sf_dir):
    """Whole texts as a test's input, expected output and error; the shorter input comes first."""
    text = F.coalesce("text", F.lit(""))
    one = lambda i, e, a, err, ok: F.struct(i.alias("input"), e.alias("expected"), F.lit(a).alias("actual"), err.cast("string").alias("error"), ok.alias("passed"))
    ok = F.col("doc_id") % 2 == 0
    tests = F.array(one(text, text, "x", F.lit(None), ok), one(F.lit("in"), F.lit("y"), "", text, ok), one(F.lit("333"), F.lit("y"), "y", F.lit(None), F.lit(True)))
    return table(spark, sf_dir, "documents").select("doc_id", G.failing_tests(tests).alias("report"))


@query(
    "grade_interactions",
    """WITH a AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    n AS (SELECT *, regexp_extract_all(right('#### ' || text, 300), '(\\-?[0-9\\.\\,]+)', 1) AS n FROM a),
    p AS (SELECT *, CASE WHEN len(n) > 0 THEN coalesce(list_last(list_filter(n, lambda x: x NOT IN ('', '.'))), n[1]) END AS number FROM n)
    SELECT conv_id, CASE WHEN coalesce(number = (conv_id % 10)::VARCHAR, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, coalesce(number = (conv_id % 10)::VARCHAR, FALSE) AS stop FROM p""".replace("\\\\", "\\"),
)
def grade_interactions(spark, sf_dir):
    """All conversations: does the last number of their last answer equal the conversation's last digit."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return G.interaction(turns, turns.where("role = 'assistant'").select("conv_id", (F.col("conv_id") % 10).cast("string").alias("gold")).distinct())
