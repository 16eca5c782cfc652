"""Queries over the checks of training rows, teachers' messages, and the whole cascade of graders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as S
from ..operators import conversations as C
from ..operators import validity as V
from .catalog import query
from .tables import table

#: Training rows of pages: one prompt of the whole page, in some without or with two image marks; images by number, in some none or two, or absolute.
ROWS = """WITH r AS (SELECT page_id AS row_id, coalesce(html, '') AS html, page_id % 7 = 0 AS two, page_id % 11 = 0 AS bare, page_id % 13 = 0 AS none, page_id % 17 = 0 AS abs, page_id % 5 = 0 AS lost, (length(coalesce(html, '')) % 900 + 2)::BIGINT AS w FROM pages),
 p AS (SELECT *, CASE WHEN two THEN '<image><image>' WHEN bare THEN '' ELSE '<image>' END || CASE WHEN row_id % 19 = 0 THEN ' Red Bounding Box ' ELSE '' END || html AS content FROM r),
 q AS (SELECT *, list_filter([CASE WHEN len(string_split(content, '<image>')) <> 2 THEN 'prompt must contain one <image>' END, CASE WHEN contains(lower(content), 'red bounding box') THEN 'obsolete red-box instruction' END,
   CASE WHEN none THEN 'images must contain exactly one image' WHEN lost THEN 'missing image file: ' || CASE WHEN abs THEN '/img/' ELSE '/data/img/' END || row_id || '.png' WHEN row_id % 3 = 0 THEN 'student=(' || w || ', ' || w || '), teacher=(' || (w * 2 + 5) || ', ' || (w * 2) || '), expected~=(' || (w + 2) || ', ' || w || ')' END], lambda x: x IS NOT NULL) AS problems FROM p)"""


def training_rows(spark, sf_dir):
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    mark = F.when(p % 7 == 0, "<image><image>").when(p % 11 == 0, "").otherwise("<image>")
    content = F.concat(mark, F.when(p % 19 == 0, " Red Bounding Box ").otherwise(""), html)
    own = F.concat(F.when(p % 17 == 0, "/img/").otherwise("img/"), p.cast("string"), F.lit(".png"))
    entry = lambda path: F.struct(path.alias("image"), F.lit(None).cast("string").alias("path"))
    teacher = F.struct(F.lit("").alias("image"), F.concat(F.lit("img/t"), p.cast("string"), F.lit(".png")).alias("path"))
    images = F.when(p % 13 == 0, F.array(entry(own), entry(own))).otherwise(F.array(entry(own)))
    rows = table(spark, sf_dir, "pages").select(p.alias("row_id"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"), images.alias("images"), F.array(teacher).alias("teacher_images"), (p % 2).cast("string").alias("task"), "html")
    w = F.length(html) % 900 + 2
    file = lambda path, x, y: F.struct(path.alias("path"), x.cast("int").alias("width"), y.cast("int").alias("height"))
    student = F.when(p % 5 != 0, file(F.concat(F.when(p % 17 == 0, "/img/").otherwise("/data/img/"), p.cast("string"), F.lit(".png")), w, w))
    other = file(F.concat(F.lit("/data/img/t"), p.cast("string"), F.lit(".png")), w * 2 + F.when(p % 3 == 0, 5).otherwise(1), w * 2)
    files = table(spark, sf_dir, "pages").select(F.explode(F.array_compact(F.array(student, other))).alias("f")).select("f.*")
    return rows, files


@query("training_row_problems", f"{ROWS} SELECT row_id, array_to_string(problems, '; ') AS problems FROM q")
def training_row_problems(spark, sf_dir):
    rows, files = training_rows(spark, sf_dir)
    return V.row_problems(rows, files, "/data").select("row_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "training_row_report",
    f"""{ROWS}, f AS (SELECT row_id, unnest(problems) AS problem FROM q), e AS (SELECT row_id || ' ' || problem AS line, row_id, problem FROM f ORDER BY row_id, problem LIMIT 8)
    SELECT (SELECT count(*) FROM q) AS rows_, (SELECT count(*) FROM q WHERE len(problems) > 0) AS bad_rows, (SELECT NOT bool_or(none OR abs) FROM q) AS portable_paths, (SELECT string_agg(line, '; ' ORDER BY row_id, problem) FROM e) AS first_problems,
      (SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT row_id % 2 AS t, count(*) AS n FROM q GROUP BY 1)) AS tasks""",
)
def training_row_report(spark, sf_dir):
    rows, files = training_rows(spark, sf_dir)
    out = V.row_report(V.row_problems(rows, files, "/data"), F.col("task"))
    shown = F.array_join(F.transform("first_problems", lambda p: F.concat(p["row"].cast("string"), F.lit(" "), p["problem"])), "; ")
    tasks = F.array_join(F.transform("tasks", lambda t: F.concat(t["task"], F.lit(":"), t["n"].cast("string"))), ",")
    return out.select(F.col("rows").alias("rows_"), "bad_rows", "portable_paths", F.nullif(shown, F.lit("")).alias("first_problems"), F.nullif(tasks, F.lit("")).alias("tasks"))


@query(
    "teacher_messages",
    """WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<image>', '') AS text FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t)
    SELECT conv_id, string_agg(role || '[image:t' || (2 * k) || ';text:' || CASE WHEN text = '' THEN '' ELSE text END || ';image:t' || (2 * k + 1) || CASE WHEN k = n - 1 THEN ';text: Hint: 7' ELSE '' END || ']', '' ORDER BY turn) AS shown FROM n GROUP BY conv_id""",
)
def teacher_messages(spark, sf_dir):
    """Conversations with an image before and behind every turn's whole text, shown with other images, and a hint at the end."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.lit("<image>"), F.coalesce(F.nullif(F.replace(F.coalesce("text", F.lit("")), F.lit("<image>"), F.lit("")), F.lit("")), F.lit("\x01")), F.lit("<image>")))
    rows = C.messages(turns).withColumn("images", F.transform(F.sequence(F.lit(0), 2 * F.size("messages") - 1), lambda i: F.concat(F.lit("t"), i.cast("string"))))
    rows = rows.withColumn("m", C.hinted_messages(C.templated_messages(F.col("messages"), F.col("images")), F.lit("7"), " Hint: {answer}"))
    one = lambda p: F.concat(p["type"], F.lit(":"), F.when(p["type"] == "image", p["image"]).otherwise(F.replace(p["text"], F.lit("\x01"), F.lit(""))))
    shown = F.transform("m", lambda m: F.concat(m["role"], F.lit("["), F.array_join(F.transform(m["content"], one), ";"), F.lit("]")))
    return rows.select("conv_id", F.array_join(shown, "").alias("shown"))


@query("grade_cascade")
def grade_cascade(spark, sf_dir):
    """Whole documents and short answers through all rules, by kind; held by tests a row."""
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "pope").when(k == 1, "mmvp").when(k == 2, "mcq").otherwise("open")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("<answer>"), F.when(k == 0, "Yes.").when(k == 1, "(a) it").when(k == 2, "B) this").otherwise("\\frac12"), F.lit("</answer>"))).otherwise(F.coalesce("text", F.lit("")))
    gold = F.when(k == 0, "yes").when(k == 1, "(a)").when(k == 2, "B").otherwise("0.5")
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), said.alias("answer"), gold.alias("gold"))
    return S.rule_cascade(rows, "kind", "answer", "gold").select("doc_id", "judge", "judge_source", "to_model", F.md5("extracted_answer").alias("part"))
