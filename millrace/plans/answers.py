"""Queries over mathematical answers: whole documents and turns inside boxes, behind markers and in brackets, beside LaTeX literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import answers as S
from .catalog import query
from .tables import table

#: LaTeX answers by document number, the same text in both dialects.
MADE = [
    "\\frac{1}{2}", "0.5", "1/2", "3\\frac{1}{2}", "\\text{5 cm}", "1,234", "(1, 2.50)", "[0,1)", "\\sqrt{8}", "\\$5", "50\\%", "30^\\circ", "x+1", "\\boxed{7}", "2\\pi", "7 3/4", "{6}", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}",
]
CASES = "CASE doc_id % 18 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(MADE)) + " END"
SOURCES = [("documents", "'made'", "doc_id", "({made})"), ("documents", "'text'", "doc_id", "coalesce(text, '')"), ("conversations", "'turn'", "conv_id * 10000 + turn", "coalesce(text, '')")]
SQL_ROWS = "r AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, {origin} AS origin, {x.format(made=CASES)} AS said FROM {name}" for name, origin, i, x in SOURCES) + ")"
WS = "[\\t-\\r \\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def answer_rows(spark, sf_dir):
    """(doc_id, origin, said): literals, whole documents, whole turns."""
    parts = []
    for name, origin, i, x in SOURCES:
        made = x.format(made=CASES.replace("\\", "\\\\"))
        parts.append(table(spark, sf_dir, name).selectExpr(f"cast({i} as bigint) as doc_id", f"{origin} as origin", f"{made} as said"))
    return parts[0].union(parts[1]).union(parts[2])


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[\\t-\\r \\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\t-\\r \\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')"


def scanned(tail: str) -> str:
    """SQL of what stands between the first brace and the one at which the depth is back at none."""
    marks, sizes = f"regexp_extract_all({tail}, '[{{}}]')", f"regexp_split_to_array({tail}, '[{{}}]')"
    at = f"list_sum(list_transform({sizes}[1:i], lambda p: length(p))) + i"
    depth = f"list_sum(list_transform({marks}[1:i], lambda m: CASE m WHEN '{{' THEN 1 ELSE -1 END))"
    end = f"list_transform(list_filter(range(1, len({marks}) + 1), lambda i: {marks}[i] = '}}' AND {depth} = 0)[1:1], lambda i: {at})[1]"
    return f"CASE WHEN strpos({tail}, '{{') > 0 AND {end} > strpos({tail}, '{{') THEN substr({tail}, strpos({tail}, '{{') + 1, ({end} - strpos({tail}, '{{') - 1)::BIGINT) END"


BOXED = "b AS (SELECT *, 'so \\boxed{' || said || '} and ' || CASE WHEN doc_id % 3 = 0 THEN '\\fbox{z}' WHEN doc_id % 3 = 1 THEN '\\boxed  {y} $ 1' ELSE '' END AS box FROM r)"


def boxed_text():
    return F.concat(F.lit("so \\boxed{"), "said", F.lit("} and "), F.when(F.col("doc_id") % 3 == 0, "\\fbox{z}").when(F.col("doc_id") % 3 == 1, "\\boxed  {y} $ 1").otherwise(""))


@query(
    "answer_boxes",
    f"""WITH {SQL_ROWS}, {BOXED}, t AS (SELECT *, '{{' || list_last(string_split(box, '\\boxed{{')) AS strict, list_last(string_split(box, '\\boxed')) AS tail FROM b)
    SELECT doc_id, origin, {scanned('strict')} AS strict, {stripped(scanned('tail'))} AS anywhere,
      CASE WHEN contains(box, '\\boxed ') THEN string_split(list_last(string_split(box, '\\boxed ')), '$')[1] WHEN starts_with(tail, '{{') THEN {scanned('tail')} END AS spaced FROM t""",
)
def answer_boxes(spark, sf_dir):
    box = boxed_text()
    return answer_rows(spark, sf_dir).select("doc_id", "origin", A.boxed_strictly(box).alias("strict"), A.boxed_anywhere(box).alias("anywhere"), A.boxed_or_spaced(box).alias("spaced"))


@query("answer_second_form")
def answer_second_form(spark, sf_dir):
    """Held by tests a rule."""
    return answer_rows(spark, sf_dir).select("doc_id", "origin", A.second_form("said").alias("form"))


@query("answer_line_form")
def answer_line_form(spark, sf_dir):
    """Held by tests a rule."""
    return answer_rows(spark, sf_dir).select("doc_id", "origin", A.line_form("said").alias("form"))


@query("answer_rule_grades")
def answer_rule_grades(spark, sf_dir):
    """Each answer against its neighbour in value: in words, in a tuple with a number, and as it is; held by tests a rule."""
    said, other = F.col("said"), F.when(F.col("doc_id") % 2 == 0, "0.5").otherwise(F.col("said"))
    in_tuple = lambda c, x: F.concat(F.lit("("), F.lit(x), F.lit(","), c, F.lit(")"))
    return answer_rows(spark, sf_dir).select("doc_id", "origin", A.answer_grade(said, other).alias("grade"), A.answer_grade(in_tuple(said, "1,000"), in_tuple(said, "1000.0")).alias("in_tuple"))


@query(
    "answer_structures",
    f"""WITH {SQL_ROWS}, n AS (SELECT doc_id, origin, regexp_replace(said, '[^A-Za-z0-9 ]', '', 'g') AS word FROM r)
    SELECT doc_id, origin, CASE doc_id % 4 WHEN 0 THEN 'right' WHEN 1 THEN 'wrong' WHEN 2 THEN 'wrong' ELSE CASE WHEN regexp_matches(word, '^ *[0-9]+ *$') THEN 'wrong' ELSE 'unresolved' END END AS grade FROM n""",
)
def answer_structures(spark, sf_dir):
    """Flat lists of two numbers and a whole text without signs: as near, with another number, with another end, with another text."""
    rows = answer_rows(spark, sf_dir).select("doc_id", "origin", F.regexp_replace("said", "[^A-Za-z0-9 ]", "").alias("word"))
    k = F.col("doc_id") % 4
    listed = lambda number, word, end: F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(", "), number, F.lit(","), word, end)
    other = listed(F.when(k == 1, "7.5").otherwise("2.50001"), F.when(k == 3, F.concat(F.lit("77.7"), F.translate("word", " ", ""))).otherwise(F.upper("word")), F.when(k == 2, "]").otherwise(")"))
    return rows.select("doc_id", "origin", A.structure_grade(listed(F.lit("2.5"), F.col("word"), F.lit(")")), other).alias("grade"))


def cascade_sql() -> str:
    """A common table a marker: what is left of the text and whether one was found."""
    step, sql = "m0", "m0 AS (SELECT doc_id, origin, 'First. The answer is: ' || said || '. It is 5 more' AS rest, '' AS steps FROM r)"
    n = 0

    def add(found: str, rest: str, name: str):
        nonlocal step, sql, n
        n += 1
        sql += f",\n m{n} AS (SELECT doc_id, origin, CASE WHEN {found} THEN {stripped(rest)} ELSE rest END AS rest, CASE WHEN {found} THEN steps || {name} ELSE steps END AS steps FROM {step})"
        step = f"m{n}"

    lit = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    for marks, keep in ((A.LEADING, True), (A.TRAILING, False), (A.WORDS, True)):
        if marks is A.WORDS:  # no box in these texts
            add("contains(rest, '. ')", "substr(rest, 1, length(rest) - strpos(reverse(rest), ' .') - 1)", "''")
        for m in marks:
            back = f"strpos(reverse(lower(rest)), reverse({lit(m)}))"
            add(f"{back} > 0", f"right(rest, {back} - 1)" if keep else f"left(rest, length(rest) - {back} + 1 - {len(m)})", lit(m + "|"))
    return f"{sql} SELECT doc_id, origin, rest AS answer, steps, steps <> '' AND regexp_matches(rest, '\\p{{Nd}}') AS matched FROM {step}"


@query("answer_marked", f"WITH {SQL_ROWS}, {cascade_sql()}".replace("FROM r)", "FROM r WHERE NOT contains(said, 'box'))", 1))
def answer_marked(spark, sf_dir):
    """Texts that hold a box go another way, which tests hold; there are none but one literal."""
    rows = answer_rows(spark, sf_dir).where("not contains(said, 'box')")
    found = A.marked_answer(F.concat(F.lit("First. The answer is: "), "said", F.lit(". It is 5 more")))
    steps = F.concat_ws("", F.transform(F.col("m.steps"), lambda s: F.concat(s, F.lit("|"))))
    return rows.select("doc_id", "origin", found.alias("m")).select("doc_id", "origin", "m.answer", steps.alias("steps"), "m.matched")


@query("answer_scores")
def answer_scores(spark, sf_dir):
    """Grades and steps of whole texts; held by tests against plain Python."""
    rows = answer_rows(spark, sf_dir).withColumn("answer", F.concat(F.lit("Step 2: the answer is "), boxed_text())).withColumn("gold", F.when(F.col("doc_id") % 2 == 0, "0.5").otherwise(F.col("said")))
    out = S.marked_scores(rows, "answer", "gold")
    return out.select("doc_id", "origin", "pred", F.array_join("pred_steps", "|").alias("steps"), "grade", "good_format")


@query(
    "answer_feedback",
    f"""WITH {SQL_ROWS}, t AS (SELECT doc_id, origin, right(said || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' \\boxed{{' || right(said, 20) || '}}' END, 100) AS tail, right(said, 20) AS gold, doc_id % 5 = 0 AS cut FROM r),
    s AS (SELECT *, '{{' || list_last(string_split(tail, '\\boxed{{')) AS strict FROM t),
    p AS (SELECT *, CASE WHEN contains(tail, '\\boxed{{') THEN coalesce({scanned('strict')}, '') ELSE '' END AS pred FROM s)
    SELECT doc_id, origin, pred, (pred = '')::INT AS incorrect_format, cut::INT AS truncated, CASE WHEN pred = '' AND NOT cut THEN 'format' WHEN cut THEN 'truncated' ELSE '' END AS said_of FROM p""",
)
def answer_feedback(spark, sf_dir):
    gold = F.right("said", F.lit(20))
    rows = answer_rows(spark, sf_dir).withColumn("gold", gold).withColumn("answer", F.concat("said", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(" \\boxed{"), gold, F.lit("}")))))
    out = S.feedback_scores(rows, "answer", "gold", truncated=F.col("doc_id") % 5 == 0)
    kind = F.when(F.col("feedback") == S.FORMAT_FEEDBACK, "format").when(F.col("feedback") == S.TRUNCATED_FEEDBACK, "truncated").otherwise(F.col("feedback"))
    return out.select("doc_id", "origin", "pred", "incorrect_format", "truncated", kind.alias("said_of"))
