"""Queries over conversations, LaTeX answers and balanced parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex as X
from ..operators import balance as B
from ..operators import conversations as C
from .catalog import query
from .tables import rounded, table


@query("chat_messages", "SELECT conv_id, string_agg(role || ':' || length(coalesce(text, '')), ',' ORDER BY turn, role) AS shape, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    m = C.messages(table(spark, sf_dir, "conversations"))
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.length(F.coalesce(x["content"], F.lit(""))).cast("string"))), ",").alias("shape"), F.size("messages").cast("long").alias("n"))


WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query("chat_loss_mask", f"SELECT conv_id, sum(len({WORDS}) + 1)::BIGINT AS tokens, coalesce(sum(len({WORDS})) FILTER (role = 'assistant'), 0)::BIGINT AS loss_tokens FROM conversations GROUP BY conv_id")
def chat_loss_mask(spark, sf_dir):
    rows = C.loss_masked(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("tokens").cast("long").alias("tokens"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("loss_tokens"))


@query("chat_last_assistant", "SELECT conv_id, arg_max(text, CASE WHEN role = 'assistant' THEN turn END) AS text, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def chat_last_assistant(spark, sf_dir):
    return C.last_assistant(table(spark, sf_dir, "conversations"))


@query(
    "chat_media_parts",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text:look ;image:' || url || ';text:here' WHEN 1 THEN 'text:none' ELSE 'image:' || url || ';video:' END AS parts FROM pages",
)
def chat_media_parts(spark, sf_dir):
    content = F.when(F.col("page_id") % 3 == 0, "look <image>here").when(F.col("page_id") % 3 == 1, "none").otherwise("<image><video>")
    images = F.when(F.col("page_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array("url"))
    shown = F.transform("p", lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["text"], x["image"], F.lit(""))))
    return table(spark, sf_dir, "pages").withColumn("p", C.parts(content, images)).select("page_id", F.array_join(shown, ";").alias("parts"))


@query("chat_preference_pack", "SELECT conv_id, turn, '1,2,' || (turn + 5) || ',0|1,2,' || 7 || ',8' AS packed FROM conversations")
def chat_preference_pack(spark, sf_dir):
    one = lambda *x: F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v for v in x])
    packed = C.preference_pack(one(1, 2), one(F.col("turn") + 5), one(7, 8, 9), 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(packed, lambda p: F.array_join(F.transform(p, lambda v: v.cast("string")), ",")), "|").alias("packed"))


@query(
    "tool_best_so_far",
    """SELECT event_id, CASE WHEN value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS tool_reward FROM events""",
)
def tool_best_so_far(spark, sf_dir):
    return C.best_so_far(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "tool_reward")


LATEX = r"""CASE doc_id % 10 WHEN 0 THEN '\frac12' WHEN 1 THEN '0.5' WHEN 2 THEN 'x=1/2' WHEN 3 THEN '\sqrt3 \text{ cm}' WHEN 4 THEN '1,234'
 WHEN 5 THEN '50\%' WHEN 6 THEN '\dfrac{3}{4}' WHEN 7 THEN '.25' WHEN 8 THEN '90^\circ' ELSE 'abc' END"""
#: Beside the literals, whole documents and turns.
LATEX_ROWS = [("documents", "doc_id", "'made'", LATEX), ("documents", "doc_id", "'text'", "coalesce(text, '')"), ("conversations", "conv_id * 10000 + turn", "'turn'", "coalesce(text, '')")]


def plain_sql(x: str) -> str:
    """SQL of the plain form, a step for each of its rules."""
    literal = lambda v: v.replace("{", "{{").replace("}", "}}")
    swap = lambda pairs: [f"replace({{0}}, '{literal(a)}', '{literal(b)}')" for a, b in pairs]
    steps = ["replace({0}, chr(10), '')", *swap(X.SIZES[1:]), r"string_split({0}, '\text{{ ')[1]", *swap(X.POINTS)]
    steps += [r"regexp_replace({0}, '^\.', '0.')", "regexp_replace({0}, '^([^=]?[^=]?)=([^=]*)$', '\\2')", r"regexp_replace({0}, '(\\sqrt)([^{{])', '\1{{\2}}', 'g')", "replace({0}, ' ', '')"]
    steps += [r"regexp_replace({0}, '\\frac([^{{])([^{{])', '\\frac{{\1}}{{\2}}', 'g')", r"regexp_replace({0}, '\\frac([^{{])\{{', '\\frac{{\1}}{{', 'g')", r"regexp_replace({0}, '^0\.5$', '\\frac{{1}}{{2}}')"]
    steps += [r"regexp_replace({0}, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\frac{{\1}}{{\2}}')"]
    for step in steps:
        x = step.format(x)
    return x


LATEX_SQL = "r AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, {origin} AS origin, {x} AS answer FROM {name}" for name, i, origin, x in LATEX_ROWS) + ")"


def latex_rows(spark, sf_dir):
    one, two, three = (table(spark, sf_dir, name).selectExpr(f"cast({i} as bigint) as doc_id", f"{origin} as origin", x.replace("\\", "\\\\") + " as answer") for name, i, origin, x in LATEX_ROWS)
    return one.union(two).union(three)


@query("latex_forms", f"WITH {LATEX_SQL} SELECT doc_id, origin, {plain_sql('answer')} AS form FROM r")
def latex_forms(spark, sf_dir):
    return latex_rows(spark, sf_dir).select("doc_id", "origin", X.plain_latex("answer").alias("form"))


@query(
    "latex_grades",
    rf"""WITH {LATEX_SQL}, f AS (SELECT *, {plain_sql('answer')} AS form FROM r), n AS (SELECT *, regexp_replace(form, '[,%]', '', 'g') AS bare FROM f),
    v AS (SELECT *, coalesce(TRY_CAST(bare AS DOUBLE), CASE WHEN regexp_matches(bare, '^\\frac\{{[0-9.]+\}}\{{[0-9.]+\}}$') THEN TRY_CAST(regexp_extract(bare, '\{{([0-9.]+)\}}', 1) AS DOUBLE) / TRY_CAST(regexp_extract(bare, '\{{([0-9.]+)\}}$', 1) AS DOUBLE) END) AS x FROM n)
    SELECT doc_id, origin, CASE WHEN form = '\frac{{1}}{{2}}' THEN 'right' WHEN x IS NULL THEN 'unresolved' WHEN abs(x - 0.5) <= 0.5e-4 OR abs(x - 50) <= 50e-4 OR abs(x - 0.005) <= 0.005e-4 THEN 'right' ELSE 'wrong' END AS grade FROM v""",
)
def latex_grades(spark, sf_dir):
    return latex_rows(spark, sf_dir).select("doc_id", "origin", X.grade("answer", F.lit("1/2")).alias("grade"))


@query(
    "latex_line_score",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^0-9bdf]', '', 'g') AS digits FROM documents)
    SELECT doc_id, CASE WHEN pred = right(digits, 1) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, pred FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN right(digits, 9) WHEN 1 THEN '[INVALID]' ELSE right(digits, 1) END AS pred FROM t)""",
)
def latex_line_score(spark, sf_dir):
    """A text's last digits and b, d, f behind "Answer:", in dollars and with units, and twice; without one an invalid line."""
    digits = F.regexp_replace(F.coalesce("text", F.lit("")), "[^0-9bdf]", "")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\nAnswer: x = $"), F.right(digits, F.lit(9)), F.lit("$ dollars"))).when(F.col("doc_id") % 3 == 1, digits)
    said = said.otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\nAnswer: 12\nanswer : "), F.right(digits, F.lit(1)), F.lit(" ")))
    s = table(spark, sf_dir, "documents").select("doc_id", X.line_score(F.coalesce(said, F.lit("")), F.right(digits, F.lit(1))).alias("s"))
    return s.select("doc_id", "s.score", "s.pred")


@query(
    "latex_boxed",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\{}]', '', 'g') AS bare FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '\frac{' || bare || '}{2}' WHEN 1 THEN NULL WHEN 2 THEN bare || '{c}' WHEN 4 THEN string_split(bare, '$')[1] END AS boxed FROM t""",
)
def latex_boxed(spark, sf_dir):
    """Whole texts, without their own braces, in boxes: nested, in none, in a framed one, in an open one, behind a blank."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\{}]", "")
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit("\\boxed{1} or \\boxed{\\frac{"), bare, F.lit("}{2}} done"))).when(k == 1, bare).when(k == 2, F.concat(F.lit("\\boxed{1} \\fbox{"), bare, F.lit("{c}}")))
    said = said.when(k == 3, F.concat(F.lit("\\boxed{open "), bare)).otherwise(F.concat(F.lit("\\boxed{1} \\boxed "), bare, F.lit("$ more")))
    return table(spark, sf_dir, "documents").select("doc_id", X.boxed(said).alias("boxed"))


def lengths(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return n.select(F.expr("row div 64").alias("batch"), "row", "n")


def spread_of(parts, spark, sf_dir):
    """Rows, parts and the spread of part sums of each batch."""
    sums = parts.join(lengths(spark, sf_dir), ["batch", "row"]).groupBy("batch", "part").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    return sums.groupBy("batch").agg(F.sum("c").alias("rows"), F.count("*").alias("parts"), rounded(F.max("s") - F.min("s")).alias("spread"))


@query("balance_differencing")
def balance_differencing(spark, sf_dir):
    return spread_of(B.balanced_parts(lengths(spark, sf_dir), "batch", "row", "n", 4), spark, sf_dir)


@query("balance_least_loaded")
def balance_least_loaded(spark, sf_dir):
    return spread_of(B.balanced_parts(lengths(spark, sf_dir), "batch", "row", "n", 4, greedy=True), spark, sf_dir)


@query("balance_micro_batches")
def balance_micro_batches(spark, sf_dir):
    return spread_of(B.micro_batches(lengths(spark, sf_dir), "batch", "row", "n", 1000), spark, sf_dir)
