"""Queries over gates and reports (survey blocks 2.2, 2.4, 2.9, 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import conversations as C
from ..operators import gates as G
from ..operators import records as R
from .catalog import query
from .tables import TOK, rounded, sequences, table


@query("gate_short_prompts", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) <= 200")
def gate_short_prompts(spark, sf_dir):
    return G.short_enough(table(spark, sf_dir, "documents"), C.whitespace_tokens(F.col("text")), 200).select("doc_id")


@query("gate_whitelist", "SELECT doc_id, lang FROM documents")
def gate_whitelist(spark, sf_dir):
    return G.keep_columns(table(spark, sf_dir, "documents"), ["lang", "missing", "doc_id"])


@query("gate_forbidden_tokens", f"WITH {TOK} SELECT row_id, bool_or(m = 1 AND id IN (3, 5)) AS forbidden FROM tok GROUP BY row_id")
def gate_forbidden_tokens(spark, sf_dir):
    return sequences(spark, sf_dir, "ids", "mask").select("row_id", G.forbidden_tokens("ids", "mask", [3, 5]).alias("forbidden"))


@query(
    "gate_table_report",
    "SELECT count(*) AS rows, count(*) FILTER (NOT (url LIKE 'http%')) AS scheme, count(*) FILTER (NOT coalesce(url LIKE '%example.com%', FALSE)) AS host, count(*) FILTER (page_id % 7 = 0) AS seventh FROM pages",
)
def gate_table_report(spark, sf_dir):
    return G.table_report(table(spark, sf_dir, "pages"), {"scheme": F.col("url").startswith("http"), "host": F.contains("url", F.lit("example.com")), "seventh": F.col("page_id") % 7 != 0})


@query("gate_half_size", "SELECT page_id, abs(page_id // 2 - greatest(page_id // 2, 1)) <= 1 AND abs(page_id // 2 + page_id % 3 - greatest(page_id // 2, 1)) <= 1 AS good FROM pages")
def gate_half_size(spark, sf_dir):
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", G.half_size((p, p), (F.expr("page_id div 2"), F.expr("page_id div 2 + page_id % 3"))).alias("good"))


@query("sample_seeded")
def sample_seeded(spark, sf_dir):
    """Drawn by a seeded NumPy generator."""
    return G.sampled(R.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 50, seed=1).select("doc_id")


@query("sample_generations")
def sample_generations(spark, sf_dir):
    return G.shown_generations(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input")), 10).select("place", "doc_id")


@query("report_unbalance", "SELECT min(s) AS min, max(s) AS max, max(s) - min(s) AS minmax_diff, round(avg(s), 6) AS mean FROM (SELECT o_custkey % 8 AS part, sum(o_orderkey) AS s FROM orders GROUP BY 1)".replace("sum(o_orderkey) AS s", "sum(o_orderkey)::BIGINT AS s"))
def report_unbalance(spark, sf_dir):
    out = G.unbalance(table(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 8), "part", F.col("o_orderkey"))
    return out.withColumn("mean", rounded(F.col("mean")))


@query("report_throughput", f"WITH {TOK} SELECT sum(m)::DOUBLE AS total_tokens, 2.5::DOUBLE AS time_per_step, round(sum(m) / 20, 6) AS tokens_per_device_second FROM tok")
def report_throughput(spark, sf_dir):
    out = G.throughput(sequences(spark, sf_dir, "mask"), S.count_mask("mask"), 2.5, 8)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query("report_slowest", "SELECT round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(avg(value), 6) + 0.0 AS mean, arg_max(user_id, (value, -event_id)) AS user_id FROM events")
def report_slowest(spark, sf_dir):
    out = G.slowest(table(spark, sf_dir, "events"), "value", "event_id", "user_id")
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("min", "max", "mean")], "user_id")


@query(
    "report_metric_sections",
    """WITH n AS (SELECT event_type AS source, CASE event_id % 4 WHEN 0 THEN 'acc/mean@4' WHEN 1 THEN 'acc/best@8/mean' WHEN 2 THEN 'reward/std@8' ELSE 'reward/mean@8' END AS name FROM events GROUP BY ALL)
    SELECT source, name, CASE WHEN name = 'acc/best@8/mean' THEN 'val-core' ELSE 'val-aux' END AS section FROM n""",
)
def report_metric_sections(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["acc/mean@4", "acc/best@8/mean", "reward/std@8", "reward/mean@8"])), (F.col("event_id") % 4 + 1).cast("int"))
    return G.metric_section(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), names.alias("name")).distinct(), "acc")


@query(
    "report_distillation_fractions",
    "SELECT round(count(DISTINCT CASE WHEN quality = 1 THEN doc_id // 5 END) / count(DISTINCT doc_id // 5), 6) AS success_group, round(avg((quality = 1)::INT), 6) AS success_sample, round(avg((toxic = 1)::INT), 6) AS feedback, round(avg(doc_id % 2), 6) AS mask FROM labels",
)
def report_distillation_fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("uid", F.expr("doc_id div 5"))
    out = G.distillation_fractions(rows, "uid", F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 2)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(
    "report_run_prefixes",
    """WITH n AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type AND event_id > (SELECT min(event_id) FROM events) THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM n)
    SELECT run::BIGINT AS run, count(*) AS size, arg_min(event_id, event_id) AS prefix, min(event_type) AS event_type FROM g GROUP BY run""",
)
def report_run_prefixes(spark, sf_dir):
    out = G.run_prefixes(table(spark, sf_dir, "events"), "event_type", "event_id", "event_id")
    return out.select(F.col("run").cast("long").alias("run"), "size", "prefix", "event_type")


@query("report_window_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS load FROM events")
def report_window_load(spark, sf_dir):
    return G.window_load(table(spark, sf_dir, "events"), "user_id", "event_id", 60).select("event_id", "load")


@query(
    "geometry_boxes",
    "SELECT page_id, CASE WHEN least(page_id * 3 % 200 + 50, 100) - (page_id * 3 % 200 - 20) >= 28 AND least(page_id * 3 % 200 + 50, 100) - greatest(page_id * 3 % 200 - 20, 0) >= 28 THEN greatest(page_id * 3 % 200 - 20, 0) || ',0,' || least(page_id * 3 % 200 + 50, 100) || ',60' END AS box FROM pages",
)
def geometry_boxes(spark, sf_dir):
    x = F.col("page_id") * 3 % 200
    whole = lambda v: F.lit(v).cast("long")
    box = G.valid_box(F.array(x - 20, whole(-5), x + 50, whole(60)), whole(100), whole(80))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(box, lambda v: v.cast("string")), ",").alias("box"))


@query(
    "tool_merged_score",
    """WITH t AS (SELECT doc_id, contains(coalesce(text, ''), 'Action') AS own FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND NOT own THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t""",
)
def tool_merged_score(spark, sf_dir):
    """Actions before, between and behind a whole text, whose digest is one of the inputs."""
    k, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    digest = F.concat(F.lit('{"q": "'), F.md5(text), F.lit('"}'))
    right = F.concat(text, F.lit("\nAction: find\nAction Input: "), digest, F.lit("\n"), text, F.lit('\nAction: open\nAction Input: {"p": 2}\n'), text)
    said = F.when(k == 0, right).when(k == 1, F.concat(F.lit("Action: open\nAction Input: "), digest, text)).otherwise(F.concat(F.lit("Action: find\nAction: open\nAction Input: {bad}\n"), text))
    gold = F.concat(F.lit('[{"Action": "open", "Action_Input": "{\\"p\\": 2}"}, {"Action": "find", "Action_Input": '), digest, F.lit("}]"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("answer"), gold.alias("gold"))
    return G.python_score(rows, G.merged_tool_score, "answer", "gold").select("doc_id", "score")


@query(
    "code_scores",
    """WITH t AS (SELECT doc_id, replace(coalesce(text, ''), '```', '') AS code FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN length(code) >= 2 THEN code || chr(10) ELSE 'y = 22' || chr(10) END WHEN 1 THEN 'x' || chr(10) END AS code,
      CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sparse, CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM t""",
)
def code_scores(spark, sf_dir):
    """Whole texts as code in a fence, before one, and without one; the longest fenced block counts."""
    code, k = F.replace(F.coalesce("text", F.lit("")), F.lit("```"), F.lit("")), F.col("doc_id") % 3
    long = F.when(F.length(code) >= 2, code).otherwise("y = 22")
    said = F.when(k == 0, F.concat(F.lit("a\n```python\nx\n```\nb\n```\n"), long, F.lit("\n```"))).when(k == 1, F.concat(code, F.lit("\n```py\nx\n```\n"))).otherwise(code)
    passed = F.array(F.lit(True), F.col("doc_id") % 4 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", G.code_block(said).alias("code"), G.code_score(passed).alias("sparse"), G.code_score(passed, False).alias("share"))
