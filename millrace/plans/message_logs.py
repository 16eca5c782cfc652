"""Queries over the incremental log of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import message_log as M
from .catalog import query
from .tables import table

LOG_SQL = r"""WITH h AS (SELECT '<system>' || chr(10) || 'You help.</turn>' || chr(10) || '<user>' || chr(10) || 'I am a user.</turn>' || chr(10) AS history, '<assistant>' || chr(10) AS asked),
 t AS (SELECT conv_id, turn, coalesce(role, '') AS role, '<' || coalesce(role, '') || '>' || chr(10) AS open, coalesce(text, '') || '</turn>' || chr(10) AS body, coalesce(role, '') = 'assistant' AS answer FROM conversations WHERE NOT (coalesce(role, '') = 'tool' AND coalesce(text, '') = '')),
 k AS (SELECT t.*, regexp_extract_all(history || CASE WHEN answer THEN asked ELSE '' END, '\S+\s*|\s+') AS base, regexp_extract_all(history || open || body, '\S+\s*|\s+') AS al FROM t, h),
 s AS (SELECT *, coalesce(list_filter(range(1, len(base) + 1), lambda i: base[i] IS DISTINCT FROM al[i])[1] - 1, len(base)) AS shared FROM k),
 o AS (SELECT *, CASE WHEN answer THEN [1] ELSE [] END AS ask, al[shared + 1:] AS own, shared < len(base) AS flag FROM s),
 g AS (SELECT conv_id, sum(len(ask) + len(own)) AS n, sum(len(own)) FILTER (answer) AS loss, min(turn) FILTER (answer) AS first, count(*) FILTER (flag) AS flagged,
         string_agg(array_to_string(own, ''), '' ORDER BY turn) FILTER (answer) AS said,
         string_agg(CASE WHEN answer THEN '<assistant>' || chr(10) ELSE '' END || array_to_string(own, ''), '' ORDER BY turn) AS log, string_agg(open || body, '' ORDER BY turn) AS whole FROM o GROUP BY conv_id),
 p AS (SELECT o.conv_id, sum(len(ask) + len(own)) AS before FROM o JOIN g USING (conv_id) WHERE g.first IS NULL OR o.turn < g.first GROUP BY o.conv_id)
 SELECT conv_id, n::BIGINT AS ids, coalesce(loss, 0)::BIGINT AS loss, (coalesce(before, 0) + CASE WHEN first IS NULL THEN 0 ELSE 1 END)::BIGINT AS prompt_length, flagged::BIGINT AS flagged,
   md5(coalesce(said, '')) AS said, md5(log) AS log FROM g LEFT JOIN p USING (conv_id)"""


@query("chat_message_log", LOG_SQL)
def chat_message_log(spark, sf_dir):
    """All conversations, with longer bounds than any has, so that the log's text can be compared as a whole."""
    log = M.message_log(table(spark, sf_dir, "conversations"), longest=1 << 30, longest_response=1 << 30)
    # a flagged turn's own ids hold what was joined to the history, so that texts are compared as the log has them
    under_loss = F.filter(F.arrays_zip(F.col("ids").alias("i"), F.col("loss_mask").alias("m")), lambda x: x["m"] == 1)
    total = lambda c: F.size(c).cast("long")
    return log.select("conv_id", total("ids").alias("ids"), total(under_loss).alias("loss"), F.col("prompt_length").cast("long").alias("prompt_length"), total("flagged_turns").alias("flagged"), F.md5(F.array_join(F.transform(under_loss, lambda x: x["i"]), "")).alias("said"), F.md5(F.array_join("ids", "")).alias("log"))
