"""Queries over orders of rows, teachers' hints and answers of edited images (survey blocks 2.3, 2.6, 2.9, 2.12, 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from .catalog import query
from .records import ROWS, batch
from .tables import table


@query("sample_shuffled", f"WITH {ROWS} SELECT row_id, row_number() OVER (ORDER BY md5('7:0:' || row_id), row_id) - 1 AS position FROM b")
def sample_shuffled(spark, sf_dir):
    return P.sampler(batch(spark, sf_dir), "shuffle", 7).select("row_id", "position")


@query("sample_curriculum", f"WITH {ROWS} SELECT row_id, row_number() OVER (ORDER BY c % 100, row_id) - 1 AS position FROM b")
def sample_curriculum(spark, sf_dir):
    return P.sampler(batch(spark, sf_dir), "curriculum", difficulty=F.col("c") % 100).select("row_id", "position")


@query("sample_sequential", f"WITH {ROWS} SELECT row_id, row_id AS position FROM b")
def sample_sequential(spark, sf_dir):
    return P.sampler(batch(spark, sf_dir)).select("row_id", "position")


@query(
    "sample_epochs",
    f"""WITH {ROWS}, e AS (SELECT row_id, e::INT AS epoch, row_number() OVER (PARTITION BY e ORDER BY md5('3:' || e || ':' || row_id), row_id) - 1 AS p FROM b, range(2) r(e))
    SELECT row_id, epoch, p // 50 AS batch FROM e""",
)
def sample_epochs(spark, sf_dir):
    """All orders twice, in two seeded orders, in batches of fifty."""
    return P.epochs(batch(spark, sf_dir), 50, 2, seed=3).select("row_id", "epoch", "batch")


@query("rows_grown", f"WITH {ROWS} SELECT row_id, k FROM b UNION ALL SELECT (SELECT count(*) FROM b) + row_number() OVER (ORDER BY row_id) - 1, -k FROM b WHERE c % 2 = 0")
def rows_grown(spark, sf_dir):
    b = batch(spark, sf_dir)
    return P.grown(b.select("row_id", "k", "c"), b.withColumn("k", -F.col("k")).select("row_id", "k", "c"), F.col("c") % 2 == 0).select("row_id", "k")


HINTED = "h AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN left(lang, 1) WHEN 1 THEN ' ' END AS hint, CASE WHEN doc_id % 3 = 0 THEN source END AS truth, CASE WHEN doc_id % 5 = 0 THEN lang END AS answer FROM documents)"
TAKEN = "nullif(coalesce(nullif(trim(hint), ''), truth, answer), '')"


@query("teacher_hints", f"WITH {HINTED} SELECT doc_id, {TAKEN} AS hint, ({TAKEN} IS NOT NULL)::INT::DOUBLE AS mask, concat_ws(chr(10) || chr(10), coalesce(text, ''), {TAKEN}) AS prompt FROM h")
def teacher_hints(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.select("doc_id", F.coalesce("text", F.lit("")).alias("question"), F.when(i % 4 == 0, F.left("lang", F.lit(1))).when(i % 4 == 1, " ").alias("hint"), F.when(i % 3 == 0, F.col("source")).alias("ground_truth"), F.when(i % 5 == 0, F.col("lang")).alias("answer"), F.array(F.lit("x")).alias("images"))
    out = P.teacher_prompts(rows, "hint")
    return out.select("doc_id", P.teacher_hint(F.col("hint"), F.col("ground_truth"), F.col("answer")).alias("hint"), "mask", "prompt")


@query("teacher_swaps", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'edit,' || source END AS images, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask FROM documents")
def teacher_swaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.lit("q").alias("question"), F.array(F.lit("own")).alias("images"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("edit"), F.col("source"))).alias("teacher_images"), F.lit(2).alias("placeholders"))
    out = P.teacher_prompts(rows, "swap", fallback=True)
    return out.select("doc_id", F.array_join("images", ",").alias("images"), "mask")


@query(
    "teacher_reprompts",
    """WITH r AS (SELECT doc_id, coalesce(text, '') AS q, CASE WHEN doc_id % 2 = 0 THEN lang END AS peer, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN ' ' END AS feedback FROM documents)
    SELECT doc_id, concat_ws(chr(10) || chr(10), q, peer, nullif(feedback, ' ')) AS prompt, (peer IS NOT NULL OR nullif(feedback, ' ') IS NOT NULL)::INT::DOUBLE AS mask FROM r""",
)
def teacher_reprompts(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("question"), F.array(F.lit("x")).alias("images"), F.when(i % 2 == 0, F.col("lang")).alias("peer"), F.when(i % 3 == 0, F.col("source")).when(i % 3 == 1, " ").alias("feedback"))
    return P.teacher_prompts(rows, "reprompt").select("doc_id", "prompt", "mask")


@query("join_edited_answers", "SELECT page_id, arg_max(lang, doc_id) AS answer FROM pages JOIN documents ON doc_id % (SELECT count(*) FROM pages) = page_id % (SELECT count(*) FROM pages) GROUP BY page_id")
def join_edited_answers(spark, sf_dir):
    """Pages as edited images, each named after a number; documents give the numbers' options, the last one counts."""
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    rows = pages.select("page_id", F.concat(F.lit("img/idx"), (F.col("page_id") % n).cast("string"), F.lit("_edited.png")).alias("image"))
    options = table(spark, sf_dir, "documents").select((F.col("doc_id") % n).alias("number"), F.col("lang").alias("option"), F.col("doc_id").alias("order"))
    return P.edited_answer(rows, options).select("page_id", "answer")


@query("rows_merged_metadata", "SELECT doc_id, lang || '/' || source || '/' || doc_id AS merged FROM documents")
def rows_merged_metadata(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    a, b = F.create_map(F.lit("lang"), text("lang"), F.lit("source"), text("source")), F.create_map(F.lit("source"), text("source"), F.lit("id"), text("doc_id"))
    m = P.merged_metadata(a, b)
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", F.concat_ws("/", *[F.element_at("m", k) for k in ("lang", "source", "id")]).alias("merged"))


@query(
    "tok_top_k",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings)
    SELECT vec_id, slot::BIGINT AS slot, round(CASE WHEN rank() OVER (PARTITION BY vec_id ORDER BY x DESC) <= 5 THEN x END, 6) + 0.0 AS logit FROM e""",
)
def tok_top_k(spark, sf_dir):
    return P.nucleus(slots(spark, sf_dir), "vec_id", "logit", top_k=5).withColumn("logit", F.round("logit", 6) + F.lit(0.0))


@query(
    "tok_top_p",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings),
    p AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM e WINDOW w AS (PARTITION BY vec_id)),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
    SELECT vec_id, slot::BIGINT AS slot, round(CASE WHEN b < 0.61234567 THEN x END, 6) + 0.0 AS logit FROM c""",
)
def tok_top_p(spark, sf_dir):
    return P.nucleus(slots(spark, sf_dir), "vec_id", "logit", top_p=0.61234567).withColumn("logit", F.round("logit", 6) + F.lit(0.0))


def slots(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("slot", "logit")).select("vec_id", F.col("slot").cast("long").alias("slot"), F.col("logit").cast("double").alias("logit"))
