"""Queries over record operators (survey blocks 2.2, 2.3, 2.5, 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import records as R
from .catalog import query
from .tables import rounded, table

#: orders as a batch: row_id is the order number's place, which the table holds densely.
ROWS = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders)"


def batch(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    return R.numbered(rows, "k").select("row_id", "k", "c", "p")


def record_query(name: str, sql: str):
    """fn(batch) against SQL over `b`."""

    def add(fn):
        query(name, f"WITH {ROWS} {sql}")(lambda spark, sf_dir: fn(batch(spark, sf_dir)))
        return fn

    return add


record_query("rows_numbered", "SELECT row_id, k FROM b")(lambda b: b.select("row_id", "k"))
record_query("rows_select", "SELECT row_id, c FROM b")(lambda b: b.select("row_id", "c"))
record_query("rows_pop", "SELECT row_id, p FROM b")(lambda b: R.pop(b, "p")[1])
record_query("rows_rename", "SELECT row_id, k, c AS customer, p AS priority FROM b")(lambda b: R.rename(b, ["c", "p"], ["customer", "priority"]))
record_query("rows_take", "SELECT x.pos::BIGINT AS row_id, k FROM b JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 11)) x(pos, row_id) USING (row_id)")(lambda b: R.take(b, [7, 3, 7, 11]).select("row_id", "k"))
record_query("rows_mask", "SELECT row_id, k FROM b WHERE p LIKE '1%'")(lambda b: b.where(F.col("p").startswith("1")).select("row_id", "k"))
record_query("rows_slice", "SELECT row_id, k FROM b WHERE row_id BETWEEN 10 AND 99 AND (row_id - 10) % 3 = 0")(lambda b: R.cut(b, 10, 100, 3).select("row_id", "k"))
record_query("rows_union_columns", "SELECT row_id, k, c, c * 2 AS d FROM b")(lambda b: R.union_columns(b.select("row_id", "k", "c"), b.select("row_id", "c", (F.col("c") * 2).alias("d"))))
record_query("rows_repeat_interleaved", "SELECT row_id * 3 + j AS row_id, k FROM b, range(3) r(j)")(lambda b: R.repeat(b, 3).select("row_id", "k"))
record_query("rows_repeat_tiled", "SELECT j * (SELECT count(*) FROM b) + row_id AS row_id, k FROM b, range(3) r(j)")(lambda b: R.repeat(b, 3, interleave=False).select("row_id", "k"))
record_query("rows_repeat_each", "SELECT row_id, j::INT AS copy FROM b, range(4) r(j) WHERE j < c % 4")(lambda b: R.repeat_each(b, F.col("c") % 4).select("row_id", "copy"))
record_query("rows_concat", "SELECT row_id, k FROM b UNION ALL SELECT row_id + (SELECT count(*) FROM b), k FROM b")(lambda b: R.concat(b.select("row_id", "k"), b.select("row_id", "k")))
record_query("rows_chunk", "SELECT row_id, (row_id // ((SELECT count(*) + 6 FROM b) // 7))::INT AS chunk FROM b")(lambda b: R.chunk(b, 7, strict=False).select("row_id", "chunk"))
record_query("rows_batches_drop_last", "SELECT row_id, (row_id // 64)::INT AS batch FROM b WHERE row_id // 64 < (SELECT count(*) FROM b) // 64")(lambda b: R.batches(b, 64, drop_last=True).select("row_id", "batch"))
record_query("rows_pad_to_divisor", "SELECT row_id, k, FALSE AS padding FROM b UNION ALL SELECT n + i, k, TRUE FROM (SELECT count(*) AS n FROM b) t, range(32) r(i), b WHERE i < (32 - n % 32) % 32 AND b.row_id = i % n")(lambda b: R.pad_to(b, 32).select("row_id", "k", "padding"))
record_query("rows_pad_unpad", "SELECT row_id, k FROM b")(lambda b: R.unpad(R.pad_to(b, 32)).select("row_id", "k"))
record_query("rows_pad_with_first", "SELECT row_id, k FROM b UNION ALL SELECT (SELECT count(*) FROM b) + i, k FROM b, range(5) r(i) WHERE row_id = 0")(lambda b: R.pad_with(b, 5, "first").select("row_id", "k"))
record_query("rows_fold", "SELECT row_id // 4 AS row_id, string_agg(k::VARCHAR, ',' ORDER BY row_id) AS ks FROM b GROUP BY 1")(lambda b: R.fold(b, 4).select("row_id", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("ks")))
record_query("rows_unfold", "SELECT row_id * 2 + j AS row_id, CASE j WHEN 0 THEN k || ',' || c ELSE c || ',' || k END AS piece FROM b, range(2) r(j)")(
    lambda b: R.unfold(b.select("row_id", F.array("k", "c", "c", "k").alias("v")), 2, "v").select("row_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("piece"))
)
record_query("rows_reorder", "SELECT (SELECT count(*) FROM b) - 1 - row_id AS row_id, k FROM b")(lambda b: R.reorder(b, R.reversed_places(b)).select("row_id", "k"))
record_query("rows_missing_numbers", "SELECT row_id FROM b WHERE c % 3 = 0")(lambda b: R.missing_numbers(b.where("c % 3 > 0"), b.count()))
record_query("rows_misaligned", "SELECT count(*) FILTER (row_id % 50 = 7) AS mismatches, min(row_id) FILTER (row_id % 50 = 7) AS first_mismatch FROM b")(lambda b: R.misaligned(b.select("row_id", "p"), b.select("row_id", F.when(F.col("row_id") % 50 == 7, "x").otherwise(F.col("p")).alias("p")), "p"))
record_query(
    "rows_runs",
    """, n AS (SELECT *, CASE WHEN lag(p) OVER (ORDER BY row_id) IS DISTINCT FROM p AND row_id > 0 THEN 1 ELSE 0 END AS new FROM b),
    g AS (SELECT *, sum(new) OVER (ORDER BY row_id) AS run FROM n)
    SELECT row_id, run::BIGINT AS run, row_number() OVER (PARTITION BY run ORDER BY row_id) - 1 AS run_pos FROM g""",
)(lambda b: R.runs(b, "p", "row_id").select("row_id", F.col("run").cast("long").alias("run"), F.col("run_pos").cast("long").alias("run_pos")))
record_query("rows_keep_last", "SELECT c, arg_max(k, row_id) AS k, max(row_id) AS row_id FROM b GROUP BY c")(lambda b: R.keep_last(b.select("c", "k", "row_id"), ["c"], "row_id"))
record_query(
    "rows_compact_answers",
    """SELECT c, k, row_id, first_seen FROM (
      SELECT c, k, row_id, min(row_id) OVER (PARTITION BY c) AS first_seen,
             row_number() OVER (PARTITION BY c ORDER BY (p LIKE '1%'), row_id DESC) AS i FROM b) WHERE i = 1""",
)(lambda b: R.compact_answers(b, "c", F.col("p").startswith("1"), "row_id").select("c", "k", "row_id", "first_seen"))
record_query("rows_shard", "SELECT row_id FROM b WHERE row_id % 5 = 2 AND c % 2 = 0")(lambda b: b.where("pmod(row_id, 5) = 2").join(b.where("c % 2 = 1").select("row_id"), "row_id", "left_anti").select("row_id"))
record_query("rows_head_sample", "SELECT row_id, k FROM b WHERE row_id < 25")(lambda b: b.where("row_id < 25").select("row_id", "k"))
record_query("rows_top_per_group", "SELECT c, k FROM (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY k DESC) AS i FROM b) WHERE i <= 2")(lambda b: b.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("k")))).where("i <= 2").select("c", "k"))


@record_query("rows_epochs", "SELECT e * (((SELECT count(*) FROM b) + 99) // 100) + row_id // 100 AS step, count(*) AS n FROM b, range(2) r(e) GROUP BY 1")
def rows_epochs(b):
    """Pages of a hundred rows, all of them in each of two epochs."""
    n = b.count()
    return R.batches(b, 100, n).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(1)))).groupBy((F.col("e") * -(-n // 100) + F.col("batch")).cast("long").alias("step")).agg(F.count("*").alias("n"))


@query(
    "join_category_backfill",
    """WITH bench AS (SELECT text, arg_max(lang, doc_id) AS by_text FROM documents GROUP BY text),
    src AS (SELECT source, arg_max(lang, doc_id) AS by_source FROM documents WHERE doc_id % 3 = 0 GROUP BY source)
    SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, by_source, by_text, 'unknown') AS category
    FROM documents LEFT JOIN src USING (source) LEFT JOIN bench USING (text)""",
)
def join_category_backfill(spark, sf_dir):
    """A row's own category, else that of the last benchmark row with its first key, else with its second."""
    d = table(spark, sf_dir, "documents")
    out = R.lookup(d, d.where("doc_id % 3 = 0"), ["source"], "doc_id", "lang", "by_source")
    out = R.lookup(out, d, ["text"], "doc_id", "lang", "by_text")
    return out.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "by_source", "by_text", F.lit("unknown")).alias("category"))


@query("join_orders_without_lines", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_orders_without_lines(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("join_semi_on_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi_on_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query(
    "join_first_success_peer",
    """WITH r AS (SELECT doc_id, doc_id // 6 AS uid, coalesce(quality, 0) = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id)),
    k AS (SELECT *, min(doc_id) FILTER (ok) OVER (PARTITION BY uid) AS s1 FROM r),
    k2 AS (SELECT *, min(CASE WHEN ok AND doc_id > s1 THEN doc_id END) OVER (PARTITION BY uid) AS s2 FROM k)
    SELECT doc_id, CASE WHEN s1 = doc_id THEN s2 ELSE s1 END AS peer FROM k2""",
)
def join_first_success_peer(spark, sf_dir):
    """The first successful other row of the group: the two smallest successes serve all rows."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.expr("doc_id div 6").alias("uid"), (F.coalesce("quality", F.lit(0)) == 1).alias("ok"))
    w = Window.partitionBy("uid")
    rows = rows.withColumn("s1", F.min(F.when(F.col("ok"), F.col("doc_id"))).over(w))
    rows = rows.withColumn("s2", F.min(F.when(F.col("ok") & (F.col("doc_id") > F.col("s1")), F.col("doc_id"))).over(w))
    return rows.select("doc_id", F.when(F.col("s1") == F.col("doc_id"), F.col("s2")).otherwise(F.col("s1")).alias("peer"))


@query(
    "join_two_keys",
    """WITH side AS (SELECT k, arg_max(lang, ord) AS lang FROM (SELECT 'q' || doc_id AS k, lang, doc_id AS ord FROM documents UNION ALL SELECT 'i' || (doc_id * 2), lang, doc_id FROM documents) GROUP BY k)
    SELECT page_id, lang FROM pages JOIN side ON k = CASE WHEN page_id % 2 = 0 THEN 'q' || page_id ELSE 'i' || (page_id + 1) END""",
)
def join_two_keys(spark, sf_dir):
    """References that may be found under either of two keys."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("ord"), F.explode(F.array(F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.concat(F.lit("i"), (F.col("doc_id") * 2).cast("string")))).alias("k"))
    side = d.groupBy("k").agg(F.max_by("lang", "ord").alias("lang"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("q"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("i"), (F.col("page_id") + 1).cast("string"))).alias("k"))
    return pages.join(side, "k").select("page_id", "lang")


EDITS = "edits AS (SELECT doc_id AS item, 'edit/' || doc_id || '_edited.png' AS edit FROM labels WHERE toxic = 0 UNION ALL SELECT 10000000 + doc_id, 'x' FROM labels WHERE toxic = 1)"


def worlds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    rows = R.numbered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.concat(F.lit("img/"), "source").alias("image")), "item")
    edits = lab.where("toxic = 0").select(F.col("doc_id").alias("item"), F.format_string("edit/%d_edited.png", "doc_id").alias("edit")).union(lab.where("toxic = 1").select((F.col("doc_id") + 10000000).alias("item"), F.lit("x")))
    return rows, edits, lab.where("quality = 1").select(F.col("doc_id").alias("item"))


@query(
    "build_dual_world",
    f"""WITH {EDITS}, only_ AS (SELECT doc_id AS item, 'img/' || source AS image FROM documents WHERE lang <> 'de')
    SELECT row_number() OVER (ORDER BY o.item) - 1 AS idx, o.item, e.edit IS NOT NULL AS has_edit, coalesce(e.edit, image) AS world_b
    FROM only_ o LEFT JOIN (SELECT * FROM edits WHERE item IN (SELECT doc_id FROM labels WHERE quality = 1)) e USING (item)""",
)
def build_dual_world(spark, sf_dir):
    rows, edits, good = worlds(spark, sf_dir)
    only = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("item"))
    return R.dual_world(rows, edits, good, only).select("idx", "item", "has_edit", "world_b")


@query(
    "build_dual_world_summary",
    f"""WITH {EDITS} SELECT count(*) FILTER (edit IS NOT NULL) AS with_edit, count(*) FILTER (edit IS NULL) AS fallback,
    (SELECT count(*) FROM edits WHERE item >= 10000000) AS unmatched FROM documents LEFT JOIN edits ON item = doc_id""",
)
def build_dual_world_summary(spark, sf_dir):
    rows, edits, _ = worlds(spark, sf_dir)
    return R.build_summary(R.dual_world(rows, edits), edits)


@query(
    "build_hints",
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, length(repeat('R', 120) || doc_id) AS hint_length FROM documents",
)
def build_hints(spark, sf_dir):
    rows = R.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    hints = rows.select("row_id", F.lit(1).alias("order"), F.concat(F.repeat(F.lit("R"), 120), F.col("doc_id").cast("string")).alias("hint")).union(rows.select("row_id", F.lit(2), F.lit("[ERR:timeout]" + "x" * 120)))
    return R.with_hints(rows, hints).select("row_id", F.length("hint").cast("long").alias("hint_length"))


@query("set_operations", "SELECT doc_id, 'both' AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(lab).withColumn("part", F.lit("both")).union(d.subtract(lab).withColumn("part", F.lit("unlabelled")))


@query("path_resolution", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs/' || page_id ELSE '/data/rel/' || page_id END AS path FROM pages")
def path_resolution(spark, sf_dir):
    entry = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("rel/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", R.resolved_path("/data/", entry).alias("path"))


@query(
    "window_longest_two",
    "SELECT o_custkey AS c, max(n) AS longest, max(n) FILTER (i = 2) AS second FROM (SELECT o_custkey, o_orderkey, n, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) AS i FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1",
)
def window_longest_two(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderkey")))
    return o.groupBy(F.col("o_custkey").alias("c")).agg(F.max("n").alias("longest"), F.max(F.when(F.col("i") == 2, F.col("n"))).alias("second"))


@query("group_balanced_lengths", "SELECT c, count(*) AS n, sum(24576 * k + k * k)::DOUBLE AS workload FROM (SELECT o_custkey AS c, o_orderkey % 100 AS k FROM orders) GROUP BY c")
def group_balanced_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 100).alias("k"))
    return rows.groupBy("c").agg(F.count("*").alias("n"), rounded(F.sum(S.workload(F.col("k")))).alias("workload"))
