"""Queries over tool calls, generated rows, images and frames, and over written and reread files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tools as T
from ..sources import files, generators, media
from .catalog import query
from .streams import shared_folder
from .tables import rounded, table

SCHEMA = {"properties": {"k": {"type": "integer"}, "device": {"type": "object"}, "tags": {"type": "array"}}, "required": ["k", "device"]}
TYPE_SQL = "CASE WHEN json_valid(p) THEN json_type(p, '$.{0}') END"


@query(
    "tool_arguments",
    f"""WITH r AS (SELECT DISTINCT ON (click_id) click_id, coalesce(props, '') AS p FROM clicks), t AS (SELECT *, json_valid(p) AS ok, CASE WHEN json_valid(p) THEN json_type(p) END AS kind, {', '.join(f"{TYPE_SQL.format(c)} AS {c}" for c in SCHEMA['properties'])} FROM r)
    SELECT click_id, CASE WHEN coalesce(kind, '') <> 'OBJECT' THEN '{{}}' ELSE p END AS arguments, coalesce(kind, '') <> 'OBJECT' AS has_error,
      CASE WHEN NOT ok THEN 'no JSON' WHEN kind <> 'OBJECT' THEN 'no object' ELSE array_to_string(list_filter([CASE WHEN k IS NULL THEN 'missing k' END, CASE WHEN k NOT IN ('BIGINT', 'UBIGINT') THEN 'type k' END, CASE WHEN device IS NULL THEN 'missing device' END, CASE WHEN device <> 'OBJECT' THEN 'type device' END, CASE WHEN tags <> 'ARRAY' THEN 'type tags' END], lambda x: x IS NOT NULL), ',') END AS problems FROM t""",
)
def tool_arguments(spark, sf_dir):
    """The properties of all clicks as a tool's arguments, each click once."""
    rows = table(spark, sf_dir, "clicks").select("click_id", "props").dropDuplicates(["click_id"])
    found = rows.select("click_id", T.checked_arguments("props", SCHEMA).alias("c"))
    return found.select("click_id", "c.arguments", "c.has_error", F.array_join("c.problems", ",").alias("problems"))


@query(
    "tool_loose_results",
    r"""WITH p AS (SELECT doc_id, translate(coalesce(text, ''), '''', '"') AS a, translate('{''query'': ''' || coalesce(lang, '?') || ''', ''results'': [{''title'': ''' || doc_id || '''}, {''title'': 2}], "title" : 1}', '''', '"') AS b FROM documents)
    SELECT doc_id, regexp_extract(a, '(?s)"results"\s*:\s*(\[.*?\])', 1) || regexp_extract(b, '(?s)"results"\s*:\s*(\[.*?\])', 1) AS text, regexp_extract(a, 'query"\s*:\s*"([^"]+)"', 1) || '|' || regexp_extract(b, 'query"\s*:\s*"([^"]+)"', 1) AS queries,
      (len(regexp_extract_all(a, '"title"\s*:')) + len(regexp_extract_all(b, '"title"\s*:')))::INT AS total_results FROM p""",
)
def tool_loose_results(spark, sf_dir):
    """Whole documents as one part, a loosely quoted result as the other."""
    loose = F.concat(F.lit("{'query': '"), F.coalesce("lang", F.lit("?")), F.lit("', 'results': [{'title': '"), F.col("doc_id").cast("string"), F.lit("'}, {'title': 2}], \"title\" : 1}"))
    found = table(spark, sf_dir, "documents").select("doc_id", T.loose_results(F.array(F.coalesce("text", F.lit("")), loose)).alias("r"))
    return found.select("doc_id", "r.text", F.array_join("r.queries", "|").alias("queries"), "r.total_results")


@query("generated_prompts", "SELECT doc_id, k::BIGINT AS sample, lang || ':' || (doc_id * 7 + k) % 1000 AS seed, length(text)::BIGINT AS chars FROM documents, range(3) r(k)")
def generated_prompts(spark, sf_dir):
    """Three generated samples a document, from a data source of as many rows as that, joined with the documents."""

    def rows(first, last):
        for i in range(first, last):
            yield i // 3, i % 3, (i // 3 * 7 + i % 3) % 1000

    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id").alias("n")).first()["n"]
    generators.register(spark, "millrace_samples", "doc_id long, sample long, seed long", rows)
    made = spark.read.format("millrace_samples").option("rows", 3 * ((last if last is not None else -1) + 1)).option("partitions", 16).load()
    return made.join(docs, "doc_id").select("doc_id", "sample", F.concat("lang", F.lit(":"), F.col("seed").cast("string")).alias("seed"), F.length("text").cast("long").alias("chars"))


@query(
    "image_headers",
    """WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'png' WHEN page_id % 3 = 1 THEN 'gif' END AS format, (length(html) % 5000 + 1)::INT AS w, (page_id % 3000 + 1)::INT AS h FROM pages)
    SELECT page_id, format, CASE WHEN format IS NOT NULL THEN w END AS width, CASE WHEN format IS NOT NULL THEN h END AS height,
      CASE WHEN format IS NULL THEN NULL WHEN w * h <= 1000000 THEN w ELSE greatest(floor(w * sqrt(1000000.0 / (w * h))), 1)::INT END AS capped FROM s""",
)
def image_headers(spark, sf_dir):
    """Headers of PNG and GIF images made of the pages' lengths and numbers, before the pages' own bytes."""
    w, h = F.length("html") % 5000 + 1, (F.col("page_id") % 3000 + 1).cast("int")
    wide = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    small = lambda x: F.unhex(F.concat(F.substring(F.lpad(F.hex(x), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(x), 4, "0"), 1, 2)))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), wide(w), wide(h))
    gif = F.concat(F.lit("GIF89a").cast("binary"), small(w), small(h))
    content = F.concat(F.when(F.col("page_id") % 3 == 0, png).when(F.col("page_id") % 3 == 1, gif).otherwise(F.lit("<!").cast("binary")), F.col("html").cast("binary"))
    sized = table(spark, sf_dir, "pages").select("page_id", media.image_size(content).alias("s")).select("page_id", "s.*")
    cap = files.fit_size(F.col("width").cast("double"), F.col("height").cast("double"), 1_000_000)
    return sized.select("page_id", "format", "width", "height", F.when(F.col("width").isNotNull(), cap["width"].cast("int")).alias("capped"))


@query(
    "video_frames",
    """WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 2000 + 1)::INT AS total, l_quantity AS rate, CASE WHEN l_suppkey % 4 = 0 THEN (l_suppkey % 100)::INT END AS own, CASE WHEN l_suppkey % 4 = 1 THEN l_tax * 100 END AS fps FROM lineitem),
    f AS (SELECT *, CASE WHEN own IS NOT NULL THEN round_even(own / 2.0, 0) * 2 ELSE floor(least(least(greatest(total / rate * CASE WHEN fps IS NOT NULL THEN fps ELSE 1.5 END, ceil(CASE WHEN fps IS NULL THEN 6 ELSE 4 END / 2.0) * 2), floor(CASE WHEN fps IS NULL THEN 64 ELSE least(768, total) END / 2.0) * 2), total) / 2.0) * 2 END AS m FROM v)
    SELECT k AS l_orderkey, n AS l_linenumber, count(*) AS rows_, sum(CASE WHEN m >= 2 AND m <= total THEN m END)::BIGINT AS frames,
      sum(CASE WHEN m >= 2 AND m <= total THEN list_sum(list_transform(range(0, m::INT), lambda i: round_even((total - 1) * i / (m - 1), 0))) END)::BIGINT AS indices FROM f GROUP BY ALL""",
)
def video_frames(spark, sf_dir):
    """Frames of videos as long as lines' part numbers say, by their own rule or the caller's."""
    s = F.col("l_suppkey")
    own, fps, none = F.when(s % 4 == 0, (s % 100).cast("int")), F.when(s % 4 == 1, F.col("l_tax") * 100), F.lit(None)
    rule = media.sampling(own, fps, none, none, fps=1.5, least=6, most=64)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2000 + 1).cast("int").alias("total"), F.col("l_quantity").alias("rate"), rule.alias("rule"))
    rows = rows.withColumn("m", media.frame_count(F.col("total"), F.col("rate"), F.col("rule"))).withColumn("i", media.frame_indices(F.col("total"), F.col("m")))
    indices = F.aggregate("i", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows_"), F.sum("m").alias("frames"), F.sum(indices).alias("indices"))


@query("files_answers_resumed", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS at, length(text)::BIGINT AS chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def files_answers_resumed(spark, sf_dir):
    """Answers in JSON lines: a first run that does one half and fails on some, a second that does what is left, then one record each."""
    path = f"{shared_folder(spark)}/answers"
    todo = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    bad = F.col("model_answer").startswith("[API_ERROR]")
    failed = F.when(F.col("doc_id") % 7 == 0, "[API_ERROR] busy").otherwise(F.col("text"))
    files.write_lines(todo.where("doc_id % 2 = 0").select("doc_id", failed.alias("model_answer"), F.lit(1).cast("long").alias("at")), path, compression="gzip")
    rest = files.left_to_do(todo, path, "doc_id", ~bad)
    files.write_lines(rest.select("doc_id", F.col("text").alias("model_answer"), F.lit(2).cast("long").alias("at")), path, compression="gzip")
    files.compact_answers(spark, path, "doc_id", "doc_id long, model_answer string, at long", bad, "gzip")
    out = spark.read.schema("doc_id long, model_answer string, at long").json(path)
    return out.select("doc_id", "at", F.length("model_answer").cast("long").alias("chars"), F.md5("model_answer").alias("digest"))


@query("files_checked_formats", "SELECT doc_id, lang, md5(coalesce(text, '-')) AS digest, f.format FROM documents, (VALUES ('json'), ('parquet')) f(format)")
def files_checked_formats(spark, sf_dir):
    """All documents written as Parquet and as JSON lines in the shared folder and read again as rows, each by its reader."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    files.write_table(docs, f"{folder}/docs.parquet")
    files.write_lines(docs, f"{folder}/docs.jsonl", compression="gzip")
    out = lambda df, name: df.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit("-"))).alias("digest"), F.lit(name).alias("format"))
    return out(files.load_rows(spark, f"{folder}/docs.parquet"), "parquet").union(out(files.load_rows(spark, f"{folder}/docs.jsonl", docs.schema), "json"))


@query("files_hint_shards", "SELECT doc_id AS idx, md5('hint ' || (CASE WHEN doc_id % 5 = 0 THEN 'two ' ELSE 'one ' END) || text) AS digest FROM documents WHERE text IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 100")
def files_hint_shards(spark, sf_dir):
    """Hints in two shards of JSON lines, where the second has some anew: merged, the last of each that is long enough."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").where("text is not null and length(trim(BOTH ' \\t\\n\\r' FROM text)) >= 100")
    hint = lambda word: F.concat(F.lit(f"hint {word} "), "text").alias("reasoning")
    docs.select(F.col("doc_id").alias("idx"), hint("one")).write.json(f"{folder}/shard-0")
    docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("idx"), hint("two")).write.json(f"{folder}/shard-1")
    docs.where("doc_id % 5 = 1").select(F.col("doc_id").alias("idx"), F.lit("short").alias("reasoning")).write.json(f"{folder}/shard-2")
    hints, _ = files.merge_hints(spark, f"{folder}/shard-*", 1)
    return hints.select("idx", F.md5("reasoning").alias("digest"))
