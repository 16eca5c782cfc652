"""Reading and writing records.  Paths are anything that Spark's file systems resolve."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN = (".parquet", ".json", ".jsonl")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def file_system(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    (a, fs), (b, _) = file_system(spark, old), file_system(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't rename {old} to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Mends what a broken-off replacement left: the old table comes back unless the new one is there; unfinished ones go."""
    path = path.rstrip("/")
    if exists(spark, f"{path}.old"):
        if exists(spark, path):
            delete(spark, f"{path}.old")
        else:
            rename(spark, f"{path}.old", path)
    delete(spark, f"{path}.new")


def replace_table(df: DataFrame, path: str, write=None, between=None) -> None:
    """Writes df beside the table at a path, then puts it in its place by renaming; df may read the table itself.

    Until the last rename the old table can be had back by `recover`; readers never see a part of the new one.
    write(df, path) is Parquet unless given; between() is called between the renames, for tests that break it off."""
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    (write or (lambda d, p: d.write.option("compression", "zstd").parquet(p)))(df, f"{path}.new")
    if exists(spark, path):
        rename(spark, path, f"{path}.old")
    if between:
        between()
    rename(spark, f"{path}.new", path)
    delete(spark, f"{path}.old")


def left_to_do(todo: DataFrame, path: str, key: str, good: Column | None = None) -> DataFrame:
    """The rows of todo that the JSON lines at a path don't hold yet; `good` tells which of its records count as done."""
    spark = todo.sparkSession
    recover(spark, path)
    if not exists(spark, path):
        return todo
    done = spark.read.schema(f"`{key}` {todo.schema[key].dataType.simpleString()}, model_answer string").json(path)
    return todo.join((done.where(good) if good is not None else done).select(key).distinct(), key, "left_anti")


def compact_answers(spark: SparkSession, path: str, key: str, columns: str, bad: Column, compression: str = "none") -> None:
    """Rewrites the JSON lines of answers, appended in any number of runs, to one record a key: a good one before a bad one, then the last by `at`."""
    from ..operators.records import keep_last

    rows = spark.read.schema(columns).json(path).withColumn("_order", F.struct((~bad).alias("good"), F.col("at")))
    replace_table(keep_last(rows, [key], "_order").drop("_order"), path, lambda d, p: d.write.option("compression", compression).json(p))


def refuse_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def load_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet, or JSON lines; refused if there are no rows."""
    if path.rstrip("/").endswith(".parquet"):
        return refuse_empty(spark.read.parquet(path), path)
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("samplingRatio", 1.0)
    return refuse_empty(reader.json(path), path)


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one batch; columns that a file lacks are null.  Other endings are refused."""
    out = None
    for path in paths:
        if not path.endswith(KNOWN):
            raise ValueError(f"{path} is neither Parquet nor JSON")
        one = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def load_columns(spark: SparkSession, paths: list[str], columns: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Parquet files with columns (dotted for fields of structs) under new names; optional ones where they exist."""
    df = spark.read.parquet(*paths)
    extra = {k: c for k, c in (optional or {}).items() if c.split(".")[0] in df.columns}
    return df.select(*[F.col(c).alias(k) for k, c in ({**columns, **extra}).items()])


def load_preferences(spark: SparkSession, paths: list[str]) -> DataFrame:
    return load_columns(spark, paths, {c: c for c in ("prompt", "chosen", "rejected")})


def load_chats(spark: SparkSession, paths: list[str]) -> DataFrame:
    return load_columns(spark, paths, {"messages": "messages"}, {"tools": "tools", "enable_thinking": "enable_thinking"})


def nested(df: DataFrame, path: str) -> Column:
    """A dotted field; null where the schema lacks it."""
    kind = df.schema
    for name in path.split("."):
        fields = getattr(kind, "fields", None)
        at = next((f for f in fields if f.name == name), None) if fields else None
        if at is None:
            return F.lit(None)
        kind = at.dataType
    return F.col(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or JSON lines, told by the first character."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.option("multiLine", array).json(path)


def id_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct ids of JSON lines under the key or idx, as text; refused if a row has neither."""
    df = spark.read.json(path)
    have = [F.col(c).cast("string") for c in (key, "idx") if c in df.columns]
    if not have:
        raise ValueError(f"{path} has neither {key} nor idx")
    value = F.coalesce(*have, F.raise_error(F.lit(f"a row of {path} has neither {key} nor idx")))
    return df.select(value.alias("id")).distinct()


def edit_index(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """id and path of the files whose name matches the pattern; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.rlike(name, F.lit(pattern))).select(F.regexp_extract(name, pattern, 1).alias("id"), "path")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def shard_lines(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of many files: file, order (by file name, then place in the file), the parsed fields, and bad where a line isn't JSON."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.where(F.trim("value") != "").withColumn("r", parsed)
    return out.select("file", F.struct("file", "block", "at").alias("order"), "r.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def merge_hints(spark: SparkSession, pattern: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(hints by number, the last of each; counts of bad lines, refused hints and missing numbers)."""
    from ..functions.text import hint_is_usable
    from ..operators.records import keep_last, missing_numbers

    lines = shard_lines(spark, pattern, "idx long, reasoning string")
    good = lines.where(~F.col("bad") & hint_is_usable("reasoning"))
    last = keep_last(good.select("idx", "reasoning", "order"), ["idx"], "order").select("idx", "reasoning")
    counts = lines.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & ~hint_is_usable("reasoning")).alias("refused"))
    return last, counts.crossJoin(missing_numbers(last, n, "idx").agg(F.count("*").alias("missing")))


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_lines(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append", compression: str = "none") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_responses(prompts: DataFrame, responses: DataFrame, path: str) -> None:
    """prompts with an array of their responses, by sample number."""
    got = responses.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "text"))), lambda r: r["text"]).alias("responses"))
    write_table(prompts.join(got, "row_id", "left"), path)


def summary(df: DataFrame) -> str:
    """The one row of an aggregate as JSON with sorted keys."""
    return json.dumps(df.first().asDict(), sort_keys=True, default=str)


def metrics_line(df: DataFrame) -> DataFrame:
    """name and value rows as one line "step:n - name:value ..."."""
    one = F.concat(F.col("name"), F.lit(":"), F.format_string("%.3f", "value"))
    lines = df.groupBy("step").agg(F.array_join(F.sort_array(F.collect_list(one)), " - ").alias("_l"))
    return lines.select("step", F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - "), F.col("_l")).alias("line"))


def log_metrics(df: DataFrame, path: str) -> None:
    """name and value rows as JSON lines {"step", "data"}."""
    data = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data")
    write_lines(df.groupBy("step").agg(data), path)


def cache_key(*parts) -> str:
    return hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, key: str, compute) -> DataFrame:
    """The table under the key, computed and written if it isn't there."""
    path = f"{folder}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        write_table(compute(), path, "overwrite")
    return spark.read.parquet(path)


def call_service(df: DataFrame, column: str, client, attempts: int = 3) -> DataFrame:
    """df with reply and error: client(text) -> text on each row, a new try after a failure.  The client is sent to the executors."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def each(frames):
        for pdf in frames:
            replies, errors = [], []
            for value in pdf[column]:
                reply, error = None, None
                for _ in range(attempts):
                    try:
                        reply, error = client(value), None
                        break
                    except Exception as failure:  # what a service does wrong is a row's result
                        error = f"{type(failure).__name__}: {failure}"
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(reply=replies, error=errors)

    return df.mapInPandas(each, f"{kinds}, reply string, error string")


def fit_size(width: Column, height: Column, most: int) -> Column:
    """struct<width, height>: scaled down, sides rounded down, until they have at most that many pixels."""
    scale = F.sqrt(F.lit(float(most)) / (width * height))
    small = lambda x: F.greatest(F.floor(x * scale), F.lit(1)).cast("int")
    fits = width * height <= most
    return F.struct(F.when(fits, width).otherwise(small(width)).alias("width"), F.when(fits, height).otherwise(small(height)).alias("height"))


def data_uri(kind: str, content) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))
