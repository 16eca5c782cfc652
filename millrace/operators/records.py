"""Operators on batches of records: projection, joins, dedupe, reshape, order.

A batch is a DataFrame with a row number `row_id` from 0; operators that change rows say what
becomes of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "row_id"


def settled(df: DataFrame) -> DataFrame:
    """df with its rows and their partitions fixed: checkpointed where spark.checkpoint.dir is set; else cached if all tasks run here (tests), an error on a cluster."""
    context = df.sparkSession.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not where:
            return df.persist()
        context.setCheckpointDir(where)
    return df.checkpoint()


def accumulated(df: DataFrame, *order, value: Column, name: str) -> DataFrame:
    """Running sums of the value in the given order.

    Ranges of the order are summed in parallel; then the sums of the ranges before, a row a range, are added.
    No task sees more than its range.  Rows that the order doesn't tell apart come in any order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = settled(df.withColumn("_v", value).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum("_v").alias("_n")).select("_part", F.sum("_n").over(before).alias("_start"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_own", own).join(F.broadcast(starts), "_part")
    return summed.withColumn(name, F.col("_own") + F.coalesce("_start", F.lit(0))).drop("_v", "_part", "_own", "_start")


def numbered(df: DataFrame, *order, name: str = ROW) -> DataFrame:
    """Dense numbers from 0 in the given order."""
    return accumulated(df, *order, value=F.lit(1), name=name).withColumn(name, (F.col(name) - 1).cast("long"))


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the batch without the columns, row numbers with the columns)."""
    return df.drop(*columns), df.select(ROW, *columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names for {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new)))


def take(df: DataFrame, indices: list[int]) -> DataFrame:
    """The rows of those numbers, in that order and as often; renumbered."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(int(i)).cast("long") for i in indices])).alias("_pos", ROW))
    return df.join(F.broadcast(wanted), ROW).withColumn(ROW, F.col("_pos").cast("long")).drop("_pos")


def cut(df: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... below end; their numbers stay."""
    at = F.col(ROW)
    return df.where((at >= start) & (at < end) & ((at - start) % step == 0))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row by row, the columns of both; a shared column must agree (null and NaN with themselves)."""
    shared = [c for c in a.columns if c in b.columns and c != ROW]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    out = a.join(right, ROW, "full_outer")
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs between the batches")).cast(dict(a.dtypes)[c])))
    return out.drop(*[f"_b_{c}" for c in shared])


def lookup(df: DataFrame, side: DataFrame, keys: list[str], order: str, value: str, name: str, default=None) -> DataFrame:
    """df with the side's value under the keys; of the side's rows under one key the last counts."""
    last = side.groupBy(*keys).agg(F.max_by(value, order).alias(name))
    joined = df.join(last, keys, "left")
    return joined if default is None else joined.withColumn(name, F.coalesce(name, F.lit(default)))


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last by the order."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def compact_answers(df: DataFrame, uid: str, bad: Column, order: str) -> DataFrame:
    """One row a uid: a good one beats a bad one, then the later wins; `first_seen` is where the uid came first."""
    rest = [c for c in df.columns if c != uid]
    marked = df.withColumn("_bad", bad)
    one = marked.groupBy(uid).agg(F.max_by(F.struct(*rest), F.struct(~F.col("_bad"), F.col(order))).alias("_r"), F.min(order).alias("first_seen"))
    return one.select(uid, *[F.col(f"_r.{c}").alias(c) for c in rest], "first_seen")


def missing_numbers(df: DataFrame, n: int, column: str = ROW) -> DataFrame:
    """Which of 0..n-1 the column lacks."""
    return df.sparkSession.range(n).withColumnRenamed("id", column).join(df.select(column).distinct(), column, "left_anti")


def misaligned(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """How many rows of the shorter batch differ from the other in the column, and the first that does."""
    pairs = a.select(ROW, F.col(column).alias("_a")).join(b.select(ROW, F.col(column).alias("_b")), ROW)
    differ = ~F.col("_a").eqNullSafe(F.col("_b"))
    return pairs.agg(F.count_if(differ).alias("mismatches"), F.min(F.when(differ, F.col(ROW))).alias("first_mismatch"))


def runs(df: DataFrame, value: str, order: str) -> DataFrame:
    """run: number of the stretch of equal neighbouring values, from 0; run_pos: place in it."""
    rows = numbered(df, order, name="_i")
    before = rows.select((F.col("_i") + 1).alias("_i"), F.col(value).alias("_before"))
    new = F.when((F.col("_i") > 0) & ~F.col(value).eqNullSafe(F.col("_before")), 1).otherwise(0)
    out = accumulated(rows.join(before, "_i", "left"), "_i", value=new, name="run").drop("_before")
    first = out.groupBy("run").agg(F.min("_i").alias("_first"))
    return out.join(first, "run").withColumn("run_pos", F.col("_i") - F.col("_first")).drop("_i", "_first")


def repeat(df: DataFrame, times: int, interleave: bool = True, count: int | None = None) -> DataFrame:
    """Each row `times` times, next to each other or batch by batch; renumbered."""
    each = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        place = F.col(ROW) * times + F.col("_j")
    else:
        place = F.col("_j") * F.lit(df.count() if count is None else count) + F.col(ROW)
    return each.withColumn(ROW, place.cast("long")).drop("_j")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as it says; 0 drops it.  `copy` numbers the copies."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def concat(*batches: DataFrame) -> DataFrame:
    """Batches one after another; columns that one lacks are null; renumbered."""
    out, offset = None, 0
    for b in batches:
        moved = b.withColumn(ROW, F.col(ROW) + F.lit(offset))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        offset += b.count()
    return out


def chunk(df: DataFrame, parts: int, count: int | None = None, strict: bool = True) -> DataFrame:
    """chunk: which of `parts` equal stretches the row is in."""
    n = df.count() if count is None else count
    if strict and n % parts:
        raise ValueError(f"{n} rows don't divide into {parts}")
    size = -(-n // parts)
    return df.withColumn("chunk", F.floor(F.col(ROW) / F.lit(max(size, 1))).cast("int"))


def batches(df: DataFrame, size: int, count: int | None = None, drop_last: bool = False) -> DataFrame:
    """batch: which stretch of `size` rows the row is in; without the last if it isn't full and drop_last."""
    out = df.withColumn("batch", F.floor(F.col(ROW) / F.lit(size)).cast("int"))
    return out.where(F.col("batch") < (df.count() if count is None else count) // size) if drop_last else out


def pad_to(df: DataFrame, divisor: int, count: int | None = None) -> DataFrame:
    """Rows from the head, again and again, until the divisor divides their number; `padding` marks them."""
    n = df.count() if count is None else count
    missing = -n % divisor
    if not n or not missing:
        return df.withColumn("padding", F.lit(False))
    extra = df.sparkSession.range(missing).select((F.col("id") + n).alias("_new"), (F.col("id") % n).alias(ROW))
    more = df.join(F.broadcast(extra), ROW).withColumn(ROW, F.col("_new")).drop("_new").withColumn("padding", F.lit(True))
    return df.withColumn("padding", F.lit(False)).unionByName(more)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("padding")).drop("padding")


def pad_with(df: DataFrame, n: int, candidate: str = "last", count: int | None = None) -> DataFrame:
    """n more copies of the first or last row."""
    size = df.count() if count is None else count
    one = df.where(F.col(ROW) == (0 if candidate == "first" else size - 1))
    more = one.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(ROW, F.col("_j").cast("long") + size).drop("_j") if n else one.limit(0)
    return df.unionByName(more)


def unfold(df: DataFrame, parts: int, *columns: str) -> DataFrame:
    """The arrays cut into `parts` equal pieces, a row each; other columns repeated.  Renumbered."""
    each = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        size = F.floor(F.size(c) / parts).cast("int")
        each = each.withColumn(c, F.slice(c, F.col("_j") * size + 1, size))
    return each.withColumn(ROW, F.col(ROW) * parts + F.col("_j")).drop("_j")


def fold(df: DataFrame, size: int) -> DataFrame:
    """Stretches of `size` rows as one row of arrays, in order."""
    rest = [c for c in df.columns if c != ROW]
    grouped = df.groupBy(F.floor(F.col(ROW) / size).cast("long").alias("_g")).agg(F.sort_array(F.collect_list(F.struct(ROW, *rest))).alias("_r"))
    return grouped.select(F.col("_g").alias(ROW), *[F.transform("_r", _field(c)).alias(c) for c in rest])


def _field(name: str):
    return lambda x: x[name]


def reorder(df: DataFrame, places: DataFrame) -> DataFrame:
    """places: row_id and new_pos; rows get their new numbers."""
    return df.join(places, ROW).withColumn(ROW, F.col("new_pos").cast("long")).drop("new_pos")


def reversed_places(df: DataFrame) -> DataFrame:
    """Places that turn the batch round: row_id and new_pos."""
    top = df.agg(F.max(ROW).alias("_top"))
    return df.select(ROW).crossJoin(F.broadcast(top)).select(ROW, (F.col("_top") - F.col(ROW)).alias("new_pos"))


def list_to_columns(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One array a key, from an array of maps; a map that lacks a key, and one that has another, are refused."""
    other = F.exists(column, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, keys)))) > 0)
    lacks = F.exists(column, lambda m: F.size(m) < len(keys))
    checked = F.when(other | lacks, F.raise_error(F.lit(f"a row's keys aren't {', '.join(keys)}")).cast("boolean")).otherwise(True)
    return df.where(checked).select(ROW, *[F.transform(column, _field(k)).alias(k) for k in keys])


def resolved_path(root: str, entry: Column) -> Column:
    """The single image path, made absolute."""
    return F.when(entry.startswith("/"), entry).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), entry))


def dual_world(rows: DataFrame, edits: DataFrame, good: DataFrame | None = None, only: DataFrame | None = None, key: str = "item") -> DataFrame:
    """World B of each row is its edit, if there is one (and it is listed as good, if there is a list), else its own
    image.  only: ids of the rows to keep (an error if none is).  Adds has_edit, world_b and idx, dense in order.

    rows: row_id, the key, image; edits: key, edit."""
    if only is not None:
        rows = rows.join(only.select(key).distinct(), key, "left_semi")
    found = edits.groupBy(key).agg(F.max("edit").alias("edit"))
    if good is not None:
        found = found.join(good.select(key).distinct(), key, "left_semi")
    out = rows.join(found, key, "left").withColumn("has_edit", F.col("edit").isNotNull()).withColumn("world_b", F.coalesce("edit", "image")).drop("edit")
    return numbered(out, ROW, name="idx")


def build_summary(built: DataFrame, edits: DataFrame, key: str = "item") -> DataFrame:
    """Rows with an edit, without one, and edits that no row has."""
    unmatched = edits.select(key).distinct().join(built.select(key), key, "left_anti").agg(F.count("*").alias("unmatched"))
    return built.agg(F.count_if("has_edit").alias("with_edit"), F.count_if(~F.col("has_edit")).alias("fallback")).crossJoin(unmatched)


def with_hints(rows: DataFrame, hints: DataFrame, least: int = 100) -> DataFrame:
    """hint by row number; refused unless every row has a usable one.  hints: row_id, order, hint."""
    from ..functions.text import hint_is_usable

    usable = keep_last(hints.where(hint_is_usable("hint", least)), [ROW], "order").select(ROW, "hint")
    out = rows.join(usable, ROW, "left")
    return out.withColumn("hint", F.coalesce("hint", F.raise_error(F.concat(F.lit("no usable hint for row "), F.col(ROW).cast("string")))))
