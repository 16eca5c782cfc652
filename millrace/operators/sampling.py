"""Orders of rows for training, teachers' hints, and answers of edited images.

Seeded orders come from MD5 of seed, epoch and row, so that they are the same for every partitioning and on every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import ROW, numbered

# Fixed value: how an edited image's name tells the row it was made for.
EDIT_NAME = r"idx(\d+)_edited"


def drawn(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(ROW).cast("string")))


def sampler(df: DataFrame, kind: str = "sequential", seed: int = 0, difficulty: Column | None = None) -> DataFrame:
    """position: the place of each row, from 0 - its own ("sequential"), a seeded one ("shuffle"), or by difficulty ("curriculum")."""
    if kind == "sequential":
        return df.withColumn("position", F.col(ROW))
    if kind == "curriculum":
        if difficulty is None:
            raise ValueError("a curriculum needs a difficulty")
        return numbered(df.withColumn("_d", difficulty), "_d", ROW, name="position").drop("_d")
    if kind != "shuffle":
        raise ValueError(f"no sampler is called {kind}")
    return numbered(df.withColumn("_d", drawn(seed, F.lit(0))), "_d", ROW, name="position").drop("_d")


def epochs(df: DataFrame, size: int, times: int, seed: int | None = None, count: int | None = None) -> DataFrame:
    """epoch, batch: every row once an epoch in batches of `size`, in a seeded order of each epoch or in its own.

    The size must divide the number of rows."""
    n = df.count() if count is None else count
    if n % size:
        raise ValueError(f"{n} rows don't divide into batches of {size}")
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if seed is None:
        place = F.col(ROW)
    else:
        rows = numbered(rows.withColumn("_d", drawn(seed, F.col("epoch"))), "epoch", "_d", ROW, name="_p")
        place = F.col("_p") - F.col("epoch") * n
    return rows.withColumn("batch", F.floor(place / size).cast("long")).drop("_d", "_p")


def grown(df: DataFrame, more: DataFrame, fits: Column) -> DataFrame:
    """df and those of the new rows that fit, numbered on."""
    return df.unionByName(numbered(more.where(fits), ROW, name=ROW).withColumn(ROW, F.col(ROW) + df.count()))


def merged_metadata(a: Column, b: Column) -> Column:
    """Two maps as one; a key with two values is refused."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    clash = F.filter(both, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    more = F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(a), k))
    return F.when(F.size(clash) > 0, F.raise_error(F.concat(F.lit("two values of "), clash[0])).cast("map<string,string>")).otherwise(F.map_concat(a, more))


def filled(x: Column) -> Column:
    """Null for blank texts."""
    return F.when(F.rlike(x, F.lit(r"(?U)\S")), x)


def teacher_hint(hint: Column, ground_truth: Column, answer: Column) -> Column:
    """The hint, if it isn't blank, else the ground truth, else the other answer; null if what is taken is blank."""
    return filled(F.coalesce(filled(hint), ground_truth, answer))


def swapped(images: Column, own: Column, placeholders: Column, fallback: bool) -> Column:
    """struct<images, mask>: the other images, one for each placeholder; without them the row's own and mask 0, if that is allowed."""
    few = F.coalesce(F.size(images), F.lit(0))
    other = F.when(few != placeholders, F.raise_error(F.concat(F.lit("images for placeholders: "), few.cast("string"), F.lit(" for "), placeholders.cast("string"))).cast("array<string>")).otherwise(images)
    none = own if fallback else F.raise_error(F.lit("no teacher images")).cast("array<string>")
    return F.when(few > 0, F.struct(other.alias("images"), F.lit(1.0).alias("mask"))).otherwise(F.struct(none.alias("images"), F.lit(0.0).alias("mask")))


def teacher_prompts(df: DataFrame, mode: str, fallback: bool = False, question: str = "question") -> DataFrame:
    """prompt, images and mask of the teacher's side.

    "hint": the question and the hint (columns hint, ground_truth, answer); mask 0 without one.
    "swap": the question over teacher_images, one for each of `placeholders`.
    "reprompt": the question, a successful peer's reply and feedback (columns peer, feedback); mask 0 with neither."""
    q, own = F.col(question), F.col("images")
    if mode == "hint":
        hint = teacher_hint(F.col("hint"), F.col("ground_truth"), F.col("answer"))
        return df.withColumn("mask", F.when(hint.isNull(), 0.0).otherwise(1.0)).withColumn("prompt", F.concat_ws("\n\n", q, hint))
    if mode == "swap":
        side = swapped(F.col("teacher_images"), own, F.col("placeholders"), fallback)
        return df.withColumn("_s", side).withColumn("prompt", q).withColumn("mask", F.col("_s.mask")).withColumn("images", F.col("_s.images")).drop("_s")
    if mode != "reprompt":
        raise ValueError(f"no mode is called {mode}")
    peer, feedback = filled(F.col("peer")), filled(F.col("feedback"))
    return df.withColumn("mask", F.when(peer.isNull() & feedback.isNull(), 0.0).otherwise(1.0)).withColumn("prompt", F.concat_ws("\n\n", q, peer, feedback))


def edited_answer(df: DataFrame, options: DataFrame, image: str = "image") -> DataFrame:
    """answer: the option that the edit made true, found by the row number in the image's name.

    options: number, option; of one number's rows the last by `order` counts.  A name without number, and a number without
    option, are errors."""
    number = F.regexp_extract(image, EDIT_NAME, 1)
    last = options.groupBy(F.col("number").cast("long").alias("_n")).agg(F.max_by("option", "order").alias("_o"))
    rows = df.withColumn("_n", F.when(number == "", F.raise_error(F.concat(F.lit("no row number in "), F.col(image))).cast("long")).otherwise(number.cast("long")))
    missing = F.raise_error(F.concat(F.lit("no option for row "), F.col("_n").cast("string"))).cast("string")
    return rows.join(last, "_n", "left").withColumn("answer", F.coalesce("_o", missing)).drop("_n", "_o")


def nucleus(df: DataFrame, key: str, logit: str, top_k: int = 0, top_p: float = 1.0, order: str = "slot") -> DataFrame:
    """logit: null outside the top_k largest (ties of the last stay) and outside the smallest set of slots that holds top_p of the probability.

    One row a slot; slots of a key are one group of bounded size, the vocabulary."""
    w = Window.partitionBy(key)
    out = df
    if top_k:
        out = out.withColumn("_r", F.rank().over(w.orderBy(F.desc(logit)))).withColumn(logit, F.when(F.col("_r") <= top_k, F.col(logit))).drop("_r")
    if top_p < 1:
        p = F.exp(F.col(logit) - F.max(logit).over(w))
        out = out.withColumn("_p", F.coalesce(p / F.sum(p).over(w), F.lit(0.0)))
        before = F.coalesce(F.sum("_p").over(w.orderBy(F.desc_nulls_last(logit), order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        out = out.withColumn("_b", before).withColumn(logit, F.when(F.col("_b") < top_p, F.col(logit))).drop("_p", "_b")
    return out
