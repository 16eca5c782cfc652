"""Training rows held against what training needs: prompts, image paths, files, sizes; every problem with its row.

Files are a listing (path, width, height), so that "is there" is a join and sizes come from headers, not from decoded images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

# What is said about a row, and the instruction that prompts may not hold any more.
ONE_MESSAGE, ONE_IMAGE, OBSOLETE, RED_BOX = "prompt must have one user message", "prompt must contain one <image>", "obsolete red-box instruction", "red bounding box"


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def entry_path(entry: Column) -> Column:
    """The path of an image entry (struct<image, path>): the image, else the path; null if both are blank."""
    return F.coalesce(F.nullif(entry["image"], F.lit("")), F.nullif(entry["path"], F.lit("")))


def single_path(images: Column, root: str, what: str) -> Column:
    """struct<path, problem> of a list that must hold one image entry."""
    one = F.size(F.coalesce(images, F.array().cast("array<struct<image:string,path:string>>"))) == 1
    path = F.when(one, entry_path(F.try_element_at(images, F.lit(1))))
    problem = F.when(~one, f"{what} must contain exactly one image").when(path.isNull(), f"{what} has no image path")
    return F.struct(absolute(path, root).alias("path"), problem.alias("problem"))


def portable(images: Column) -> Column:
    """Is it one image, by a relative path?"""
    path = entry_path(F.try_element_at(images, F.lit(1)))
    return F.coalesce((F.size(images) == 1) & path.isNotNull() & ~path.startswith("/"), F.lit(False))


def half_of(student: Column, teacher: Column) -> Column:
    """Is a side half of the other, rounded down, give or take a pixel?"""
    return F.abs(student - F.greatest(F.lit(1), F.floor(teacher / 2))) <= 1


def prompt_problems(prompt: Column) -> Column:
    """Of an array of messages (struct<role, content>)."""
    first = F.try_element_at(prompt, F.lit(1))
    content = text(first["content"])
    one = F.coalesce(F.size(prompt) == 1, F.lit(False))
    image = (text(first["role"]) == "user") & (F.regexp_count(content, F.lit("<image>")) == 1)
    return F.array_compact(F.array(F.when(~one, ONE_MESSAGE), F.when(one & ~image, ONE_IMAGE), F.when(one & F.contains(F.lower(content), F.lit(RED_BOX)), OBSOLETE)))


def row_problems(df: DataFrame, files: DataFrame, root: str, ratio: bool = True, quick: int | None = None, row: str = "row_id") -> DataFrame:
    """Rows (row_id, prompt, images, teacher_images, ...) with problems, an array of texts; empty for good rows.

    Of images a row's first problem counts: the student's path, the teacher's, the student's file, the teacher's, their sizes.  quick: images of
    rows below that number alone are looked at.  ratio: the student's image must be half the teacher's.  A row whose sizes aren't known has no problem of sizes."""
    listed = lambda side: files.select(F.col("path").alias(f"_{side}_path"), F.struct("width", "height").alias(f"_{side}_size"))
    out = df.withColumn("_student", single_path(F.col("images"), root, "images")).withColumn("_teacher", single_path(F.col("teacher_images"), root, "teacher_images"))
    out = out.withColumn("_s_path", F.col("_student.path")).withColumn("_t_path", F.col("_teacher.path"))
    out = out.join(listed("s"), "_s_path", "left").join(listed("t"), "_t_path", "left")
    s, t = F.col("_s_size"), F.col("_t_size")
    fits = half_of(s["width"], t["width"]) & half_of(s["height"], t["height"])
    show = lambda z: F.format_string("(%d, %d)", z["width"], z["height"])
    half = lambda x: F.greatest(F.lit(1), F.floor(x / 2)).cast("long")
    unlike = F.concat(F.lit("student="), show(s), F.lit(", teacher="), show(t), F.lit(", expected~="), F.format_string("(%d, %d)", half(t["width"]), half(t["height"])))
    missing = lambda path: F.concat(F.lit("missing image file: "), path)
    image = F.coalesce(F.col("_student.problem"), F.col("_teacher.problem")).alias("p")
    image = F.when(image.isNotNull(), image).when(s.isNull(), missing(F.col("_s_path"))).when(t.isNull(), missing(F.col("_t_path")))
    image = image.when(F.lit(ratio) & ~fits, unlike)
    looked_at = F.col(row) < quick if quick is not None else F.lit(True)
    problems = F.concat(prompt_problems(F.col("prompt")), F.array_compact(F.array(F.when(looked_at, image))))
    return out.withColumn("problems", problems).drop("_student", "_teacher", "_s_path", "_t_path", "_s_size", "_t_size")


def row_report(checked: DataFrame, task: Column, most: int = 8, row: str = "row_id") -> DataFrame:
    """One row: rows, rows with problems, the first `most` problems by row number, whether all paths are relative, and rows a task."""
    named = F.transform("problems", lambda p: F.struct(F.col(row).alias("row"), p.alias("problem")))
    first = checked.select(F.explode(named).alias("p")).orderBy("p.row", "p.problem").limit(most).agg(F.sort_array(F.collect_list("p")).alias("first_problems"))
    tasks = checked.groupBy(F.coalesce(task, F.lit("")).alias("task")).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("task", "n"))).alias("tasks"))
    whole = checked.agg(F.count("*").alias("rows"), F.count_if(F.size("problems") > 0).alias("bad_rows"), F.bool_and(portable(F.col("images")) & portable(F.col("teacher_images"))).alias("portable_paths"))
    return whole.join(first).join(tasks)  # a row each
