import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import sampling as P


def test_orders_are_the_same_for_any_partitioning(spark):
    rows = spark.range(60).withColumnRenamed("id", "row_id")
    got = [sorted((r.row_id, r.epoch, r.batch) for r in P.epochs(rows.repartition(n), 20, 3, seed=5).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len({tuple(b for _, e, b in got[0] if e == k) for k in range(3)}) == 3
    with pytest.raises(ValueError, match="divide"):
        P.epochs(rows, 7, 1)
    with pytest.raises(ValueError, match="sampler"):
        P.sampler(rows, "other")


def test_refusals(spark):
    one = spark.createDataFrame([("img/x.png", ["a"], ["b", "c"], 1, "q", 1)], "image string, images array<string>, teacher_images array<string>, placeholders int, question string, row_id int")
    options = spark.createDataFrame([(4, "A", 1)], "number int, option string, order int")
    for frame in (P.edited_answer(one, options), P.edited_answer(one.withColumn("image", F.lit("idx5_edited.png")), options), P.teacher_prompts(one, "swap"), P.teacher_prompts(one.withColumn("teacher_images", F.lit(None).cast("array<string>")), "swap")):
        with pytest.raises(PySparkException):
            frame.collect()
    with pytest.raises(PySparkException, match="two values"):
        one.select(P.merged_metadata(F.create_map(F.lit("k"), F.lit("a")), F.create_map(F.lit("k"), F.lit("b")))).collect()
    assert P.edited_answer(one.withColumn("image", F.lit("x/idx4_edited.png")), options).first()["answer"] == "A"
