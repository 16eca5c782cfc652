"""A corpus pipeline: five stages over documents, each by an operator of the llm subpackage.

Stages take (spark, docs, sf_dir).  All but the last return the columns of documents; between
stages the rows are written as Parquet and read again.

Documents may have further columns, whatever their names: inside a stage they are called c0, c1, ...  A null text counts as
empty, and very long ones are worked on like any other.  Equal rows get equal results in all stages but near_dedup, which keeps one of them; rows without
doc_id, and rows that repeat one, are documents of their own.  An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, col, delete_folder, new_folder, read, written
from millrace.llm.decontamination import decontamination
from millrace.llm.near_copies import near_copies
from millrace.llm.packing import packing
from millrace.llm.pii import find_pii, redacted
from millrace.llm.quality import quality_classifier
from millrace.llm.simhash_dedup import simhash_dedup

#: SQL has neither the classifier, the fingerprints nor the tokenizer.
ORACLE_SQL = None


def inner(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names that no operator uses."""
    return docs.select(*[col(c) if c in ("doc_id", "text") else col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def outer(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names."""
    return out.select(*[col(c) if c in ("doc_id", "text") else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the best grade is at least one half."""
    rows = inner(docs)
    return outer(quality_classifier(rows, read(spark, sf_dir, "labels"), columns=rows.columns).where("kept"), docs)


def beaten(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """Of rows and their components, the rows that aren't the first of their component by doc_id (null: last), then row."""
    rows = groups.join(ids, "row")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return rows.join(first, "component").where("row <> first.row").select("row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of smallest doc_id.

    Groups are those of op6, and of what these leave those that 5-word shingles connect (Jaccard 0.8 or more).  Every row has
    a number of its own here, so that unlike texts of one doc_id both stay, and texts without doc_id take part."""
    rows = written(inner(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    ids, texts = rows.select("row", "doc_id"), rows.select(F.col("row").alias("doc_id"), "text")
    # rows of an empty text are copies of each other; those of equal fingerprints or few differing bits too
    copies = checkpoint(beaten(simhash_dedup(texts).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), ids))
    rest = texts.join(copies.select(F.col("row").alias("doc_id")), "doc_id", "left_anti")
    near = checkpoint(beaten(near_copies(rest).select(F.col("id").alias("row"), "component"), ids))
    return outer(rows.join(copies.union(near), "row", "left_anti"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in 20 or more lies in a benchmark passage."""
    rows = inner(docs)
    return outer(decontamination(rows, read(spark, sf_dir, "benchmark"), columns=rows.columns).where("not contaminated"), docs)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in place of personal data and secrets, and counts characters again where that changes a text."""
    rows = inner(docs)
    hidden = find_pii(rows, columns=rows.columns).withColumn("text", redacted(F.col("text"), F.col("pii")))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        hidden = hidden.withColumn(n, F.when(F.size("pii") > 0, F.length("text")).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return outer(hidden, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", hide_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again; a
    stage's rows are deleted once the next one's are written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
