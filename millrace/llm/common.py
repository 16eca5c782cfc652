"""What several operators share: folders on the cluster, chunking, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents holds on average.
CHUNK_BYTES = 2 << 20
#: Tasks over which the edges of one node are spread.
SALTS = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """The column of exactly that name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: list[str], name: str) -> str:
    """The name, with as many underscores as it takes to be none of those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def passed_names(columns: list[str], outputs: list[str]) -> list[str]:
    """Names under which input columns are passed on: one that is called like an output gets "_input" behind it."""
    out: list[str] = []
    for c in columns:
        out.append(free_name([*columns, *outputs, *out], c + "_input") if c.lower() in outputs else c)
    return out


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where that is unset, a folder of this machine if all tasks run here (tests), else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as compressed Parquet in the shared folder, read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def chunk_count(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """So many groups that each holds about chunk_bytes of text; at least one a shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes))


def part_count(docs: DataFrame, chunks: int) -> int:
    """So many parts for what chunks send each other by key."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks // 3)


def chunked(docs: DataFrame, chunks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, doc_id, text): documents dealt to chunks by the hash of their id."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


def salted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with m of their u; a node of very many edges is dealt to SALTS tasks."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    right = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge its smallest reachable node.

    Alternates two joins, each of which hooks every node to the smallest neighbour that it
    knows (large star, small star); all aggregates are minima, so that a hub needs no list of
    its neighbours.  Rounds grow with the logarithm of the longest chain.  Each round is
    checkpointed, and the loop ends when no edge changes.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = checkpoint(e)
    last = None
    for _ in range(max_rounds):
        # large star: all neighbours above a node go to the smallest of the node and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's lower neighbours and itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted(large, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = checkpoint(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
