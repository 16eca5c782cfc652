"""The driver's tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
TOKENS = {"rewards": "l_quantity", "mask": "if(l_returnflag <> 'R', 1, 0)", "values": "l_discount * 100", "log_prob": "-(l_tax * 10 + 0.1)", "old_log_prob": "-(l_discount * 8 + 0.15)", "ref_log_prob": "-(l_quantity / 50 + 0.05)", "advantages": "l_quantity - 25", "ids": "l_suppkey % 7"}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str):
    return lambda x: x[name]


def sequences(spark, sf_dir: str, *columns: str) -> DataFrame:
    """One row an order: row_id, uid (eight neighbouring order numbers) and the token arrays of its lines."""
    columns = columns or tuple(TOKENS)
    picked = F.sort_array(F.collect_list(F.struct(*ROW_KEY, *[F.expr(TOKENS[c]).alias(c) for c in columns])))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(picked.alias("t"))
    return rows.select("row_id", F.expr("row_id div 8").alias("uid"), *[F.transform("t", field(c)).alias(c) for c in columns])


#: One row a token; aggregates over row_id or uid give what the array operators give.
TOK = """
tok AS (
  SELECT l_orderkey AS row_id, l_orderkey // 8 AS uid,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos,
         l_quantity AS r, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS m, l_discount * 100 AS v,
         -(l_tax * 10 + 0.1) AS lp, -(l_discount * 8 + 0.15) AS old, -(l_quantity / 50 + 0.05) AS ref,
         l_quantity - 25 AS a, l_suppkey % 7 AS id
  FROM lineitem),
seq AS (SELECT row_id, min(uid) AS uid, sum(r) AS score, sum(m) AS len, count(*) AS size FROM tok GROUP BY row_id)
"""


def exploded(df: DataFrame, *columns: str) -> DataFrame:
    """row_id, pos and the columns' values, rounded, one row a token."""
    z = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return df.select("row_id", F.posexplode(z).alias("pos", "t")).select("row_id", F.col("pos").cast("long").alias("pos"), *[rounded(F.col(f"t.{c}")).alias(c) for c in columns])


def rounded(c, places: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)
