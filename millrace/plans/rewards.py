"""Queries over reward managers and tool calls (survey blocks 2.13, 2.15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import managers as G
from .catalog import query
from .tables import TOK, rounded, sequences, table

SCORED = "least(-(len - 3) / 4 * 0.5, 0)"
RIGHT = "(row_id % 5 = row_id % 3)::INT"


def answered(spark, sf_dir):
    """Sequences with an answer that is right where the order number is alike modulo 5 and 3."""
    i = F.col("row_id")
    return sequences(spark, sf_dir, "mask").select("row_id", "mask", F.lit("school").alias("data_source"), F.concat(F.lit("so #### "), (i % 5).cast("string")).alias("response"), (i % 3).cast("string").alias("gold"))


def total(df):
    rows = df.withColumn("reward", rounded(F.aggregate("rewards", F.lit(0.0), lambda a, b: a + b)))
    return rows.withColumn("score", rounded(F.col("score")))


@query("reward_naive", f"WITH {TOK} SELECT row_id, {RIGHT}::DOUBLE AS score, CASE WHEN len > 0 THEN {RIGHT} ELSE 0 END::DOUBLE AS reward FROM seq")
def reward_naive(spark, sf_dir):
    return total(G.rewarded(answered(spark, sf_dir), "naive", routes={"school": "gsm8k"})).select("row_id", "score", "reward")


@query(
    "reward_dapo",
    f"WITH {TOK} SELECT row_id, {RIGHT}::DOUBLE AS score, len > 3 AS overlong, round({SCORED}, 6) + 0.0 AS overlong_reward, round(CASE WHEN len > 0 THEN {RIGHT} + {SCORED} ELSE 0 END, 6) + 0.0 AS reward FROM seq",
)
def reward_dapo(spark, sf_dir):
    out = G.rewarded(answered(spark, sf_dir), "dapo", routes={"school": "gsm8k"}, longest=7, buffer=4, factor=0.5)
    return total(out).select("row_id", "score", "overlong", rounded(F.col("overlong_reward")).alias("overlong_reward"), "reward")


GIVEN = "CASE WHEN row_id % 4 = 0 THEN 0.25 END"


@query("reward_given", f"WITH {TOK} SELECT row_id, coalesce({GIVEN}, {RIGHT})::DOUBLE AS score, CASE WHEN len > 0 THEN coalesce({GIVEN}, {RIGHT}) ELSE 0 END::DOUBLE AS reward FROM seq")
def reward_given(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("given_score", F.when(F.col("row_id") % 4 == 0, 0.25))
    return total(G.rewarded(rows, "naive", routes={"school": "gsm8k"})).select("row_id", "score", "reward")


@query("reward_free", f"WITH {TOK} SELECT row_id, coalesce({GIVEN}, 0)::DOUBLE AS score, CASE WHEN len > 0 THEN coalesce({GIVEN}, 0) ELSE 0 END::DOUBLE AS reward FROM seq")
def reward_free(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("given_score", F.when(F.col("row_id") % 4 == 0, 0.25))
    return total(G.rewarded(rows, "naive", reward_free=True)).select("row_id", "score", "reward")


def by_lengths(pdf: pd.DataFrame) -> pd.Series:
    return pdf["response"].str.len().astype("float64")


def unless_toxic(pdf: pd.DataFrame) -> pd.Series:
    if (pdf["toxic"] == 1).any():
        raise ValueError("not scored")
    return pdf["quality"].astype("float64")


@query("reward_batch", "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS score FROM documents")
def reward_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("response"), F.array(F.lit(1)).alias("mask"))
    return G.rewarded(rows, "batch", function=by_lengths).select("doc_id", "score")


@query("reward_prime", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END::DOUBLE AS score FROM labels")
def reward_prime(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.array(F.lit(1)).alias("mask"))
    return G.rewarded(rows, "prime", function=unless_toxic).select("doc_id", "score")


@query("tool_channel_calls", "SELECT conv_id, turn, 'look' AS name, '{\"turn\": ' || turn || '}' AS arguments, 'ok ' || coalesce(text, '') AS content FROM conversations")
def tool_channel_calls(spark, sf_dir):
    """A thought, the turn's whole text and a call, in the channel format."""
    text = F.coalesce("text", F.lit(""))
    mark = lambda kind: F.lit(f"<|start|>assistant<|channel|>{kind}<|message|>")
    said = F.concat(mark("analysis"), text, F.lit("<|end|>ok "), text, mark("commentary to=functions.look <|constrain|>json"), F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}<|call|>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return rows.select("conv_id", "turn", F.explode(T.channel_calls("said")).alias("c"), T.without_channel_calls("said").alias("content")).select("conv_id", "turn", "c.name", "c.arguments", "content")
