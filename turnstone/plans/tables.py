"""The driver's tables in the shape that operators expect, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table

#: A conversation's turns are a minute apart, conversations an hour; nanoseconds.
MINUTE = 60 * 10**9


def micros(time: str) -> Column:
    """Microseconds since the epoch of a time without zone (UTC)."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, id, parent_id, turn, role, content, timestamp_ns): conversations as linear trees."""
    t = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn").cast("long")
    name = F.concat_ws(":", conv, turn)
    parent = F.when(turn > 0, F.concat_ws(":", conv, turn - 1))
    at = (conv * 60 + turn) * MINUTE
    return t.select(conv.alias("conversation_id"), name.alias("id"), parent.alias("parent_id"), turn.alias("turn"), "role", F.col("text").alias("content"), at.alias("timestamp_ns"))


TURNS_SQL = f"""turns AS (
    SELECT conv_id AS conversation_id, conv_id || ':' || turn AS id,
           CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_id,
           CAST(turn AS BIGINT) AS turn, role, text AS content,
           (conv_id * 60 + turn) * {MINUTE} AS timestamp_ns
    FROM conversations)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as trees with branches: every turn whose number is divisible by 3 hangs on the turn
    two before it, so that turn 1 of each such pair ends a branch."""
    t = turns(spark, sf_dir)
    back = F.when((F.col("turn") >= 3) & (F.col("turn") % 3 == 0), 2).otherwise(1)
    parent = F.when(F.col("turn") > 0, F.concat_ws(":", "conversation_id", F.col("turn") - back))
    return t.withColumn("parent_id", parent)


TREE_SQL = TURNS_SQL + """, tree AS (
    SELECT conversation_id, id,
           CASE WHEN turn > 0 THEN conversation_id || ':' || (turn - CASE WHEN turn >= 3 AND turn % 3 = 0 THEN 2 ELSE 1 END) END AS parent_id,
           turn, role, content, timestamp_ns
    FROM turns)"""
