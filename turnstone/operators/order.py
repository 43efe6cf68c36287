"""Places in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def in_runs(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with `name`, a number that grows with keys but leaves gaps; written in sorted runs."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), "runs")


def numbered(rows: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """rows with their place by keys, from 0. Rows equal in keys come in any order.

    Sorted runs are written; a row's number has its run's in the upper bits, so that one row a run,
    with the number of rows before it, is all that meets in a task.
    """
    runs = in_runs(rows, keys, "_at").withColumn("_run", F.shiftright("_at", 33))
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_begin"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a run
    shifts = cut(sizes.select("_run", (before - F.col("_begin")).alias("_shift")), "shifts")
    return runs.join(shifts, "_run").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")
