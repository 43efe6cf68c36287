"""Duplicate chains, supersession, life cycle, reprocessing, work order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .order import numbered

DAY = 86_400


def duplicate_chain(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(component, earlier, later): pairs (a, b) of duplicates as chains of neighbours by (time, id)."""
    home = components(pairs).join(items.select(F.col("id").alias("node"), "time"), "node")
    order = Window.partitionBy("root").orderBy("time", "node")
    return home.select(F.col("root").alias("component"), F.lag("node").over(order).alias("earlier"), F.col("node").alias("later")).where("earlier is not null")


def projected(items: DataFrame, superseding: DataFrame, duplicates: DataFrame, anchors: DataFrame) -> DataFrame:
    """items (id, state, explicit) with next and superseded_by.

    superseding: (newer, older). duplicates: (id) of items with an active duplicate. anchors: (id,
    anchor). Superseded items are archived (the one superseder is named), so are extracted ones with a
    duplicate; explicit ones, or those with two independent anchors, are canonical; other extracted
    ones become knowledge.
    """
    over = superseding.groupBy(F.col("older").alias("id")).agg(F.when(F.count_distinct("newer") == 1, F.min("newer")).alias("superseded_by"), F.lit(True).alias("_over"))
    dup = duplicates.select("id").distinct().withColumn("_dup", F.lit(True))
    held = anchors.groupBy("id").agg(F.count_distinct("anchor").alias("_anchors"))
    all_of = items.join(over, "id", "left").join(dup, "id", "left").join(held, "id", "left")
    state = (
        F.when(F.col("_over"), "archived")
        .when((F.col("state") == "extracted") & F.col("_dup"), "archived")
        .when(F.col("explicit") | (F.col("_anchors") >= 2), "canonical")
        .when(F.col("state") == "extracted", "knowledge")
        .otherwise(F.col("state"))
    )
    return all_of.select(*items.columns, state.alias("next"), "superseded_by")


def eligible(state: Column, now: Column, source: Column, processed: Column, epoch_days: int = 30) -> Column:
    """Whether an item is due: extracted ones always; others once an epoch of their source time, or
    without one, since they were processed, has passed."""
    epoch = lambda t: F.floor(F.greatest(F.lit(0), t - source) / (epoch_days * DAY))
    by_source = processed.isNull() | (epoch(now) > epoch(processed))
    by_cooldown = processed.isNull() | (now - processed >= epoch_days * DAY)
    return (state == "extracted") | F.when(source.isNotNull(), by_source).otherwise(by_cooldown)


def claim_order(work: DataFrame, by: list[str], now: int) -> DataFrame:
    """Claimable work (priority, source_time, ..., state, lease_until, retry_after) with place: pending, or
    with a lapsed lease, or failed and due again; the lower priority number first."""
    ready = (F.col("state") == "pending") | ((F.col("state") == "processing") & (F.col("lease_until") <= now)) | ((F.col("state") == "failed") & (F.col("retry_after") <= now))
    return numbered(work.where(ready), ["priority", "source_time", *by], "place").withColumn("place", F.col("place") + 1)


def state_counts(work: DataFrame, states: list[str]) -> DataFrame:
    """One row with the number of work items in each state."""
    return work.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
