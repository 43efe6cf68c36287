"""A work queue as tables: leases, failures, retries, deferral, and what a background pass takes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_trimmed

#: The least delay after a model's backpressure, and the most items that a pass takes up (fixed values).
LEAST_DELAY, PASS_ITEMS = 60, 64


def delay(hint: Column) -> Column:
    """Seconds to wait after backpressure: the hint, if there is one, but not less than a minute."""
    return F.greatest(F.coalesce(hint, F.lit(0)), F.lit(LEAST_DELAY))


def due(work: DataFrame, now: int) -> DataFrame:
    """work (state, lease_until, retry_after, token) with what is due at now promoted: failed work whose
    retry has come and work whose lease has lapsed are pending again, without lease or retry."""
    again = ((F.col("state") == "failed") & (F.col("retry_after") <= now)) | ((F.col("state") == "processing") & (F.col("lease_until") <= now))
    again = F.coalesce(again, F.lit(False))
    none = lambda c: F.when(~again, F.col(c)).alias(c)
    cleared = {"state": F.when(again, "pending").otherwise(F.col("state")).alias("state"), **{c: none(c) for c in ("lease_until", "retry_after", "token")}}
    return work.select(*(cleared.get(c, F.col(c)) for c in work.columns))


def transitions(work: DataFrame, commands: DataFrame) -> DataFrame:
    """work after commands, with outcome: `-` (none), `done`, or why a command changes nothing.

    work: (episode_id, state, token, lease_until, retry_after, error); commands: one at most for each
    episode, (episode_id, op, token, at, until, reason). `renew` and `fail`, `terminal`, `complete` need the
    live lease that token names; `renew` a later `until`; `fail` a reason and an `until` after `at`;
    `terminal` a reason; `retry` brings terminal work back as pending.
    """
    c = commands.select("episode_id", "op", F.col("token").alias("_t"), "at", "until", blank_trimmed(F.coalesce("reason", F.lit(""))).alias("reason"))
    both = work.join(c, "episode_id", "left")
    held = F.coalesce((F.col("state") == "processing") & (F.col("token") == F.col("_t")) & (F.col("lease_until") > F.col("at")), F.lit(False))
    op = F.col("op")
    outcome = (
        F.when(op.isNull(), "-")
        .when((op == "retry") & (F.col("state") == "terminal"), "done")
        .when(op == "retry", "not terminal")
        .when(~held, "no live lease")
        .when((op == "renew") & ~F.coalesce(F.col("until") > F.col("lease_until"), F.lit(False)), "not later")
        .when((op == "fail") & ((F.col("reason") == "") | ~F.coalesce(F.col("until") > F.col("at"), F.lit(False))), "invalid")
        .when((op == "terminal") & (F.col("reason") == ""), "invalid")
        .otherwise("done")
    )
    done = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "done"
    keeps = ~ok | (op == "renew")
    state = F.when(ok & (op == "fail"), "failed").when(ok & (op == "terminal"), "terminal").when(ok & (op == "complete"), "complete").when(ok & (op == "retry"), "pending").otherwise(F.col("state"))
    new = {
        "state": state,
        "token": F.when(keeps, F.col("token")),
        "lease_until": F.when(ok & (op == "renew"), F.col("until")).when(~ok, F.col("lease_until")),
        "retry_after": F.when(ok & (op == "fail"), F.col("until")).when(~ok | (op == "renew"), F.col("retry_after")),
        "error": F.when(ok & op.isin("fail", "terminal"), F.col("reason")).when(ok & (op == "retry"), F.lit(None)).otherwise(F.col("error")),
    }
    return done.select(*(new[k].alias(k) if k in new else F.col(k) for k in work.columns), "outcome")


def waiting_mentions(queued: DataFrame, in_flight: DataFrame, now: int, most: int) -> DataFrame:
    """(owner, mention, place): for each owner the next mentions (owner, mention, arrived, not_before) in
    the order of their first arrival, each once; those deferred beyond now wait, and so do those in flight
    (owner, mention). No owner has more than `most` at once, those in flight included."""
    once = queued.groupBy("owner", "mention").agg(F.min("arrived").alias("arrived"), F.max("not_before").alias("not_before"))
    ready = once.where(F.coalesce("not_before", F.lit(now)) <= now).join(in_flight, ["owner", "mention"], "left_anti")
    busy = in_flight.groupBy("owner").agg(F.count("*").alias("_busy"))
    order = F.row_number().over(Window.partitionBy("owner").orderBy("arrived", "mention"))
    return ready.withColumn("place", order).join(busy, "owner", "left").where(F.col("place") + F.coalesce("_busy", F.lit(0)) <= most).select("owner", "mention", "place")


def background_pass(queue: DataFrame, lacking: DataFrame, eligible: DataFrame, most: int = PASS_ITEMS) -> DataFrame:
    """(lane, id): what one pass over a store takes up: all of the queue (id), all that lacks a vector (id),
    and the first `most` eligible statements (id, since), longest waiting first."""
    first = eligible.orderBy("since", "id").limit(most).select("id")
    lane = lambda df, name: df.select(F.lit(name).alias("lane"), "id")
    return lane(queue, "queue").union(lane(lacking, "vectors")).union(lane(first, "statements"))
