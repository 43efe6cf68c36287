"""Import of conversation trees from tagged records, with fragments for every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .archive import paths, range_text, windows

NODE = ("id", "conversation_id", "parent_id", "role", "timestamp_ns", "content")
ECHO = ("conversation_id", "message_id", "sequence", "timestamp_ns", "model_round", "event_kind", "correlation_id", "name", "content")


def imported(records: DataFrame, turns: int = 8, overlap: int = 2, tail: bool = True) -> dict[str, DataFrame]:
    """Tables of records (as the `graphlines` source gives them): nodes, branches, titles, echoes,
    fragments, rejected.

    A node that comes again with the same content is one; with another, all its records are rejected
    as `conflict`. A branch whose leaf, or an ancestor of it, isn't there is rejected as `dangling`. The
    last record of a branch, by file and place, holds; so does a conversation's last title. fragments:
    (conversation_id, branch, start, end, text), windows of `turns` turns of each branch's path from its root,
    `turns - overlap` apart, with the closing tail unless it is left open.
    """
    if turns <= 0 or not 0 <= overlap < turns:
        raise ValueError("fragments need turns > 0 and overlap < turns")
    records = cut(records, "records")
    key = ["conversation_id", "id"]
    given = records.where("kind = 'node'")
    clash = given.groupBy(*key).agg(F.count_distinct(F.to_json(F.struct(*NODE[2:]))).alias("_n")).where("_n > 1").drop("_n")
    clash = cut(clash, "conflicts")
    nodes = cut(given.join(clash, key, "left_anti").select(*NODE).distinct(), "nodes")
    place = F.struct("file", "offset")
    named = records.where("kind = 'branch'")
    last = named.groupBy("conversation_id", "id").agg(F.max_by(F.struct("leaf_node_id", "canonical", "title", "file", "offset"), place).alias("b"))
    last = last.select("conversation_id", F.col("id").alias("branch"), F.col("b.leaf_node_id").alias("leaf"), F.coalesce("b.canonical", F.lit(False)).alias("canonical"), "b.title", "b.file", "b.offset")
    ends = last.select("conversation_id", "leaf").distinct()
    way = paths(nodes, ends)
    # whole paths end at a root
    roots = way.join(nodes.where("parent_id is null").select("conversation_id", "id"), key).select("conversation_id", "leaf", (F.col("back") + 1).cast("long").alias("length"))
    branches = cut(last.join(roots, ["conversation_id", "leaf"], "left"), "branches")
    whole = branches.where("length is not null")
    on_path = way.join(whole, ["conversation_id", "leaf"]).select("conversation_id", "branch", "id", (F.col("length") - 1 - F.col("back")).alias("position")).join(nodes.select(*key, "role", "content"), key)
    by = ["conversation_id", "branch"]
    ranges = windows(whole.select(*by, "length"), by, turns, overlap, tail)
    titles = named.where("title is not null").groupBy("conversation_id").agg(F.max_by("title", place).alias("title"))
    rejected = records.where("kind = 'rejected'").select("file", "offset", "problem", "content")
    rejected = rejected.union(given.join(clash, key, "left_semi").select("file", "offset", F.lit("conflict"), "content"))
    rejected = rejected.union(branches.where("length is null").select("file", "offset", F.lit("dangling"), F.col("branch")))
    return {
        "nodes": nodes,
        "branches": whole.select("conversation_id", "branch", "leaf", "canonical", "length"),
        "titles": titles,
        "echoes": records.where("kind = 'echo'").select(*ECHO).distinct(),
        "fragments": range_text(on_path, ranges, by),
        "rejected": rejected,
    }
