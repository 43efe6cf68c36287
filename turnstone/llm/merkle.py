"""Operator 12: a Merkle tree over a table, and proofs of its rows, with nodes in external memory.

Leaves are sorted into runs by (tree, id) and written; a run's place and a row's place in it give
each leaf its coordinate, without a task that sees a whole tree. The node store is a folder of
Parquet, a partition a level; each level is made from the one before, which is read once. Trees of
the parts (sources) have their roots as leaves of one more tree.

Proofs are taken out by coordinate. Levels are read in bands of BAND; in a band the nodes below one
ancestor are a block of at most 39, and the blocks of a band are merged with what leads from their
ancestors to the root, the highest band first. So what is long, the way to the root, is shuffled for
one in 27 nodes, and each node of the store once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import free_prefix, fresh_path, n_partitions, written

#: Nodes of a run that become one, levels of a band, levels that a tree of 64-bit size has at most.
FAN, BAND, MOST_LEVELS = 3, 3, 40
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def _up(place: Column, levels: int) -> Column:
    """The place, levels above, of the ancestor of what is at place."""
    return F.call_function("div", place, F.lit(FAN**levels))


def field(column: Column) -> Column:
    """A value as part of a leaf: `-` for null, else its length in UTF-8 bytes, a colon, the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: none for one leaf, one for two or three."""
    return sum(((n > FAN**k).cast("int") for k in range(MOST_LEVELS)), F.lit(0))


def indexed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx, their place (from 0) in their tree by order, and n, the rows of the tree.

    A run is a partition of rows in the range of (tree, order). A row's place is the number of its
    tree's rows in runs before, and of those before it in its run; a table with a row for each run
    and each tree that it holds part of tells the former. Rows equal in order are told apart by a
    number that each gets as it is first written, so that very many of them make several runs.
    """
    spark, own = rows.sparkSession, free_prefix(rows)
    rows = written(rows.withColumn(own + "tie", F.monotonically_increasing_id()), "unsorted")
    keys = [tree, *order, own + "tie"]
    in_order = rows.repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys).drop(own + "tie")
    # the upper bits of this id are the partition's number, the lower 33 the row's in it
    runs = written(in_order.withColumn(own + "at", F.monotonically_increasing_id()), "runs", instead_of=rows)
    runs = runs.withColumn(own + "run", F.shiftright(own + "at", 33))
    sizes = runs.groupBy(tree, own + "run").agg(F.count(F.lit(1)).alias(own + "size"), F.min(own + "at").alias(own + "begin"))
    whole = Window.partitionBy(tree)  # a row for each run that holds part of the tree
    before = F.coalesce(F.sum(own + "size").over(whole.orderBy(own + "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(tree).alias(own + "of"), F.col(own + "run").alias(own + "in"), (before - F.col(own + "begin")).alias(own + "shift"), F.sum(own + "size").over(whole).alias("n"))
    starts = written(starts, "starts")
    placed = runs.join(starts, F.col(tree).eqNullSafe(F.col(own + "of")) & (F.col(own + "run") == F.col(own + "in")))
    return placed.withColumn("idx", F.col(own + "at") + F.col(own + "shift")).drop(*(own + c for c in ("at", "run", "of", "in", "shift")))


class NodeStore:
    """Nodes (tree, idx, n, hash, height) of trees in a shared folder, a Parquet partition a level.

    n is the number of nodes that the tree has at the level, height its last level. Leaves keep
    their payload columns, which are null above.
    """

    def __init__(self, leaves: DataFrame, payload: tuple[str, ...] = ()):
        """leaves: (tree, idx, n, hash, payload...)."""
        self.spark, self.path, self.payload = leaves.sparkSession, fresh_path(leaves.sparkSession, "nodes"), payload
        leaves = leaves.select("tree", "idx", "n", "hash", height(F.col("n")).alias("height"), *payload)
        self.schema = StructType([*leaves.schema, StructField("level", IntegerType())])
        leaves.write.parquet(f"{self.path}/level=0")
        self.height = self.level(0).agg(F.max("height")).first()[0] or 0
        for k in range(1, self.height + 1):
            self._above(self.level(k - 1)).write.parquet(f"{self.path}/level={k}")

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={k}")

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def roots(self) -> DataFrame:
        """(tree, hash, height): the last node of each tree."""
        return self.nodes().where("n = 1").select("tree", "hash", "height")

    @staticmethod
    def _above(below: DataFrame) -> DataFrame:
        """The next level: each run of FAN neighbours becomes a node, in trees that aren't down to one."""
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        runs = below.where("n > 1").groupBy("tree", _up(F.col("idx"), 1).alias("idx"), _up(F.col("n") + FAN - 1, 1).alias("n"), "height").agg(run.alias("run"))
        return runs.select("tree", "idx", "n", F.sha2(F.array_join("run.hash", ""), 256).alias("hash"), "height")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, idx, hash, payload..., proof) for every leaf. above: (tree, height, proof) for every
        tree, proof the way on from its root. A proof has for each level what stands before and after
        the own node in its run."""
        band_of_root = F.call_function("div", F.greatest(F.col("height") - 1, F.lit(0)), F.lit(BAND))
        ways = None
        for b in range(max(self.height - 1, 0) // BAND, -1, -1):
            low = b * BAND
            begun = above.where(band_of_root == b).select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("at"), F.col("proof").alias("way"))
            ways = begun if ways is None else ways.select(F.col("tree").alias("of"), F.col("idx").alias("at"), F.col("proof").alias("way")).union(begun)
            met = self._blocks(b).join(ways, F.col("tree").eqNullSafe(F.col("of")) & (F.col("anchor") == F.col("at")))
            each = met.select("tree", "height", "block", "way", F.explode(F.filter("block", lambda x: x["level"] == low)).alias("own"))  # noqa: B023
            here = F.filter(F.array(*(F.when(F.col("height") > low + k, _step(low, k)) for k in range(BAND))), lambda s: s.isNotNull())
            ways = each.select("tree", "own.idx", "own.hash", *(f"own.{c}" for c in self.payload), F.concat(here, "way").alias("proof"))
        return ways

    def _blocks(self, b: int) -> DataFrame:
        """(tree, height, anchor, block): a band's nodes below one node of the next band."""
        low = b * BAND
        # the root of a tree is part of no run; a lone leaf is there to be asked for
        nodes = self.nodes().where(F.col("level").between(low, low + BAND - 1) & ((F.col("level") < F.col("height")) | (F.col("height") == 0)))
        anchor = F.coalesce(*(F.when(F.col("level") == low + k, _up(F.col("idx"), BAND - k)) for k in range(BAND)))
        block = F.sort_array(F.collect_list(F.struct("level", "idx", "hash", *self.payload)))
        return nodes.groupBy("tree", "height", anchor.alias("anchor")).agg(block.alias("block"))


def _step(low: int, k: int) -> Column:
    """What stands beside the ancestor, k levels up, of the node `own` of level low in `block`."""
    ancestor = _up(F.col("own.idx"), k)

    def side(before: bool) -> Column:
        run = F.filter("block", lambda x: (x["level"] == low + k) & (_up(x["idx"], 1) == _up(ancestor, 1)) & ((x["idx"] < ancestor) if before else (x["idx"] > ancestor)))
        return F.array_join(F.transform(run, lambda x: x["hash"]), "")

    return F.struct(side(True).alias("before"), side(False).alias("after"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, start, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(leaves: DataFrame, payload: tuple[str, ...] = ()) -> tuple[DataFrame, str | None]:
    """((tree, doc_id, hash, payload..., subroot, proof), root) of leaves (tree, doc_id, hash,
    payload...), which are in the order of their doc_id, equal ones in that of their digest; null
    comes first, as tree too. No leaf has no root."""
    parts = NodeStore(indexed(leaves, "tree", ["doc_id", "hash"]), ("doc_id", *payload))
    subroots = written(parts.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("part"), "hash", F.col("height").alias("part_height")), "subroots")
    whole = NodeStore(indexed(subroots, "tree", ["part"]), ("part", "part_height"))
    root = whole.roots().first()
    start = whole.roots().select("tree", "height", F.array().cast(STEPS).alias("proof"))
    tops = written(whole.proofs(start).select(F.col("part").alias("tree"), F.col("part_height").alias("height"), "hash", "proof"), "subroot-proofs")
    of = tops.select(F.col("tree").alias("of"), F.col("hash").alias("subroot"))
    out = parts.proofs(tops).join(of, F.col("tree").eqNullSafe(F.col("of"))).drop("of", "idx")
    return out, root and root["hash"]


def tampered_with(id_col: str = "doc_id") -> Column:
    """Rows that the report tampers with: 2 divides the crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0


def manifest_report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Tampering takes the line breaks out of a text. Nulls, empty texts and repeated rows are leaves
    like all others; a null id is tampered with never. Other columns have no part in a leaf.
    """
    fields = [F.col(c) for c in FIELDS]
    without_breaks = leaf_hash(*fields[:-1], F.translate("text", "\n", ""))
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", leaf_hash(*fields).alias("hash"), F.when(tampered_with(), without_breaks).alias("tampered"))
    rows, root = manifest(leaves, ("tampered",))
    found = folded(F.coalesce("tampered", "hash"), F.col("proof"))
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
