"""Operator 10: near-duplicate vectors by NN-descent.

Equal vectors are one node. A first neighbour graph comes from a few random hyperplane hashes, whose
buckets (cut into blocks where they are large) are compared inside. NN-descent then refines it: at
each node the lists of its neighbours and of those that name it meet, all pairs of them of which one
is new are compared, and what is nearer than the worst entry of a list enters it, until little
changes. There are as many hashes as it takes that two vectors at the threshold meet in one, however
many vectors there are; each doubling adds fresh ones. Edges at or over the threshold are links. A
list is saturated if all its entries are links: it is then enlarged to the node's whole component,
which is compared in blocks, so that no link of a large group is lost and none of its pairs is
written. Recall is audited on samples of nodes compared with all rows, each node counting alike,
nodes outside enlarged components and those with an entry near the threshold on their own, by counts,
without a table of true links; lists are
doubled and refined again until it is high enough. If it isn't after the last doubling, all nodes
are compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, small_batches, written
from .components import components
from .exact_topk import usable

#: Entries of a list, hashes of the first graph and vectors of a bucket, vectors of a bucket's block
#: and of a component's, rows of a block that are multiplied at once.
NEIGHBOURS, HASHES, BUCKET, BLOCK, WIDE_BLOCK, TILE = 10, 6, 256, 512, 4096, 1024
#: Rounds of refinement, and the share of entries that may still change after the last one.
ROUNDS, SETTLED = 4, 0.002
#: Sampled nodes of the audit, the recall that is asked for, and how often lists are doubled for it.
AUDITED, RECALL, DOUBLINGS = 1024, 0.97, 3
#: How far below the threshold an entry may be for its node to be audited first.
MARGIN = 0.05
#: Bytes of a batch of vectors that goes to Python.
BATCH_BYTES = 64 << 20
#: Nodes that all nodes are compared with at once.
SLICE = 8192

EDGES = "u long, v long, sim double"
#: fresh: not compared yet with the others around a node.
GRAPH = f"{EDGES}, fresh boolean"


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    """Blobs of doubles as unit vectors; shorter ones are filled with zeros, see `apart`."""
    sizes = {len(b) for b in blobs}
    if len(sizes) == 1:
        x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    else:
        x = np.frombuffer(b"".join(b.ljust(max(sizes), b"\0") for b in blobs), dtype="<f8").reshape(len(blobs), -1)
    with np.errstate(over="ignore"):
        largest = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(largest > 0, largest, 1)  # no overflow for large components
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def apart(sims: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """sims, in place, with vectors of unequal lengths as unlike as can be."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    if len(a) and len(b) and ((a != a[0]).any() or (b != a[0]).any()):
        sims[a[:, None] != b[None, :]] = -2
    return sims


def by_group(rows: DataFrame, keys: list[str], form: str, work: Callable[[dict[str, list]], Iterator[dict]]) -> DataFrame:
    """work on each group of rows with equal keys, streamed; work yields columns of numpy arrays."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        out: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([o[k] for o in out]) for k in out[0]})
                out.clear()

        at = [names.index(k) for k in keys]
        last = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            tags = list(zip(*(columns[i] for i in at), strict=True))
            start = 0
            for i in range(len(tags) + 1):
                if i == len(tags) or tags[i] != last:
                    for h, c in zip(held, columns, strict=True):
                        h += c[start:i]
                    if i < len(tags):
                        if held[0]:
                            out.extend(work(dict(zip(names, held, strict=True))))
                        held = [[] for _ in names]
                        last, start = tags[i], i
            if sum(len(next(iter(o.values()))) for o in out) > 50_000:
                yield from flush()
        if held[0]:
            out.extend(work(dict(zip(names, held, strict=True))))
        yield from flush()

    return rows.repartition(n_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, form)


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of rows that take part, and (id, first, times, blob) of nodes, which are the rows of
    one vector: a number, the least of their ids, and how many they are."""
    usual = usable(vector_col) & F.col(id_col).isNotNull() & F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False))
    rows = vectors.where(usual).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [(np.array(v, dtype="<f8") + 0.0).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([xxhash.xxh3_128_digest(b) for b in blobs], pa.binary()), pa.array(blobs, pa.binary())], ["id", "key", "blob"])

    packed = written(rows.mapInArrow(pack, "id long, key binary, blob binary"), "vectors")
    first = written(packed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("times")).withColumn("node", F.monotonically_increasing_id()), "first")
    named = packed.select("id", "key").join(first, "key").select("id", "node")
    chosen = packed.join(first.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("first")))
    # the row may be repeated
    nodes = chosen.groupBy(F.col("node").alias("id")).agg(F.first("first").alias("first"), F.first("times").alias("times"), F.first("blob").alias("blob"))
    return written(named, "named"), written(nodes, "nodes")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best entries of each list; an entry that was there before isn't fresh."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _found(edges: DataFrame) -> DataFrame:
    return edges.withColumn("fresh", F.lit(True))


def _hash_bits(count: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, count) / BUCKET))))


def _hash_batches(count: int, threshold: float) -> int:
    """How many times HASHES hashes it takes that two vectors at the threshold share a bucket with
    the probability RECALL."""
    meet = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** _hash_bits(count)
    return 1 if meet >= RECALL else int(np.ceil(np.log(1 - RECALL) / np.log1p(-meet) / HASHES))


def _hashed_graph(nodes: DataFrame, count: int, k: int, threshold: float, first: int = 0, graph: DataFrame | None = None) -> DataFrame:
    """graph with what the hashes of seeds from first on find; a batch of hashes is written at a time."""
    for seed in range(first, first + _hash_batches(count, threshold)):
        found = _found(_first_graph(nodes, count, k, 7 + seed))
        graph = written(_best(graph.union(found) if graph is not None else found, k), "graph", instead_of=graph)
    return graph


def _first_graph(nodes: DataFrame, count: int, k: int, seed: int = 7) -> DataFrame:
    bits = _hash_bits(count)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows([b.as_py() for b in batch.column("blob")])
            planes = np.random.default_rng(seed).standard_normal((1 << 12, HASHES * max(1, bits)))
            if x.shape[1] > len(planes):
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], HASHES * max(1, bits)))
            signs = (x @ planes[: x.shape[1]] > 0).reshape(len(x), HASHES, max(1, bits))
            code = (signs * (1 << np.arange(max(1, bits)))).sum(axis=2) if bits else np.zeros((len(x), HASHES), dtype=np.int64)
            at = np.repeat(np.arange(len(x)), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(HASHES), len(x)), pa.int32()), pa.array(code.ravel().astype(np.int64)), batch.column("id").take(pa.array(at)), batch.column("blob").take(pa.array(at))], ["tree", "bucket", "id", "blob"])

    buckets = nodes.select("id", "blob").mapInArrow(hashed, "tree int, bucket long, id long, blob binary")
    sizes = buckets.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = buckets.join(sizes, ["tree", "bucket"]).select("tree", "bucket", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.col("blocks")).cast("int").alias("block"), "id", "blob")

    def near(group: dict[str, list]) -> Iterator[dict]:
        ids, x = np.array(group["id"]), unit_rows(group["blob"])
        for a in range(0, len(ids), 1024):
            sims = apart(x[a : a + 1024] @ x.T, group["blob"][a : a + 1024], group["blob"])
            n = min(k, len(ids) - 1)
            if n < 1:
                return
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
            at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            yield {"u": np.repeat(ids[a : a + 1024], n), "v": ids[at].ravel(), "sim": np.take_along_axis(sims, at, axis=1).ravel()}

    return by_group(cut, ["tree", "bucket", "block"], EDGES, near)


def _refined(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: neighbours of neighbours, in both directions, that improve a list. Nodes around
    which nothing is fresh are passed over."""
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("floor"))
    back = _best(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh"), k)
    around = graph.select("u", "v", "fresh").union(back.select("u", "v", "fresh")).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    changed = Window.partitionBy("u")
    around = around.withColumn("any", F.max("fresh").over(changed)).where("any").drop("any")
    known = nodes.join(worst.withColumnRenamed("u", "id"), "id", "left").select(F.col("id").alias("v"), F.coalesce("floor", F.lit(-2.0)).alias("floor"), "blob")
    met = around.join(known, "v").select(F.col("u").alias("centre"), "v", "fresh", "floor", "blob")

    def pairs(group: dict[str, list]) -> Iterator[dict]:
        ids, floor, fresh, x = np.array(group["v"]), np.array(group["floor"]), np.array(group["fresh"]), unit_rows(group["blob"])
        sims = apart(x @ x.T, group["blob"], group["blob"])
        np.fill_diagonal(sims, -3)
        i, j = np.nonzero((sims > floor[:, None]) & (fresh[:, None] | fresh[None, :]))
        yield {"u": ids[i], "v": ids[j], "sim": sims[i, j]}

    return _best(graph.withColumn("fresh", F.lit(False)).union(_found(by_group(met, ["centre"], EDGES, pairs))), k)


def _in_blocks(groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, links): linked rows of the other nodes of a node's group (id, root), block against block."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / WIDE_BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.select("id", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("id", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = nodes.join(placed, "id").select("root", "i", "j", "block", "id", "times", "blob")

    def count(group: dict[str, list]) -> Iterator[dict]:
        ids, times, x = np.array(group["id"]), np.array(group["times"]), unit_rows(group["blob"])
        i, j, block = group["i"][0], group["j"][0], np.array(group["block"])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        blobs = np.array(group["blob"], dtype=object)
        of_right = np.zeros(len(right), dtype=np.int64)
        for a in range(0, len(left), TILE):
            rows = left[a : a + TILE]
            near = apart(x[rows] @ x[right].T, list(blobs[rows]), list(blobs[right])) >= threshold
            if i == j:
                near[np.arange(len(rows)), np.arange(a, a + len(rows))] = False
            else:
                of_right += near.T @ times[rows]
            yield {"id": ids[rows], "links": near @ times[right]}
        if i != j:
            yield {"id": ids[right], "links": of_right}

    return by_group(rows, ["root", "i", "j"], "id long, links long", count).groupBy("id").agg(F.sum("links").alias("links"))


def _compared(graph: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """graph with the k best links of each node, all nodes being compared with all, a slice of them
    at a time."""
    spark = nodes.sparkSession
    slices = max(1, -(-nodes.count() // SLICE))
    cut = written(nodes.select("id", "blob", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice")), "slices")
    for n in range(slices):
        part = cut.where(F.col("slice") == n).select("id", "blob").collect()  # about SLICE rows
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in part]), [bytes(r["blob"]) for r in part]))

        def linked(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, blobs = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    rows = batch.slice(at, 512)
                    mine = rows.column("id").to_numpy()
                    own = [b.as_py() for b in rows.column("blob")]
                    both = unit_rows(blobs + own)
                    sims = apart(both[len(ids) :] @ both[: len(ids)].T, own, blobs)
                    sims[mine[:, None] == ids[None, :]] = -2
                    m = min(k, len(ids))
                    top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    best = np.take_along_axis(sims, top, axis=1)
                    i, j = np.nonzero(best >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(ids[top[i, j]]), pa.array(best[i, j])], ["u", "v", "sim"])

        graph = written(_best(graph.union(_found(nodes.select("id", "blob").mapInArrow(linked, EDGES))), k), "graph", instead_of=graph)
        shared.unpersist()
    return graph


def _audit(nodes: DataFrame, graph: DataFrame, links: DataFrame, enlarged: DataFrame, threshold: float) -> float | None:
    """The mean share of a node's true links that were found, the least of three samples: of the nodes
    outside enlarged components, of those among them that have an entry near the threshold, and of the
    nodes inside. Where links are rare, hardly a node of the first sample has one, but those of the
    second may. Inside, all is found that is in the same component, as it is compared in blocks. None
    if no node of the samples has a link."""
    spark = nodes.sparkSession
    promising = graph.where(F.col("sim") >= threshold - MARGIN).select(F.col("u").alias("id"), F.lit(True).alias("near")).distinct()
    placed = nodes.select("id", "blob").join(enlarged.select("id", "root"), "id", "left")
    kinds = placed.join(promising, "id", "left").withColumn("near", F.col("near").isNotNull())
    outside = F.col("root").isNull()
    sample = {}
    for which, where in enumerate((outside & F.col("near"), outside, ~outside)):
        for r in kinds.where(where).orderBy(F.xxhash64("id"), "id").limit(AUDITED).collect():
            sample.setdefault(r["id"], (r, set()))[1].add(which)
    kind_of, sample = {u: w for u, (_, w) in sample.items()}, [r for r, _ in sample.values()]
    if not sample:
        return None
    shared = spark.sparkContext.broadcast(([r["id"] for r in sample], [-1 if r["root"] is None else r["root"] for r in sample], [bytes(r["blob"]) for r in sample]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots, blobs = np.array(shared.value[0]), np.array(shared.value[1]), shared.value[2]
        true, same = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                root = part.column("root").fill_null(-2).to_numpy()
                own = [b.as_py() for b in part.column("blob")]
                both = unit_rows(blobs + own)
                near = (apart(both[: len(ids)] @ both[len(ids) :].T, blobs, own) >= threshold) & (ids[:, None] != part.column("id").to_numpy()[None, :])
                true += near.sum(axis=1)
                same += (near & (roots[:, None] == root[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true), pa.array(same)], ["u", "true", "same"])

    counts = {r["u"]: (r["t"], r["s"]) for r in placed.mapInArrow(count, "u long, true long, same long").groupBy("u").agg(F.sum("true").alias("t"), F.sum("same").alias("s")).collect()}
    asked = spark.createDataFrame([(r["id"],) for r in sample], "u long")
    listed = {r["u"]: r["count"] for r in links.join(asked, "u", "left_semi").groupBy("u").count().collect()}  # AUDITED three times, at most
    means = []
    for which in range(3):
        mine = [r for r in sample if which in kind_of[r["id"]]]
        found = [(listed.get(r["id"], 0) if r["root"] is None else counts[r["id"]][1], counts[r["id"]][0]) for r in mine]
        means += [np.mean([min(1.0, n / of) for n, of in found if of])] if any(of for _, of in found) else []
    return float(min(means)) if means else None


def near_vectors(vectors: DataFrame, threshold: float = 0.9, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept, recall) for every row of vectors.

    Rows link if the cosine of their vectors, in double precision, is at least threshold. n_links
    counts the other rows linked with a row, component_id is the smallest id reachable, kept says
    that it is the row's own. Vectors that are null, empty, zero or hold null, NaN or infinite
    components, and rows with a null id, link with nothing: n_links 0, their own component, kept
    (null ids: component null, not kept). Repeated rows are vectors of their own with one id, whether
    they hold one vector or several: each counts as a row, and kept may be true for each. Vectors of
    unequal lengths never link. recall: found by the audit, the same in each row; null if no link was
    there to be measured. An empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    # vectors are short: more of them at once; what is read later with this setting is bounded by bytes
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    named, nodes = _nodes(vectors, id_col, vector_col)
    count = nodes.count()
    graph, batches = _hashed_graph(nodes, count, k, threshold), _hash_batches(count, threshold)
    for doubling in range(DOUBLINGS + 2):
        for _ in range(ROUNDS if doubling <= DOUBLINGS else 0):
            graph = written(_refined(graph, nodes, k), "graph", instead_of=graph)
            if graph.where("fresh").count() <= SETTLED * count * k:
                break
        near = graph.where(F.col("sim") >= threshold)
        links = written(near.select("u", "v").union(near.select("v", "u")).distinct(), "links")
        full = near.groupBy("u").count().where(F.col("count") >= k).select("u")
        groups = written(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("node", "id"), "groups")
        dense = groups.join(full, groups["id"] == full["u"], "left_semi").select("root").distinct()
        enlarged = written(groups.join(dense, "root", "left_semi"), "enlarged")
        recall = _audit(nodes, graph, links, enlarged, threshold)
        if recall is None or recall >= RECALL or doubling > DOUBLINGS:
            break
        if doubling == DOUBLINGS or k >= count:
            # the last way: nothing can be lost
            graph = _compared(graph, nodes, threshold, k)
            continue
        k *= 2
        graph = _hashed_graph(nodes, count, k, threshold, (doubling + 1) * batches, graph)
    times = nodes.select(F.col("id").alias("v"), "times")
    apart = links.join(enlarged.select(F.col("id").alias("u")), "u", "left_anti").join(times, "v").groupBy("u").agg(F.sum("times").alias("links")).withColumnRenamed("u", "id")
    counted = apart.union(_in_blocks(enlarged.select("id", "root"), nodes, threshold)).withColumnRenamed("id", "node")
    least = written(groups.join(nodes.select("id", "first"), "id").groupBy("root").agg(F.min("first").alias("least")), "least")
    placed = groups.join(least, "root").select(F.col("id").alias("node"), "least")
    by_node = nodes.select(F.col("id").alias("node"), "first", "times").join(counted, "node", "left").join(placed, "node", "left")
    by_node = written(by_node.select("node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "by-node")
    # A row that takes no part joins with nothing.
    taking = named.join(by_node, "node").select(F.col("id").alias("t"), "n_links", "component_id")
    valid = usable(vector_col) & F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), valid.alias("valid"))
    out = rows.where(~F.col("valid") | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).union(taking)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept, F.lit(recall).cast("double").alias("recall"))
