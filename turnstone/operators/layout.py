"""A retrieval index as files: vectors lie by community, so that a routed query reads few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..session import cut
from .communities import routed

#: Folders of communities, folder of vectors without one, vectors of a file.
PARTS, NO_PART, FILE_ROWS = 256, -1, 65_536


def part_of(community: Column, parts: int = PARTS) -> Column:
    return F.when(community.isNull(), F.lit(NO_PART)).otherwise(F.pmod(F.xxhash64(community), F.lit(parts)).cast("int"))


def write_layout(index: DataFrame, path: str, parts: int = PARTS, file_rows: int = FILE_ROWS) -> None:
    """Writes an index (id, vector, community) in folders by part. A part with many vectors, such as that
    of a large community, is dealt to several tasks and files of about file_rows."""
    rows = index.select("id", "vector", "community", part_of(F.col("community"), parts).alias("part"))
    sizes = cut(rows.groupBy("part").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files")), "parts")
    dealt = rows.join(F.broadcast(sizes), "part").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))  # a row a part
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(n, "part", "_file").drop("_files", "_file").write.partitionBy("part").parquet(path)


def read_layout(spark: SparkSession, path: str, index_schema: str) -> DataFrame:
    """index_schema: that of (id, vector, community)."""
    return spark.read.schema(f"{index_schema}, part int").parquet(path)


def routed_search(layout: DataFrame, centroids: DataFrame, queries: DataFrame, seeds: int = 4, communities: int = 4, parts: int = PARTS) -> DataFrame:
    """(query_id, id, score, rank): as `retrieval.retrieved` in routed mode, over a layout. The routes of
    queries (query_id, query), a stated batch, are written and prune the layout's folders as the join
    runs; only vectors of chosen communities, and those without one, are scored."""
    chosen = routed(centroids, queries, communities).select("query_id", "community", part_of(F.col("community"), parts).alias("part"))
    none = queries.select("query_id", F.lit(None).cast(dict(chosen.dtypes)["community"]).alias("community"), F.lit(NO_PART).alias("part"))
    routes = cut(chosen.union(none).join(queries, "query_id"), "routes").where(F.col("part") >= NO_PART)
    on = [layout["part"] == routes["part"], layout["community"].eqNullSafe(routes["community"])]
    # at most `communities` rows a query and one more, of a stated batch
    met = layout.join(F.broadcast(routes), on).select("query_id", "id", cosine(F.col("vector"), F.col("query")).alias("score")).where("score is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= seeds)
