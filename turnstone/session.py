"""Sessions and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "turnstone", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; conf overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A local session that names none gets one under
    /tmp; on a cluster that is an error, since each machine would write its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/turnstone-checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/turnstone/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Takes away the tables that this application wrote on its way, once its results are read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that loops don't grow their lineage."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
