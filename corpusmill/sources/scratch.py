"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: the cluster's spark.checkpoint.dir, or under
    the warehouse where that is unset; a local session (tests) uses /tmp/checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints/corpusmill"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def fresh(spark: SparkSession, tag: str) -> str:
    """A path of its own below the application's scratch folder."""
    return f"{scratch(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: the plan above it restarts from files
    that every executor sees, so a lost executor costs a re-read and ids made below stay the same."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the application's scratch tables. Frames that operators returned can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
