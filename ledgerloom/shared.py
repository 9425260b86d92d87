"""Tables in the folder that the whole cluster shares: what a query reads several times is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names.

    All paths of an application are below ``ledgerloom-<application id>``: whoever runs it can remove that folder once it has
    ended. A local session without the setting gets a temporary folder; on a cluster the setting is a must.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.ledgerloom.shared.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.ledgerloom.shared.dir", base)
    return f"{base.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read; if it comes in fewer pieces than there are cores (one file, one row group), its rows are dealt anew to all of them.

    Large tables come in pieces enough and are left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def kept(df: DataFrame) -> DataFrame:
    """The rows, written and read back: lineage ends here, and lost executors cost a retry of the tasks that read."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
