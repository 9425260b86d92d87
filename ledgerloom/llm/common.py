"""What the operators of this subpackage share: tables, the shared folder, and column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words of texts: all but ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, below ``ledgerloom-<application id>``: whoever runs the application can remove that once it has ended.

    The cluster names that folder in ``spark.checkpoint.dir``; where it is unset (a local
    session, as in tests), a folder under the warehouse's parent is set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.ledgerloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.ledgerloom.shared.dir", base)
    return f"{base.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
