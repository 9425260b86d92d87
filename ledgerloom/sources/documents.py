"""Corpora of documents that were read already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def described(docs: DataFrame, engine: str) -> DataFrame:
    """doc_id, hash (SHA-256 of the text), pages (form feeds end one), chars, engine; a null text has no hash and no pages."""
    pages = F.size(F.split("text", "\f"))
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.when(F.col("text").isNotNull(), pages).alias("pages"), F.length("text").alias("chars"), F.lit(engine).alias("engine"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and text of text files, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
