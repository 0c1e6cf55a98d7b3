"""Lineage cuts through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SENT_ROWS = 100_000  # about 10 MB of rows in memory

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master may do without: it gets one scratch folder per application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIR[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a stage table to the shared folder and continue from the files.

    Unlike a cache the table outlives its executors, keeps column pruning, filter
    pushdown and size statistics, and gives later plans a short logical tree. Spark takes the
    compressed files for the size of the rows and would send tables of many times that size
    to all executors through the driver; ``merge`` keeps a table of ``SENT_ROWS`` rows or more out
    of that, unless ``broadcast`` asks for it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if table.count() >= SENT_ROWS else table
