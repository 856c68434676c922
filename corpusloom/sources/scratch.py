"""Folders in the place that driver and executors share, for what is computed once and read often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new, uniquely named folder under ``spark.checkpoint.dir``; a local session that names none (a test) gets a temporary one."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str, within: str | None = None) -> DataFrame:
    """``df`` written to such a folder (or to one in ``within``), in folders ``by`` columns, and read again: computed once, its size known to the planner."""
    path = f"{within}/{name}" if within else folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def streamable(spark: SparkSession, path: str) -> str:
    """A path that a file stream reads: a folder or pattern as it is, a file as a pattern that only it matches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(where) and fs.getFileStatus(where).isFile() else path


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
