"""Intermediate data in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master, an error on a cluster (its machines would not see it)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        set_before = context._jsc.sc().getCheckpointDir()
        if not set_before.isDefined():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="presswork-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that doesn't exist yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back: its lineage ends, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column of a written table, from the names of its folders; none if it wasn't written yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))
