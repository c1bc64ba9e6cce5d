"""What a session needs before Python workers run this package's code, and where intermediate files may lie."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed on their path.

    On a cluster whose nodes don't see this folder, install the package there (pyproject.toml) or pass it with --py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster gets an error, since its executors would each
    write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """Remove a path of any store when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the scratch folder, which goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stackloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(delete_on_exit(spark, path))
