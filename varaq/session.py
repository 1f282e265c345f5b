"""Session helpers: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where it may be unset, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"varaq-shared-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _settled_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/settled-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later passes neither recompute it nor lose it with an executor.

    What a session has settled lies in one folder, which goes when the driver ends, or before with `release`.
    """
    spark = df.sparkSession
    folder = _settled_dir(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, there = _file_system(spark, folder)
    fs.deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that this session has settled; frames that read it can't be used any more."""
    fs, there = _file_system(spark, _settled_dir(spark))
    fs.delete(there, True)
