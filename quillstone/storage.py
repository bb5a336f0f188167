"""Folders that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master may do without, and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def index_path(spark: SparkSession, name: str, of: str) -> str:
    """Where the index of that name over the data at `of` lies; building it again replaces it."""
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(of.encode()).hexdigest()[:16]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def write_foldered(rows: DataFrame, path: str, by: str) -> None:
    """Rows in one folder per value of a column; their schema is kept beside, so that an empty table can be read as well."""
    rows.limit(0).write.mode("overwrite").parquet(f"{path}_schema")
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def read_foldered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}_schema").schema).parquet(path)
