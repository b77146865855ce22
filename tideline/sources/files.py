"""Files behind a path, on any store Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """The file system and path object behind ``path`` (works for any store Spark can write to)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = folder(spark, path)
    return fs.exists(jvm_path)
