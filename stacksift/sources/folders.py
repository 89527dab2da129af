"""Folders of any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """Hadoop path and file system of a folder, wherever it is stored."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    there, files = _path(spark, path)
    return files.exists(there)


def delete_folder(spark: SparkSession, path: str) -> None:
    there, files = _path(spark, path)
    files.delete(there, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    there, files = _path(spark, path)
    return files.getContentSummary(there).getLength()
