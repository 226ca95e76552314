"""Existence tests on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target = _target(spark, path)
    return store.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    store, target = _target(spark, path)
    return store.exists(target) and store.getFileStatus(target).isFile()
