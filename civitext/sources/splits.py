"""Cached splits as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.sources.paths import is_file, path_exists

# Names of the splits.
SPLITS = ["train", "val", "test"]


def save_splits(df: DataFrame, path: str) -> None:
    """One folder per split; each task writes what it holds, nothing is shuffled."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame | None:
    """All splits with a `split` column, or None if one is missing or was not finished.

    A folder counts as finished with its `_SUCCESS` mark; a plain file is one.
    Takes the folders of `save_splits` and a folder of `<split>.parquet` files.
    """
    if path_exists(spark, f"{path}/_SUCCESS") and all(path_exists(spark, f"{path}/split={s}") for s in SPLITS):
        return spark.read.parquet(path).withColumn("split", F.col("split").cast("string"))
    files = [f"{path}/{s}.parquet" for s in SPLITS]
    if all(is_file(spark, f) or path_exists(spark, f"{f}/_SUCCESS") for f in files):
        parts = [
            spark.read.parquet(f"{path}/{s}.parquet").withColumn("split", F.lit(s)) for s in SPLITS
        ]
        return reduce(DataFrame.unionByName, parts)
    return None


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Cached splits, else computed and cached, so that every run sees the same rows."""
    cached = load_splits(spark, path)
    if cached is None:
        save_splits(compute(), path)
        cached = load_splits(spark, path)
    if cached is None:
        raise ValueError(f"a split without rows was written to {path}")
    return cached
