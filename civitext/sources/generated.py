"""Candidate texts as JSON: one object of parallel arrays, or one object per row."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.operators.common import exploded
from civitext.schemas import GENERATED_COLUMNS, GENERATED_ROWS
from civitext.sources.paths import path_exists

CHUNK_ROWS = 1_000


def read_generated(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(pos, tweet, class) from objects holding arrays; no rows if the file is missing.

    A single object spread over lines is read by one task, as its format
    demands. With `multi_line` off, every line is an object and files split.
    """
    empty = spark.createDataFrame([], "pos int, tweet string, class string")
    if not path_exists(spark, path):
        return empty
    objects = spark.read.schema(GENERATED_COLUMNS).option("multiLine", multi_line).json(path)
    samples = exploded(objects, [], F.arrays_zip("tweet", "class"), "pos", "_s")
    return samples.select("pos", F.col("_s.tweet").alias("tweet"), F.col("_s.class").alias("class"))


def read_generated_rows(spark: SparkSession, path: str) -> DataFrame:
    """(tweet, class) from one object per line; no rows if the path is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], GENERATED_ROWS)
    return spark.read.schema(GENERATED_ROWS).json(path)


def class_number(tag: Column, tags: list[str]) -> Column:
    """Running number of the tag as a string."""
    at = F.array_position(F.array(*[F.lit(t) for t in tags]), tag)
    return F.when(at > 0, (at - 1).cast("string"))


def as_samples(df: DataFrame, tags: list[str], text: str = "text", tag: str = "tag") -> DataFrame:
    return df.select(F.col(text).alias("tweet"), class_number(F.col(tag), tags).alias("class"))


def write_generated(df: DataFrame, path: str, tags: list[str], text: str = "text", tag: str = "tag") -> None:
    """One object per line."""
    as_samples(df, tags, text, tag).write.mode("overwrite").json(path)


def write_generated_columns(
    df: DataFrame, path: str, tags: list[str], text: str = "text", tag: str = "tag", key: str = "row_id",
    chunk: int = CHUNK_ROWS,
) -> None:
    """Objects of parallel arrays, about `chunk` samples to a line, spread by hash of `key`."""
    chunks = max(ceil(df.count() / chunk), 1)
    bucket = F.pmod(F.xxhash64(key), F.lit(chunks)).alias("_chunk")
    sample = F.struct(F.col(text).alias("tweet"), class_number(F.col(tag), tags).alias("class"))
    grouped = df.select(bucket, sample.alias("_s")).groupBy("_chunk").agg(F.collect_list("_s").alias("_s"))
    arrays = grouped.select(F.col("_s.tweet").alias("tweet"), F.col("_s.class").alias("class"))
    arrays.write.mode("overwrite").json(path)
