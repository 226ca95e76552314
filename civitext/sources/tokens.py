"""Token-id files and vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions.sequences import ids_to_text, text_to_ids
from civitext.operators.ordered import with_row_number


def write_token_ids(df: DataFrame, path: str, tag: str = "tag", ids: str = "ids") -> None:
    """One line of space-separated ids per sequence, one folder per tag."""
    df.select(F.col(tag).alias("tag"), ids_to_text(F.col(ids)).alias("value")).write.mode(
        "overwrite"
    ).partitionBy("tag").text(path)


def read_token_ids(spark: SparkSession, path: str, max_len: int | None = None) -> DataFrame:
    """(tag, ids), cut to `max_len` ids if given."""
    ids: Column = text_to_ids(F.col("value"))
    if max_len:
        ids = F.slice(ids, 1, max_len)
    return spark.read.schema("value string, tag string").text(path).select("tag", ids.alias("ids"))


def write_vocab_text(vocab: DataFrame, path: str) -> None:
    """One word per line in id order, over as many part files as the sort has ranges."""
    vocab.orderBy("id").select("word").write.mode("overwrite").text(path)


def read_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    """(word, id): the id is the line number over the files in name order."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("word"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("_path").asc(), F.col("_block").asc(), F.col("_row").asc()]
    return with_row_number(lines, order, "id").select("word", (F.col("id") - 1).alias("id"))
