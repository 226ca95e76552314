"""Cleaning candidate texts as they arrive.

The cleaning rules look at one row at a time, so the batch operator runs on a
stream unchanged; there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civitext.operators.cleaning import with_cleaning
from civitext.schemas import GENERATED_ROWS


def candidate_stream(spark: SparkSession, path: str) -> DataFrame:
    """(tweet, class) from JSON lines as files appear under `path`."""
    return spark.readStream.schema(GENERATED_ROWS).json(path)


def start_cleaning(
    stream: DataFrame, out: str, checkpoint: str, text: str = "tweet", available_now: bool = False
) -> StreamingQuery:
    """Writes every row with its reason (`kept` if none) and cleaned text, one folder per reason."""
    rows = with_cleaning(stream, text).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    writer = rows.writeStream.format("parquet").partitionBy("reason").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
