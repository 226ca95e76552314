"""Report and prediction sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per row, nested columns as nested objects; parent folders are made."""
    report.write.mode("overwrite").json(path)


def prediction_table(baseline: DataFrame, augmented: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, label, pred_b, prob_b, pred_a, prob_a), one row per example."""
    b = baseline.select(key, "label", F.col("prediction").alias("pred_b"), F.col("prob").alias("prob_b"))
    a = augmented.select(key, F.col("prediction").alias("pred_a"), F.col("prob").alias("prob_a"))
    return b.join(a, key)


def write_predictions(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)
