"""Comment tables: with flags, already binary, or whichever of two is usable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from civitext.operators.labels import already_binary, binary_labels
from civitext.schemas import COMMENTS, FLAGS


def read_comments(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Comment table. Text formats need a schema; Parquet brings its own."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(schema or COMMENTS)
        if fmt == "csv":
            reader = reader.options(header=True, multiLine=True, escape='"')
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def labelled_or_flags(
    primary: Callable[[], DataFrame],
    fallback: Callable[[], DataFrame],
    text: str = "comment_text",
    label: str = "label",
    flags: list[str] = FLAGS,
    key: str = "row_id",
) -> tuple[str, DataFrame]:
    """Which source was used, and its canonical table.

    The primary one is used if it can be read and has a label and a text
    column; else the label comes from the flags of the fallback.
    """
    try:
        df = primary()
        if {text, label} <= set(df.columns):
            return "primary", already_binary(df, text, label, key)
    except AnalysisException:
        pass
    return "fallback", binary_labels(fallback(), flags, text, key)
