"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of anything but the space and the controls tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; an empty array for a null text or one without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, counted without keeping them."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.replace(squeezed, F.lit("w"), F.lit("")))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def octets(text: Column) -> Column:
    """UTF-8 bytes; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def as_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that added columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text modulo `folds`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds
