"""Repeatable samples and caps of a stated size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.operators.splitting import PREFIX, hash_order

# Caps of a quick trial run.
QUICK_CAPS = {"train": 5000, "val": 500, "test": 500}
PLAIN_TOP_K = 1_000


def first_rows(df: DataFrame, k: int, *order_by: Column) -> DataFrame:
    """First `k` rows of an order: a top-k per task, then one over those."""
    return df.orderBy(*order_by).limit(k)


def sample_k(df: DataFrame, k: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly `k` rows (all, if there are fewer), the same ones for the same seed.

    For a large `k`, a histogram of hash prefixes first tells which bins hold
    the sample, so that one task sorts little more than `k` rows.
    """
    if k > PLAIN_TOP_K:
        prefix = F.substring(hash_order(key, seed), 1, PREFIX)
        bins = df.groupBy(prefix.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        upward = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        reached = bins.withColumn("_upto", F.sum("_n").over(upward)).filter(F.col("_upto") >= k)
        last = reached.agg(F.min("_bin")).first()[0]
        if last is not None:
            df = df.filter(prefix <= last)
    return first_rows(df, k, hash_order(key, seed), F.col(key))


def quick_cap(df: DataFrame, caps: dict[str, int] | None = None, key: str = "row_id") -> DataFrame:
    """First rows of every split by key, for a quick trial run."""
    caps = caps or QUICK_CAPS
    parts = [first_rows(df.filter(F.col("split") == s), k, F.col(key)) for s, k in caps.items()]
    return reduce(DataFrame.unionByName, parts)
