"""Exact stratified splits by hash order, without ordering a whole stratum in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.session import stage

PREFIX = 4  # hex digits of the hash that form the histogram: 65,536 bins per label


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def cut_hashes(
    df: DataFrame, key: str, label: str, seed: int, per_mille: list[int]
) -> DataFrame:
    """(label, t0, t1, ...): hash of the row at each cut rank floor(n * share) of its label.

    A histogram over hash prefixes (combined before its shuffle) finds the one
    bin a cut falls into; only the rows of that bin are ordered.
    """
    hashed = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), hash_order(key, seed).alias("_h"))
    hashed = hashed.withColumn("_bin", F.substring("_h", 1, PREFIX))
    bins = hashed.groupBy("_label", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy("_label")
    running = by_label.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(by_label))
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("_cut"), F.expr(f"_all * {m} div 1000").alias("_target"))
            for i, m in enumerate(per_mille)
        ]
    )
    cut_bins = (
        bins.select("_label", "_bin", "_n", "_upto", F.inline(targets))
        .filter((F.col("_upto") - F.col("_n") < F.col("_target")) & (F.col("_target") <= F.col("_upto")))
        .select("_label", "_bin", "_cut", (F.col("_target") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    # A few rows per label. Staged, so that Spark knows their size and sends them to the rows.
    cut_bins = stage(cut_bins, "cut_bins")
    in_bin = Window.partitionBy("_label", "_cut").orderBy("_h", "_key")
    at_cut = (
        hashed.join(cut_bins, ["_label", "_bin"])
        .withColumn("_row", F.row_number().over(in_bin))
        .filter(F.col("_row") == F.col("_rank"))
    )
    thresholds = at_cut.groupBy("_label").agg(
        *[F.max(F.when(F.col("_cut") == i, F.col("_h"))).alias(f"t{i}") for i in range(len(per_mille))]
    )
    return stage(thresholds, "cut_hashes")


def stratified_split(
    df: DataFrame,
    key: str = "row_id",
    label: str = "label",
    seed: int = 42,
    train: float = 0.8,
    val: float = 0.1,
) -> DataFrame:
    """Adds `split` (train / val / test); sizes are floors of the shares in every label.

    The rows themselves are not shuffled: they meet one threshold row per label.
    """
    cuts = [round(train * 1000), round((train + val) * 1000)]
    cut = cut_hashes(df, key, label, seed, cuts).withColumnRenamed("_label", label)
    h = hash_order(key, seed)
    split = F.when(h <= F.col("t0"), "train").when(h <= F.col("t1"), "val").otherwise("test")
    return df.join(cut, label, "left").withColumn("split", split).select(*df.columns, "split")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))
