"""Adding cleaned candidates to a training split and measuring the class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def augment(train: DataFrame, candidates: DataFrame, label: int = 1, key: str | None = None) -> DataFrame:
    """Bag union of ([key,] text, label) rows; every candidate gets `label`."""
    keys = [key] if key else []
    added = candidates.select(*keys, "text", F.lit(label).cast("int").alias("label"))
    return train.select(*keys, "text", F.col("label").cast("int").alias("label")).unionByName(added)


def settings(train: DataFrame, candidates: DataFrame, label: int = 1) -> DataFrame:
    """(setting, label) of the baseline and the augmented training set."""
    base = train.select(F.col("label").cast("int").alias("label"))
    added = candidates.select(F.lit(label).cast("int").alias("label"))
    both = F.explode(F.array(F.lit("baseline"), F.lit("augmented")))
    return base.select(both.alias("setting"), "label").unionByName(
        added.select(F.lit("augmented").alias("setting"), "label")
    )


def setting_counts(train: DataFrame, candidates: DataFrame, label: int = 1) -> DataFrame:
    return (
        settings(train, candidates, label)
        .groupBy("setting", F.col("label").cast("bigint").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def augmentation_impact(train: DataFrame, candidates: DataFrame, label: int = 1) -> DataFrame:
    """(setting, n0, n1, pct1) for baseline, augmented and their delta, in one row set."""

    def stats(on):
        n0 = F.count_if(on & (F.col("label") == 0))
        n1 = F.count_if(on & (F.col("label") == 1))
        return n0, n1, F.when(n0 + n1 > 0, 100.0 * n1 / (n0 + n1)).otherwise(0.0)

    b0, b1, bp = stats(F.col("setting") == "baseline")
    a0, a1, ap = stats(F.col("setting") == "augmented")
    one = settings(train, candidates, label).agg(
        b0.alias("b0"), b1.alias("b1"), bp.alias("bp"), a0.alias("a0"), a1.alias("a1"), ap.alias("ap")
    )

    def row(name, n0, n1, pct):
        return F.struct(F.lit(name).alias("setting"), n0.alias("n0"), n1.alias("n1"), pct.alias("pct1"))

    c = F.col
    return one.select(
        F.inline(
            F.array(
                row("baseline", c("b0"), c("b1"), c("bp")),
                row("augmented", c("a0"), c("a1"), c("ap")),
                row("delta", c("a0") - c("b0"), c("a1") - c("b1"), c("ap") - c("bp")),
            )
        )
    )
