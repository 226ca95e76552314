"""Label derivation, class subsets and class-balance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.functions.text import is_nonblank
from civitext.schemas import FLAGS, NEUTRAL_TAG


def present(df: DataFrame, flags: list[str]) -> list[str]:
    return [f for f in flags if f in df.columns]


def flag_sum(df: DataFrame, flags: list[str]) -> Column:
    """Sum of the flags that exist in `df`, null counting as 0."""
    found = [F.coalesce(F.col(f), F.lit(0)) for f in present(df, flags)]
    return reduce(lambda a, b: a + b, found, F.lit(0))


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(is_nonblank(F.col(text)))


def binary_labels(
    df: DataFrame, flags: list[str] = FLAGS, text: str = "comment_text", key: str = "row_id"
) -> DataFrame:
    """Canonical (key, text, label): label 1 if any flag is set, blank text dropped."""
    return nonblank(
        df.select(
            key,
            F.col(text).cast("string").alias("text"),
            (flag_sum(df, flags) > 0).cast("int").alias("label"),
        )
    )


def already_binary(
    df: DataFrame, text: str = "comment_text", label: str = "label", key: str = "row_id"
) -> DataFrame:
    """Canonical table from a source that carries its label."""
    return nonblank(
        df.select(key, F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))
    )


def per_class(
    df: DataFrame, flags: list[str], text: str = "comment_text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(tag, ...carry, text): a row once for every flag it has set, in one pass."""
    tags = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in present(df, flags)]))
    return (
        df.filter(F.col(text).isNotNull())
        .select(F.explode_outer(tags).alias("tag"), *carry, F.col(text).alias("text"))
        .filter(F.col("tag").isNotNull())
    )


def neutral_rows(df: DataFrame, flags: list[str] = FLAGS, text: str = "comment_text") -> DataFrame:
    """Rows without any flag and with a text."""
    return df.filter((flag_sum(df, flags) == 0) & F.col(text).isNotNull())


def class_table(
    df: DataFrame, flags: list[str], all_flags: list[str], text: str = "comment_text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per-class rows and neutral rows, tagged, for the per-class export."""
    neutral = neutral_rows(df, all_flags, text).select(
        F.lit(NEUTRAL_TAG).alias("tag"), *carry, F.col(text).alias("text")
    )
    return per_class(df, flags, text, carry).unionByName(neutral)


def class_training_table(
    real: DataFrame, synthetic: DataFrame | None, tags: list[str], key: str = "row_id", neutral: str = NEUTRAL_TAG
) -> DataFrame:
    """(key, text, class_idx): the K-class training table, blank texts dropped.

    `real` is (key, tag, text): the neutral tag is class 0, the others follow in the order
    of `tags`; rows of other tags are no class and are dropped. `synthetic` (key, text) is a
    class of its own behind them.
    """
    order = [neutral] + [t for t in tags if t != neutral] if neutral in tags else list(tags)
    number = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag")).cast("int") - 1
    rows = nonblank(real.select(key, "text", number.alias("class_idx")).filter(F.col("class_idx") >= 0))
    if synthetic is None:
        return rows
    return rows.unionByName(nonblank(synthetic.select(key, "text", F.lit(len(order)).alias("class_idx"))))


def tag_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """One row per label 0/1: count, share, ratio n0 / max(n1, 1) and its flag.

    Rows with another label have no row here but count in the total, so that the shares
    say what part of the whole table a label is; rows without a label do not count.
    """
    counts = df.agg(
        F.count_if(F.col("label") == 0).alias("n0"),
        F.count_if(F.col("label") == 1).alias("n1"),
        F.count("label").alias("n"),
    )
    total = F.greatest(F.col("n"), F.lit(1))
    ratio = F.col("n0") / F.greatest(F.col("n1"), F.lit(1))
    both = F.array(
        F.struct(F.lit(0).cast("bigint").alias("label"), F.col("n0").alias("n")),
        F.struct(F.lit(1).cast("bigint").alias("label"), F.col("n1").alias("n")),
    )
    return counts.select(
        F.inline(both), total.alias("total"), ratio.alias("ratio")
    ).select(
        "label",
        "n",
        (F.col("n") / F.col("total")).alias("share"),
        "ratio",
        (F.col("ratio") > threshold).alias("imbalanced"),
    )


def class_weights(df: DataFrame) -> DataFrame:
    """(label, weight): total / (C * count) with C = highest label + 1, 0 for an absent class."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.agg(F.sum("n").alias("total"), (F.max("label") + 1).alias("classes"))
    every = overall.select(
        F.explode(F.sequence(F.lit(0), F.col("classes") - 1)).alias("label"), "total", "classes"
    )
    return every.join(counts, "label", "left").select(
        F.col("label").cast("bigint").alias("label"),
        F.when(F.col("n") > 0, F.col("total") / (F.col("classes") * F.col("n")))
        .otherwise(F.lit(0.0))
        .alias("weight"),
    )
