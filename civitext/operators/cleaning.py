"""Cleaning of candidate texts, with a reason code for every dropped row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitext.functions.text import words
from civitext.operators.common import compute_once

# The reasons in test order, the unknown-word marks and the limits.
REASONS = ["empty", "too_short", "high_unk", "repetitive", "non_alpha", "short_after_clean"]
UNK_WORDS = ["<unk>", "unk"]
MAX_SHORT_WORDS = 2
MAX_UNK_SHARE = 0.3
MAX_REPEAT_SHARE = 0.5
MIN_ALPHA_SHARE = 0.5


def with_cleaning(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `reason` (null if kept) and `cleaned` (null if dropped).

    Row-local and stateless, so it also takes a streaming DataFrame.
    """
    rows = compute_once(df, "_words", words(F.coalesce(F.col(text), F.lit(""))))
    rows = compute_once(rows, "_low", F.lower(F.concat_ws(" ", "_words")))
    rows = compute_once(rows, "_sorted", F.sort_array(F.split("_low", " ")))
    known = F.size(F.array_remove(F.array_remove("_sorted", UNK_WORDS[0]), UNK_WORDS[1]))
    rows = rows.withColumn("_n", F.size("_words"))
    n = F.col("_n")
    rows = compute_once(rows, "_unk", F.when((n > 0) & F.contains("_low", F.lit(UNK_WORDS[1])), n - known).otherwise(0))
    left = n - F.col("_unk")
    # A word making up more than half of a sorted list sits in its middle.
    middle = F.element_at("_sorted", (F.floor(n / 2) + 1).cast("int"))
    repeated = n - F.size(F.array_remove("_sorted", middle))
    # Words without any letter, between spaces or ends.
    letterless = F.regexp_count(F.concat_ws(" ", "_words"), F.lit("(?<![^ ])[^a-zA-Z ]++(?![^ ])"))
    reason = (
        F.when(n == 0, REASONS[0])
        .when(n <= MAX_SHORT_WORDS, REASONS[1])
        .when(F.col("_unk") / n > MAX_UNK_SHARE, REASONS[2])
        .when(repeated / n > MAX_REPEAT_SHARE, REASONS[3])
        .when((n - letterless) / n < MIN_ALPHA_SHARE, REASONS[4])
        .when(left <= MAX_SHORT_WORDS, REASONS[5])
    )
    marked = F.filter("_words", lambda w: ~F.lower(w).isin(UNK_WORDS))
    joined = F.when(F.col("_unk") > 0, F.array_join(marked, " ")).otherwise(F.concat_ws(" ", "_words"))
    return (
        compute_once(rows, "reason", reason)
        .withColumn("cleaned", F.when(F.col("reason").isNull(), joined))
        .drop("_words", "_low", "_sorted", "_n", "_unk")
    )


def clean_generated(df: DataFrame, text: str = "text") -> DataFrame:
    """The kept rows, `text` replaced by its cleaned form."""
    kept = with_cleaning(df, text).filter(F.col("reason").isNull())
    return kept.withColumn(text, F.col("cleaned")).drop("reason", "cleaned")


def clean_report(cleaned: DataFrame) -> DataFrame:
    """(reason, n, share): one row per reason met, one for `kept`, one for `input`."""
    return (
        cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("reason")
        .agg(F.sum("n").alias("n"))
        .select(F.coalesce("reason", F.lit("input")).alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))
        .transform(_with_share)
    )


def _with_share(counts: DataFrame) -> DataFrame:
    # At most eight rows: the reasons, `kept` and `input`.
    rows = counts.agg(F.collect_list(F.struct("reason", "n")).alias("rows"), F.max("n").alias("top"))
    return rows.select(F.inline("rows"), F.greatest("top", F.lit(1)).alias("top")).select(
        "reason", "n", (F.col("n") / F.col("top")).alias("share")
    )
