"""Exact binary metrics, grouped, and baseline-versus-augmented comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.functions.scores import verdict
from civitext.operators.ordered import with_running_sum

EPSILON = 1e-15
METRICS = ["accuracy", "precision", "recall", "f1", "auc_roc"]


def ratio(num: Column, den: Column) -> Column:
    """Quotient, 0 if the divisor is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def confusion_matrix(
    df: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(*by, tn, fp, fn, tp)."""
    def cell(y, p):
        return F.count_if((F.col(label) == y) & (F.col(prediction) == p))

    return df.groupBy(*(by or [])).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def rates(matrix: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to confusion-matrix rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.select(
        "*",
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(
    df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "prob"
) -> DataFrame:
    """(*by, auc_roc): exact, ties counted half, null unless both classes occur.

    Rows with one score are combined first; the running count of negatives is
    taken over score ranges in parallel.
    """
    by = by or []
    counts = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    below = with_running_sum(counts, [F.col(score).asc()], "neg", "below", by)
    pairs = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2.0)
    totals = below.groupBy(*by).agg(
        F.sum(pairs).alias("_pairs"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    area = F.col("_pairs") / (F.col("_p").cast("double") * F.col("_n"))
    return totals.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), area).alias("auc_roc"))


def binary_metrics(
    df: DataFrame,
    by: list[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "prob",
) -> DataFrame:
    """(*by, tn, fp, fn, tp, accuracy, precision, recall, f1, auc_roc)."""
    one = rates(confusion_matrix(df, by, label, prediction))
    area = roc_auc(df, by, label, score)
    if by:
        return one.join(area, by, "left")
    # Both sides are global aggregates of one row.
    return one.withColumn("_one", F.lit(1)).join(area.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def log_loss(
    df: DataFrame, label: str = "label", score: str = "prob", weight: str | None = None
) -> DataFrame:
    """(log_loss): mean of -ln p(label), weighted if `weight` is given.

    Scores are clipped to EPSILON .. 1 - EPSILON, so that a score of 0 or 1 on the wrong
    side counts with a large but finite loss. Rows without a score or label do not count.
    """
    score_ = F.least(F.greatest(F.col(score).cast("double"), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    p = F.when(F.col(label) == 1, score_).otherwise(1.0 - score_)
    w = F.col(weight) if weight else F.lit(1.0)
    df = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return df.agg(F.sum(-w * F.log(p)).alias("_loss"), F.sum(w).alias("_w")).select(
        F.when(F.col("_w") > 0, F.col("_loss") / F.col("_w")).alias("log_loss")
    )


def long_metrics(wide: DataFrame, by: list[str]) -> DataFrame:
    """(*by, metric, value)."""
    return wide.unpivot(by, METRICS, "metric", "value")


def compare(wide: DataFrame, setting: str = "setting", by: list[str] | None = None) -> DataFrame:
    """(*by, metric, baseline, augmented, delta, verdict) from one metric row per setting.

    Delta is rounded to six digits; it and the verdict are null where a value is.
    """
    by = by or []
    long = long_metrics(wide, [*by, setting])
    both = long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col(setting) == "baseline", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col(setting) == "augmented", F.col("value"))).alias("augmented"),
    )
    delta = F.round(F.col("augmented") - F.col("baseline"), 6)
    return both.withColumn("delta", delta).withColumn("verdict", verdict(F.col("delta")))


def mean_score(df: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(key, mean_score) over repeated draws."""
    return df.groupBy(key).agg(F.avg(score).alias("mean_score"))
