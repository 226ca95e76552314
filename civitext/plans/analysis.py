"""The two end-to-end jobs: the full analysis, and evaluating saved models on an outside set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.operators.adapters import adapt
from civitext.operators.augmentation import augmentation_impact
from civitext.operators.classifier import TextClassifier
from civitext.operators.cleaning import clean_generated
from civitext.operators.metrics import binary_metrics, compare
from civitext.operators.sampling import QUICK_CAPS, quick_cap
from civitext.operators.splitting import stratified_split
from civitext.plans import experiment
from civitext.session import stage, staging
from civitext.sources.generated import read_generated
from civitext.sources.reports import prediction_table, write_predictions, write_report
from civitext.sources.splits import load_or_compute


def full_analysis(
    spark: SparkSession,
    load: Callable[[], DataFrame],
    generated_path: str,
    splits_path: str,
    out: str,
    outside: dict[str, Callable[[], DataFrame]] | None = None,
    seed: int = 42,
    quick_test: bool = False,
    shared_weights: bool = False,
) -> DataFrame:
    """Splits, cleaned candidates, fits, metrics and outside sets; returns the one-row report.

    `load` gives the canonical (row_id, text, label) and is only called if
    `splits_path` holds no cached splits. Writes under `out`: `report`,
    `impact`, `predictions` per model and the fitted models.
    """
    with staging(spark):
        rows = load_or_compute(spark, splits_path, lambda: stratified_split(load(), seed=seed))
        if quick_test:
            # Fewer training rows only: metrics cover all validation and test rows.
            fewer = quick_cap(rows, {"train": QUICK_CAPS["train"]})
            rows = fewer.unionByName(rows.filter(F.col("split") != "train"))
        rows = rows.withColumn("row_id", F.col("row_id").cast("string"))
        train = rows.filter(F.col("split") == "train").drop("split")
        test = rows.filter(F.col("split") == "test").drop("split")
        kept = clean_generated(read_generated(spark, generated_path).select(F.col("tweet").alias("text")))
        number = F.monotonically_increasing_id().cast("string")
        added = stage(kept.select(F.concat(F.lit("added:"), number).alias("row_id"), "text"), "added")

        fitted = experiment.fit_settings(train, added, shared_weights=shared_weights)
        for (model, setting), clf in fitted.items():
            clf.save(f"{out}/models/{model}/{setting}")
        for model in {m for m, _ in fitted}:
            table = prediction_table(fitted[model, "baseline"].score(test), fitted[model, "augmented"].score(test))
            write_predictions(table, f"{out}/predictions/{model}")
        write_report(augmentation_impact(train, added), f"{out}/impact")
        skipped: list[str] = []
        cross = experiment.cross_dataset(fitted, outside, skipped=skipped) if outside else None
        report = experiment.report(train, added, test, experiment.evaluate(fitted, test), cross, skipped)
        write_report(report, f"{out}/report")
    return spark.read.schema(report.schema).json(f"{out}/report")


def evaluate_saved(
    spark: SparkSession, models_path: str, posts: DataFrame, adapter: str, out: str, key: str = "row_id", **options
) -> DataFrame:
    """(metric, baseline, augmented, delta, verdict) of two saved models on an adapted outside set."""
    with staging(spark):
        rows = stage(adapt(adapter, posts, carry=(key,), **options), "outside")
        fitted = {
            ("saved", setting): TextClassifier.load(spark, f"{models_path}/{setting}", key)
            for setting in ("baseline", "augmented")
        }
        scored = stage(experiment.score_all(fitted, rows, key), "scored")
        result = compare(binary_metrics(scored, ["setting"]))
        write_report(result, f"{out}/cross_{adapter}")
    return spark.read.schema(result.schema).json(f"{out}/cross_{adapter}")
