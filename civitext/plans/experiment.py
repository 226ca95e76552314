"""Baseline-versus-augmented experiment and evaluation on outside sets."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitext.operators.augmentation import augment
from civitext.operators.classifier import TextClassifier, fit_text_classifier, score_together
from civitext.operators.labels import class_weights
from civitext.operators.metrics import METRICS, binary_metrics, compare
from civitext.operators.tfidf import term_totals
from civitext.session import stage

log = logging.getLogger(__name__)

PARALLEL_FITS = 2

Fit = Callable[..., TextClassifier]

# Models by name; a model is a function of (train, key, weights) with a `score` method.
MODELS: dict[str, Fit] = {"tfidf_lr": fit_text_classifier}


def fit_settings(
    train: DataFrame,
    candidates: DataFrame,
    key: str = "row_id",
    models: dict[str, Fit] | None = None,
    shared_weights: bool = False,
) -> dict[tuple[str, str], TextClassifier]:
    """A fitted model per (model, setting).

    Both settings are fitted on their own, each with its own term table. With
    `shared_weights` both use the class weights of the baseline set.
    `candidates` is (key, text); its keys must not occur in `train`.
    """
    base = stage(train.select(key, "text", F.col("label").cast("int").alias("label")), "train")
    # Terms of the base texts are added up once; the augmented set takes these totals and those of the added texts.
    added = stage(candidates.select(key, "text"), "added")
    augmented = augment(base, added, key=key)
    weights = class_weights(base) if shared_weights else None
    sets = {"baseline": base, "augmented": augmented}
    totals: dict[str, DataFrame] = {}
    if fit_text_classifier in (models or MODELS).values():
        totals["baseline"] = term_totals(base, key)
        both = totals["baseline"].unionByName(term_totals(added, key))
        totals["augmented"] = stage(both.groupBy("term").agg(F.sum("tot").alias("tot")), "term_totals")
    # The fits do not depend on each other, so their jobs share the cluster.
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        running = {
            (name, setting): pool.submit(
                fit, rows, key=key, weights=weights, **({"totals": totals[setting]} if fit is fit_text_classifier else {})
            )
            for name, fit in (models or MODELS).items()
            for setting, rows in sets.items()
        }
        return {which: job.result() for which, job in running.items()}


def score_all(
    fitted: dict[tuple[str, str], TextClassifier], rows: DataFrame, key: str = "row_id", digits: int | None = None
) -> DataFrame:
    """(model, setting, ...rows, prediction, prob).

    All text classifiers share one pass over the texts; models of another kind score on
    their own. With `digits` scores are rounded before the prediction.
    """
    together = {f"{model}\x00{setting}": clf for (model, setting), clf in fitted.items() if isinstance(clf, TextClassifier)}
    parts = []
    if together:
        scored = score_together(together, rows, key, digits=digits)
        names = F.split("model", "\x00")
        parts.append(
            scored.select(names[0].alias("model"), names[1].alias("setting"), *[c for c in scored.columns if c != "model"])
        )
    for (model, setting), clf in fitted.items():
        if not isinstance(clf, TextClassifier):
            parts.append(clf.score(rows).select(F.lit(model).alias("model"), F.lit(setting).alias("setting"), "*"))
    return reduce(lambda a, b: a.unionByName(b.select(*a.columns)), parts)


def evaluate(fitted: dict[tuple[str, str], TextClassifier], test: DataFrame, digits: int | None = None) -> DataFrame:
    """One metric row per (model, setting)."""
    scored = stage(score_all(fitted, test, digits=digits), "scored")
    return binary_metrics(scored, ["model", "setting"])


def cross_dataset(
    fitted: dict[tuple[str, str], TextClassifier],
    sets: dict[str, Callable[[], DataFrame]],
    setting: str | None = "augmented",
    skipped: list[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """One metric row per (model, setting, dataset); a set whose source cannot be read is skipped.

    Each loader gives (row_id, text, label), with keys that may occur in other sets too.
    `setting` None evaluates both settings. Names of skipped sets are added to `skipped`. A
    job that fails on a set that could be opened raises. All sets are one table with the
    set's name beside the key: they are scored in one pass, and all confusion matrices and
    areas come from one aggregation and one keyed running sum.
    """
    chosen = {k: v for k, v in fitted.items() if setting is None or k[1] == setting}
    parts = []
    for name, load in sets.items():
        try:
            rows = load()
        except (AnalysisException, OSError) as error:
            log.warning("set %s skipped: %s", name, error)
            if skipped is not None:
                skipped.append(name)
            continue
        named = F.concat_ws(":", F.lit(name), F.col("row_id").cast("string"))
        parts.append(rows.select(named.alias("row_id"), F.lit(name).alias("dataset"), "text", F.col("label").cast("int").alias("label")))
    if not parts:
        raise ValueError("no outside set could be read")
    # Scoring reads the rows three times: to size its tasks, to cut the texts, and for the labels.
    rows = stage(reduce(DataFrame.unionByName, parts), "outside")
    scored = stage(score_all(chosen, rows, digits=digits), "scored")
    return binary_metrics(scored, ["model", "setting", "dataset"])


def report(
    train: DataFrame,
    candidates: DataFrame,
    test: DataFrame,
    in_domain: DataFrame,
    cross: DataFrame | None = None,
    skipped: list[str] | None = None,
) -> DataFrame:
    """One nested row: set sizes, metric rows, deltas, outside-set metric rows and skipped sets.

    The metric tables hold one row per model and setting, so listing them in
    one row is bounded.
    """
    columns = ["tn", "fp", "fn", "tp", *METRICS]

    def listed(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    in_domain = stage(in_domain, "in_domain")
    parts = [
        train.agg(
            F.count(F.lit(1)).alias("train_original"),
            F.count_if(F.col("label") == 1).alias("original_toxic"),
            F.count_if(F.col("label") == 0).alias("original_nontoxic"),
        ),
        candidates.agg(F.count(F.lit(1)).alias("generated_cleaned")),
        test.agg(F.count(F.lit(1)).alias("test_size")),
        listed(in_domain, "in_domain", ["model", "setting", *columns]),
        listed(compare(in_domain, by=["model"]), "improvement", ["model", "metric", "delta", "verdict"]),
    ]
    if cross is not None:
        parts.append(listed(cross, "cross_dataset", ["model", "setting", "dataset", *columns]))
    # Every part is a global aggregate of one row.
    if cross is not None:
        names = F.array(*[F.lit(s) for s in skipped or []]).cast("array<string>")
        parts.append(train.sparkSession.range(1).select(names.alias("skipped_sets")))
    keyed = [part.withColumn("_one", F.lit(1)) for part in parts]
    row = reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
    added = F.col("generated_cleaned")
    return row.withColumn("train_augmented", F.col("train_original") + added).withColumn(
        "augmented_toxic", F.col("original_toxic") + added
    )
