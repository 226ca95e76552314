import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from civitext.operators import metrics

SCHEMA = "label int, prediction int, prob double"


def test_perfect_and_degenerate(spark):
    one_class = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], SCHEMA)
    row = metrics.binary_metrics(one_class).first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.auc_roc) == (1.0, 0.0, 0.0, 0.0, None)
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 0, 0, 0)
    none = spark.createDataFrame([(1, 0, 0.1), (0, 0, 0.2)], SCHEMA)
    assert metrics.binary_metrics(none).first().precision == 0.0


def test_auc_equals_the_evaluator_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), 0, rng.randint(0, 20) / 20) for _ in range(3_000)]
    df = spark.createDataFrame([(y, p, s) for y, p, s in rows], SCHEMA)
    got = metrics.roc_auc(df).first().auc_roc
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0)
    assert got == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_grouped_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 1), 0, rng.randint(0, 9) / 10) for g in "ab" for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, " + SCHEMA)
    got = {r.g: r.auc_roc for r in metrics.roc_auc(df, ["g"]).collect()}
    for g in "ab":
        pos = [s for k, y, _, s in rows if k == g and y == 1]
        neg = [s for k, y, _, s in rows if k == g and y == 0]
        pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[g] == pytest.approx(pairs / (len(pos) * len(neg)))


def test_log_loss(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (0, 0.2, 3.0)], "label int, prob double, w double")
    assert metrics.log_loss(df).first().log_loss == pytest.approx((0.6931471805599453 + 0.2231435513142097) / 2)
    assert metrics.log_loss(df, weight="w").first().log_loss == pytest.approx((0.6931471805599453 + 3 * 0.2231435513142097) / 4)
    assert metrics.log_loss(df.limit(0)).first().log_loss is None


def test_comparison(spark):
    wide = spark.createDataFrame(
        [("baseline", 0.5, 0.5, 0.5, 0.5, None), ("augmented", 0.6, 0.4, 0.5, 0.5000004, 0.9)],
        "setting string, accuracy double, precision double, recall double, f1 double, auc_roc double",
    )
    rows = {r.metric: (r.delta, r.verdict) for r in metrics.compare(wide).collect()}
    assert rows == {
        "accuracy": (0.1, "OUTPERFORMS"), "precision": (-0.1, "UNDERPERFORMS"), "recall": (0.0, "MATCHES"),
        "f1": (0.0, "MATCHES"), "auc_roc": (None, None),
    }
