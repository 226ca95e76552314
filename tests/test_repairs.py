"""Cases in which operators once gave wrong or incomplete answers."""

import math
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from civitext.functions.scores import softmax
from civitext.operators.metrics import log_loss
from civitext.operators.similarity import max_anchor_cosine
from civitext.plans.experiment import cross_dataset
from civitext.sources import splits


def test_log_loss_of_certain_scores(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.5), (0, 0.0), (0, None), (None, 0.5)], "label int, prob double")
    want = (-math.log(1e-15) - math.log(0.5)) / 3
    assert log_loss(rows).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("block", [None, 1])
def test_vectors_of_other_widths_and_null_elements(spark, block):
    cands = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 1.0, 0.0]), (4, []), (5, None), (6, [1.0, None, 0.0, 0.0]), (7, [1.0] * 6)]
    anchors = [([1.0, 0.0, 0.0, 0.0],), ([0.0, 1.0, 0.0, 0.0],), (None,), ([1.0, None, 0.0, 0.0],), ([],)]
    got = max_anchor_cosine(
        spark.createDataFrame(cands, "id long, v array<double>"), spark.createDataFrame(anchors, "v array<double>"), "id", "v", block
    )
    got = {r["id"]: r["max_cos"] for r in got.collect()}
    assert got.pop(2) == pytest.approx(1) and got.pop(3) == pytest.approx(0.5**0.5)
    assert got == {1: None, 4: None, 5: None, 6: None, 7: None}


def test_softmax_of_wide_arrays(spark):
    row = spark.range(1).select(softmax(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: i.cast("float"))).alias("p")).first()
    assert sum(row["p"]) == pytest.approx(1) and row["p"][-1] == pytest.approx(1 - math.exp(-1))


def test_unfinished_splits_are_no_cache(spark, tmp_path):
    path = str(tmp_path / "splits")
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "row_id long, split string")
    splits.save_splits(rows, path)
    assert splits.load_splits(spark, path).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert splits.load_splits(spark, path) is None


def test_a_failing_job_is_not_a_missing_set(spark):
    class Scorer:
        def score(self, rows):
            return rows.mapInPandas(lambda batches: 1 / 0, "row_id string, label int, prediction int, prob double")

    rows = spark.createDataFrame([("1", "a", 1)], "row_id string, text string, label int")
    with pytest.raises(PythonException):
        cross_dataset({("m", "augmented"): Scorer()}, {"set": lambda: rows})
    skipped = []
    with pytest.raises(ValueError):
        cross_dataset({}, {"gone": lambda: spark.read.parquet("/no/such/folder")}, skipped=skipped)
    assert skipped == ["gone"]
