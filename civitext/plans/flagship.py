"""The flagship query: how cleaned candidates move the class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civitext.operators.augmentation import augmentation_impact
from civitext.operators.cleaning import clean_generated
from civitext.plans import inputs


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """(setting, n0, n1, pct1): labelled table, then with the cleaned lines added as label 1.

    Label 1 for the lines is a convention of this query, not a claim about them.
    """
    return augmentation_impact(inputs.label_rows(spark, sf), clean_generated(inputs.lines(spark, sf)))
