"""Expressions over score and class arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(scores: Column) -> Column:
    """Exponentials of the scores less their maximum, scaled to sum to one."""
    # Maximum and sum are elements of one-element arrays, so that each is computed once.
    exps = F.flatten(
        F.transform(
            F.array(F.array_max(scores)),
            lambda top: F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double"))),
        )
    )
    totals = F.transform(F.array(exps), lambda e: F.struct(e.alias("e"), array_sum(e).alias("total")))
    return F.flatten(F.transform(totals, lambda t: F.transform(t["e"], lambda e: e / t["total"])))


def argmax(scores: Column) -> Column:
    """Zero-based place of the largest score, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)) - 1


def one_hot(index: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def miss_score(probabilities: Column, index: Column) -> Column:
    """One less the probability of the class at zero-based `index`."""
    return 1.0 - F.element_at(probabilities, (index + 1).cast("int"))


def majority(votes: Column) -> Column:
    """Most frequent value of a short array, the first seen one on ties."""
    counted = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(
            F.size(F.filter(votes, lambda x: x == v)).alias("n"),
            (-F.array_position(votes, v)).alias("early"),
            v.alias("vote"),
        ),
    )
    return F.array_max(counted)["vote"]


def verdict(delta: Column) -> Column:
    return (
        F.when(delta > 0, "OUTPERFORMS").when(delta < 0, "UNDERPERFORMS").when(delta == 0, "MATCHES")
    )
