"""Third-party labelled sets brought to (text, label), and votes to one label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.functions.scores import majority
from civitext.functions.text import is_nonblank

# Class codes of the three-way set.
THREE_WAY_NEITHER = 2
THREE_WAY_ABSENT = -1


def adapt_threeway(
    df: DataFrame, text: str = "tweet", label: str = "class", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Class 2 is non-toxic, other classes are toxic; blank text and absent classes are dropped."""
    code = F.coalesce(F.col(label), F.lit(THREE_WAY_ABSENT))
    return df.filter(is_nonblank(F.col(text)) & (code != THREE_WAY_ABSENT)).select(
        *carry,
        F.col(text).alias("text"),
        F.when(code == THREE_WAY_NEITHER, 0).otherwise(1).alias("label"),
    )


def adapt_annotated(
    df: DataFrame, non_toxic_value: int = 0, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Posts given as tokens with annotator labels.

    The label is the annotators' majority, else the `label` column if there is
    one; a post with neither, or with blank text, is dropped. `non_toxic_value`
    names the class that counts as non-toxic.
    """
    text = F.array_join("post_tokens", " ")
    votes = majority(F.transform("annotators", lambda a: a["label"]))
    value = F.coalesce(votes, F.col("label")) if "label" in df.columns else votes
    return (
        df.select(*carry, text.alias("text"), value.alias("_value"))
        .filter(is_nonblank(F.col("text")) & F.col("_value").isNotNull())
        .select(*carry, "text", F.when(F.col("_value") == non_toxic_value, 0).otherwise(1).alias("label"))
    )


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "annotated": adapt_annotated,
    "three_way": adapt_threeway,
}


def adapt(name: str, df: DataFrame, **options) -> DataFrame:
    """Adapter by name; register more by adding to `ADAPTERS`."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}, known: {sorted(ADAPTERS)}")
    return ADAPTERS[name](df, **options)


def majority_vote(df: DataFrame, key: str, vote: str, order: Column) -> DataFrame:
    """(key, vote): most frequent vote of every key, the first seen one on ties.

    One row per vote. Counting comes first, so a key holding a large share of
    the rows shrinks to one row per distinct vote before it meets in one task.
    """
    counted = df.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col(vote).alias("vote")))
    return counted.groupBy(key).agg(best.alias("best")).select(key, F.col("best.vote").alias(vote))
