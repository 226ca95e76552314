"""Word counts and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitext.operators.common import exploded, packed
from civitext.operators.ordered import top_by_count, with_row_number
from civitext.schemas import MIN_FREQ_A, MIN_FREQ_B, SPECIALS_A, SPECIALS_B, TOP_WORDS_B

# Places in an array.
POSITION_BITS = 31


def explode_words(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(*keys, pos, word): one row per token."""
    return exploded(df, list(keys), tokens, "pos", "word")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, n); combined in every task before the shuffle, so a hot word stays small."""
    return explode_words(df, tokens).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def specials(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = F.posexplode(F.array(*[F.lit(s) for s in names])).alias("id", "word")
    return spark.range(1).select(rows).select("word", F.col("id").cast("bigint").alias("id"))


def first_seen_counts(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(word, n, first): count of every word and the smallest (*keys, pos), as a value that sorts like it.

    With whole-number keys that value has a fixed width, so counting and the minimum are
    one hash aggregation and tokens are not sorted.
    """
    at = packed(df, list(keys), POSITION_BITS)
    rows = df.select(at.alias("_at"), F.posexplode_outer(tokens).alias("pos", "word")).filter(F.col("pos").isNotNull())
    if isinstance(rows.schema["_at"].dataType, T.StructType):
        place = F.struct("_at", "pos")
    else:
        place = F.col("_at") + F.col("pos").cast(rows.schema["_at"].dataType)
    rows = rows.select("word", place.alias("_place"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))


def vocab_first_seen(
    df: DataFrame, tokens: Column, *keys: str, min_freq: int = MIN_FREQ_A
) -> DataFrame:
    """(word, id): words seen at least `min_freq` times, ids in first-seen order after the specials."""
    kept = first_seen_counts(df, tokens, *keys).filter(F.col("n") >= min_freq)
    ranked = with_row_number(kept.select("word", "first"), [F.col("first").asc()], "id")
    ids = ranked.select("word", (F.col("id") + len(SPECIALS_A) - 1).alias("id"))
    return specials(df.sparkSession, SPECIALS_A).unionByName(ids)


def vocab_topk(
    df: DataFrame,
    tokens: Column,
    *keys: str,
    k: int = TOP_WORDS_B,
    min_freq: int = MIN_FREQ_B,
) -> DataFrame:
    """(word, id): the `k` most frequent words, then those seen `min_freq` times.

    Ids follow the count, ties the first place seen.
    """
    top = top_by_count(first_seen_counts(df, tokens, *keys), k, "n", F.col("first").asc())
    # At most k rows are left, so one task numbers them.
    order = Window.orderBy(F.col("n").desc(), F.col("first").asc())
    ranked = top.filter(F.col("n") >= min_freq).withColumn("id", F.row_number().over(order))
    ids = ranked.select("word", (F.col("id") + len(SPECIALS_B) - 1).cast("bigint").alias("id"))
    return specials(df.sparkSession, SPECIALS_B).unionByName(ids)


def vocab_size(df: DataFrame, tokens: Column, min_freq: int = MIN_FREQ_A) -> DataFrame:
    """(tokens, distinct_words, kept_words); the specials are not counted."""
    return token_counts(df, tokens).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("distinct_words"),
        F.count_if(F.col("n") >= min_freq).alias("kept_words"),
    )
