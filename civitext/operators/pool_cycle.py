"""Generations of a scored pool: a table per generation, committed one after the other.

Generation 0 holds all rows with their scores. Each further one takes the rows that
survive by the scores of the generation before, and scores them anew with its own model.
A generation counts from the mark that Spark's writer leaves when all its files are
there; what a broken run has left without it is written over. So a cycle goes on after
the last generation that is complete, in the same or another session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions.text import wordpunct
from civitext.operators.classifier import ClassScorer
from civitext.operators.common import compute_once
from civitext.operators.encoding import sample_length
from civitext.operators.neutral_pool import EVOLVE_RATE, K_SHOTS, surviving
from civitext.schemas import MAX_SEQ_LENGTH
from civitext.session import stage, staging
from civitext.sources.paths import path_exists

# A model: (rows with a `row_id` and a text) -> (row_id, score).
Model = Callable[[DataFrame], DataFrame]


def class_model(scorer: ClassScorer, class_idx: int = 0, digits: int | None = None) -> Model:
    """Probability of one class by a K-class text scorer; with `digits`, rounded, so that ties are stable."""

    def score(rows: DataFrame) -> DataFrame:
        share = scorer.score(rows.select(scorer.key, "text"))
        value = F.col("probs")[class_idx]
        return share.select(F.col(scorer.key).alias("row_id"), (value if digits is None else F.round(value, digits)).alias("score"))

    return score


def scored_rows(rows: DataFrame, model: Model, max_len: int = MAX_SEQ_LENGTH) -> DataFrame:
    """The columns of `rows` with `score`: the model's, 0 for a text of too few or too many tokens.

    Only texts that have a length to be scored reach the model, and only they meet its
    scores: these texts are short, and staged. All others stay where they are. `row_id`
    names a row.
    """
    rows = rows.drop("score")
    marked = compute_once(rows, "_tokens", wordpunct(F.col("text")))
    fits = F.coalesce(sample_length(F.col("_tokens"), max_len), F.lit(False))
    short = stage(marked.filter(fits).drop("_tokens"), "short_texts")
    scores = model(short.select("row_id", "text")).select("row_id", F.col("score").alias("_score"))
    joined = short.join(scores, "row_id", "left").withColumn("score", F.coalesce("_score", F.lit(0.0)))
    others = marked.filter(~fits).drop("_tokens").withColumn("score", F.lit(0.0))
    return joined.select(*rows.columns, "score").unionByName(others)


class PoolCycle:
    """The generations under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rate: float = EVOLVE_RATE, k_shots: int = K_SHOTS) -> None:
        self.spark, self.path, self.keys, self.rate, self.k_shots = spark, path.rstrip("/"), keys, rate, k_shots

    def folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}"

    def last(self) -> int | None:
        """Number of the last complete generation."""
        found = -1
        while path_exists(self.spark, f"{self.folder(found + 1)}/_SUCCESS"):
            found += 1
        return None if found < 0 else found

    def read(self, generation: int) -> DataFrame:
        if not path_exists(self.spark, f"{self.folder(generation)}/_SUCCESS"):
            raise ValueError(f"generation {generation} is not complete")
        return self.spark.read.parquet(self.folder(generation))

    def _commit(self, rows: DataFrame, generation: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.folder(generation))
        return self.read(generation)

    def start(self, rows: DataFrame, model: Model) -> DataFrame:
        """Generation 0 of (row_id, *keys, text, ...), all rows scored; read back if it is complete."""
        if self.last() is not None:
            return self.read(0)
        with staging(self.spark):
            return self._commit(scored_rows(rows, model), 0)

    def advance(self, model: Model) -> DataFrame:
        """The next generation: survivors of the last one, scored by `model`."""
        last = self.last()
        if last is None:
            raise ValueError("the cycle has not been started")
        with staging(self.spark):
            kept = surviving(self.read(last), self.keys, self.rate, self.k_shots)
            return self._commit(scored_rows(kept, model), last + 1)

    def run(self, rows: DataFrame, models: Callable[[int], Model], generations: int) -> DataFrame:
        """Up to `generations` generations after the first, each with the model of its number.

        What is complete is not done again: only models of missing generations are asked for.
        """
        if self.last() is None:
            self.start(rows, models(0))
        while self.last() < generations:
            self.advance(models(self.last() + 1))
        return self.read(generations)
