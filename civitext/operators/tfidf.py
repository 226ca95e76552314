"""TF-IDF in long form: 1-2-grams, sublinear counts, smoothed idf, unit length."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions.text import ngram_terms, with_bigrams
from civitext.operators.ordered import top_by_count, top_of_staged
from civitext.session import BROADCAST_ROWS, broadcast_if_small, stage

# Fixed value: size of the term vocabulary.
MAX_TERMS = 50_000
# Text that one task cuts into terms, and what a row counts besides its text.
BYTES_PER_TASK = 4 << 20
ROW_BYTES = 64


def occurrences(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, term): a row for every time that a text holds a term.

    Texts are spread by key once, over as many tasks as their bytes ask for, and no later
    step by key shuffles again. A number of partitions that is asked for is not coalesced:
    what a task holds once texts have become terms does not grow with the input.
    """
    rows = df.select(key, F.col(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text") + ROW_BYTES)).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(size / BYTES_PER_TASK))
    terms = rows.repartition(tasks, F.col(key)).select(key, ngram_terms(F.col("_text")).alias("_words"))
    terms = terms.select(key, F.explode_outer(with_bigrams(F.col("_words"))).alias("term"))
    return terms.filter(F.col("term").isNotNull())


def term_counts(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, term, c), spread by key as `occurrences` are."""
    return occurrences(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))


def known_counts(df: DataFrame, terms: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, idx, c): how often a text holds each term of `terms`.

    Terms outside the table leave before anything is counted, and counting goes by their
    numbers `idx`. Whatever else is known of a term is joined to the counts by number:
    what a task keeps for a term of a text is its key and two numbers.
    """
    numbers = terms.select("term", "idx")
    if numbers.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        # Too many terms to send: they are counted first, so that a frequent one is a row per text.
        return term_counts(df, key, text).join(numbers, "term").select(key, "idx", "c")
    found = occurrences(df, key, text).join(F.broadcast(numbers), "term")
    return found.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("c"))


def term_totals(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(term, tot) of all terms, staged."""
    return stage(occurrences(df, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("tot")), "term_totals")


def counted_terms(
    df: DataFrame, key: str = "row_id", text: str = "text", max_terms: int = MAX_TERMS, totals: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(idx, term, tot, df) of the `max_terms` most frequent terms, and (key, idx, c) of the texts, both staged.

    The totals alone tell which terms are the most frequent. Only for those, and by their
    numbers, texts are counted term by term. `totals`, the `term_totals` of the texts if
    they are at hand, save cutting the texts once more.
    """
    totals = term_totals(df, key, text) if totals is None else totals
    top = top_of_staged(totals, max_terms, "tot", F.col("term").asc())
    top = stage(top.select((F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "term", "tot"), "top_terms")
    counts = stage(known_counts(df, top, key, text), "term_counts")
    texts = counts.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    return stage(top.join(texts, "idx"), "counted_terms"), counts


def top_terms(counts: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, tot, df): the `max_terms` most frequent terms, ties by term."""
    terms = counts.groupBy("term").agg(F.sum("c").alias("tot"), F.count(F.lit(1)).alias("df"))
    return top_by_count(terms, max_terms, "tot", F.col("term").asc())


def numbered_terms(terms: DataFrame, n_docs: int) -> DataFrame:
    """(idx, term, idf): column numbers in term order; at most `max_terms` rows."""
    idx = F.row_number().over(Window.orderBy("term")) - 1
    return with_idf(terms.select(idx.alias("idx"), "term", "df"), n_docs)


def with_idf(terms: DataFrame, n_docs: int) -> DataFrame:
    """(idx, term, idf) of terms that have their numbers."""
    return terms.select("idx", "term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def raw_weight(idf: str = "idf") -> Column:
    """Weight of a term in a text before the text's vector gets unit length."""
    return (1.0 + F.log(F.col("c").cast("double"))) * F.col(idf)


def weigh(
    counts: DataFrame, terms: DataFrame, key: str = "row_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, idx, term, weight, ...keep) for the terms of a fitted table.

    `counts` has a term's number (`known_counts`) or the term itself (`term_counts`). A
    table of up to a million terms is broadcast, a larger one joined.
    """
    on = "term" if "term" in counts.columns else "idx"
    raw = counts.join(broadcast_if_small(terms), on).withColumn("_w", raw_weight())
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "idx", "term", (F.col("_w") / norm).alias("weight"), *keep)


def term_sums(
    docs: DataFrame, terms: DataFrame, key: str, models: list[tuple[str, list[Column]]], text: str = "text"
) -> DataFrame:
    """(key, sums): for each model an array with, for each of its coefficients, the sum over a text's unit vector.

    A model is the idf column of `terms` that it goes by, null for a term it does not know,
    and its coefficients over columns of `terms`. `terms` has one row per `idx` for all
    models, so that a text's terms are counted once. Lengths and all sums come from one
    aggregation over rows spread by key; no vector and no window is needed. A text without
    known terms has no row, a model that knows none of its terms has null sums.
    """
    idfs = [F.col(idf).alias(f"_f{m}") for m, (idf, _) in enumerate(models)]
    coefs = [c.alias(f"_c{m}_{k}") for m, (_, each) in enumerate(models) for k, c in enumerate(each)]
    counts = known_counts(docs, terms, key, text)
    raw = counts.join(broadcast_if_small(terms.select("idx", *idfs, *coefs)), "idx")
    weights = [raw_weight(f"_f{m}").alias(f"_w{m}") for m in range(len(models))]
    rows = raw.select(key, *weights, *[f"_c{m}_{k}" for m, (_, each) in enumerate(models) for k in range(len(each))])
    squares = [F.sum(F.col(f"_w{m}") * F.col(f"_w{m}")).alias(f"_squares{m}") for m in range(len(models))]
    sums = [
        F.sum(F.col(f"_w{m}") * F.col(f"_c{m}_{k}")).alias(f"_s{m}_{k}") for m, (_, each) in enumerate(models) for k in range(len(each))
    ]
    found = rows.groupBy(key).agg(*squares, *sums)
    scaled = [
        F.array(*[F.col(f"_s{m}_{k}") / F.sqrt(f"_squares{m}") for k in range(len(each))]) for m, (_, each) in enumerate(models)
    ]
    return found.select(key, F.array(*scaled).alias("sums"))
