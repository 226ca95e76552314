"""Quality rules: base figures of a text, and a hashed n-gram log-likelihood ratio.

Tokens are lower-cased runs of letters and digits, and runs of other characters but
white space. Every single token and every pair of neighbours is hashed into BUCKETS
buckets. Two multinomials over the buckets are counted: one over the trusted texts,
one over the whole corpus. A text's score is the mean over its n-grams of
log(trusted share / corpus share), both smoothed by one; it is kept if the mean is
at least MIN_SCORE, which has no part that depends on other texts' scores.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import as_row, words
from civitext.operators.common import compute_once

BUCKETS = 10_000
MIN_SCORE = -0.1
MIN_WORDS = 50
_FEW = 32
SYMBOLS = "[#*$%&|<>]"
_TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"


def _pairs_of(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(item, next item) for neighbours of an array; empty under two items."""
    size = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, size), F.slice(items, 2, size), combine)


def _repeat_places(windows: Column, repeated: Column) -> Column:
    """Positions, in order, of the windows whose hash is in the array `repeated`.

    A few repeated hashes are looked for one by one. Among many, all windows are sorted
    with their positions, so that equal ones are neighbours. Both give the same.
    """
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    few = F.transform(F.filter(placed, lambda s: F.array_contains(repeated, s["h"])), lambda s: s["p"])
    pairs = _pairs_of(F.sort_array(placed), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    many = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    return F.when(F.size(repeated) <= _FEW, few).otherwise(many)


def base_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has none of anything and fails. Windows of three words are
    compared by 64-bit hashes within their text. A repeated window covers three words,
    less where the next one starts before that.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    df = compute_once(df, "_words", words(own))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(own, F.lit(SYMBOLS)).cast("long"))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = compute_once(df, "_lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = compute_once(df, "_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    two = _pairs_of(F.col("_hashes"), lambda a, b: F.xxhash64(a, b))
    size = F.greatest(F.size("_hashes") - 2, F.lit(0))
    three = F.zip_with(F.slice(two, 1, size), F.slice("_hashes", 3, size), lambda ab, c: F.xxhash64(ab, c))
    df = compute_once(df, "_windows", three)
    df = compute_once(df, "_sorted", F.sort_array("_windows"))
    twice = _pairs_of(F.col("_sorted"), lambda a, b: F.when(a == b, a))
    df = compute_once(df, "_twice", F.array_distinct(F.array_compact(twice)))
    df = compute_once(df, "_at", F.when(F.size("_twice") > 0, _repeat_places(F.col("_windows"), F.col("_twice"))))
    steps = _pairs_of(F.col("_at"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + 3
    df = df.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_twice", "_at")


def token_hashes(text: Column) -> Column:
    """Hashes of a text's tokens, in their order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def bucket_counts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, n, own): n-grams of all texts and of the trusted ones, by bucket.

    `trusted` has the keys of the trusted texts. Texts with a null key count for the
    corpus only.
    """
    marked = trusted.select(F.col(key).alias("_key")).filter("_key is not null").distinct().withColumn("_trusted", F.lit(True))
    # Trusted keys grow with the corpus: never broadcast, so that the plan is one at every size.
    read = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    read = read.join(marked.hint("merge"), "_key", "left")
    read = compute_once(read.select("_trusted", "_text"), "_hashed", token_hashes(F.col("_text")))
    # Lambdas end with the array, so that its rows are made, put into buckets and counted in one compiled loop.
    grams = F.concat("_hashed", _pairs_of(F.col("_hashed"), lambda a, b: F.xxhash64(a, b)))
    read = compute_once(read.select("_trusted", "_hashed"), "_grams", grams)
    read = read.select("_trusted", F.explode("_grams").alias("_gram"))
    counted = read.groupBy(_bucket(F.col("_gram")).alias("bucket"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count("_trusted").alias("own"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """log(trusted share / corpus share) by bucket; BUCKETS numbers whatever the corpus."""
    counted = bucket_counts(docs, trusted, key, text).collect()
    raw = {r["bucket"]: r["n"] for r in counted}
    own = {r["bucket"]: r["own"] for r in counted}
    all_raw, all_own = sum(raw.values()) + BUCKETS, sum(own.values()) + BUCKETS
    return [
        math.log((own.get(b, 0) + 1) / all_own) - math.log((raw.get(b, 0) + 1) / all_raw) for b in range(BUCKETS)
    ]


def with_score(df: DataFrame, weights: list[float], text: str = "text") -> DataFrame:
    """Adds `score`: the mean weight of a text's n-grams, 0 for a text without any."""
    df = compute_once(df, "_hashed", token_hashes(F.col(text)))
    # One literal after constant folding; an array of literals would be built for every n-gram.
    known = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate("_hashed", F.lit(0.0), lambda s, h: s + F.get(known, _bucket(h)))
    pairs = _pairs_of(F.col("_hashed"), lambda a, b: F.get(known, _bucket(F.xxhash64(a, b))))
    total = total + F.aggregate(pairs, F.lit(0.0), lambda s, w: s + w)
    size = F.greatest(2 * F.size("_hashed") - 1, F.lit(0))
    return df.withColumn("score", F.when(size > 0, total / size).otherwise(0.0)).drop("_hashed")


def judge_quality(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE
) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    One row for every row of `docs`, the row itself as a struct: repeated rows are
    judged alike, a null key stays null, an empty table gives no rows.
    """
    weights = bucket_weights(docs, trusted, key, text)
    judged = base_figures(docs.select(as_row(docs), F.col(f"`{text}`").alias("text")))
    judged = with_score(judged, weights).drop("text")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
