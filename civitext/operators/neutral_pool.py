"""Pool of neutral sentences: filtering, scoring, survival, few-shot examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions.text import is_good_neutral, sanitize_line, straighten, wordpunct
from civitext.operators.common import packed
from civitext.operators.encoding import sample_length
from civitext.operators.ordered import best_rows, with_row_number
from civitext.operators.sampling import first_rows, sample_k
from civitext.operators.splitting import hash_order
from civitext.schemas import MAX_SEQ_LENGTH
from civitext.session import broadcast_if_small, stage

# Number of examples, size of the head they are drawn from, share
# of the pool that survives a refresh, and the least pool in examples.
K_SHOTS = 5
TOP_N = 100
EVOLVE_RATE = 0.5
LEAST_POOL = 4

# Fixed text of the few-shot prompt.
PROMPT_HEADER = [
    "You generate exactly one neutral, non-toxic online message.",
    "Requirements:",
    "- Output exactly one single-line sentence.",
    "- Keep it natural, plain, and conversational.",
    "- Do not use labels, bullets, quotes, markdown, wiki markup, redirects, usernames, or explanations.",
    "- Do not mention toxicity, hate speech, or safety.",
    "- Keep it under 20 words.",
    "",
    "Examples:",
]
PROMPT_FOOTER = ["", "Output one new neutral sentence only:"]


def dedup_first_seen(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """(*order, text): the first row of every distinct text, by `order`, whose values name a row.

    Rows are grouped by two independent 64-bit hashes of the text, and the first one is a
    minimum of one packed number, so both aggregations hash fixed-width keys and combine
    before the shuffle: a text holding a large share of the rows arrives as one row per
    task. Texts stay where they are until the rows to drop are known; these leave by an
    anti-join on `order`, broadcast up to a counted size. A third hash tells whether
    different texts met under one name; such a group is told apart by the texts themselves.
    """
    named = df.select(*order, text).withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(F.lit(1), text))
    check = F.xxhash64(F.lit(2), text)
    place = packed(df, order)
    narrow = stage(named.select(*order, "_a", "_b", check.alias("_check"), place.alias("_place")), "text_names")
    groups = narrow.groupBy("_a", "_b").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.min("_check").alias("_low"), F.max("_check").alias("_high"),
    )
    repeated = stage(groups.filter("_n > 1"), "repeated_texts")
    met = narrow.join(broadcast_if_small(repeated), ["_a", "_b"])
    clash = repeated.filter("_low <> _high").select("_a", "_b")
    later = met.filter((F.col("_low") == F.col("_high")) & (F.col("_place") != F.col("_first"))).select(*order)
    later = stage(later, "later_rows")
    kept = df.select(*order, text)
    if not clash.isEmpty():
        apart = named.join(F.broadcast(clash), ["_a", "_b"], "left_semi").select(*order, text)  # a chance of 2^-128 a pair
        kept = named.join(F.broadcast(clash), ["_a", "_b"], "left_anti").select(*order, text)
        first = apart.groupBy(text).agg(F.min(F.struct(*order)).alias("_first"))
        kept = kept.unionByName(first.select(*[F.col(f"_first.{c}").alias(c) for c in order], text))
    return kept.join(broadcast_if_small(later), order, "left_anti").select(*order, text)


def not_examples(df: DataFrame, examples: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not among the examples."""
    return df.join(examples.select(text).distinct(), text, "left_anti").select(*df.columns)


def neutral_candidates(df: DataFrame, text: str = "text", max_words: int = MAX_SEQ_LENGTH) -> DataFrame:
    return df.filter(is_good_neutral(F.col(text), max_words))


def fallback_pool(
    neutrals: DataFrame,
    examples: DataFrame,
    needed: int,
    key: str = "row_id",
    seed: int = 42,
    max_words: int = MAX_SEQ_LENGTH,
) -> DataFrame:
    """(rank, text): up to `needed` usable sentences in draw order.

    `needed` non-example neutrals are drawn (any neutral, if all of them are
    examples), sanitized, filtered and freed of repeats.
    """
    others = not_examples(neutrals, examples)
    if others.isEmpty():
        others = neutrals
    drawn = sample_k(others.select(key, "text"), needed, key, seed)
    # From here on at most `needed` rows are left.
    drawn = drawn.withColumn("_h", hash_order(key, seed)).withColumn("text", sanitize_line(F.col("text")))
    good = not_examples(neutral_candidates(drawn, "text", max_words), examples)
    unique = good.groupBy("text").agg(F.min(F.struct("_h", key)).alias("_first"))
    places = [F.col("_first._h").asc(), F.col(f"_first.{key}").asc()]
    return with_row_number(unique.select("_first", "text"), places, "rank").select("rank", "text")


def score_pool(df: DataFrame, score: Column, text: str = "text", max_len: int = MAX_SEQ_LENGTH) -> DataFrame:
    """Adds `score`, 0 for a text that has too few or too many tokens."""
    fits = sample_length(wordpunct(F.col(text)), max_len)
    return df.withColumn("score", F.when(fits, score).otherwise(F.lit(0.0)))


def pool_size(n: int, rate: float = EVOLVE_RATE, k_shots: int = K_SHOTS) -> int:
    """Rows of a pool of `n` that survive: max(4 * k_shots, min(n, int(n * rate)))."""
    return max(LEAST_POOL * k_shots, min(n, int(n * rate)))


def surviving(pool: DataFrame, keys: list[str], rate: float = EVOLVE_RATE, k_shots: int = K_SHOTS) -> DataFrame:
    """The best rows by score, equal scores in key order. Texts are not moved to find them."""
    return best_rows(pool, pool_size(pool.count(), rate, k_shots), "score", keys)


def refresh_pool(
    pool: DataFrame, keys: list[str], rate: float = EVOLVE_RATE, k_shots: int = K_SHOTS
) -> DataFrame:
    """The best rows by score with their `rank`; ranks are settled on scores and keys alone."""
    # Scores are computed once, here; the rest of the rows is read again for the survivors.
    narrow = stage(pool.select(*keys, "score"), "pool_scores")
    kept = surviving(narrow, keys, rate, k_shots)
    ranks = with_row_number(kept, [F.col("score").desc(), *[F.col(k).asc() for k in keys]], "rank")
    return pool.drop("score").join(ranks, keys).select(*pool.columns, "rank")


def fewshot_examples(
    pool: DataFrame,
    neutrals: DataFrame | None = None,
    top_n: int = TOP_N,
    k_shots: int = K_SHOTS,
    order: list[str] | None = None,
    key: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """(rank, text): `k_shots` texts drawn from the non-empty ones of the `top_n` best rows.

    With fewer candidates than shots, all of them are taken and the rest is
    drawn from the neutrals that are not among them.
    """
    best = [F.col("score").desc(), *[F.col(c).asc() for c in (order or [key])]]
    top = first_rows(pool, top_n, *best).filter(F.length("text") > 0)
    drawn = sample_k(top.select(key, "text"), k_shots, key, seed)
    drawn = drawn.select(F.lit(0).alias("_part"), hash_order(key, seed).alias("_h"), "text")
    if neutrals is not None:
        missing = k_shots - drawn.count()
        if missing > 0:
            extra = sample_k(not_examples(neutrals.select(key, "text"), top), missing, key, seed)
            drawn = drawn.unionByName(
                extra.select(F.lit(1).alias("_part"), hash_order(key, seed).alias("_h"), "text")
            )
    # At most `k_shots` rows.
    return drawn.select(F.row_number().over(Window.orderBy("_part", "_h")).alias("rank"), "text")


def prompt_text(examples: DataFrame) -> DataFrame:
    """(prompt): fixed header, numbered examples, fixed footer. `examples` holds a few rows."""
    numbered = F.struct("rank", straighten(F.col("text")).alias("text"))
    listed = examples.agg(F.array_sort(F.collect_list(numbered)).alias("ex"))
    lines = F.transform("ex", lambda e: F.concat(e["rank"].cast("string"), F.lit(". "), e["text"]))
    parts = F.concat(
        F.array(*[F.lit(s) for s in PROMPT_HEADER]), lines, F.array(*[F.lit(s) for s in PROMPT_FOOTER])
    )
    return listed.select(F.array_join(parts, "\n").alias("prompt"))
