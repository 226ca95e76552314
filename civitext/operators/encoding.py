"""Words to ids and back, through joins with the vocabulary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.functions.sequences import pad, until_eos
from civitext.schemas import MAX_SEQ_LENGTH, MAX_SEQ_LENGTH_B, PAD_ID, SPECIALS_A, START_ID, UNK_ID, UNK_ID_B
from civitext.session import BROADCAST_ROWS, stage

SALTS = 16


def encodable(tokens: Column, max_len: int = MAX_SEQ_LENGTH) -> Column:
    """Two to `max_len` - 1 tokens: room for an end mark."""
    n = F.size(tokens)
    return (n > 1) & (n <= max_len - 1)


def sample_length(tokens: Column, max_len: int = MAX_SEQ_LENGTH) -> Column:
    """Three to `max_len` - 1 tokens."""
    n = F.size(tokens)
    return (n >= 3) & (n < max_len)


def look_up(
    items: DataFrame, table: DataFrame, on: str, value: str, how: str = "left", head_rows: int | None = None
) -> DataFrame:
    """Adds `value` of `table` to every item, null where `on` is not in it.

    A table of bounded size is broadcast. A larger one is joined in two steps:
    its low ids, the most used words, are broadcast, and only items not found
    there are shuffled, salted against a hot key outside the vocabulary. The items
    are staged in between, so that what they come from is computed once.
    """
    head_rows = head_rows or BROADCAST_ROWS
    if table.limit(head_rows + 1).count() <= head_rows:
        return items.join(F.broadcast(table), on, how)
    # Ids are dense from 0, so this side has at most `head_rows` rows.
    head = table.filter(F.col("id") < head_rows).select(on, F.col(value).alias("_head"))
    tail = table.filter(F.col("id") >= head_rows).select(on, F.col(value).alias("_tail"))
    tail = tail.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = stage(items.join(F.broadcast(head), on, "left"), "looked_up")
    salt = F.pmod(F.xxhash64(*items.columns), F.lit(SALTS)).cast("int")
    found = first.filter(F.col("_head").isNotNull()).withColumn(value, F.col("_head")).drop("_head")
    rest = (
        first.filter(F.col("_head").isNull())
        .drop("_head")
        .withColumn("_salt", salt)
        .join(tail, [on, "_salt"], "left")
        .withColumn(value, F.col("_tail"))
        .drop("_salt", "_tail")
    )
    joined = found.unionByName(rest)
    return joined if how == "left" else joined.filter(F.col(value).isNotNull())


def _regroup(items: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return items.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias(name))


def encode_tokens(
    df: DataFrame, vocab: DataFrame, keys: list[str], tokens: str = "tokens", unk_id: int = UNK_ID
) -> DataFrame:
    """(*keys, ids): the id of every token, `unk_id` for words outside the vocabulary.

    Sequences are spread by key before they are cut into tokens, so joining a
    broadcast vocabulary and putting them together again needs no other shuffle.
    """
    items = df.repartition(*[F.col(k) for k in keys]).select(
        *keys, F.posexplode_outer(tokens).alias("pos", "word")
    )
    found = look_up(items, vocab, "word", "id")
    ids = F.coalesce(F.col("id"), F.lit(unk_id)).cast("int")
    coded = found.select(*keys, "pos", F.when(F.col("pos").isNotNull(), ids).alias("id"))
    grouped = _regroup(coded, keys, "id", "ids")
    return grouped.withColumn("ids", F.array_compact("ids"))


def encode_cut(
    df: DataFrame, vocab: DataFrame, keys: list[str], tokens: str = "tokens", max_len: int = MAX_SEQ_LENGTH_B,
    unk_id: int = UNK_ID_B,
) -> DataFrame:
    """(*keys, ids, length): the first `max_len` tokens as ids, padded to that length, and their number.

    The fixed-width input of a recurrent classifier; a text without tokens has length 0.
    """
    cut = df.select(*keys, F.slice(tokens, 1, max_len).alias(tokens))
    coded = encode_tokens(cut, vocab, keys, tokens, unk_id)
    return coded.select(*keys, pad(F.col("ids"), max_len).alias("ids"), F.size("ids").alias("length"))


def _decode(df: DataFrame, vocab: DataFrame, keys: list[str], ids: Column, unknown: str | None) -> DataFrame:
    items = df.select(*keys, ids.alias("_ids"))
    items = items.repartition(*[F.col(k) for k in keys]).select(
        *keys, F.posexplode_outer("_ids").alias("pos", "id")
    )
    found = look_up(items, vocab, "id", "word")
    word = F.col("word") if unknown is None else F.coalesce("word", F.lit(unknown))
    named = found.select(*keys, "pos", F.when(F.col("pos").isNotNull(), word).alias("word"))
    # Joining skips nulls: unknown ids without a stand-in and empty sequences.
    return _regroup(named, keys, "word", "words").select(*keys, F.array_join("words", " ").alias("text"))


def decode_tokens(df: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(*keys, text): ids up to the end mark, start marks skipped, unknown ids as the unknown mark."""
    kept = F.array_remove(until_eos(F.col(ids)), START_ID)
    return _decode(df, vocab, keys, kept, SPECIALS_A[UNK_ID])


def decode_sample(df: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(*keys, text): as above, but padding and unknown ids are dropped."""
    kept = F.array_remove(F.array_remove(until_eos(F.col(ids)), PAD_ID), START_ID)
    return _decode(df, vocab, keys, kept, None)


def decode_keep_eos(df: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(*keys, text): padding and start marks dropped, the end mark kept as a word."""
    kept = F.array_remove(F.array_remove(F.col(ids), PAD_ID), START_ID)
    return _decode(df, vocab, keys, kept, SPECIALS_A[UNK_ID])
