"""Corpus job: class texts -> vocabulary -> encoded sequences -> files, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions.sequences import append_eos, frame
from civitext.functions.text import letter_words
from civitext.operators.common import compute_once
from civitext.operators.encoding import encodable, encode_tokens, sample_length
from civitext.operators.vocabulary import vocab_first_seen
from civitext.schemas import MAX_SEQ_LENGTH
from civitext.session import stage
from civitext.sources.textlines import order_tags, read_tagged
from civitext.sources.tokens import write_token_ids, write_vocab_text


@dataclass
class Corpus:
    tokens: DataFrame
    vocab: DataFrame
    encoded: DataFrame
    keys: list[str]


def tokenized(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, tokens)."""
    return compute_once(df, "tokens", letter_words(F.col(text))).select(*keys, "tokens")


def encode_corpus(
    tokens: DataFrame, vocab: DataFrame, keys: list[str], max_len: int = MAX_SEQ_LENGTH
) -> DataFrame:
    """(*keys, ids) of the sequences that fit, each closed by an end mark."""
    fitting = tokens.filter(encodable(F.col("tokens"), max_len))
    return encode_tokens(fitting, vocab, keys).withColumn("ids", append_eos(F.col("ids")))


def encode_framed(
    tokens: DataFrame, vocab: DataFrame, keys: list[str], max_len: int = MAX_SEQ_LENGTH
) -> DataFrame:
    """(*keys, ids) of sample-length sequences between a start and an end mark."""
    fitting = tokens.filter(sample_length(F.col("tokens"), max_len))
    return encode_tokens(fitting, vocab, keys).withColumn("ids", frame(F.col("ids")))


def build_corpus(
    df: DataFrame, keys: list[str], text: str = "text", max_len: int = MAX_SEQ_LENGTH
) -> Corpus:
    """Vocabulary over all lines, ids for those that fit. `keys` give the reading order.

    Texts are cut again for the encoding: staging the tokens took longer where it was measured.
    """
    tokens = tokenized(df, keys, text)
    vocab = stage(vocab_first_seen(tokens, F.col("tokens"), *keys), "vocab")
    return Corpus(tokens, vocab, encode_corpus(tokens, vocab, keys, max_len), keys)


def corpus_job(spark: SparkSession, files: dict[str, str], out: str, max_len: int = MAX_SEQ_LENGTH) -> Corpus:
    """Class text files to token-id files by tag and a vocabulary file."""
    keys = ["tag_no", "path", "line_no", "piece"]
    lines = read_tagged(spark, files)
    corpus = build_corpus(lines, keys, "value", max_len)
    write_vocab_text(corpus.vocab, f"{out}/vocab")
    names = F.array(*[F.lit(t) for t in order_tags(list(files))])
    tagged = corpus.encoded.withColumn("tag", F.element_at(names, F.col("tag_no") + 1))
    write_token_ids(tagged, f"{out}/ids")
    return corpus
