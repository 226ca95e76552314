"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions.text import lines_of, sentences_of
from civitext.operators.cleaning import clean_generated
from civitext.operators.common import exploded, spread
from civitext.operators.encoding import decode_tokens
from civitext.operators.splitting import stratified_split
from civitext.plans.corpus import Corpus, build_corpus
from civitext.session import stage

LINE_KEYS = ["doc_id", "line_no"]
FLAG_COLUMNS = ["toxic", "low_quality"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of a table, spread over the cores if its files are few."""
    return spread(table(spark, sf, name).select(key, text), key)


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, comment_text, toxic, low_quality): the comment table."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic", (1 - F.col("quality")).alias("low_quality"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("comment_text"))
    return docs.join(labels, "doc_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id")


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label) of the labelled table, without reading the texts."""
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


def with_stand_in(df: DataFrame) -> DataFrame:
    """Adds `prob`, a fixed score where a model would be needed, and `prediction`."""
    df = df.withColumn("prob", (F.col("doc_id") % 10) / F.lit(10.0))
    return df.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return exploded(docs, ["doc_id"], lines_of(F.col("text")), "line_no", "text")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return exploded(docs, ["doc_id"], sentences_of(F.col("text")), "sent_no", "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, tag, line_no, text): conversation lines with the role as tag."""
    rows = table(spark, sf, "conversations").withColumnRenamed("role", "tag")
    return exploded(rows, ["conv_id", "turn", "tag"], lines_of(F.col("text")), "line_no", "text")


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return build_corpus(lines(spark, sf), LINE_KEYS)


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, text): encoded lines decoded again, rare words as the unknown mark."""
    built = corpus(spark, sf)
    return decode_tokens(built.encoded, built.vocab, LINE_KEYS)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned candidates (doc_id, line_no, text), staged as several reports read them."""
    return stage(clean_generated(round_trip(spark, sf)), "candidates")


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(label_rows(spark, sf), key="doc_id")


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(labelled(spark, sf), key="doc_id")


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(spark, sf).filter(F.col("split") == "train")


def annotated_posts(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, post_tokens, annotators, label): turns as posts with up to three votes by a fixed rule."""
    turn, conv = F.col("turn"), F.col("conv_id")
    votes = [turn % 3, (turn + conv) % 3, F.length("text") % 3]
    annotators = F.array(*[F.struct(v.cast("int").alias("label")) for v in votes])
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.split("text", " ").alias("post_tokens"),
        F.when(turn % 4 != 3, annotators).alias("annotators"),
        F.when(conv % 5 != 0, (conv % 3).cast("int")).alias("label"),
    )
