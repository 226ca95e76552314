"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

# Flag columns of the multi-label comment table.
FLAGS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# Classes that get a text file of their own, and the neutral tag.
EXPORT_FLAGS = ["toxic", "obscene", "insult", "identity_hate"]
NEUTRAL_TAG = "nor"

COMMENTS = T.StructType(
    [T.StructField("comment_text", T.StringType())]
    + [T.StructField(f, T.IntegerType()) for f in FLAGS]
)

# One object holding two parallel arrays.
GENERATED_COLUMNS = T.StructType(
    [
        T.StructField("tweet", T.ArrayType(T.StringType())),
        T.StructField("class", T.ArrayType(T.StringType())),
    ]
)

# One object per sample.
GENERATED_ROWS = T.StructType(
    [T.StructField("tweet", T.StringType()), T.StructField("class", T.StringType())]
)

# Special tokens of encoder A, ids 0-3, and of encoder B, ids 0-1.
SPECIALS_A = ["<PAD>", "<START>", "<EOS>", "<UNK>"]
SPECIALS_B = ["<PAD>", "<UNK>"]
PAD_ID, START_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
UNK_ID_B = 1

# Lengths and frequencies.
MAX_SEQ_LENGTH = 20
MAX_SEQ_LENGTH_B = 200
MIN_FREQ_A = 3
MIN_FREQ_B = 2
TOP_WORDS_B = 50_000
