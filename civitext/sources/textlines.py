"""Text files of any common encoding, class files, and the per-class export."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.functions.text import is_nonblank, strip
from civitext.schemas import NEUTRAL_TAG
from civitext.session import broadcast_if_small, stage

# What ends a line besides "\n"; "\r\n" counts once.
LINE_BREAKS = r"\r|[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Bytes 0x80-0x9f, read as Latin-1, and what the Windows code page makes of them.
C1_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
C1_FROM = "".join(map(chr, C1_BYTES))
C1_TO = bytes(C1_BYTES).decode("cp1252")
C1_UNDEFINED = "[" + "".join(rf"\x{b:02x}" for b in range(0x80, 0xA0) if b not in C1_BYTES) + "]"
# Bytes of an exported file.
FILE_BYTES = 128 << 20


def _split_index(raw: DataFrame) -> DataFrame:
    """(path, _block, _first, _n, _before, _utf8, _undefined): one row for each split of each file.

    `_first` is the number of a split's first row among all rows of the read, `_before` the
    lines of the file before the split. Encodings are settled for the whole file.
    """
    latin = F.decode("_raw", "ISO-8859-1")
    per_split = raw.groupBy("path", "_block").agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.is_valid_utf8(F.col("_raw").cast("string"))).alias("_utf8"),
        F.bool_or(latin.rlike(C1_UNDEFINED)).alias("_undefined"),
    )
    file = Window.partitionBy("path")
    before = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select(
        "path",
        "_block",
        "_first",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.bool_and("_utf8").over(file).alias("_utf8"),
        F.bool_or("_undefined").over(file).alias("_undefined"),
    )


def read_text_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = True) -> DataFrame:
    """(path, line_no, piece, value): lines of text files in UTF-8, Windows-1252 or Latin-1.

    The encoding is settled for a whole file: UTF-8 if all of it is valid, else
    Windows-1252 unless a byte it does not define occurs, else Latin-1. Files
    are read by split, so a large one is not held in memory: one pass checks
    the bytes and counts lines per split, the other decodes. `line_no` counts
    newline-ended lines of the file, `piece` the parts that other line breaks
    make of one. A byte-order mark is dropped.

    Rows of a split follow each other in the task that reads it, and both passes read the
    same splits in the same tasks. So a line's number is its row's number in the read, less
    that of its split's first row, plus the lines before the split: the text is neither
    shuffled nor sorted, only the index of the splits is broadcast, up to a counted size.
    Should the passes ever cut the files otherwise, some row lies outside its split as the
    index has it, and the read fails.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").cast("binary").alias("_raw"),
        F.monotonically_increasing_id().alias("_at"),
    )
    latin = F.decode("_raw", "ISO-8859-1")
    lines = raw.join(broadcast_if_small(stage(_split_index(raw), "file_splits")), ["path", "_block"], "left")
    row = F.col("_at") - F.col("_first")
    same = (row >= 0) & (row < F.col("_n"))
    other = F.raise_error(F.lit("files were cut in another way than when their lines were counted")).cast("bigint")
    lines = lines.withColumn("line_no", F.when(same, F.col("_before") + row).otherwise(other))
    windows = F.translate(latin, C1_FROM, C1_TO)
    utf8 = F.col("_raw").cast("string")
    utf8 = F.when(F.col("line_no") == 0, F.regexp_replace(utf8, r"\A\x{FEFF}", "")).otherwise(utf8)
    text = F.when(F.col("_utf8"), utf8).when(F.col("_undefined"), latin).otherwise(windows)
    pieces = F.split(F.regexp_replace(text, r"\r\z", ""), LINE_BREAKS)
    out = lines.select("path", "line_no", F.posexplode_outer(pieces).alias("piece", "value"))
    if keep_blank:
        return out
    return out.filter(is_nonblank(F.col("value"))).withColumn("value", strip(F.col("value")))


def order_tags(tags: list[str], neutral: str = NEUTRAL_TAG) -> list[str]:
    """Neutral tag first (the first tag, if there is no such tag), then the others as given."""
    first = neutral if neutral in tags else tags[0]
    return [first] + [t for t in tags if t != first]


def read_tagged(
    spark: SparkSession, files: dict[str, str], neutral: str = NEUTRAL_TAG, keep_blank: bool = False
) -> DataFrame:
    """(tag, tag_no, path, line_no, piece, value) of several class files."""
    parts = [
        read_text_lines(spark, files[tag], keep_blank).select(
            F.lit(tag).alias("tag"), F.lit(no).alias("tag_no"), "*"
        )
        for no, tag in enumerate(order_tags(list(files), neutral))
    ]
    return reduce(DataFrame.unionByName, parts)


def _numbered_by_bytes(file_bytes: int) -> Callable:
    """Adds `part`: the number of the file that a row goes to, by a running sum of bytes in each task and tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[int, int]] = {}
        for batch in batches:
            numbers = []
            for tag, size in zip(batch.column("tag").to_pylist(), batch.column("bytes").to_pylist()):
                part, used = held.get(tag, (0, 0))
                if used and used + size > file_bytes:
                    part, used = part + 1, 0
                held[tag] = part, used + size
                numbers.append(part)
            columns = [batch.column("tag"), batch.column("text"), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["tag", "text", "part"])

    return run


def write_class_text(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """(tag, text) as one folder of CSV files per tag and part, no header.

    No file is longer than `file_bytes`, but for one that holds a single longer text. A text
    with newlines can only be read by one task per file, so their size bounds that task.
    Each task numbers its files by a running sum of the bytes it writes; nothing is shuffled.
    """
    # A quoted text has its quotes doubled and two around it, and a line end.
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    size = F.coalesce(F.octet_length("text") + quotes, F.lit(0)) + 3
    rows = df.select("tag", "text", size.cast("bigint").alias("bytes"))
    parts = rows.mapInArrow(_numbered_by_bytes(file_bytes), "tag string, text string, part int")
    parts.write.mode("overwrite").partitionBy("tag", "part").options(
        header=False,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def read_class_text(spark: SparkSession, path: str) -> DataFrame:
    """(text, tag) of the export, embedded newlines included."""
    read = spark.read.schema("text string, tag string, part int").options(
        header=False, escape='"', multiLine=True, maxCharsPerColumn=-1
    ).csv(path)
    return read.select("text", "tag")
