"""Token ids as flat unsigned integers with 64-bit document offsets.

Documents are dealt out by ranges of their keys. Every task encodes its range and
writes three flat little-endian files: token ids in the smallest unsigned type that
holds the vocabulary, document ends as 64-bit offsets within the file, and document
keys. A table lists what the tasks that counted have written; prefix sums over its
rows give each file's base in the one stream of all tokens, so no file is rewritten.
Files of lost or repeated tasks are not listed and not read.
"""

from __future__ import annotations

import json
import re
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.session import stage, stage_path

END_ID = 0
# A missing key in a file of keys.
NO_KEY = -(1 << 63)
# Bytes of pieces of text and their ids that a Python worker keeps; beyond that it starts anew.
KNOWN_BYTES = 384 << 20
_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# White space and what follows it up to the next white space. A byte-level tokenizer never
# joins a character with white space that comes after it, so pieces are encoded alone.
_PIECE = f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
# Pieces whose units the pattern below gives: one blank at most, then characters of blocks
# where what is a letter or a number has long been settled. The library cuts all others.
_PLAIN = f"[{_SPACE}]?[^{_SPACE}\\u0530-\\U0010ffff]+"
# The units of a byte-level tokenizer within such a piece.
_UNIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def _byte_signs() -> dict[str, str]:
    """How a byte-level tokenizer spells bytes: printable ones as themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return str.maketrans({chr(b): chr(256 + n) for n, b in enumerate(others)})


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, local if it names no scheme."""
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+:/", uri) else f"file://{uri}")


class _Known(dict):
    """Ids of pieces and their units as bytes; one that is asked for and not known is learned."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn, self.held = learn, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        self.held += len(piece) + len(ids) + 200
        return ids


class Encoder:
    """Ids of whole texts as bytes, as the tokenizers library's plain call on each text gives them.

    With a byte-level tokenizer words recur, so each different piece is learned once: it is
    cut into units, and the library's model turns each different unit into ids. Texts that
    hold one of the tokenizer's added tokens, and all texts of other kinds of tokenizer,
    are encoded whole.
    """

    def __init__(self, path: str, kind: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str())
        cut = parts["pre_tokenizer"] or {}
        by_piece = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        self.by_piece = by_piece and parts["normalizer"] is None and parts["model"]["type"] == "BPE" and not parts["model"]["dropout"]
        self.added = [t["content"] for t in parts["added_tokens"]]
        if self.by_piece:
            self.cut, self.tokenize = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model.tokenize
        self.kind, self.signs, self.known = kind, _byte_signs(), _Known(self._learn)
        self.pieces, self.is_plain, self.units = re.compile(_PIECE).findall, re.compile(_PLAIN).fullmatch, regex.compile(_UNIT).findall

    def _ids(self, spelled: list[str]) -> bytes:
        """Ids of units in the tokenizer's spelling of bytes."""
        return np.array([t.id for unit in spelled for t in self.tokenize(unit)], self.kind).tobytes()

    def _learn(self, piece: str) -> bytes:
        if not self.is_plain(piece):
            return self._ids([u for u, _ in self.cut(piece)])
        units = self.units(piece)
        if len(units) > 1:  # a unit is a piece of its own
            return b"".join(map(self.known.__getitem__, units))
        return self._ids([piece.encode().decode("latin-1").translate(self.signs)])

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.known.held > KNOWN_BYTES:
            self.known = _Known(self._learn)
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


def encoder_of(path: str, kind: str) -> Encoder:
    """The Python worker's encoder for a file.

    Workers serve one task after the other and what they have learned is good for all of
    them. Functions come by value, so what tasks share is a module made for it.
    """
    shared = sys.modules.setdefault("_civitext_worker", types.ModuleType("_civitext_worker"))
    held = shared.__dict__.setdefault("encoders", {})
    if (path, kind) not in held:
        held[path, kind] = Encoder(path, kind)
    return held[path, kind]


def _writer(folder: str, tokenizer: str, kind: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer, kind)
        part, end = TaskContext.get().partitionId(), np.array([end_id], kind).tobytes()
        width = np.dtype(kind).itemsize
        store, path = store_of(folder)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        docs = tokens = 0
        with (
            store.open_output_stream(f"{path}/{name}.tokens") as out,
            store.open_output_stream(f"{path}/{name}.ends") as ends,
            store.open_output_stream(f"{path}/{name}.keys") as keys,
        ):
            for batch in batches:
                at = []
                # One text at a time leaves the Arrow batch.
                for text in batch.column("text"):
                    ids = encoder.encode(text.as_py() or "")
                    out.write(ids + end)
                    tokens += len(ids) // width + 1
                    at.append(tokens)
                ends.write(np.array(at, "<i8").tobytes())
                names = batch.column("key").fill_null(NO_KEY).to_numpy(zero_copy_only=False)
                keys.write(names.astype("<i8").tobytes())
                docs += len(at)
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([tokens])], ["part", "name", "docs", "tokens"]
            )

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", vocabulary: int = 50_257,
    end_id: int = END_ID, parts: int | None = None,
) -> DataFrame:
    """(part, name, docs, tokens, first_doc, first_token): the files of all tokens, in order.

    Documents are in ascending order of key, null keys first, equal keys by a hash of the
    text and then the text; keys are whole numbers or become such. A null text is an empty
    one, which has the end id alone. An empty table has no files.
    """
    spark = docs.sparkSession
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    parts = parts or max(docs.rdd.getNumPartitions(), 1)
    # By key and a hash, not the text: the sample that finds the ranges goes to the driver.
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    listed = stage(
        ranged.mapInArrow(_writer(folder, tokenizer, kind, end_id), "part int, name string, docs long, tokens long"), "token_files"
    )
    # One row per file: the prefix sums need no more.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("first_doc", F.coalesce(F.sum("docs").over(before), F.lit(0))).withColumn(
        "first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    ).withColumn("kind", F.lit(kind))


def _mapped(store: fs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Numbers `first` to `last` of a file: memory-mapped where it is local, else read as asked for."""
    if isinstance(store, fs.LocalFileSystem):
        numbers = np.memmap(path, kind, "r")
        return lambda first, last: numbers[first:last]
    file, width = store.open_input_file(path), np.dtype(kind).itemsize
    return lambda first, last: np.frombuffer(file.read_at((last - first) * width, first * width), kind)


def _reader(folder: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                tokens, ends, keys = (
                    _mapped(store, f"{path}/{row['name']}.{what}", kind)
                    for what, kind in (("tokens", row["kind"]), ("ends", "<i8"), ("keys", "<i8"))
                )
                first = 0
                for begin in range(0, row["docs"], 2000):
                    last = min(begin + 2000, row["docs"])
                    stops, named = ends(begin, last), keys(begin, last)
                    starts = np.concatenate(([first], stops[:-1]))
                    body = np.asarray(tokens(first, int(stops[-1])), "<u4")
                    ids = [body[a - first : b - first] for a, b in zip(starts, stops)]
                    columns = [
                        pa.array(named, mask=named == NO_KEY), pa.array(starts + row["first_token"]), pa.array(stops - starts),
                        pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    ]
                    first = int(stops[-1])
                    if with_ids:
                        columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                    names = ["key", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def read_token_files(listed: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document, from the files.

    `start` counts the tokens before the document in the whole stream. The checksum is
    over all its ids as 32-bit little-endian numbers.
    """
    spread = listed.repartition(max(listed.count(), 1), "part")
    kinds = "key long, start long, n_tokens long, ids_crc32 long"
    return spread.mapInArrow(_reader(folder, with_ids), kinds + (", ids array<long>" if with_ids else ""))


def token_folder(spark: SparkSession) -> str:
    return stage_path(spark, "tokens")
