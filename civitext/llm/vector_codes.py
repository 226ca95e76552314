"""Vector compression: product codes whose codebooks are fitted by ball k-means.

A vector becomes integers, is cut into PARTS equal parts, and each part becomes the
number of the nearest entry of its position's codebook. The fit is exact k-means on
integers, so its results do not depend on the order or number of tasks.

Ball k-means saves distances without changing a result. The parts that held entry i in
the round before are a ball around it, with their largest distance as its radius, taken
per Arrow batch, so that no extra pass is needed. Entry j can only take a part of the
ball if half the distance from i to j is within the radius: these are its neighbours.
Sorted by that half distance they cut the ball into rings. A part inside the first ring,
the stable core, stays where it is; a part in ring r is compared with the r nearest
neighbours only. All comparisons are of exact squares; where halves are equal the entry
is a candidate, so that ties are found and go to the lower number.

A round is one pass over a staged table of one row per vector with its current code.
It writes the next such table and, in the same pass, a row of sums and counts for each
batch; only these rows, a bounded number of columns wide, make the next codebooks. A
round's table is committed before the one before it is deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitext.session import broadcast_if_small, stage, unstage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Labels whose sums are broadcast; a longer list is joined by key and salt.
BROADCAST_LABELS = 100_000
SALTS = 16


def nearest_entries(parts: np.ndarray, entries: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of `entries` for each row of `parts`.

    `held` is any entry number per row; the closer it is, the fewer distances are taken.
    Equal distances go to the lower number.
    """
    gaps = ((entries[:, None] - entries[None]) ** 2).sum(2)
    best, dist = held.copy(), ((parts - entries[held]) ** 2).sum(1)
    doubled = 4 * dist  # of twice the distance, to be compared with whole gaps
    for i in np.unique(held):
        ball = np.flatnonzero(held == i)
        near = np.argsort(gaps[i], kind="stable")
        near = near[near != i]
        near = near[gaps[i][near] <= doubled[ball].max()]
        ring = np.searchsorted(gaps[i][near], doubled[ball], side="right")
        outward = np.argsort(-ring, kind="stable")
        ball, ring = ball[outward], ring[outward]
        for r, j in enumerate(near):
            asked = ball[: np.searchsorted(-ring, -r, side="left")]
            d = ((parts[asked] - entries[j]) ** 2).sum(1)
            wins = (d < dist[asked]) | ((d == dist[asked]) & (j < best[asked]))
            best[asked[wins]], dist[asked[wins]] = j, d[wins]
    return best, dist


def usable(vector: Column) -> Column:
    """False for a null vector and one with a null, infinite or not-a-number component."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Floors of SCALE times the components as a matrix; raises for vectors of another width."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components expected, found one of {lengths[lengths != width][0]}")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype("float64") * SCALE)
    most = np.abs(scaled).max(initial=0)
    if most >= 2**31 or 16 * max(width, 1) * most**2 >= 2**62:
        raise ValueError("components are too large for exact 64-bit distances")
    return scaled.astype("int32").reshape(len(vectors), width)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1, dtype="int32") * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix that `_binary` took apart."""
    size = width * np.dtype(kind).itemsize
    if not size:
        return np.empty((len(column), 0), kind)
    start = np.frombuffer(column.buffers()[1], "int32")[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, start).reshape(-1, width)


def _coded(numbers: np.ndarray, books: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error) of vectors; `books` is (parts, entries, components of a part)."""
    codes, error = np.empty((len(numbers), PARTS), "uint8"), np.zeros(len(numbers), "int64")
    split = numbers.astype("int64").reshape(len(numbers), PARTS, -1)
    for p in range(PARTS):
        best, dist = nearest_entries(split[:, p], books[p], held[:, p].astype("int64"))
        codes[:, p] = best
        error += dist
    return codes, error


def _sums(numbers: np.ndarray, codes: np.ndarray, entries: int) -> list[int]:
    """Counts by (part, entry), then sums by (part, entry, component)."""
    split = numbers.astype("int64").reshape(len(numbers), PARTS, -1)
    counts, sums = np.zeros((PARTS, entries), "int64"), np.zeros((PARTS, entries, split.shape[2]), "int64")
    for p in range(PARTS):
        counts[p] = np.bincount(codes[:, p], minlength=entries)
        np.add.at(sums[p], codes[:, p], split[:, p])
    return [*counts.ravel().tolist(), *sums.ravel().tolist()]


def _first_vectors(vectors: DataFrame) -> np.ndarray:
    """(entry, components) of the vectors with the smallest keys: ENTRIES rows at most."""
    rows = vectors.filter("key is not null").orderBy("key", "vector").limit(ENTRIES).collect()
    if len(rows) < ENTRIES:
        rows += vectors.filter("key is null").orderBy("vector").limit(ENTRIES - len(rows)).collect()
    if not rows:
        return np.empty((0, 0), "int64")
    return _integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), len(rows[0]["vector"])).astype("int64")


def _round(rows: DataFrame, books: np.ndarray, kinds: dict[str, T.DataType], first: bool, last: bool) -> DataFrame:
    """One pass: vectors with their nearest entries, and the sums of each batch or, at last, the errors."""
    width = books.shape[0] * books.shape[2]
    schema = T.StructType([T.StructField("key", kinds["key"]), T.StructField("label", kinds["label"])])
    schema = schema.add("code", "binary")
    schema = schema.add("error", "long") if last else schema.add("numbers", "binary").add("sums", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, label = batch.column("key"), batch.column("label")
            if first:
                numbers, held = _integers(batch.column("vector"), width), np.zeros((batch.num_rows, PARTS), "uint8")
            else:
                numbers, held = _matrix(batch.column("numbers"), "int32", width), _matrix(batch.column("code"), "uint8", PARTS)
            codes, error = _coded(numbers, books, held)
            if last:
                yield pa.RecordBatch.from_arrays([key, label, _binary(codes), pa.array(error)], schema.names)
                continue
            no_sums = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([key, label, _binary(codes), _binary(numbers), no_sums], schema.names)
            sums = pa.array([_sums(numbers, codes, books.shape[1])], pa.list_(pa.int64()))
            none = [pa.nulls(1, key.type), pa.nulls(1, label.type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, sums], schema.names)

    return rows.mapInArrow(run, schema)


def _moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means; an entry without parts stays. One row per number of the codebooks is collected."""
    totals = coded.filter("sums is not null").select(F.posexplode("sums").alias("at", "value"))
    totals = totals.groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(books.shape[0] * books.shape[1] * (1 + books.shape[2]), "int64")
    for at, value in totals:
        flat[at] = value
    cut = books.shape[0] * books.shape[1]
    counts, sums = flat[:cut].reshape(*books.shape[:2], 1), flat[cut:].reshape(books.shape)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def books_digest(books: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all integers by part, entry and position, in decimal and joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code, error), codebooks): the coded vectors as a staged table.

    `code` is one byte per part, `error` the squared distances of all parts. Vectors that
    are null or hold a null or not finite component are left out. The codebooks start as
    the vectors with the smallest keys (ties by vector, null keys after all others); with
    fewer vectors than ENTRIES they have an entry for each. An empty vector has parts
    without components and entry 0. Repeated rows are coded alike and count each time.
    Vectors of several widths, of a width that PARTS does not divide, and components
    beyond exact 64-bit distances raise: none of them has a code.
    """
    named = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    named = named.filter(usable(F.col("vector")))
    kinds = {"key": named.schema["key"].dataType, "label": named.schema["label"].dataType}
    start = _first_vectors(named)
    if start.shape[1] % PARTS:
        raise ValueError(f"{PARTS} equal parts do not make {start.shape[1]} components")
    books = start.reshape(len(start), PARTS, -1 if start.size else 0).transpose(1, 0, 2)
    state = named
    for turn in range(ROUNDS):
        coded = stage(_round(state, books, kinds, turn == 0, False), "codes")
        books = _moved(coded, books)
        if turn:
            unstage(before)  # noqa: F821 - set by the round before
        before, state = coded, coded.filter("sums is null").select("key", "label", "code", "numbers")
    final = stage(_round(state, books, kinds, False, True), "codes")
    unstage(before)
    return final, books


def compress_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row per usable vector.

    `code` has two hex digits for each part, `label_error` is the error summed over all
    vectors of an equal label, nulls together. See `fit_codes` for what is left out or
    raises. Other columns of `vectors` are not read, whatever their names.
    """
    coded, books = fit_codes(vectors, key, vector, label)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    sums = stage(sums, "label_errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    small = broadcast_if_small(sums, BROADCAST_LABELS)
    if small is sums:  # a label may hold a third of all rows
        sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        small, same = sums, same & (F.col("salt") == F.col("_salt"))
    return coded.join(small, same).select(
        F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
