"""Highest cosine similarity of every vector to a set of anchor vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.operators.ordered import with_row_number
from civitext.session import stage_path

# Most bytes of anchors that are sent to every task; more are cut into blocks of this size.
BLOCK_BYTES = 32 << 20
# Blocks that a task keeps in memory.
HELD_BLOCKS = 4
# Most bytes of one product of candidates and anchors, or of their bounds.
PRODUCT_BYTES = 64 << 20
# Anchors that blocks are rings around, at most.
PIVOTS = 256
# What rounding can take from a bound.
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norm, 1e-8)


def _best(units: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Row-wise maximum of the product of unit rows, in tiles of PRODUCT_BYTES at most."""
    out = np.full(len(units), -np.inf)
    side = max(1, int((PRODUCT_BYTES / 8) ** 0.5))
    for at in range(0, len(units), side):
        rows = units[at : at + side]
        for to in range(0, len(anchors), side):
            np.maximum(out[at : at + side], (rows @ anchors[to : to + side].T).max(axis=1), out=out[at : at + side])
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(-1, width)


def _usable(vector: str) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def max_anchor_cosine(
    candidates: DataFrame, anchors: DataFrame, key: str, vector: str, block: int | None = None,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(key, max_cos), one row per candidate: the result is that of every anchor with every candidate.

    Anchors that are null, empty or hold a null are no anchors; usable ones of different
    widths raise. A candidate of another width, with a null element, empty or null has a
    null `max_cos`, and so have all without any anchor.

    Candidates are read once and neither shuffled nor copied. Up to `block` anchors travel
    to the tasks as one matrix. More are written as blocks of at most `block` vectors, each
    a ring around the pivot it is nearest to; a task reads the blocks that can still hold a
    nearer anchor than those it has seen, see `_ringed`.
    """
    anch = anchors.select(vector).filter(_usable(vector))
    low, high = anch.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"anchors have widths from {low} to {high}")
    width = high or 0
    cands = candidates.select(key, vector)
    block = block or max(1, BLOCK_BYTES // (8 * max(width, 1)))
    if anch.limit(block + 1).count() <= block:
        return _small(cands, [r[0] for r in anch.collect()], key, vector)
    return _ringed(cands, anch, key, vector, block, width, pivots)


def _fitting(column: pa.Array, width: int) -> np.ndarray:
    """True for each vector of that width without a null."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    # Elements of null vectors are not in `flatten`.
    owner = np.repeat(np.arange(len(column)), lengths)
    gaps = np.bincount(owner, weights=np.asarray(column.flatten().is_null()), minlength=len(column))
    return (lengths == width) & (gaps == 0)


def _small(cands: DataFrame, rows: list[list[float]], key: str, vector: str) -> DataFrame:
    key_type = cands.schema[key].dataType.simpleString()
    if not rows:
        return cands.select(key, F.lit(None).cast("double").alias("max_cos"))
    width = len(rows[0])
    anchors = cands.sparkSession.sparkContext.broadcast(_unit(np.array(rows, dtype="float64")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, best = _fitting(batch.column(1), width), np.full(batch.num_rows, np.nan)
            if fits.any():
                best[fits] = _best(_unit(_matrix(batch.column(1).filter(pa.array(fits)), width)), anchors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, mask=~fits)], [key, "max_cos"])

    return cands.mapInArrow(score, f"{key} {key_type}, max_cos double")


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _blocks_of(anch: DataFrame, vector: str, block: int, pivots: np.ndarray) -> tuple[str, list]:
    """Folder of the anchors' blocks, and (block, pivot, least angle, largest angle) of each.

    Exact copies of an anchor change no maximum and go first. Vectors too short to have a
    direction belong to no pivot.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column(0), pivots.shape[1]))
            angles = _angles(units, pivots)
            nearest = angles.argmin(1)
            angle = angles[np.arange(len(units)), nearest]
            short = np.linalg.norm(units, axis=1) < 0.5
            nearest[short], angle[short] = -1, 0
            rows = pa.ListArray.from_arrays(np.arange(len(units) + 1, dtype="int32") * pivots.shape[1], units.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype("int32")), pa.array(angle), rows], ["pivot", "angle", "unit"])

    distinct = anch.groupBy(vector).agg(F.lit(0).alias("_c")).select(vector)
    placed = distinct.mapInArrow(place, "pivot int, angle double, unit array<double>")
    ranked = with_row_number(placed, [F.col("angle").asc()], "_no", ["pivot"])
    name = F.concat_ws("_", F.col("pivot") + 1, F.floor((F.col("_no") - 1) / block))
    rows = ranked.select(name.alias("block"), "pivot", "angle", "unit")
    path = stage_path(anch.sparkSession, "anchor_blocks")
    # A block is bounded, so one task can write it.
    rows.select("block", "unit").repartition("block").write.partitionBy("block").parquet(path)
    index = rows.groupBy("block", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    return path, [tuple(r) for r in index.collect()]


def _ringed(cands: DataFrame, anch: DataFrame, key: str, vector: str, block: int, width: int, pivots: int) -> DataFrame:
    """The largest cosine by exact bounds on blocks of anchors.

    Angles between directions keep the triangle inequality: with an angle t to a pivot, no
    anchor between the angles low and high from it is nearer than max(t - high, low - t).
    A batch of candidates takes the blocks from the most promising one on; a block is read
    if some candidate's bound is above the best it has, and multiplied with these alone.
    """
    spark, key_type = cands.sparkSession, cands.schema[key].dataType.simpleString()
    # A fixed choice of anchors, `pivots` at most.
    some = anch.orderBy(F.xxhash64(vector), vector).limit(pivots).collect()
    heads = _unit(np.array([r[0] for r in some], dtype="float64"))
    heads = heads[np.linalg.norm(heads, axis=1) >= 0.5]
    heads = heads if len(heads) else np.eye(1, width)
    path, index = _blocks_of(anch, vector, block, heads)
    shipped = spark.sparkContext.broadcast((heads, index))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, index = shipped.value
        names, of, low, high = (np.array(c) for c in zip(*index))
        store, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        held: dict[str, np.ndarray] = {}

        def anchors_of(name: str) -> np.ndarray:
            if name not in held:
                if len(held) >= HELD_BLOCKS:
                    held.pop(next(iter(held)))
                read = parquet.read_table(f"{folder}/block={name}", filesystem=store, columns=["unit"], partitioning=None)
                held[name] = _matrix(read["unit"].combine_chunks(), width)
            return held[name]

        def nearest(units: np.ndarray) -> np.ndarray:
            """Largest cosines of as many rows as a tile of bounds has."""
            turn = _angles(units, heads)
            at = turn[:, np.maximum(of, 0)]
            bound = np.cos(np.clip(np.maximum(at - high, low - at), 0, np.pi)) + SLACK
            bound[:, of < 0] = 1 + SLACK
            bound[np.linalg.norm(units, axis=1) < 0.5] = 1 + SLACK
            best = np.full(len(units), -np.inf)
            for b in np.argsort(-bound.sum(0), kind="stable"):
                ask = np.flatnonzero(bound[:, b] > best)
                if len(ask):
                    best[ask] = np.maximum(best[ask], _best(units[ask], anchors_of(str(names[b]))))
            return best

        tile = max(1, PRODUCT_BYTES // (8 * max(len(index), len(heads))))
        for batch in batches:
            fits, best = _fitting(batch.column(1), width), np.full(batch.num_rows, np.nan)
            rows = np.flatnonzero(fits)
            if len(rows):
                units = _unit(_matrix(batch.column(1).filter(pa.array(fits)), width))
                for begin in range(0, len(rows), tile):
                    best[rows[begin : begin + tile]] = nearest(units[begin : begin + tile])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, mask=~fits)], [key, "max_cos"])

    return cands.mapInArrow(score, f"{key} {key_type}, max_cos double")
