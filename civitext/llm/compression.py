"""Quality classifier by compression: two zstandard dictionaries and one calibrated difference.

One dictionary is trained on samples of texts labelled good, one on samples of texts
labelled bad. A text is cut into blocks of BLOCK bytes, so that it does not become its own
dictionary, and every block of the whole text is compressed with both. The difference of
the two sizes over their sum is between -1 and 1 and does not depend on length; a logistic
curve, fitted on labelled texts that the dictionaries have not seen, makes it a score.

The fit takes a bounded sample of the labelled rows: FIT_ROWS and CALIBRATION_ROWS of each
class, by hash of the key, and SAMPLES samples of each class. All rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from math import exp

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import as_row, fold_of
from civitext.session import stage, unstage

FOLDS = 5
CALIBRATION_FOLD = 4
# Most labelled rows of a class that make the dictionaries, and that make the curve.
FIT_ROWS = 4096
CALIBRATION_ROWS = 4096
# Most samples of a class that the dictionaries are trained on, and their bytes.
SAMPLES = 16_384
SAMPLE = 1024
# Bytes of a text that are compressed at once.
BLOCK = 256
DICT_BYTES = 112 << 10
LEVEL = 3
CUT = 0.3
_SPACE = 1 << 60


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """One per dictionary and Python worker; an empty one compresses without."""
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if made:
        made.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def compressed_bytes(data: bytes, dictionary: bytes) -> int:
    """Size of all blocks of `data`, each compressed on its own with `dictionary`."""
    compress, view = _compressor(dictionary).compress, memoryview(data)
    return sum(len(compress(view[at : at + BLOCK])) for at in range(0, len(data), BLOCK))


def difference_of(text: str | None, good: bytes, bad: bytes) -> float:
    """(bad - good) / (bad + good) of the compressed sizes; 0 for a null or empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    g, b = compressed_bytes(data, good), compressed_bytes(data, bad)
    return (b - g) / (b + g)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary of `size` bytes at most; samples too few to train on become one as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_curve(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of `ys` over `xs`.

    Newton's method on the log loss of targets moved to (n1 + 1) / (n1 + 2) and
    1 / (n0 + 2), which keeps the slope finite where the classes do not overlap. Without
    rows of both classes the slope is positive and the shift 0.
    """
    n1, n0 = int((ys == 1).sum()), int((ys == 0).sum())
    if not n1 or not n0:
        return 10.0, 0.0
    goal = np.where(ys == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(xs).max()), 1e-9)
    rows = np.stack([xs / scale, np.ones(len(xs))], 1)

    def loss(w: np.ndarray) -> float:
        z = rows @ w
        return float((np.logaddexp(0, z) - goal * z).sum())

    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-rows @ w))
        slope = rows.T @ (p - goal)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries of bounded size and the curve."""

    good: bytes
    bad: bytes
    slope: float
    shift: float

    def score_of(self, text: str | None) -> float:
        z = self.slope * difference_of(text, self.good, self.bad) + self.shift
        return 1 / (1 + exp(-z)) if z >= 0 else exp(z) / (1 + exp(z))

    def score(self, text: Column) -> Column:
        """Score of each text, 0 to 1; whole texts, block by block."""
        model = self

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([model.score_of(t.as_py()) for t in texts], pa.float64())

        return run(text)


def _drawn(rows: DataFrame, drawn: Column, most: int) -> Column:
    """True for about 95 percent of `most` rows of each class, for all where there are no more than `most`."""
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    limits = {y: _SPACE if n <= most else int(_SPACE * 0.95 * most / n) for y, n in sizes.items()}
    return reduce(lambda a, b: a | b, [(F.col("y") == y) & (drawn < limit) for y, limit in limits.items()], F.lit(False))


def _sampled(labels: DataFrame, most: int) -> DataFrame:
    """(key, y): about and never more than twice `most` rows in all, by hash of the key."""
    drawn = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(_SPACE))
    return labels.filter(_drawn(labels, drawn, most)).orderBy(drawn, "key").limit(2 * most).select("key", "y")


def _samples(texts: DataFrame) -> DataFrame:
    """(y, drawn, sample): all texts in pieces of SAMPLE bytes, with a hash to draw by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cut = [data[at : at + SAMPLE] for at in range(0, len(data), SAMPLE)]
                columns = [pa.array([y] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["y", "at", "sample"])

    cut = texts.select("y", "text").mapInArrow(run, "y int, at long, sample binary")
    return cut.select("y", F.pmod(F.xxhash64("at", "sample"), F.lit(_SPACE)).alias("drawn"), "sample")


def _training_samples(texts: DataFrame) -> dict[int, list[bytes]]:
    """Samples of each class in a fixed, mixed order, SAMPLES at most."""
    samples = stage(_samples(texts), "samples")
    rows = samples.filter(_drawn(samples, F.col("drawn"), SAMPLES)).limit(2 * SAMPLES).collect()
    unstage(samples)
    rows = sorted((r["drawn"], bytes(r["sample"]), r["y"]) for r in rows)
    return {y: [b for _, b, c in rows if c == y][:SAMPLES] for y in (0, 1)}


def fit_compression(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text"
) -> CompressionModel:
    """Model of `label` 1 against 0, learnt from labelled rows outside fold 0 of `fold_of`.

    Only the sampled keys, a bounded number, are sent to the texts, which are not shuffled.
    Keys with labels of both kinds teach nothing, nor do null keys and labels. Without
    labels of both classes the dictionaries of missing ones are empty.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).filter("y in (0, 1)")
    known = known.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    fold = fold_of(F.col("key"), FOLDS)
    known = stage(known.withColumn("fold", fold).filter("fold > 0"), "known")
    bodies = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    teaching = _sampled(known.filter(F.col("fold") != CALIBRATION_FOLD), FIT_ROWS)
    samples = _training_samples(bodies.join(F.broadcast(stage(teaching, "teaching")), "key"))
    good, bad = (train_dictionary(samples[y]) if samples[y] else b"" for y in (1, 0))
    checked = _sampled(known.filter(F.col("fold") == CALIBRATION_FOLD), CALIBRATION_ROWS)

    @F.arrow_udf("double")
    def difference(texts: pa.Array) -> pa.Array:
        return pa.array([difference_of(t.as_py(), good, bad) for t in texts], pa.float64())

    pairs = bodies.join(F.broadcast(stage(checked, "checked")), "key").select("key", "y", difference("text").alias("x"))
    pairs = pairs.groupBy("key").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = sorted((r["x"], r["y"]) for r in pairs.select("x", "y").collect())
    slope, shift = fit_curve(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    return CompressionModel(good, bad, slope, shift)


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """(row, score, predicted), one row per row of `docs`; `row` holds its columns.

    Null and empty texts have no difference and get the curve's value there. Very long
    texts are compressed block by block. Repeated rows get equal scores; an empty table
    gives no row.
    """
    scored = docs.select(as_row(docs), model.score(F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
