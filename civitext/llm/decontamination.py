"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without ASCII punctuation. An item's tokens are tiled
greedily with passages of the document: the longest passage both share is marked,
then the longest among what is left, down to MIN_MATCH tokens. The order of the
passages does not matter, so that a reordered item is still covered. A document is
contaminated by an item if its tiles cover THRESHOLD of the item's tokens or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import as_row
from civitext.session import stage

MIN_MATCH = 5
THRESHOLD = 0.5
# Bits of the filter that documents read against: the size of the broadcast, 8 MB.
FILTER_BITS = 1 << 26
_PROBES = 4
_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}
_MIX = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
# Between the passages kept of a document; no token, as tokens have no white space.
BREAK = "\n"


def tokens_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def _ids(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_TABLES.get("up", ())) < n:
        size = max(4096, 2 * n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values of all windows of `width` ids, modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(ids))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * down, out=sums[1:])
    return (sums[width:] - sums[:-width]) * up[:n]


def _slots(values: np.ndarray, probe: int) -> np.ndarray:
    """Place of each value in the filter, for one of its hash functions."""
    return ((values ^ (values >> np.uint64(29))) * np.uint64(_MIX[probe])) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


def _in_filter(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Positions of the values that may be in the filter."""
    at = np.arange(len(values))
    for probe in range(_PROBES):
        if not len(at):
            break
        slots = _slots(values[at], probe)
        bits = filled[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))
        at = at[(bits & np.uint64(1)).astype(bool)]
    return at


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, tokens, n_tokens, seeds): items with at least MIN_MATCH tokens, each seed with its places in the item."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
            tokens = tokens_of(text.as_py())
            if len(tokens) >= MIN_MATCH:
                seeds, times = np.unique(rolling(_ids(tokens), MIN_MATCH), return_counts=True)
                seeds = [{"seed": s, "times": n} for s, n in zip(seeds.view(np.int64).tolist(), times.tolist())]
                rows.append((item, b" ".join(tokens).decode("utf-8", "replace"), len(tokens), seeds))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([r[3] for r in rows], pa.list_(pa.struct([("seed", pa.int64()), ("times", pa.int32())]))),
            ],
            ["item", "tokens", "n_tokens", "seeds"],
        )


def _slot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bits) of the filter for seeds of a batch."""
    for batch in batches:
        seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
        slots = np.unique(np.concatenate([_slots(seeds, p) for p in range(_PROBES)]))
        bits = (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array(bits)], ["word", "bits"]
        )


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """Bit filter of the seeds: FILTER_BITS / 64 rows at most reach the driver."""
    words = seeds.mapInArrow(_slot_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()
    filled = np.zeros(FILTER_BITS >> 6, np.uint64)
    filled[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return filled


def tiles(text: list, item: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) by greedy string tiling, longest first.

    The longest length at which an unmarked passage is shared is found by bisection
    over Karp-Rabin values; all its passages that do not overlap, in the item's order,
    are compared and marked; then the next length is sought below it. None is no token.
    """
    names: dict = {}
    a = np.array([0 if t is None else names.setdefault(t, len(names) + 1) for t in item], np.uint64)
    b = np.array([0 if t is None else names.setdefault(t, len(names) + 1) for t in text], np.uint64)
    free_a, free_b = a > 0, b > 0
    found: list[tuple[int, int, int]] = []

    def windows(ids: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        blocked = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(blocked[width:] == blocked[:-width]) if len(ids) >= width else np.zeros(0, np.int64)
        return at, rolling(ids, width)[at] if len(at) else np.zeros(0, np.uint64)

    def shared(width: int) -> bool:
        return bool(np.isin(windows(a, free_a, width)[1], windows(b, free_b, width)[1]).any())

    high = min(len(a), len(b))
    while high >= min_match and shared(min_match):
        low = min_match
        while low < high:  # the longest shared width, as a wider one contains narrower ones
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        width = low
        at_a, keys_a = windows(a, free_a, width)
        at_b, keys_b = windows(b, free_b, width)
        order = np.argsort(keys_b, kind="stable")
        sorted_b, marked = keys_b[order], False
        for start, key in zip(at_a, keys_a):
            if not free_a[start : start + width].all():
                continue
            for place in order[np.searchsorted(sorted_b, key) : np.searchsorted(sorted_b, key, "right")]:
                other = at_b[place]
                if free_b[other : other + width].all() and (a[start : start + width] == b[other : other + width]).all():
                    free_a[start : start + width] = False
                    free_b[other : other + width] = False
                    found.append((int(start), int(other), width))
                    marked = True
                    break
        # Without a mark the shared value was a chance one of unlike passages.
        high = width if marked else width - 1
    return found


def _seeded(filled_at: Broadcast) -> Callable:
    """Task that keeps of each document its seeds in the filter and the passages they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = filled_at.value
        for batch in batches:
            uids, keys, seeds, passages, places = [], [], [], [], []
            for uid, key, text in zip(*(batch.column(c) for c in ("uid", "key", "text"))):
                tokens = tokens_of(text.as_py())
                if len(tokens) < MIN_MATCH:
                    continue
                values = rolling(_ids(tokens), MIN_MATCH)
                at = _in_filter(values, filled)
                if not len(at):
                    continue
                parts, spans, start, end = [], [], int(at[0]), int(at[0]) + MIN_MATCH
                for p in at[1:].tolist():
                    if p > end:
                        parts.append(tokens[start:end])
                        spans.append(start)
                        start = p
                    end = p + MIN_MATCH
                parts.append(tokens[start:end])
                spans.append(start)
                uids.append(uid.as_py())
                keys.append(key.as_py())
                seeds.append(np.unique(values[at]).view(np.int64))
                passages.append(BREAK.join(b" ".join(p).decode("utf-8", "replace") for p in parts))
                places.append(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(seeds, pa.list_(pa.int64())),
                    pa.array(passages, pa.string()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                ["uid", "key", "seeds", "passages", "places"],
            )

    return run


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, key, item, n_tokens, covered, tiles) of candidate pairs."""
    for batch in batches:
        covered, spans = [], []
        cols = [batch.column(c) for c in ("passages", "places", "tokens")]
        for passages, places, item in zip(*cols):
            text, origin = [], []
            for part, start in zip(passages.as_py().split(BREAK), places.as_py()):
                tokens = part.split(" ")
                text += [*tokens, None]
                origin += [*range(start, start + len(tokens)), -1]
            got = tiles(text, item.as_py().split(" "))
            covered.append(sum(width for _, _, width in got))
            spans.append([{"item_start": i, "doc_start": origin[d], "length": w} for i, d, w in got])
        kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"),
                batch.column("key"),
                batch.column("item"),
                batch.column("n_tokens"),
                pa.array(covered, pa.int32()),
                pa.array(spans, kind),
            ],
            ["uid", "key", "item", "n_tokens", "covered", "tiles"],
        )


_TILED = (
    "uid long, key long, item long, n_tokens int, covered int, "
    "tiles array<struct<item_start: int, doc_start: int, length: int>>"
)


def contamination(
    rows: DataFrame, items: DataFrame, text: Column, item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(uid, key, item, n_tokens, covered, tiles) of every row and item over the threshold.

    `rows` has columns `uid`, which tells rows apart, and `key`, which is carried. Documents are read once, against a
    filter of fixed size; of each only the seeds that may be an item's and the passages
    under them go on. Seeds are joined with the items' seeds by value. A pair is tiled
    if it shares enough seeds to reach the threshold, each counted at every place it has in
    the item: an item's tiles have at least one place for every MIN_MATCH tokens they cover.

    Items under MIN_MATCH tokens have no seeds and contaminate nothing, nor do null or
    empty texts on either side. Repeated items are items of their own.
    """
    spark = rows.sparkSession
    known = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text"))
    known = known.mapInArrow(_item_rows, "item long, tokens string, n_tokens int, seeds array<struct<seed: long, times: int>>")
    known = stage(known.withColumn("at", F.monotonically_increasing_id()), "items")  # as items may repeat
    owners = known.select(F.inline("seeds"), "at", "n_tokens")
    filled = spark.sparkContext.broadcast(_filter_of(owners.select("seed")))
    asked = rows.select("uid", F.col("key").cast("long").alias("key"), text.alias("text"))
    seeded = stage(
        asked.mapInArrow(_seeded(filled), "uid long, key long, seeds array<long>, passages string, places array<int>"),
        "seeded",
    )
    met = seeded.select("uid", F.explode("seeds").alias("seed")).join(owners, "seed")
    pairs = met.groupBy("uid", "at").agg(F.sum("times").alias("shared"), F.first("n_tokens").alias("n"))
    enough = pairs.filter(F.col("shared") * MIN_MATCH >= F.ceil(F.col("n") * threshold)).select("uid", "at")
    tried = enough.join(seeded.select("uid", "key", "passages", "places"), "uid")
    tried = tried.join(known.select("at", "item", "tokens", "n_tokens"), "at")
    tried = tried.select("uid", "key", "item", "n_tokens", "passages", "places", "tokens")
    return tried.mapInArrow(_tile_rows, _TILED).filter(F.col("covered") >= F.col("n_tokens") * F.lit(threshold))


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, item_id, n_tokens, covered, coverage, tiles): each contaminated document with each of its items.

    Rows are judged one by one: a repeated row gives repeated results, a null key stays null.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    found = contamination(rows, items, F.col("text"), item_id, item_text, threshold)
    return found.select(
        F.col("key").alias(key), F.col("item").alias("item_id"), "n_tokens", "covered",
        (F.col("covered") / F.col("n_tokens")).alias("coverage"), "tiles",
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` that no item contaminates, with their columns as they came.

    A key names one document: rows that repeat it go if one of them is contaminated.
    Rows with a null key are judged one by one.
    """
    keyed = docs.filter(F.col(f"`{key}`").isNotNull())
    hit = contaminated(keyed, items, key, text, threshold=threshold).select(F.col(key).alias("_key")).distinct()
    kept = keyed.join(hit, F.col(f"`{key}`") == hit["_key"], "left_anti")
    nameless = stage(
        docs.filter(F.col(f"`{key}`").isNull()).select(as_row(docs), F.monotonically_increasing_id().alias("uid")), "nameless"
    )
    if nameless.isEmpty():
        return kept
    rows = nameless.select("uid", F.lit(None).cast("long").alias("key"), F.col(f"row.`{text}`").alias("text"))
    hit = contamination(rows, items, F.col("text"), threshold=threshold).select("uid").distinct()
    return kept.unionByName(nameless.join(hit, "uid", "left_anti").select("row.*"))
