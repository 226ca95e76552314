"""Shards of nearly equal bytes: a minimax partition of groups that stay whole.

Rows with equal texts are one group. Groups lie on a line in the order of their text
digests, and shards are runs of that line. The smallest capacity at which a greedy
pass from the left needs no more than the given shards is found by bisection, and the
line is cut where that pass stops. Groups above an even share of what is left get
shards of their own first, so that the others stay even.

The line may have any length. The driver sees a summary of it: bins with their first
and last group end. A greedy pass over a summary has a certain lower and upper reach,
which settle most capacities; the bins around the cuts are then read in finer steps,
until one capacity and its cuts are exact. A step returns at most `_STEPS` bins for
each of at most four bins per cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import as_row, octets
from civitext.operators.ordered import with_row_number, with_running_sum

SHARDS = 16
_STEPS = 2048

Bins = list[tuple[int, int]]


def _reach(bins: Bins, firsts: list[int], x: int) -> tuple[int, int, int | None]:
    """Lower and upper bound of the last group end that is not above x; the bin to read, if they differ."""
    at = bisect_right(firsts, x) - 1
    if at < 0:
        return 0, 0, None
    first, last = bins[at]
    return (last, last, None) if x >= last else (first, x, at)


def _greedy(bins: Bins, firsts: list[int], shards: int, capacity: int, upper: bool) -> tuple[list[int], set[int]]:
    """Ends of the shards that a greedy pass fills, by lower or upper bounds, and the bins it was unsure in."""
    ends, unsure, at = [], set(), 0
    for _ in range(shards):
        *reach, bin_ = _reach(bins, firsts, at + capacity)
        at = reach[upper]
        ends.append(at)
        if bin_ is not None:
            unsure.add(bin_)
    return ends, unsure


def _least(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """Smallest number in low .. high for which `holds`, which is true at `high`."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def smallest_capacity(
    total: int, largest: int, shards: int, read: Callable[[list[tuple[int, int]], int], Bins], steps: int = _STEPS
) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the shard ends at it.

    `read(windows, steps)` returns bins (first end, last end) of the line inside each
    of the disjoint windows, at most `steps` for a window.
    """
    bins = read([(1, total)], 16 * steps)
    low, high = max(largest, -(-total // shards)), total
    while True:
        firsts = [b[0] for b in bins]

        def full(capacity: int, upper: bool) -> bool:
            return _greedy(bins, firsts, shards, capacity, upper)[0][-1] >= total

        high = _least(low, high, lambda c: full(c, False))
        low = _least(low, high, lambda c: full(c, True))
        passes = [_greedy(bins, firsts, shards, c, upper) for c in (low, high) for upper in (False, True)]
        if low == high and passes[0][0] == passes[1][0]:
            return low, passes[0][0]
        # A pass without an unsure bin is exact, so there is one; two steps part its ends.
        unsure = sorted(set().union(*(bins_ for _, bins_ in passes)))
        windows = [bins[i] for i in unsure]
        bins = sorted([x for i, x in enumerate(bins) if i not in set(unsure)] + read(windows, steps))


def _reader(line: DataFrame) -> Callable[[list[tuple[int, int]], int], Bins]:
    def read(windows: list[tuple[int, int]], steps: int) -> Bins:
        place = F.lit(None)
        for number, (a, b) in reversed(list(enumerate(windows))):
            width = -(-(b - a + 1) // steps)
            bin_ = F.struct(F.lit(number).alias("w"), F.floor((F.col("end") - a) / width).cast("long").alias("b"))
            place = F.when(F.col("end").between(a, b), bin_).otherwise(place)
        near = line.filter(F.col("end").between(windows[0][0], windows[-1][1]))
        found = near.groupBy(place.alias("place")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
        return sorted((r["first"], r["last"]) for r in found.filter("place is not null").collect())

    return read


def giants_of(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest sizes, given in falling order, get a shard of their own."""
    count = 0
    while shards > 1 and count < len(sizes) and sizes[count] * shards > total:
        total, shards, count = total - sizes[count], shards - 1, count + 1
    return count


def shard_rows(
    docs: DataFrame, payload: Column, key: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """(row, size, text_crc32, shard, slot) for every row of `docs`; `row` is the payload.

    `size` is the text's UTF-8 bytes plus 1. A null text has no bytes and is of one
    group with empty texts. Slots count from 0 in each shard in the order of digest and
    key, without gaps; repeated rows get slots of their own and stay in one shard. With
    fewer groups than shards, some shards stay empty; an empty table gives no rows.
    """
    bytes_ = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    read = docs.select(
        payload.alias("row"),
        F.col(f"`{key}`").alias("key"),
        (octets(F.col(f"`{text}`")) + 1).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.unhex(F.sha2(bytes_, 256)).alias("digest"),
    )
    lined = with_row_number(read, [F.col("digest"), F.col("key")], "at")
    groups = lined.groupBy("digest").agg(
        F.sum("size").alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    line = with_running_sum(groups, [F.col("digest")], "bytes", "before")
    largest = line.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    total = line.agg(F.sum("bytes")).first()[0] or 0
    n_giants = giants_of([r["bytes"] for r in largest], total, shards)
    giants = largest[:n_giants]
    if giants:
        # What remains is a line of its own: their bytes are taken out of the positions.
        line = line.filter(~F.col("first_at").isin([r["first_at"] for r in giants]))
        for r in giants:
            line = line.withColumn("before", F.col("before") - F.when(F.col("first_at") > r["first_at"], r["bytes"]).otherwise(0))
        total -= sum(r["bytes"] for r in giants)
    line = line.select((F.col("before") + F.col("bytes")).alias("end"), "last_at")
    lasts: list[int] = []
    if total:
        rest = largest[n_giants]["bytes"]
        _, ends = smallest_capacity(total, rest, shards - n_giants, _reader(line))
        at = {r["end"]: r["last_at"] for r in line.filter(F.col("end").isin(ends)).collect()}
        lasts = [at[e] for e in ends]

    at, shard, slot = F.col("at"), F.lit(None).cast("int"), F.lit(None).cast("long")
    start, runs = 0, []
    for number, last in enumerate(lasts):
        if last > start:
            runs.append((start, last, n_giants + number))
        start = max(start, last)
    for start, last, number in reversed(runs):
        taken = sum((F.when(at > r["last_at"], r["last_at"] - r["first_at"] + 1).otherwise(0)
                     for r in giants if start < r["first_at"] <= last), F.lit(0))
        shard = F.when(at <= last, number).otherwise(shard)
        slot = F.when(at <= last, at - start - 1 - taken).otherwise(slot)
    for number, r in enumerate(giants):
        own = at.between(r["first_at"], r["last_at"])
        shard, slot = F.when(own, number).otherwise(shard), F.when(own, at - r["first_at"]).otherwise(slot)
    return lined.select("row", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows of `docs` with `shard` and `slot`; columns of these names are replaced."""
    placed = shard_rows(docs, as_row(docs), key, text, shards)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*own, "shard", "slot")
