"""Audit of how five filters act together, over all orders of them.

Each document becomes a mask of the filters that it fails. Documents with one mask act
alike in every order, so a part of the corpus is at most 32 cells of counts. A Gray code
then walks all 32 subsets of filters, toggling one filter at a time: each cell keeps a
counter of the active filters that it fails, and the running survivors change only by
cells whose counter leaves or reaches zero. The 32 states hold every step of every
order: a step's figures are the difference of the states before and after it.

Whether an equal text with a smaller key exists is decided on digests: the smallest key
of each digest, and the rows that have it, joined by digest and key, so that a text with
very many copies is no hot key. Texts are read once and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.operators.common import compute_once
from civitext.session import stage

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
# Thresholds: words, percent of distinct words, percent of capitals.
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SYMBOLS = "[#$%&*|]"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """(*keep, digest, mask): the failures that a text has by itself, A to D, as bits."""
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(*keep, body.alias("_body"))
    # A trimmed text has no empty word but an empty text's only one.
    rows = compute_once(rows, "_words", F.split(F.btrim(F.col("_body"), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+"))
    blank = F.element_at("_words", 1) == ""
    words = F.when(blank, 0).otherwise(F.size("_words"))
    distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct("_words")))
    capitals = F.regexp_count("_body", F.lit("[A-Z]")).cast("long")
    fails = {
        "A": words < MIN_WORDS,
        "B": 100 * distinct.cast("long") < MIN_DISTINCT * words.cast("long"),
        "C": 100 * capitals > MAX_CAPITALS * F.length("_body").cast("long"),
        "D": F.col("_body").rlike(SYMBOLS),
    }
    mask = sum((F.when(failed, _bit(name)).otherwise(0) for name, failed in fails.items()), F.lit(0))
    kept = [c for c in rows.columns if c not in ("_body", "_words")]
    return rows.select(*kept, F.unhex(F.sha2("_body", 256)).alias("digest"), mask.alias("mask"))


def failure_cells(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents by the filters they fail."""
    keep = [F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")]
    marks = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rated = text_failures(docs, F.col(f"`{text}`"), keep).join(marks, "key", "left").fillna(0, ["good", "toxic"])
    rated = stage(rated, "failures")
    first = rated.groupBy("digest").agg(F.min("key").alias("key"))
    counts = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    every = rated.groupBy("part", "mask").agg(*counts)
    # Rows without a key have none smaller.
    single = rated.join(first, ["digest", "key"], "left_semi").unionByName(rated.filter("key is null"))
    single = stage(single.groupBy("part", "mask").agg(*counts), "single")
    copies = every.unionByName(single.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]))
    copies = copies.groupBy("part", "mask").agg(*sums).withColumn("mask", F.col("mask") + _bit("E"))
    return single.unionByName(copies.filter("n > 0"))


def subset_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; `cells` and the result are (..., mask or subset, count).

    The subsets come in Gray-code order, so each step toggles one filter.
    """
    states = np.empty_like(cells)
    active = np.zeros(STATES, "int64")
    running = cells.sum(axis=-2)
    states[..., 0, :] = running
    masks, subset = np.arange(STATES), 0
    for step in range(1, STATES):
        subset, before = step ^ (step >> 1), subset
        toggled = subset ^ before
        hit = (masks & toggled) > 0
        was = active.copy()
        active[hit] += 1 if subset & toggled else -1
        running = running - cells[..., (was == 0) & (active > 0), :].sum(axis=-2)
        running = running + cells[..., (was > 0) & (active == 0), :].sum(axis=-2)
        states[..., subset, :] = running
    return states


def order_rows(cells: np.ndarray) -> list[tuple]:
    """(filter_order, step, *COUNTS) of one part; `cells` is (mask, count) of all, good and toxic documents."""
    states = subset_states(cells)
    shapley = {}
    for name in FILTERS:
        bit, total = _bit(name), 0
        for subset in range(STATES):
            if not subset & bit:
                before = subset.bit_count()
                orders = factorial(before) * factorial(len(FILTERS) - 1 - before)
                total += orders * int(states[subset, 0] - states[subset | bit, 0])
        shapley[name] = total
    out = []
    for order in map("".join, permutations(FILTERS)):
        done = 0
        for step, name in enumerate(order, 1):
            bit = _bit(name)
            gone = states[done] - states[done | bit]
            failing = int(states[0, 0] - states[bit, 0])
            out.append((order, step, int(states[done | bit, 0]), int(gone[0]), failing - int(gone[0]), int(cells[bit, 0]),
                        int(gone[1]), int(gone[2]), shapley[name]))
            done |= bit
    return out


def audit_filters(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, filter_order, step, *COUNTS): 600 rows, zeros included, for each value of `part`.

    Filters, by letter: A too few words, B too few distinct words, C too many capitals, D a
    symbol, E the text of a smaller key anywhere in the table. A null text is an empty one;
    it fails A, and E as other empty texts do. A null part is the empty string. Rows that
    repeat a key are rows of their own: with equal texts neither has the smaller key. A null
    key is smaller than none and no key is smaller than it. A document is good or toxic if
    any of its labels says so. An empty table has no part and gives no row. Other columns
    are not read, whatever their names.
    """
    listed = failure_cells(docs, labels, key, text, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # 32 at most
    )
    names = ["part", "filter_order", "step", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed in zip(*(batch.column(c).to_pylist() for c in ("part", "cells"))):
                cells = np.zeros((STATES, 3), "int64")
                for c in listed:
                    cells[c["mask"]] = c["n"], c["good"], c["toxic"]
                columns = list(zip(*order_rows(cells)))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *arrays], names)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return listed.mapInArrow(run, schema)
