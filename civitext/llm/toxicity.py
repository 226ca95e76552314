"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models predict a text's next symbol from the three before it. Symbols are the
bytes of the lower-cased text in 64 classes, so a model has at most 2^24 entries
whatever it was fitted on; this is also the bound of what is broadcast. A class
takes its own counts only at full length. Whatever it has not seen often goes to the
lower orders, whose continuation counts both classes share: a rare expression that
says nothing about the class has the same probability in both.

    P_c(x | h) = (max(n_c(hx) - D, 0) + D * followers_c(h) * P(x | h')) / n_c(h)

`h'` is `h` without its first symbol, and P is the shared model of that order.

Beside them stand two models of words, whose contexts have no bound: each byte of a
word, and its end, is predicted from the whole word up to it, by the same formula; P is
there the pooled model of both classes in that context, which goes to the three symbols
before it. What they know is one row for each start of a word that the labelled texts
have LEAST_SEEN times or more, and grows with these; rarer starts are left to the shared
orders. The log-likelihood ratio of a word is a sum over its starts. The HEAD_STARTS
most frequent rows are broadcast, a proven bound. Rows beyond them are joined by key and
added, and of these a bit filter of fixed size is broadcast, which decides only what is
asked for. Without such rows scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.llm.common import as_row, fold_of
from civitext.llm.decontamination import _filter_of, _in_filter, _powers
from civitext.session import broadcast_if_small, stage, unstage

ORDER = 4
SYMBOL_BITS = 6
GRAM_SPACE = 1 << (ORDER * SYMBOL_BITS)
DISCOUNT = 0.75
# Folds of the labelled rows: 0 is held out, one calibrates, the rest give the counts.
FOLDS = 5
CALIBRATION_FOLD = 4
# Labelled rows the three calibration weights are fitted on, at most.
CALIBRATION_ROWS = 20_000
RIDGE = 1e-3
_BUFFER = 1 << 19  # grams counted at once
# Count below which a start of a word has no row of its own. No start is rarer than what continues it,
# so what is left holds every start of its starts.
LEAST_SEEN = 2
# Starts of words, the most frequent ones, that are broadcast with their values (12 bytes each); others are joined.
HEAD_STARTS = 1 << 21
_WORDS = 1 << 16  # bytes of words numbered at once
# What a word's ratio has to exceed to count as a peak.
WORD_PEAK = 1.5
_FEATURES = ["mean", "peaks", "brief", "word_mean", "word_peaks", "word_sum"]
_CODES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_CODES = (_CODES ^ (_CODES >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def _symbol(b: int) -> int:
    """Blank, 26 letters, any digit, and 36 classes of bytes above 127."""
    if b >= 128:
        return 28 + b % 36
    if 97 <= b <= 122:
        return b - 96
    return 27 if 48 <= b <= 57 else 0


_SYMBOLS = bytes(_symbol(b) for b in range(256))


def grams_of(text: str | None) -> np.ndarray:
    """Numbers of the symbol 4-grams of a text; runs of other characters are one blank."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    if not plain:
        return np.zeros(0, np.int32)
    s = np.frombuffer((b" " + b" ".join(plain) + b" ").translate(_SYMBOLS), np.uint8).astype(np.int32)
    out = s[: len(s) - ORDER + 1].copy() if len(s) >= ORDER else np.zeros(0, np.int32)
    for k in range(1, ORDER):
        out <<= SYMBOL_BITS
        out |= s[k : len(s) - ORDER + 1 + k]
    return out


def words_of(text: str | None) -> tuple[bytes, int]:
    """(the lower-cased words of a text, each closed by a blank, their number)."""
    plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return (b" ".join(plain) + b" " if plain else b""), len(plain)


def _blocks(raw: bytes) -> Iterator[bytes]:
    """Whole words of about _WORDS bytes at a time."""
    at = 0
    while at < len(raw):
        end = raw.rfind(b" ", at, at + _WORDS) + 1 or raw.find(b" ", at + _WORDS) + 1
        yield raw[at:end]
        at = end


def starts_in(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, the start it continues, its last three symbols) at every byte and end of words closed by blanks.

    Starts are numbered by 64-bit Karp-Rabin values; what a word begins with continues 0.
    """
    b = np.frombuffer(block, np.uint8)
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * down, out=sums[1:])
    ends = np.flatnonzero(b == 32)
    first = np.concatenate(([0], ends[:-1] + 1))
    own = np.repeat(first, ends - first + 1)
    keys = (sums[1:] - sums[own]) * up[own]
    keys = ((keys ^ (keys >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
    parents = np.concatenate(([0], keys[:-1]))
    parents[first] = 0
    s = np.frombuffer(block.translate(_SYMBOLS), np.uint8).astype(np.int32)
    lows = s.copy()
    lows[1:] |= s[:-1] << SYMBOL_BITS
    lows[2:] |= s[:-2] << (2 * SYMBOL_BITS)
    lows[first] = s[first]
    return keys, parents, lows


class _Values:
    """Values by 64-bit key. Keys are spread evenly, so their first bits tell where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys.view(np.uint64))
        self.keys = np.append(keys.view(np.uint64)[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], np.float32(0))
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((self.keys[:-1] >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys) - 1

    @classmethod
    def of(cls, held: dict) -> _Values:
        """The values whose attributes are `held`: arrays are sent without the class, which executors may not have."""
        values = cls.__new__(cls)
        values.__dict__.update(held)
        return values

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, value) of each key, 0 where it is not known."""
        asked = asked.view(np.uint64)
        at = self.begin[(asked >> self.shift).astype(np.int64)]
        seen = self.keys[at]
        further = np.flatnonzero(seen < asked)
        while len(further):
            at[further] += 1
            seen[further] = self.keys[at[further]]
            further = further[seen[further] < asked[further]]
        known = (seen == asked) & (at < len(self.keys) - 1)
        return known, np.where(known, self.values[at], np.float32(0))


def _count_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, parent, low, toxic, plain): how often each start is in toxic and in ordinary texts."""
    waiting, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, parents, lows, labels = (np.concatenate(c) for c in zip(*waiting))
        keys, first, at, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        toxic = np.bincount(at, weights=labels, minlength=len(keys)).astype(np.int64)
        cols = [keys, parents[first], lows[first], toxic, n - toxic]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "parent", "low", "toxic", "plain"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for keys, parents, lows in map(starts_in, _blocks(words_of(text.as_py())[0])):
                waiting.append((keys, parents, lows, np.full(len(keys), label, np.int8)))
                size += len(keys)
                if size > _BUFFER:
                    yield flush()
                    waiting, size = [], 0
    if waiting:
        yield flush()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, n) of a partition, at most 2 * GRAM_SPACE rows."""
    done: dict[int, list] = {0: [], 1: []}
    waiting: dict[int, list] = {0: [], 1: []}
    sizes = {0: 0, 1: 0}

    def flush(label: int) -> None:
        if waiting[label]:
            done[label].append(np.unique(np.concatenate(waiting[label]), return_counts=True))
            if len(done[label]) > 3:
                done[label] = [_merge(done[label])]
        waiting[label], sizes[label] = [], 0

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            grams = grams_of(text.as_py())
            waiting[label].append(grams)
            sizes[label] += len(grams)
            if sizes[label] > _BUFFER:
                flush(label)
    for label in (0, 1):
        flush(label)
        if done[label]:
            keys, counts = _merge(done[label])
            labels = np.full(len(keys), label, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(labels), pa.array(counts)], ["gram", "toxic", "n"]
            )


@dataclass
class WordModel:
    """What each start of a word adds to its ratio: the most frequent ones, and a table of the others, if any."""

    head: _Values
    tail: DataFrame | None = None
    filled: np.ndarray | None = None


@dataclass
class ToxicModel:
    """Log-likelihood ratios by gram and by known context, and the calibration."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(_FEATURES) + 1))
    prior: float = 0.0
    words: WordModel | None = None
    sent: Broadcast | None = None

    def send(self, spark: SparkSession) -> Broadcast:
        """What tasks need of the models, sent once."""
        if self.sent is None:
            tables = _table_of(self.grams, self.ratios, self.contexts)
            self.sent = spark.sparkContext.broadcast((*tables, vars(self.words.head), self.words.filled))
        return self.sent


def _table_of(grams: np.ndarray, ratios: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each context, rows): the ratio of every symbol after every known context.

    A symbol not seen after a known context has the context's own ratio. Row 0 is for
    contexts that are not known, whose ratio is 0. Rows are as many as known contexts.
    """
    known, at = np.unique(grams >> SYMBOL_BITS, return_inverse=True)
    rows = np.zeros((len(known) + 1, 1 << SYMBOL_BITS), np.float32)
    rows[1:] = contexts[known][:, None]
    rows[at + 1, grams & ((1 << SYMBOL_BITS) - 1)] = ratios
    row_of = np.zeros(GRAM_SPACE >> SYMBOL_BITS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    return row_of, rows.reshape(-1)


def gram_features(texts: list[str | None], row_of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(mean log-likelihood ratio, mean of what single ratios exceed 1 by, 1 / sqrt(length)) of each text."""
    forms = [(t or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split() for t in texts]
    forms = [b" " + b" ".join(f) + b" " if f else b"" for f in forms]
    sizes = np.array([len(f) for f in forms])
    out, has = np.zeros((len(texts), 3)), np.flatnonzero(sizes >= ORDER)
    if not len(has):
        return out
    s = np.frombuffer(b"".join(forms).translate(_SYMBOLS), np.uint8).astype(np.int32)
    grams = np.zeros(len(s), np.int32)
    for k in range(ORDER):
        grams[: len(s) - ORDER + 1] <<= SYMBOL_BITS
        grams[: len(s) - ORDER + 1] |= s[k : len(s) - ORDER + 1 + k]
    ratios = rows[(row_of[grams >> SYMBOL_BITS] << SYMBOL_BITS) + (grams & ((1 << SYMBOL_BITS) - 1))].astype(np.float64)
    ends = np.cumsum(sizes)
    for k in range(1, ORDER):  # what begins there would reach into the next text
        ratios[ends[sizes >= k] - k] = 0
    begins, n = (ends - sizes)[has], sizes[has] - ORDER + 1
    within = np.zeros(len(s) + 1)
    within[:-1] = ratios
    spans = np.stack([begins, ends[has]], 1).ravel()
    out[has, 0] = np.add.reduceat(within, spans)[::2] / n
    out[has, 1] = np.add.reduceat(np.maximum(within - 1, 0), spans)[::2] / n
    out[has, 2] = n**-0.5
    return out


def _shared_orders(grams: np.ndarray) -> np.ndarray:
    """P(x | h') for each of the full-length grams, from pooled continuation counts."""
    mask = (1 << (SYMBOL_BITS * (ORDER - 1))) - 1
    keys, n = np.unique(grams & mask, return_counts=True)
    return _shared_of(keys, n.astype(float))[np.searchsorted(keys, grams & mask)]


def _shared_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(x | h') for each of the sorted `keys` of ORDER - 1 symbols, n times continued to."""
    levels, counts = [keys], [n]
    for order in range(ORDER - 2, 0, -1):
        keys, n = np.unique(keys & ((1 << (SYMBOL_BITS * order)) - 1), return_counts=True)
        levels.append(keys)
        counts.append(n.astype(float))
    below = None
    for keys, n in zip(reversed(levels), reversed(counts)):
        if below is None:
            p = n / n.sum()
        else:
            _, at, followers = np.unique(keys >> SYMBOL_BITS, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=n)
            shorter = below[1][np.searchsorted(below[0], keys & (int(below[2]) - 1))]
            p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * followers[at] * shorter) / total[at]
        space = (below[2] if below else 1) << SYMBOL_BITS
        below = (keys, p, space)
    return below[1]


def _model_of(rows: np.ndarray, by_class: tuple[np.ndarray, np.ndarray]) -> ToxicModel:
    """Model of the sorted, different grams `rows` with their counts in ordinary and in toxic texts."""
    grams = rows.astype(np.int64)
    contexts, at = np.unique(grams >> SYMBOL_BITS, return_inverse=True)
    shorter = _shared_orders(grams) if len(grams) else np.zeros(0)
    logs, misses = [], []
    for label in (1, 0):
        n = by_class[label].astype(float)
        total = np.bincount(at, weights=n, minlength=len(contexts))
        followers = np.bincount(at, weights=n > 0, minlength=len(contexts))
        left = np.where(total > 0, DISCOUNT * followers / np.maximum(total, 1), 1.0)
        own = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at]
        logs.append(np.log(own + left[at] * shorter))
        misses.append(np.log(left))
    by_context = np.zeros(GRAM_SPACE >> SYMBOL_BITS, np.float32)
    by_context[contexts] = misses[0] - misses[1]
    return ToxicModel(grams.astype(np.int32), (logs[0] - logs[1]).astype(np.float32), by_context)


def _word_model(read: DataFrame, head_starts: int = HEAD_STARTS) -> WordModel:
    """Values of the starts of words of the labelled texts `read`."""
    spark = read.sparkSession
    parts = read.mapInArrow(_count_starts, "key long, parent long, low int, toxic long, plain long")
    n = {c: F.sum(c).alias(c) for c in ("toxic", "plain")}
    starts = parts.groupBy("key").agg(F.first("parent").alias("parent"), F.first("low").alias("low"), *n.values())
    starts = stage(starts.filter(F.col("toxic") + F.col("plain") >= LEAST_SEEN), "starts")
    # At most 2^18 rows, whatever the corpus.
    low = starts.groupBy("low").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("low")
    p = _shared_of(low["low"].to_numpy(np.int64), low["n"].to_numpy(float)) if len(low) else np.zeros(0)
    shared = pd.DataFrame({"low": low["low"].to_numpy(np.int32), "shared": p})
    shared = F.broadcast(spark.createDataFrame(shared, "low int, shared double"))
    # A start is continued by 256 bytes at most.
    same = Window.partitionBy("parent")

    def parts_of(n: Column) -> tuple[Column, Column]:
        """Share of a start by its own count after discount, and the share left for the order below."""
        total, followers = F.sum(n).over(same), F.sum((n > 0).cast("int")).over(same)
        own = F.when(total > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0)
        return own, F.when(total > 0, F.lit(DISCOUNT) * followers / total).otherwise(1.0)

    own, left = parts_of(F.col("toxic") + F.col("plain"))
    (toxic, toxic_left), (plain, plain_left) = parts_of(F.col("toxic")), parts_of(F.col("plain"))
    valued = starts.join(shared, "low").select(
        "key", "parent", (F.col("toxic") + F.col("plain")).alias("n"), (own + left * F.col("shared")).alias("pooled"),
        toxic.alias("toxic"), toxic_left.alias("toxic_left"), plain.alias("plain"), plain_left.alias("plain_left"),
    )
    logs = [F.log(F.col(c) + F.col(f"{c}_left") * F.col("pooled")) for c in ("toxic", "plain")]
    valued = stage(
        valued.select(
            "key", "parent", "n", (logs[0] - logs[1]).alias("ratio"),
            (F.log("toxic_left") - F.log("plain_left")).alias("miss"),
        ),
        "ratios",
    )
    missed = valued.groupBy(F.col("parent").alias("key")).agg(F.first("miss").alias("next"))
    # A word ends in the miss of its longest known start, so a longer start takes that of the shorter one back.
    before = F.when(F.col("parent") == 0, 0.0).otherwise(F.col("miss"))
    value = F.col("ratio") + F.coalesce("next", F.lit(0.0)) - before
    table = stage(valued.hint("merge").join(missed, "key", "left").select("key", "n", value.cast("float").alias("value")), "words")
    # At most 2^16 rows; the head takes whole counts from the top as long as they fit.
    sizes = table.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().toPandas().sort_values("n", ascending=False)
    fit = sizes["n"][sizes["count"].cumsum() <= head_starts]
    least = int(fit.min()) if len(fit) else None
    in_head = F.col("n") >= least if least is not None else F.lit(False)
    head = table.filter(in_head).select("key", "value").toArrow()
    values = _Values(head["key"].to_numpy().astype(np.int64), head["value"].to_numpy().astype(np.float32))
    unstage(starts)
    unstage(valued)
    if len(fit) == len(sizes):
        unstage(table)
        return WordModel(values)
    tail = table.filter(~in_head).select("key", "value")
    return WordModel(values, tail, _filter_of(tail.select(F.col("key").alias("seed"))))


_ASKED = {"key": "long", "word": "long", "base": "float", "times": "int"}


def _asked(starts: np.ndarray, first: np.ndarray, known: np.ndarray, ratios: np.ndarray, filled: np.ndarray) -> list[np.ndarray]:
    """(key, word, base, times): starts of a text's words that may be in the tail, their words, these words' ratios and numbers."""
    others = np.flatnonzero(~known)
    others = others[_in_filter(starts[others].view(np.uint64), filled)]
    if not len(others):
        return []
    # A word is named by its last start, its end; each different one asks once.
    ends = np.r_[first[1:], len(starts)] - 1
    names, one, times = np.unique(starts[ends], return_index=True, return_counts=True)
    of = np.searchsorted(first, others, "right") - 1
    kept = np.isin(of, one)
    others, of = others[kept], of[kept]
    return [starts[others], starts[ends[of]], ratios[of], times[np.searchsorted(names, starts[ends[of]])]]


def word_features(texts: list[str | None], head: _Values, filled: np.ndarray | None = None) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(sum of the words' ratios by the head, of their peaks, number of words) of each text, and what each asks the tail for."""
    forms = [words_of(t) for t in texts]
    out, asked = np.zeros((len(texts), 3)), [[] for _ in texts]
    out[:, 2] = [n for _, n in forms]
    has = np.flatnonzero(out[:, 2])
    if sum(len(raw) for raw, _ in forms) <= 4 * _WORDS:  # all in one
        blocks = [(has, b"".join(raw for raw, _ in forms))] if len(has) else []
    else:
        blocks = [(np.array([i]), block) for i in has for block in _blocks(forms[i][0])]
    for of, block in blocks:
        starts, parents, _ = starts_in(block)
        known, gains = head.find(starts)
        first = np.flatnonzero(parents == 0)
        ratios = np.add.reduceat(gains.astype(np.float64), first)
        begins = np.cumsum(np.r_[0, out[of[:-1], 2]]).astype(np.int64)  # of the texts, in words
        out[of, 0] += np.add.reduceat(ratios, begins)
        out[of, 1] += np.add.reduceat(np.maximum(ratios - WORD_PEAK, 0), begins)
        if filled is not None:
            cuts = np.r_[begins, len(first)]
            for i, a, b in zip(of, cuts, cuts[1:]):
                span = slice(first[a], first[b] if b < len(first) else len(starts))
                asked[i].append(_asked(starts[span], first[a:b] - first[a], known[span], ratios[a:b], filled))
    return out, asked


def _grouped(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, about _WORDS characters at a time."""
    group, size = [], 0
    for text in texts:
        text = text.as_py()
        if size + len(text or "") > _WORDS and group:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def _local_features(spark: SparkSession, model: ToxicModel, text: Column) -> Column:
    """Features of a text without what the tail of the word model adds, and what to ask it for."""
    sent = model.send(spark)
    figures = ["mean", "peaks", "brief", "value", "peak"]
    kinds = [f"{c} double" for c in figures] + ["words int"] + [f"{c} array<{t}>" for c, t in _ASKED.items()]
    arrow = (pa.int64(), pa.int64(), pa.float32(), pa.int32())

    @F.arrow_udf(", ".join(kinds))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row_of, rows, held, filled = sent.value
        head = _Values.of(held)
        for texts in batches:
            found, asked = [], []
            for group in _grouped(texts):
                words, more = word_features(group, head, filled)
                found.append(np.c_[gram_features(group, row_of, rows), words])
                asked += [[np.concatenate(c) for c in zip(*filter(None, m))] or [()] * 4 for m in more]
            cols = np.concatenate(found).T.copy() if found else np.zeros((6, 0))
            arrays = [pa.array(f) for f in cols[:5]] + [pa.array(cols[5].astype(np.int32))]
            arrays += [pa.array([a[k] for a in asked], pa.list_(kind)) for k, kind in enumerate(arrow)]
            yield pa.StructArray.from_arrays(arrays, [*figures, "words", *_ASKED])

    return run(text)


def _names(text: Column) -> list[Column]:
    """Two hashes, 128 bits, that stand for a text; a null one counts as empty."""
    plain = F.coalesce(text, F.lit(""))
    return [F.xxhash64(plain).alias("_a"), F.xxhash64(F.lit(1), plain).alias("_b")]


def _combined(f: Column, more: Column, more_peak: Column) -> Column:
    """All features from a text's local ones and what the tail of the word model adds."""
    peaks = F.greatest(f["peak"] + more_peak, F.lit(0.0))
    each = F.greatest(f["words"], F.lit(1))
    word = {"word_mean": (f["value"] + more) / each, "word_peaks": peaks / each, "word_sum": F.log1p(peaks)}
    return F.struct(*[(word[c] if c in word else f[c]).alias(c) for c in _FEATURES]).alias("features")


def _tail_features(texts: DataFrame, model: ToxicModel, text: str) -> DataFrame:
    """(_a, _b, features): one row for each different text of `texts`, the tail joined by key."""
    spark, own = texts.sparkSession, F.col(f"`{text}`")
    seen = texts.select(*_names(own), F.monotonically_increasing_id().alias("uid"), _local_features(spark, model, own).alias("f"))
    seen = stage(seen, "features")
    asked = seen.select("uid", F.inline(F.arrays_zip("f.key", "f.word", "f.base", "f.times")))
    met = asked.hint("merge").join(model.words.tail, "key").groupBy("uid", "word", "base", "times")
    met = met.agg(F.sum(F.col("value").cast("double")).alias("added"))

    def peak(ratio: Column) -> Column:
        return F.greatest(ratio - WORD_PEAK, F.lit(0.0))

    base = F.col("base").cast("double")
    more = met.groupBy("uid").agg(
        F.sum(F.col("times") * F.col("added")).alias("more"),
        F.sum(F.col("times") * (peak(base + F.col("added")) - peak(base))).alias("more_peak"),
    )
    local = seen.select("_a", "_b", "uid", F.col("f").dropFields("key", "word", "base", "times").alias("f"))
    full = local.hint("merge").join(more, "uid", "left")
    added = [F.coalesce(c, F.lit(0.0)) for c in ("more", "more_peak")]
    return full.select("_a", "_b", _combined(F.col("f"), *added)).groupBy("_a", "_b").agg(F.max("features").alias("features"))


def _with_features(docs: DataFrame, model: ToxicModel, text: str) -> DataFrame:
    """(row, features): every row of `docs` as a struct, with the features of its text."""
    own = F.col(f"`{text}`")
    if model.words.tail is None:
        local = docs.select(as_row(docs), _local_features(docs.sparkSession, model, own).alias("f"))
        return local.select("row", _combined(F.col("f"), F.lit(0.0), F.lit(0.0)))
    found = _tail_features(docs.select(own), model, text)
    return docs.select(as_row(docs), *_names(own)).hint("merge").join(found, ["_a", "_b"]).select("row", "features")


def _logistic(rows: pd.DataFrame) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept's."""
    x = rows[_FEATURES].to_numpy(float)
    y = rows["toxic"].to_numpy(float)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = RIDGE * len(x) * np.diag([1.0] * (z.shape[1] - 1) + [0.0]) + 1e-9 * np.eye(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] / scale * centre).sum()]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
    head_starts: int = HEAD_STARTS,
) -> ToxicModel:
    """Models from all labelled rows that are neither of the held-out fold nor among the calibration's.

    The calibration takes CALIBRATION_ROWS keys of its fold at most; the others of that
    fold teach the models. `head_starts` bounds the broadcast and changes no score but
    for rounding.
    A key labelled more than once is toxic if any of its labels is. Rows with a null
    key or label teach nothing. With no labelled texts every score is the share of
    toxic labels (0 without any).
    """
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    marks = marks.filter("key is not null and toxic in (0, 1)").groupBy("key").agg(F.max("toxic").alias("toxic"))
    marks = stage(marks.withColumn("fold", fold_of(F.col("key"), FOLDS)).filter("fold <> 0"), "marks")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    some = marks.filter(F.col("fold") == CALIBRATION_FOLD).select("key", "toxic")
    # At most CALIBRATION_ROWS keys, so that the texts of this fold stay where they are.
    some = stage(some.orderBy(F.xxhash64("key"), "key").limit(CALIBRATION_ROWS), "calibration")
    taught = marks.join(F.broadcast(some.select("key")), "key", "left_anti").select("key", "toxic")
    own = fold_of(F.col("key"), FOLDS)
    # Up to BROADCAST_ROWS labels go to the texts; more of them meet the texts by key.
    taught = broadcast_if_small(stage(taught, "labels"))
    read = stage(texts.filter(own != 0).join(taught, "key").select("text", "toxic"), "taught")
    parts = read.mapInArrow(_count_grams, "gram int, toxic int, n long")
    # At most GRAM_SPACE rows, whatever the corpus.
    sums = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    counts = parts.groupBy("gram").agg(*sums).toArrow().sort_by("gram")
    model = _model_of(counts["gram"].to_numpy(), (counts["n0"].to_numpy(), counts["n1"].to_numpy()))
    model.words = _word_model(read, head_starts)
    unstage(read)
    model.prior = float(marks.agg(F.avg("toxic")).first()[0] or 0.0)
    tried = texts.filter(own == CALIBRATION_FOLD).join(F.broadcast(some), "key").select("toxic", "text")
    rated = _with_features(tried, model, "text")
    rows = rated.select("row.toxic", "features.*").filter("brief > 0").toPandas()
    if rows["toxic"].nunique() == 2:
        model.weights = _logistic(rows)
    else:
        odds = min(max(model.prior, 1e-6), 1 - 1e-6)
        model.weights = np.array([1.0, *[0.0] * (len(_FEATURES) - 1), np.log(odds / (1 - odds))])
    return model


def _score(model: ToxicModel) -> Column:
    """Double in 0 to 1, higher where the text is likelier toxic.

    A logistic function of the length-normalised ratio. A text without letters or
    digits, an empty one or a null one scores the share of toxic labels.
    """
    *weights, offset = (float(w) for w in model.weights)
    f = F.col("features")
    margin = sum((f[name] * w for name, w in zip(_FEATURES, weights)), F.lit(offset))
    return F.when(f["brief"] == 0, F.lit(model.prior)).otherwise(1 / (1 + F.exp(-margin)))


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """(row, score, predicted): every row of `docs` as a struct, with its score.

    Rows are neither dropped nor merged: repeated rows get equal scores. An empty
    table gives no rows.
    """
    rated = _with_features(docs, model, text).select("row", _score(model).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` that the model does not call toxic, with their columns as they came."""
    rated = score_toxicity(docs, fit_toxicity(docs, labels, key, text), text)
    return rated.filter("predicted = 0").select("row.*")
