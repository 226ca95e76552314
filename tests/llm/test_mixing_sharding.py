import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from civitext.llm.mixing import mixed_rows, permuted, source_targets, taken_words
from civitext.llm.sharding import giants_of, shard_documents, shard_rows, smallest_capacity


def slow_targets(sizes):
    """Water level by sharing what is left until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_match_step_by_step_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 40, 400, 9000]) for i in range(rng.randrange(1, 12))}
    if seed % 2:
        sizes[None] = 55
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = slow_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 1023])
def test_permutation(spark, size):
    rows = spark.range(size).select(permuted(F.col("id"), F.lit(size).cast("long"), F.lit(1), F.lit(0)).alias("x"))
    got = [r["x"] for r in rows.collect()]
    assert sorted(got) == list(range(size)) and (size < 10 or got != list(range(size)))


def documents(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        source = "hot" if i % 3 else rng.choice(["a", "b", None])
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(rng.randrange(0, 400))), source, "x"))
    rows += [(None, "some words", "a", "x"), (7, None, "a", "x"), (7, " ", None, "x"), (5, "same row", "b", "x"), (5, "same row", "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_hits_its_targets(spark):
    docs = documents(spark)
    got = taken_words(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, taken_words(docs).collect()))
    sums, rows = defaultdict(int), got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["target"], r["source_size"]] += r["taken"]
    assert sum(r["size"] for r in rows) == sum(len((r["text"] or "").split()) for r in docs.collect())
    for (target, _), taken in sums.items():
        assert abs(taken - target) <= max(70, 0.02 * target)


def test_mixed_rows_are_words_of_their_documents(spark):
    docs = documents(spark)
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    own = {r["doc_id"]: Counter((r["text"] or "").split()) for r in docs.collect() if r["doc_id"] not in (5, 7, None)}
    times, total = defaultdict(Counter), 0
    for r in mixed.collect():
        assert r["text"].split()
        total += len(r["text"].split())
        if r["doc_id"] in own:
            times[r["doc_id"]].update(r["text"].split())
    for key, words in times.items():
        assert set(words) <= set(own[key]) and max(words.values()) <= 2
    assert total == sum(r["taken"] for r in taken_words(docs).collect())


def test_empty_mix(spark):
    docs = documents(spark)
    assert taken_words(docs.limit(0)).count() == 0 and mixed_rows(docs.limit(0)).count() == 0
    blank = docs.filter("text is null or text = ' '")
    assert [r["taken"] for r in taken_words(blank).collect()] == [0, 0] and mixed_rows(blank).count() == 0


def slow_capacity(sizes, shards):
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
    return None


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("steps", [2, 5, 2048])
def test_smallest_capacity(seed, steps):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 9, 40]) for _ in range(rng.randrange(1, 60))]
    shards = rng.randrange(1, 8)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

    def read(windows, steps):
        bins = {}
        for w, (a, b) in enumerate(windows):
            width = -(-(b - a + 1) // steps)
            for e in ends:
                if a <= e <= b:
                    first, last = bins.get((w, (e - a) // width), (e, e))
                    bins[w, (e - a) // width] = (min(first, e), max(last, e))
        return sorted(bins.values())

    capacity, cuts = smallest_capacity(ends[-1], max(sizes), shards, read, steps)
    assert capacity == slow_capacity(sizes, shards)
    assert cuts[-1] == ends[-1] and all(c == 0 or c in ends for c in cuts)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity


def test_giants():
    assert giants_of([50, 10, 10, 10], 80, 4) == 1 and giants_of([10, 10], 20, 4) == 2 and giants_of([], 0, 4) == 0


def test_shards_are_whole_even_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "copy " * 900, "x") for i in range(60)]
    rows += [(100 + i, f"text {rng.randrange(400)} " * rng.randrange(1, 60), "y") for i in range(500)]
    rows += [(None, None, "z"), (1, "", "z"), (7, "twice", "z"), (7, "twice", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard_rows(docs, F.struct("doc_id", "text"), shards=8).collect()
    assert len(got) == len(rows)
    of, slots, size = {}, defaultdict(list), Counter()
    for r in got:
        text = (r["row"]["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        assert of.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = of[("copy " * 900).encode()]
    rest = [n for s, n in size.items() if s != hot]
    assert len(slots[hot]) == 60 and max(rest) <= 1.1 * min(rest)
    placed = shard_documents(docs, shards=8)
    assert placed.columns == ["doc_id", "text", "shard", "slot"] and placed.count() == len(rows)


def test_few_groups_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = {r["row"]: (r["shard"], r["slot"]) for r in shard_rows(docs, F.col("doc_id")).collect()}
    assert got[1][0] == got[2][0] != got[3][0] and {got[1][1], got[2][1]} == {0, 1}
    assert shard_rows(docs.limit(0), F.col("doc_id")).count() == 0
