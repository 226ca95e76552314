import hashlib
import random

import numpy as np
import pytest

from civitext.llm.vector_codes import compress_vectors, nearest_entries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, error string"


def slow_codes(rows):
    """{row number: (code, error)} and the digest of the codebooks by k-means over all distances."""
    kept = [i for i, r in enumerate(rows) if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda i: (rows[i][0], rows[i][1]))
    parts = {i: np.floor(np.float32(rows[i][1]).astype(float) * 4096).astype(int).reshape(8, -1) for i in kept}
    books = [[parts[i][p] for i in kept[:16]] for p in range(8)]

    def near(x, book):
        return min((sum(int(a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(6):
        held = {i: [near(parts[i][p], books[p])[1] for p in range(8)] for i in kept}
        for p in range(8):
            for j in range(len(books[p])):
                mine = [parts[i][p] for i in kept if held[i][p] == j]
                if mine:
                    books[p][j] = np.array([sum(map(int, c)) // len(mine) for c in zip(*mine)])
    final = {i: [near(parts[i][p], books[p]) for p in range(8)] for i in kept}
    text = ",".join(str(int(x)) for book in books for e in book for x in e)
    codes = {i: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for i, f in final.items()}
    return codes, hashlib.sha256(text.encode()).hexdigest()


def same_as_slow(spark, rows):
    codes, digest = slow_codes(rows)
    sums = {}
    for i, (_, error) in codes.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + error
    wanted = sorted((rows[i][0], *codes[i], sums[rows[i][2]], digest) for i in codes)
    df = spark.createDataFrame([(*r, "k", "e") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, compress_vectors(df).collect())) == wanted
    return wanted


def vector(rng, width=16):
    return [rng.gauss(rng.choice((-1, 1)), 0.3) for _ in range(width)]


def test_random_vectors_with_gaps_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, vector(rng), rng.choice((0, 1, 2, None))) for i in range(120)]
    rows += [rows[5], rows[5], rows[40]]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 0), (203, [1.0] * 15 + [float("-inf")], 0)]
    same_as_slow(spark, rows)


def test_ties_go_to_the_lower_entry(spark):
    grid = [[float(x), float(y)] * 4 for x in range(-2, 3) for y in range(-2, 3)]
    rows = [(i, grid[i % 25], i % 2) for i in range(60)]  # entries that are equal, and points halfway between entries
    same_as_slow(spark, rows)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_fewer_vectors_than_entries(spark, n):
    rng = random.Random(n)
    wanted = same_as_slow(spark, [(i, vector(rng, 8), 0) for i in range(n)])
    assert all(row[2] == 0 for row in wanted)


def test_a_hot_label_and_long_vectors(spark):
    rng = random.Random(3)
    same_as_slow(spark, [(i, vector(rng, 256), 0 if i % 3 else i) for i in range(40)])


def test_nothing_to_code(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert compress_vectors(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert compress_vectors(empty).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA)).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, [], 0, "", "")], SCHEMA)).first()["code"] == "00" * 8


def test_null_keys_come_last(spark):
    rows = [(None, [9.0] * 8, 0)] + [(i, [float(i)] * 8, 0) for i in range(16)]
    got = compress_vectors(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()
    assert len(got) == 17 and {r["code"] for r in got if r["vec_id"] is None} == {"09" * 8}


@pytest.mark.parametrize("wrong", [[1.0] * 16, [1.0] * 9, [1e30] * 8])
def test_vectors_without_a_code_raise(spark, wrong):
    rows = [(5, [1.0] * 8, 0, "", ""), (1, wrong, 0, "", "")]
    with pytest.raises(Exception, match="components|equal parts"):
        compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()


def test_balls_give_the_nearest_entry_from_any_start():
    rng = np.random.default_rng(4)
    for _ in range(50):
        entries = rng.integers(-5, 6, (rng.integers(1, 17), 3))
        parts = rng.integers(-6, 7, (80, 3))
        d = ((parts[:, None] - entries[None]) ** 2).sum(2)
        best, dist = nearest_entries(parts, entries, rng.integers(0, len(entries), 80))
        assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()
