import random

import pytest

from civitext.llm.decontamination import contaminated, decontaminate, tiles


def longest_free(a, b, free_a, free_b, least):
    """Longest unmarked common passage by comparing every pair of places."""
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                k += 1
            best = max(best, k)
    return best if best >= least else 0


@pytest.mark.parametrize("seed", range(25))
def test_tiles_are_greedy_and_complete(seed):
    rng = random.Random(seed)
    words = "abcd" if seed % 2 else "ab"
    item = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
    text = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
    got = tiles(text, item, 3)
    free_a, free_b = [True] * len(item), [True] * len(text)
    for start, other, width in got:
        assert width == longest_free(item, text, free_a, free_b, 3)
        assert item[start : start + width] == text[other : other + width]
        assert all(free_a[start : start + width]) and all(free_b[other : other + width])
        free_a[start : start + width] = [False] * width
        free_b[other : other + width] = [False] * width
    assert longest_free(item, text, free_a, free_b, 3) == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
W = ITEM.split()
FILL = "nothing to see here at all in these plain words of mine"


def found(spark, docs, items):
    got = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return sorted(((r["doc_id"], r["item_id"], r["covered"]) for r in got.collect()), key=str)


def test_whole_reordered_and_partial_items(spark):
    reordered = " ".join([*W[8:], FILL, *W[:8]])
    docs = [
        (1, f"{FILL} {ITEM.upper()}, {FILL}"),
        (2, reordered.replace("nine", "nine,")),
        (3, " ".join([FILL, *W[:7]])),
        (4, " ".join(x for pair in zip(W, FILL.split()) for x in pair)),
        (5, " ".join([*W[:8], FILL])),
        (None, ITEM),
        (7, None),
        (8, ""),
        (9, ITEM),
        (9, ITEM),
    ]
    items = [(10, ITEM), (11, "too short to"), (12, None), (13, "")]
    assert found(spark, docs, items) == sorted(
        [(1, 10, 16), (2, 10, 16), (5, 10, 8), (None, 10, 16), (9, 10, 16), (9, 10, 16)], key=str
    )


def test_spans_point_into_the_document(spark):
    docs = spark.createDataFrame([(1, " ".join([FILL, *W[8:], FILL, *W[:8]]))], "doc_id long, text string")
    row = contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    words = docs.first()["text"].split()
    for t in row["tiles"]:
        assert words[t["doc_start"] : t["doc_start"] + t["length"]] == W[t["item_start"] : t["item_start"] + t["length"]]


def test_kept_documents_keep_their_columns(spark):
    rows = [(1, ITEM, "a"), (2, FILL, "b"), (None, ITEM, "c"), (None, FILL, "d"), (4, None, "e"), (2, FILL, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["uid"] for r in kept.collect()) == ["b", "b", "d", "e"]
    assert decontaminate(docs, items.limit(0)).count() == 6
    assert decontaminate(docs.limit(0), items).count() == 0


def test_against_coverage_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6, 20)))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(20))]
        for _ in range(rng.randrange(0, 3)):
            tokens = rng.choice(items)[1].split()
            cut = rng.randrange(0, len(tokens))
            parts.append(" ".join(tokens[cut:] + ["zz"] + tokens[:cut]))
        docs.append((d, " ".join(parts)))
    want = []
    for d, text in docs:
        for i, item in items:
            covered = sum(w for _, _, w in tiles(text.split(), item.split()))
            if covered >= 0.5 * len(item.split()):
                want.append((d, i, covered))
    assert found(spark, docs, items) == sorted(want, key=str)


def test_items_that_repeat_themselves_against_brute_force(spark):
    line = "round and round the garden goes"
    items = [(1, " ".join([line] * 30)), (2, " ".join([line] * 4 + [ITEM])), (3, " ".join(["la"] * 50))]
    docs = [(d, f"{FILL} {items[d - 1][1]} {FILL}") for d in (1, 2, 3)]
    docs += [(4, " ".join([line] * 14)), (5, " ".join([line] * 15)), (6, f"{FILL} {line}"), (7, " ".join(["la"] * 25))]
    want = []
    for d, text in docs:
        for i, item in items:
            covered = sum(w for _, _, w in tiles(text.split(), item.split()))
            if covered >= 0.5 * len(item.split()):
                want.append((d, i, covered))
    assert {(1, 1, 180), (5, 1, 90), (3, 3, 50), (7, 3, 25)} <= set(want) and (4, 1, 84) not in want
    assert found(spark, docs, items) == sorted(want, key=str)
