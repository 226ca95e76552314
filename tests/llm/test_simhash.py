import random
from collections import defaultdict

import pytest
import xxhash

from civitext.llm.components import connected_components
from civitext.llm.simhash import (
    as_hex,
    drop_near_duplicates,
    fingerprint_of,
    hamming_links,
    simhash_components,
)


def slow_fingerprint(text):
    words = [w for w in _cut((text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _cut(text):
    out = [""]
    for ch in text:
        if ch == " " or "\t" <= ch <= "\r":
            out.append("")
        else:
            out[-1] += ch
    return out


def slow_components(fps):
    """Class number by index, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def partition(labels):
    groups = defaultdict(set)
    for at, label in labels.items():
        groups[label].add(at)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


TEXTS = [
    None, "", " \t\n", "One", "one", "one two", "ONE  two", "a b c d", "É é É é", "x" * 70_000,
    "the same words again and again " * 40, "The same words\nagain and again " * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_brute_force(text):
    assert fingerprint_of(text) % (1 << 64) == slow_fingerprint(text)


def clustered(seed, centres, members):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(members):
            x = centre
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 3, 1024])
def test_links_connect_the_same_components_as_all_pairs(spark, hot):
    fps = clustered(7, 12, 25)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = hamming_links(spark.createDataFrame(rows, "fp long"), hot=hot)
    for a, b in links.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(links, "a", "b").collect()}
    assert partition(roots) == partition(dict(zip(fps, slow_components(fps))))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 3)]
    found = dict(connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(100, 200)} == {100}


def test_documents_match_brute_force(spark):
    base = "w%d " * 80 % tuple(range(80))
    rows = [(i, t) for i, t in enumerate([*TEXTS, base, base, base + "more", base.replace("w40", "v40")])]
    rows += [(None, base), (14, base), (None, "alone here"), (None, "alone here")]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", as_hex(got["fp"]).alias("fp"), "component_id").collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    classes = slow_components(fps)
    least = {c: min((r[0] for r, k in zip(rows, classes) if k == c and r[0] is not None), default=None) for c in classes}
    want = [(r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, classes)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_document_of_each_group_stays(spark):
    copy = "some words that stand in every copy of this text " * 3
    rows = [(3, copy, "a"), (1, copy, "b"), (1, copy, "b"), (7, "quite another text", "c"), (None, copy, "d"),
            (None, "nameless", "e"), (None, "nameless", "e"), (9, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(
        map(str, docs.filter("fp in ('c', 'g')").collect() + docs.filter("fp in ('b', 'e')").distinct().collect())
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).count() == 0 and drop_near_duplicates(docs).count() == 0
