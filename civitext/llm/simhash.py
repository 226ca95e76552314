"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ
in at most three bits differ in at most one bit of at least one segment, so every
fingerprint looks up the ball of radius one around each of its segments in a table
of segment values; the full distance of what it finds is verified. Of the ball only
the half with a bit cleared is enumerated: of two segments that differ in one bit,
exactly one reaches the other that way, so that each pair is met once per segment.

A segment value that very many fingerprints share would make pairs with the square
of their number. Such values take an exact way with links in proportion to their
number: see `_hot_links`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import as_row
from civitext.llm.components import connected_components
from civitext.session import stage

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints with one segment value above which pairs are not enumerated.
HOT = 1024
_BLOCK = 1 << 16  # shingles whose bits are counted at once
_LOW = (1 << 32) - 1


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; 0 for one without words.

    A to Z are lower-cased; words are runs of non-whitespace in the ASCII sense.
    A bit is set if it is set in over half of the shingles' hashes. Texts with
    fewer words than a shingle hash their whole word sequence.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < shingle:
        tokens = [b" ".join(tokens)]
        shingle = 1
    digest = xxhash.xxh64_intdigest
    total = len(tokens) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _BLOCK):
        size = min(_BLOCK, total - start)
        runs = [tokens[start + k : start + k + size] for k in range(shingle)]
        hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*runs))), np.uint64, size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Long column with the fingerprint of each text; null texts have fingerprint 0."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), shingle) for t in texts], pa.int64())

    return run(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _segments(fp: Column) -> Column:
    """(segment number, its value, the other segment)."""
    low, high = fp.bitwiseAND(_LOW), F.shiftrightunsigned(fp, 32)
    return F.array(
        F.struct(F.lit(0).alias("seg"), low.alias("key"), high.alias("rest")),
        F.struct(F.lit(1).alias("seg"), high.alias("key"), low.alias("rest")),
    )


def _powers() -> Column:
    return F.array(*[F.lit(1 << i).cast("long") for i in range(32)])


def _cleared(value: Column) -> Column:
    """All values that have one set bit of `value` cleared."""
    set_bits = F.filter(_powers(), lambda p: value.bitwiseAND(p) != 0)
    return F.transform(set_bits, lambda p: value.bitwiseXOR(p))


def _ball(value: Column) -> Column:
    """`value` and all values one bit away."""
    return F.concat(F.array(value), F.transform(_powers(), lambda p: value.bitwiseXOR(p)))


def _two_away(value: Column) -> Column:
    """All values exactly two bits away."""
    pairs = F.array(*[F.lit((1 << i) | (1 << j)).cast("long") for i in range(32) for j in range(i)])
    return F.transform(pairs, lambda p: value.bitwiseXOR(p))


def _hot_links(here: DataFrame, near: DataFrame) -> DataFrame:
    """Links among the fingerprints `here` of a hot segment value, and to those `near` it.

    `here` has the value itself, `near` a value one bit away. On the other segment
    everybody names points: `here` the 33 within one bit as centres and the 496
    exactly two bits away, `near` the 33 within one bit. Whoever meets a centre of
    `here` at a point is within three bits of it in all, so each links to one centre
    of the point; and two fingerprints within three bits do meet at such a point.
    """
    keys = ["seg", "key", "point"]
    centres = here.select("seg", "key", F.explode(_ball(F.col("rest"))).alias("point"), "fp", F.lit(True).alias("centre"))
    wide = here.select("seg", "key", F.explode(_two_away(F.col("rest"))).alias("point"), "fp", F.lit(False).alias("centre"))
    others = near.select("seg", "key", F.explode(_ball(F.col("rest"))).alias("point"), "fp", F.lit(False).alias("centre"))
    points = centres.unionByName(wide).unionByName(others)
    heads = points.groupBy(*keys).agg(
        F.min(F.when(F.col("centre"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("members")
    )
    heads = heads.filter("head is not null and members > 1").select(*keys, "head")
    return points.join(heads, keys).filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))


def hamming_links(fps: DataFrame, fp: str = "fp", hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at RADIUS or fewer differing bits.

    Every link is a true one. Outside hot segment values every such pair is a row;
    among the fingerprints of a hot value the rows connect the same components.
    """
    cut = fps.select(F.col(fp).alias("fp"), F.explode(_segments(F.col(fp))).alias("s")).select("fp", "s.*")
    sizes = cut.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = stage(sizes.filter(F.col("n") > hot).select("seg", "key"), "crowded")
    probes = cut.select("seg", F.explode(_cleared(F.col("key"))).alias("key"), "rest", "fp")
    own, near, links = cut, probes, None
    if not crowded.isEmpty():
        keys = ["seg", "key"]
        links = _hot_links(cut.join(crowded, keys, "left_semi"), probes.join(crowded, keys, "left_semi"))
        own = cut.join(crowded, keys, "left_anti")
    asks = own.select("seg", "key", F.col("fp").alias("a"), F.lit(True).alias("same")).unionByName(
        near.select("seg", "key", F.col("fp").alias("a"), F.lit(False).alias("same"))
    )
    found = asks.join(own.select("seg", "key", F.col("fp").alias("b")), ["seg", "key"])
    found = found.filter((~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    found = found.select("a", "b")
    return found if links is None else found.unionByName(links)


def fingerprint_groups(
    fps: DataFrame, key: str = "doc_id", fp: str = "fp", hot: int = HOT, links: DataFrame | None = None
) -> DataFrame:
    """(fp, root, component_id, links): for every distinct fingerprint its component.

    `component_id` is the smallest `key` reachable from it, null if all keys of the
    component are null; `root` names the component also then. Copies share one
    fingerprint and never meet in pairs. `links` stand in for those by Hamming distance.
    """
    classes = fps.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("first"))
    classes = stage(classes, "fingerprints")
    links = stage(hamming_links(classes, hot=hot) if links is None else links, "links")
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    grouped = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.select("fp", "root").join(names, "root")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, fp, component_id), one row per row of `docs`.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null
    key take part and can join others; they get the component's smallest key. Repeated
    rows give repeated rows. An empty table gives an empty result.
    """
    fps = stage(docs.select(F.col(f"`{key}`").alias("key"), fingerprint(F.col(f"`{text}`")).alias("fp")), "simhash")
    groups = fingerprint_groups(fps, "key", hot=hot)
    return fps.join(groups, "fp").select(F.col("key").alias(key), "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, print_of: Column | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Rows of `docs`, one for each component: the one with its smallest key.

    A key names one document: of rows that repeat it one stays. Rows with a null key
    take part; of a component in which all keys are null one row stays. Columns are
    returned as they came, whatever their names. `print_of` and `links` stand in for
    fingerprints and their links by Hamming distance.
    """
    own = F.col(f"`{key}`")
    print_of = (fingerprint(F.col(f"`{text}`")) if print_of is None else print_of).alias("fp")
    narrow = stage(docs.filter(own.isNotNull()).select(own.alias("key"), print_of), "simhash")
    nameless = docs.filter(own.isNull()).select(as_row(docs), print_of, F.monotonically_increasing_id().alias("uid"))
    nameless = stage(nameless, "nameless")
    everyone = narrow.unionByName(nameless.select(F.lit(None).cast(narrow.schema["key"].dataType).alias("key"), "fp"))
    groups = stage(fingerprint_groups(everyone, "key", hot=hot, links=links), "groups")
    first = narrow.join(groups, "fp").filter("key = component_id").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    first = stage(first.select(F.col("key").alias("_key"), "rows"), "kept")
    once, again = first.filter("rows = 1"), first.filter("rows > 1")
    kept = docs.join(once, own == once["_key"], "left_semi")
    if not again.isEmpty():
        kept = kept.unionByName(docs.join(again, own == again["_key"], "left_semi").dropDuplicates([key]))
    if not nameless.isEmpty():
        alone = nameless.join(groups.filter("component_id is null"), "fp").groupBy("root").agg(F.min("uid").alias("uid"))
        kept = kept.unionByName(nameless.join(alone, "uid", "left_semi").select("row.*"))
    return kept
