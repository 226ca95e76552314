"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitext.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of the component, for every node that has a link.

    Links are rewritten towards smaller nodes until nothing changes, which takes a
    number of rounds that grows with the logarithm of the longest chain. Each round
    is a minimum per node, combined before the shuffle, and a join that can be split
    where one node has very many links; a round's links are a table in the shared
    folder. Null nodes are no nodes; a node linked to itself alone has no row.
    """
    edges = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter("a is not null and b is not null and a > b")
        .distinct()
    )
    edges = stage(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
