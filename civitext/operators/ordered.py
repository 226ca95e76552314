"""Global order at scale: row numbers and running sums without a single-task window.

The rows are range-partitioned by the sort key and staged with their partition
number, so that both passes over them (totals per range, then rows) see the
same ranges. Only the totals, one row per range and group, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.session import stage

_PART_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def with_row_number(
    df: DataFrame, order_by: list[Column], name: str = "rank", partition_by: list[str] | None = None
) -> DataFrame:
    """One-based `name` in the global order, restarted for every `partition_by` group."""
    groups = partition_by or []
    keys = [F.col(g).asc() for g in groups] + list(order_by)
    ranged = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", _PART_BITS)),
        name,
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_range = F.col("_at").bitwiseAND((1 << _PART_BITS) - 1)
    # One offset per shuffle partition: bounded by the partition count.
    ranked = ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + in_range + 1)
    ranked = ranked.drop("_range", "_at", "_before")
    if groups:
        starts = ranked.groupBy(*groups).agg(F.min(name).alias("_start"))
        ranked = (
            ranked.join(starts, groups).withColumn(name, F.col(name) - F.col("_start") + 1).drop("_start")
        )
    return ranked


def with_running_sum(
    df: DataFrame,
    order_by: list[Column],
    value: str,
    name: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """`name`: sum of `value` over all earlier rows of the group, the row itself left out."""
    groups = partition_by or []
    keys = [F.col(g).asc() for g in groups] + list(order_by)
    ranged = stage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range", *groups).agg(F.sum(value).alias("_total"))
    before = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *groups, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range", *groups).orderBy(*order_by)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, ["_range", *groups])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_range", "_before", "_inside")
    )


def top_by_count(df: DataFrame, k: int, count: str, *ties: Column) -> DataFrame:
    """The `k` rows with the highest `count`, equal counts in the order of `ties`.

    A plain top-k sends k rows of every partition to one task, which is too much
    for a k of many thousands. A histogram of the counts, which has few distinct
    values, gives the count of the k-th row; only rows that reach it are sorted.
    """
    return top_of_staged(stage(df, "counted"), k, count, *ties)


def top_of_staged(staged: DataFrame, k: int, count: str, *ties: Column) -> DataFrame:
    """`top_by_count` of a table that is staged already; it is read twice."""
    sizes = staged.groupBy(count).agg(F.count(F.lit(1)).alias("_rows"))
    downward = Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = sizes.withColumn("_upto", F.sum("_rows").over(downward)).filter(F.col("_upto") >= k)
    least = reached.agg(F.max(count)).first()[0]
    kept = staged if least is None else staged.filter(F.col(count) >= least)
    return kept.orderBy(F.col(count).desc(), *ties).limit(k)


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 1024) -> tuple[float, int] | None:
    """(the k-th largest number of `value`, rows above it); None if there are fewer than `k` numbers.

    Exact, by histograms that close in on it: each pass counts the rows of at most `bins`
    equal steps between two numbers and goes on within the step that holds the k-th.
    Rows are neither moved nor sorted, and `bins` rows come back from a pass.
    """
    numbers = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    lo, hi, n = numbers.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if n < k or k < 1:
        return None
    above = 0
    while lo < hi:
        step = (hi - lo) / bins
        # Between neighbouring numbers there are no steps, and few numbers.
        bin_ = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)) if lo + step > lo else F.col("v")
        within = numbers.filter(F.col("v").between(lo, hi)).groupBy(bin_.alias("b"))
        found = within.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for row in sorted(found, key=lambda r: -r["lo"]):
            if above + row["n"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
    return lo, above


def best_rows(df: DataFrame, k: int, score: str, keys: list[str]) -> DataFrame:
    """The `k` rows of the highest `score`, equal ones in ascending order of `keys`; null scores count as 0.

    Only scores and keys are read to find the cut: the k-th score, and of the rows that have
    it the last key that still belongs. Then a plain filter takes the rows, which are not
    moved, whatever else they hold. `df` is read more than once.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    narrow = stage(df.select(*keys, value.alias("_value")), "scores")
    cut = kth_largest(narrow, "_value", k)
    if cut is None:
        return df if k > 0 else df.limit(0)
    least, above = cut
    ties = narrow.filter(F.col("_value") == least).select(*keys)
    last = F.lit(True)
    if ties.count() > k - above:
        # Only the ties are ordered, and only their keys.
        numbered = with_row_number(ties, [F.col(c).asc() for c in keys], "_place")
        at = numbered.filter(F.col("_place") == k - above).first()
        wanted = F.struct(*[F.lit(at[c]).cast(df.schema[c].dataType).alias(c) for c in keys])
        last = F.struct(*keys) <= wanted
    return df.filter((value > least) | ((value == least) & last))
