"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of whole-number types. A decimal of 38 digits holds 126 bits and a sign.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_DECIMAL_BITS = 126
_LONG_BITS = 63


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column behind a generator over a one-element array.

    A plain column is copied by the optimizer into every filter pushed below
    it, and computed again there; expressions are not moved across a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def exploded(df: DataFrame, keys: list[str], items: Column, pos: str, name: str) -> DataFrame:
    """(*keys, pos, name): one row per array element.

    The outer form keeps the array expression from being repeated in an
    inferred filter; rows of null and empty arrays are dropped after it.
    """
    out = df.select(*keys, F.posexplode_outer(items).alias(pos, name))
    return out.filter(F.col(pos).isNotNull())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spreads a scan that has fewer splits than the cluster has cores for.

    Costly text work right after a scan of one small or badly written file
    would run in one task. A scan of many splits is left as it is.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def packed(df: DataFrame, keys: list[str], tail_bits: int = 0) -> Column:
    """The values of `keys` in one fixed-width number, or in a struct, that keeps their order.

    Whole numbers are laid side by side in a long, or in a decimal of 38 digits, with room
    for a further number of `tail_bits` bits. A minimum of such a number is kept in a hash
    aggregation, that of a struct needs a sort. Keys of other types, or too wide together,
    make a struct. The first key keeps its sign, later ones are moved to start at 0; a
    null key comes first.
    """
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    widths = [_BITS.get(kind, _DECIMAL_BITS + 1) for kind in kinds]
    total = sum(widths) + tail_bits - 1  # the first one's sign bit is the number's own
    if total > _DECIMAL_BITS:
        return F.struct(*keys)
    kind = "bigint" if total <= _LONG_BITS else "decimal(38,0)"

    def part(key: str, width: int, first: bool) -> Column:
        low = -(1 << (width - 1))
        value = F.coalesce(F.col(key).cast("bigint"), F.lit(low).cast("bigint")).cast(kind)
        return value if first else value - F.lit(str(low)).cast(kind)

    def shifted(a: Column, bits: int) -> Column:
        return (a * F.lit(str(1 << bits)).cast(kind)).cast(kind)

    parts = [part(k, w, i == 0) for i, (k, w) in enumerate(zip(keys, widths))]
    whole = reduce(lambda a, b: (shifted(a, b[1]) + b[0]).cast(kind), zip(parts[1:], widths[1:]), parts[0])
    return shifted(whole, tail_bits) if tail_bits else whole
