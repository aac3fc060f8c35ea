"""Places in an order and exact medians over all rows, by ranges of the order.

Rows are dealt by ranges of their keys and sorted inside each. The rows of every range are counted; a range's rows come
behind those of the ranges before it, so the running sums of these counts, one number for each partition, turn places in a
range into places in the whole. No task sees more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: monotonically_increasing_id has the partition's number above these bits and the row's place in it below.
_ROW_BITS = 33


def _in_ranges(rows: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """`rows` staged by ranges of `keys`, in order in each, with __range and __at, the range's number and the place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("__place", place)
    dealt = dealt.withColumns({"__range": F.shiftright("__place", _ROW_BITS).cast("int"), "__at": F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    return staged(dealt.drop("__place"), name)


def _before(dealt: DataFrame, size: Column) -> Column:
    """What lies in the ranges before a row's own, in sums of `size`."""
    sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.sum(size).alias("n")).collect()}  # a row for each partition
    if not sizes:
        return F.lit(0).cast("long")
    sums = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes)))]
    return F.get(F.lit(sums).cast("array<bigint>"), F.col("__range"))


def with_rank(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """`rows` with rank from 1 in the order of `keys`; equal rows get their ranks in any order."""
    dealt = _in_ranges(rows, keys, "ranks")
    rank = _before(dealt, F.lit(1)) + F.col("__at") + 1
    return dealt.withColumn("rank", rank.cast("long")).drop("__range", "__at")


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`keys` and median: of the values that are not null the middle one, or the mean of the two middle ones.

    Groups without a value have no row; NaN is the largest value. Equal values are counted first, so only different ones are
    sorted, and a group with very many of them lies in many ranges.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = _in_ranges(counted, [*map(F.col, keys), F.col("__value")], "values")
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # places of a value's first and last row, from 0, in all groups together
    last = _before(dealt, F.col("__n")) + F.sum("__n").over(inside) - 1
    placed = dealt.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__n") + 1).drop("__range", "__at")
    group = placed.groupBy(*keys).agg(F.min("__first").alias("begin"), F.sum("__n").alias("size"))
    low, high = F.col("begin") + F.floor((F.col("size") - 1) / 2), F.col("begin") + F.floor(F.col("size") / 2)
    group = group.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], low.alias("__low"), high.alias("__high"))
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    met = placed.join(group, [*same, F.col("__last") >= F.col("__low"), F.col("__first") <= F.col("__high")])
    least, most = F.min("__value").cast("double"), F.max("__value").cast("double")
    return met.groupBy(*keys).agg(F.when(least == most, least).otherwise((least + most) / 2).alias("median"))
