"""Ranges of whole numbers as nodes of a tree, so that range joins are equi-joins.

A node of level j holds 8**j neighbouring numbers. A range is the union of disjoint nodes, at most 14 of each level, so their
number grows with the logarithm of the range; a number lies in one node of each level. Numbers may lie anywhere from -2**60
to 2**60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary digits of a level.
BITS = 3
#: The highest level.
TOP = 19


def _shift(name: str, x: Column, level: Column) -> Column:
    return F.call_function(name, x, level * F.lit(BITS))


def _from_to(first: Column, end: Column) -> Column:
    """first to end - 1."""
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def nodes(first: Column, last: Column) -> Column:
    """The nodes (array of struct<level, node>) that make up the range from first to last; none if it is empty or an end is null."""
    first, end = first.cast("long"), last.cast("long") + 1

    def of_level(j: Column) -> Column:
        low = lambda k: _shift("shiftright", first + _shift("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = lambda k: _shift("shiftright", end, k)
        up = j + 1
        goes_on = (j < TOP) & (low(up) < high(up))  # whole nodes of the next level lie inside
        left = _from_to(low(j), F.when(goes_on, _shift("shiftleft", low(up), F.lit(1))).otherwise(high(j)))
        right = F.when(goes_on, _from_to(_shift("shiftleft", high(up), F.lit(1)), high(j))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(left, right), lambda x: F.struct(j.alias("level"), x.alias("node")))

    return F.when(first < end, F.flatten(F.transform(F.sequence(F.lit(0), _highest(end - first)), of_level)))


def _highest(size: Column) -> Column:
    """The highest level with a node in a range of so many numbers."""
    return F.least(F.floor((F.length(F.bin(size)) - 1) / BITS), F.lit(TOP)).cast("int")


def at_nodes(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, columns: list[str]) -> DataFrame:
    """`columns` of `points` with level and node: the nodes that the column `point` lies in, of all levels that `nodes` gives for any of the ranges. Null points go."""
    size = F.col(last).cast("long") - F.col(first).cast("long") + 1
    top = ranges.agg(_highest(F.max(F.when(size > 0, size))).alias("top")).scalar()
    placed = points.where(F.col(point).isNotNull()).select(*columns, F.col(point).cast("long").alias("__at"), top.alias("__top"))
    # levels first, as rows: a lambda over an array isn't compiled
    return placed.select(*columns, "__at", F.explode(F.sequence(F.lit(0), F.col("__top"))).alias("level")).select(*columns, "level", _shift("shiftright", F.col("__at"), F.col("level")).alias("node"))
