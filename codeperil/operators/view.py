"""Views of a result: filter, group, sort, limit. The gate never looks at a view."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .summary import file_summaries, finite, global_summary

SORTS = ("crap", "coverage", "complexity", "path")


@dataclass(frozen=True)
class ViewSpec:
    """only_failing; coverage bounds in percent (None: open); sort: one of SORTS; limit (None or 0: all); group_by_file."""

    only_failing: bool = False
    min_coverage: float | None = None
    max_coverage: float | None = None
    sort: str = "crap"
    limit: int | None = None
    group_by_file: bool = False

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"unknown sort key {self.sort!r}")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")
        if self.bounds is not None:
            low, high = self.bounds
            if not all(math.isfinite(x) and 0 <= x <= 100 for x in (low, high)):
                raise ValueError("coverage bounds must lie in 0 to 100")
            if low > high:
                raise ValueError("the lower coverage bound exceeds the upper one")

    @property
    def bounds(self) -> tuple[float, float] | None:
        if self.min_coverage is None and self.max_coverage is None:
            return None
        return (0.0 if self.min_coverage is None else self.min_coverage, 100.0 if self.max_coverage is None else self.max_coverage)


def nan_last(x: Column, descending: bool) -> list[Column]:
    return [F.isnan(x).asc(), x.desc() if descending else x.asc()]


def sort_keys(sort: str) -> list[Column]:
    """Keys of a sort of functions; ties keep the input order."""
    keys = {
        "crap": nan_last(F.col("crap"), True),
        "coverage": nan_last(F.col("coverage_percent"), False),
        "complexity": [F.col("complexity").desc()],
        "path": [F.col("file_path").asc(), *nan_last(F.col("crap"), True)],
    }
    return [*keys[sort], F.col("ordinal").asc()]


def file_sort_keys(sort: str) -> list[Column]:
    keys = {
        "crap": nan_last(F.col("avg_crap"), True),
        "coverage": nan_last(F.col("avg_coverage"), False),
        "complexity": [F.col("max_complexity").desc()],
        "path": [F.col("file_path").asc()],
    }
    return [*keys[sort], F.col("first").asc()]


def filtered(verdicts: DataFrame, spec: ViewSpec) -> DataFrame:
    rows = verdicts.where("exceeds") if spec.only_failing else verdicts
    if spec.bounds is not None:
        cov = F.col("coverage_percent")
        rows = rows.where(finite(cov) & cov.between(*spec.bounds))
    return rows


def shown(verdicts: DataFrame, spec: ViewSpec) -> DataFrame:
    """The rows to show, in order. Grouped: the functions behind the groups, neither sorted nor cut."""
    rows = filtered(verdicts, spec)
    if spec.group_by_file:
        return rows
    rows = rows.orderBy(*sort_keys(spec.sort))
    return rows.limit(spec.limit) if spec.limit else rows


def grouped(verdicts: DataFrame, spec: ViewSpec) -> DataFrame:
    """File summaries of the filtered rows, sorted and cut."""
    rows = file_summaries(filtered(verdicts, spec)).orderBy(*file_sort_keys(spec.sort))
    return rows.limit(spec.limit) if spec.limit else rows


#: Up to so many rows are picked and ranked in one task.
FEW = 100_000


def with_rank(rows: DataFrame, keys: list[Column], limit: int | None = None) -> DataFrame:
    """`rows` with rank from 1 in the order of `keys`; with `limit` the first ones only."""
    if limit and limit <= FEW:
        return rows.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    ranked = order.with_rank(rows, keys)
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def view_counts(verdicts: DataFrame, spec: ViewSpec) -> DataFrame:
    """One row: eligible_count, shown_count, truncated, grouped_truncated."""
    rows = filtered(verdicts, spec)
    counts = rows.agg(F.count(F.lit(1)).alias("eligible_count"), F.count_distinct("file_path").alias("files"))
    cut = F.lit(spec.limit or (1 << 62))
    if spec.group_by_file:
        return counts.select("eligible_count", F.col("eligible_count").alias("shown_count"), F.lit(False).alias("truncated"), (F.col("files") > cut).alias("grouped_truncated"))
    return counts.select("eligible_count", F.least("eligible_count", cut).alias("shown_count"), (F.col("eligible_count") > cut).alias("truncated"), F.lit(False).alias("grouped_truncated"))


def shown_summary(verdicts: DataFrame, spec: ViewSpec) -> DataFrame:
    return global_summary(shown(verdicts, spec))
