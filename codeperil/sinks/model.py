"""What the text sinks render: a result, its view and its comparison, as rows on the driver.

Only what a text shows comes to the driver: summaries (one row each), views (cut by their limit) and, where a format
lists every function over the threshold, those through an iterator of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import delta as d
from ..operators import summary, view

#: The columns of a function's span.
SPAN = ("start_line", "end_line", "start_column", "end_column")


@dataclass
class Comparison:
    """Changes between two results, the view of them and the tolerance."""

    changes: DataFrame
    spec: d.DeltaViewSpec = field(default_factory=d.DeltaViewSpec)
    epsilon: float = 0.0
    baseline: DataFrame | None = None
    baseline_tool_version: str | None = None
    baseline_timestamp: str | None = None

    @cached_property
    def summary(self) -> Row:
        return d.delta_summary(self.changes, self.epsilon).first()

    @cached_property
    def shown(self) -> list[Row]:
        rows = d.delta_view(self.changes, self.spec)
        return rows.withColumn("violation", d.new_violation(self.epsilon)).collect()

    @cached_property
    def eligible(self) -> int:
        return d.delta_view(self.changes, d.DeltaViewSpec(self.spec.kinds, self.spec.min_delta, self.spec.max_delta, self.spec.sort)).count()

    @property
    def truncated(self) -> bool:
        return len(self.shown) < self.eligible


@dataclass
class Report:
    """A result (verdicts, best cached: several sinks read it), its view, and what is written around it."""

    verdicts: DataFrame
    tool_name: str
    tool_version: str
    language: str
    metric: str = "cognitive"
    threshold: float = 15.0
    policy: str = "pessimistic"
    spec: view.ViewSpec = field(default_factory=view.ViewSpec)
    comparison: Comparison | None = None
    diagnostics: DataFrame | None = None
    counters: Row | None = None
    parse_issues: Sequence[Row] = ()
    title: str | None = None
    subtitle: str | None = None
    timestamp: str = "0"
    diff_ref: str | None = None

    @cached_property
    def summary(self) -> Row:
        return summary.global_summary(self.verdicts).first()

    @cached_property
    def worst(self) -> Row | None:
        """The function with the largest score, the first of equals."""
        return self.verdicts.orderBy(*view.sort_keys("crap")).limit(1).first()

    @cached_property
    def shown_frame(self) -> DataFrame:
        rows = view.shown(self.verdicts, self.spec)
        if self.diagnostics is not None:
            rows = rows.join(self.diagnostics, "ordinal", "left").orderBy(*view.sort_keys(self.spec.sort))
        return rows

    @cached_property
    def shown(self) -> list[Row]:
        return self.shown_frame.collect()

    @property
    def grouped_frame(self) -> DataFrame:
        """File summaries with each file's worst function, neither sorted nor cut."""
        rows = view.filtered(self.verdicts, self.spec)
        worst = rows.groupBy("file_path").agg(F.max(F.struct("crap", (-F.col("ordinal")).alias("o"), "file_path", "qualified_name", *SPAN, "risk_level")).alias("worst")).withColumn("worst_function", F.col("worst.qualified_name"))
        return summary.file_summaries(rows).join(worst, "file_path")

    @cached_property
    def grouped(self) -> list[Row] | None:
        if not self.spec.group_by_file:
            return None
        rows = self.grouped_frame.orderBy(*view.file_sort_keys(self.spec.sort))
        return (rows.limit(self.spec.limit) if self.spec.limit else rows).collect()

    @cached_property
    def view_counts(self) -> Row:
        return view.view_counts(self.verdicts, self.spec).first()

    @cached_property
    def varied_thresholds(self) -> bool:
        low, high = self.verdicts.agg(F.min("threshold"), F.max("threshold")).first()
        return low is not None and low != high

    def exceeding(self) -> Iterator[Row]:
        """All functions over their threshold in input order, whatever the view, partition by partition."""
        rows = self.verdicts.where("exceeds")
        if self.diagnostics is not None:
            rows = rows.join(self.diagnostics, "ordinal", "left")
        return rows.orderBy("ordinal").toLocalIterator()


def number(x: float) -> str:
    """As short as it can be, without a fraction of nothing: 8, 12.5."""
    return str(int(x)) if x == int(x) else repr(x)
