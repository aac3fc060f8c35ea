"""Functions and coverage: which covered lines and branches lie in a function's span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import POLICIES, percent
from .dyadic import at_nodes, nodes


def in_spans(functions: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of `ordinal` and the columns of `points` (file_path, line, ...) whose line lies in the function's span.

    A range join as an equi-join: a span joins by the nodes that make it up, a line by the nodes that it lies in, so each
    pair comes once, whatever the span's length, and a file of any size is dealt over many tasks.
    """
    spans = _span_nodes(functions)
    placed = at_nodes(points, "line", functions, "start_line", "end_line", points.columns)
    return spans.join(placed.hint("merge"), ["file_path", "level", "node"]).select("ordinal", *[c for c in points.columns if c != "file_path"])


def counts_in_spans(functions: DataFrame, points: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """`ordinal` and, for spans with any of `points` (file_path, line, ...), what `counts` (counts or sums over points) gives.

    Points are counted for each node first, so a span adds up a few nodes however many points lie in it, and spans that
    overlap don't multiply anything.
    """
    placed = at_nodes(points, "line", functions, "start_line", "end_line", points.columns)
    of_node = placed.groupBy("file_path", "level", "node").agg(*[c.alias(name) for name, c in counts.items()])
    # by shuffle at every size: the planner takes a span's nodes for one row
    return _span_nodes(functions).join(of_node.hint("merge"), ["file_path", "level", "node"]).groupBy("ordinal").agg(*[F.sum(name).alias(name) for name in counts])


def _span_nodes(functions: DataFrame) -> DataFrame:
    return functions.select("ordinal", "file_path", F.inline(nodes(F.col("start_line"), F.col("end_line"))))


def match_functions(functions: DataFrame, lines: DataFrame, branches: DataFrame | None = None, policy: str = "pessimistic", files: DataFrame | None = None) -> DataFrame:
    """`functions` with covered, total, coverage_percent, branch_covered, branch_total, branch_coverage_percent and has_file.

    A file without any coverage follows the policy: 0 % (pessimistic), 100 % (optimistic), or its functions go (skip). A
    file that is there but has no line in the span gives 100 %. Branches that were never evaluated (null) don't count;
    without any the branch ratio is null, as it is for files without line coverage. `files`: the files that the report
    has, where it can have files without lines; else those of `lines`.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    present = (files if files is not None else lines).select("file_path").distinct().withColumn("has_file", F.lit(True))
    counted = counts_in_spans(functions, lines, {"total": F.count("line"), "covered": F.count_if(F.col("hits") > 0)})
    rows = functions.join(present, "file_path", "left").join(counted, "ordinal", "left")
    if branches is not None:
        arms = counts_in_spans(functions, branches.where("taken IS NOT NULL"), {"branch_total": F.count(F.lit(1)), "branch_covered": F.count_if(F.col("taken") > 0)})
        rows = rows.join(arms, "ordinal", "left")
    else:
        rows = rows.withColumns({"branch_total": F.lit(None).cast("long"), "branch_covered": F.lit(None).cast("long")})
    there = F.coalesce("has_file", F.lit(False))
    missing = F.lit(100.0 if policy == "optimistic" else 0.0)
    own = percent(F.coalesce("covered", F.lit(0)), F.coalesce("total", F.lit(0)), F.lit(100.0))
    arms_total = F.when(there, F.coalesce("branch_total", F.lit(0))).otherwise(F.lit(0))
    rows = rows.select(
        *functions.columns,
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.when(there, own).otherwise(missing).alias("coverage_percent"),
        F.when(arms_total > 0, F.col("branch_covered")).alias("branch_covered"),
        F.when(arms_total > 0, arms_total).alias("branch_total"),
        percent(F.coalesce("branch_covered", F.lit(0)), arms_total, F.lit(None).cast("double")).alias("branch_coverage_percent"),
        there.alias("has_file"),
    )
    return rows.where("has_file") if policy == "skip" else rows
