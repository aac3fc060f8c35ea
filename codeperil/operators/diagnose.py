"""Remediation hints for functions over their threshold.

Coverage gaps are runs of uncovered lines (a window over each function's uncovered lines). Splits and actions look at one
function's contributors only, a few dozen, and are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import in_spans

SPLIT = "struct<start: bigint, end: bigint, complexity_contribution: bigint, branch_path: string, kind: string, recommended: boolean>"


def coverage_gaps(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """ordinal, start, end: runs of consecutive uncovered lines in a function's span."""
    open_ = in_spans(functions, lines.where("hits = 0")).select("ordinal", "line").distinct()
    island = F.col("line") - F.row_number().over(Window.partitionBy("ordinal").orderBy("line"))
    return open_.withColumn("island", island).groupBy("ordinal", "island").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")


def dominant_kinds(functions: DataFrame) -> DataFrame:
    """ordinal and kind of functions of whose contributors more than 70 % are of one kind."""
    kinds = functions.select("ordinal", F.explode("contributors.kind").alias("kind")).groupBy("ordinal", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = functions.select("ordinal", F.size("contributors").alias("total")).where("total > 0")
    return kinds.join(totals, "ordinal").where("n * 100 > total * 70").select("ordinal", "kind", "n", F.col("total").cast("long").alias("total"))


def _end(c: Column) -> Column:
    return F.greatest(c["end_line"], c["line"])


def _contribution(all_: Column, start: Column, end: Column) -> Column:
    inside = F.filter(all_, lambda c: c["line"].between(start, end))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda acc, c: acc + c["increment"])


def _inner(all_: Column, outer: Column) -> Column:
    own = lambda c: (c["line"] == outer["line"]) & (c["kind"] == outer["kind"]) & c["column"].eqNullSafe(outer["column"])
    return F.size(F.filter(all_, lambda c: ~own(c) & c["line"].between(outer["line"], _end(outer))))


def _path(all_: Column, start: Column) -> Column:
    around = F.filter(F.transform(all_, lambda c, i: F.struct(c["nesting_depth"].alias("d"), c["line"].alias("l"), i.alias("i"), c["kind"].alias("k"), _end(c).alias("e"))), lambda c: (c["l"] < start) & (start <= c["e"]))
    return F.array_join(F.transform(F.array_sort(around), lambda c: c["k"]), "/")


def _picked(all_: Column, eligible, key, kind: str, start: Column, end: Column, needs_inner: bool = False) -> Column:
    """An array of the one split that a rule picks, or none: the largest key, then the smallest line, then the last."""
    ranked = F.transform(all_, lambda c, i: F.struct(key(c).cast("long").alias("key"), (-c["line"]).alias("line"), i.alias("i"), c.alias("c"), eligible(c).alias("ok")))
    best = F.array_max(F.transform(F.filter(ranked, lambda r: r["ok"]), lambda r: F.struct(r["key"], r["line"], r["i"])))
    pick = F.get(all_, best["i"])
    a, b = pick["line"], _end(pick)
    share = _contribution(all_, a, b)
    viable = best.isNotNull() & (a < b) & (a >= start) & (b <= end) & ~((a == start) & (b == end)) & (share >= 1)
    if needs_inner:
        viable = viable & (best["key"] > 0)
    split = F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), share.alias("complexity_contribution"), _path(all_, a).alias("branch_path"), F.lit(kind).alias("kind"), F.lit(False).alias("recommended"))
    return F.when(viable, F.array(split.cast(SPLIT))).otherwise(F.array().cast(f"array<{SPLIT}>"))


def picks(contributors: Column, start: Column, end: Column) -> Column:
    """What the three rules pick, in order: deepest nesting, most branches, largest block."""
    compound = lambda c: _end(c) > c["line"]
    return F.concat(
        _picked(contributors, lambda c: compound(c) & (c["nesting_depth"] > 0), lambda c: c["nesting_depth"], "deepest_nesting", start, end),
        _picked(contributors, compound, lambda c: _inner(contributors, c), "highest_branch_count", start, end, True),
        _picked(contributors, compound, lambda c: _end(c) - c["line"], "largest_subblock", start, end),
    )


def distinct_splits(found: Column) -> Column:
    """Candidates for extraction from picks: of one range the first counts; the first candidate is recommended."""
    first = F.filter(found, lambda s, i: ~F.exists(F.slice(found, 1, i), lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"])))
    return F.transform(first, lambda s, i: F.struct(s["start"], s["end"], s["complexity_contribution"], s["branch_path"], s["kind"], (i == 0).alias("recommended")).cast(SPLIT))


def diagnostics(verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """ordinal, coverage_gaps, splits, dominant, actions (their kinds in order) and root_cause of every function over its threshold."""
    over = verdicts.where("exceeds")
    gaps = coverage_gaps(over, lines).groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("coverage_gaps"))  # at most a span's lines
    rows = over.select("ordinal", "start_line", "end_line", "contributors").withColumn("contributors", F.coalesce("contributors", F.array().cast(verdicts.schema["contributors"].dataType)))
    dominant = dominant_kinds(rows).select("ordinal", F.col("kind").alias("dominant"))
    rows = rows.withColumn("picks", picks(F.col("contributors"), F.col("start_line"), F.col("end_line")))
    rows = rows.withColumn("splits", distinct_splits(F.col("picks"))).drop("picks")
    rows = rows.join(gaps, "ordinal", "left").join(dominant, "ordinal", "left")
    rows = rows.withColumn("coverage_gaps", F.coalesce("coverage_gaps", F.array().cast("array<struct<start: bigint, end: bigint>>")))
    has_gaps, has_splits = F.size("coverage_gaps") > 0, F.size("splits") > 0
    complexity = has_splits | F.col("dominant").isNotNull()
    actions = F.filter(
        F.array(
            F.when(has_gaps, F.lit("add_tests_for_lines")),
            F.when(has_splits, F.lit("extract_function")).when(F.col("dominant").isNotNull(), F.lit("simplify_branching")),
            F.when(~has_gaps & ~complexity, F.lit("accept_inherent_complexity")),
        ),
        lambda x: x.isNotNull(),
    )
    cause = F.when(has_gaps & complexity, F.lit("both")).when(has_gaps, F.lit("low_coverage")).otherwise(F.lit("high_complexity"))
    return rows.select("ordinal", "coverage_gaps", "splits", F.when(~has_splits, F.col("dominant")).alias("dominant"), actions.alias("actions"), cause.alias("root_cause"))
