"""Comparison of a baseline and a current result.

Functions pair by file and name. Left over ones pair in two tiers: by name and structure, then by structure alone, each
only where the key is unique among what is left on both sides. Structure is the complexity, the metric and the
contributors' kinds, increments and depths in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import MOVEMENT, within_band
from .view import nan_last

KINDS = ("added", "removed", "modified", "renamed")
DELTA_SORTS = ("score_delta", "current_crap", "baseline_crap", "path")
#: The columns of a side.
SIDE = ("ordinal", "file_path", "qualified_name", "start_line", "end_line", "complexity", "metric", "contributors", "coverage_percent", "crap", "risk_level", "threshold", "exceeds")


def structure(rows: DataFrame) -> Column:
    """A function's structure as text: equal texts, equal structures."""
    marks = F.transform(F.coalesce("contributors", F.array().cast(rows.schema["contributors"].dataType)), lambda c: F.concat_ws(":", c["kind"], c["increment"].cast("string"), c["nesting_depth"].cast("string")))
    return F.concat_ws("|", F.col("complexity").cast("string"), "metric", F.array_join(marks, ","))


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    own = rows.select(*[c for c in SIDE if c in rows.columns])
    for c in SIDE:
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("string" if c in ("metric", "risk_level") else "double"))
    return own.select(F.struct(*SIDE).alias(prefix), F.col("file_path").alias("f"), F.col("qualified_name").alias("q"), structure(rows).alias("s"), F.col("complexity").alias("c"), F.col("ordinal").alias("o"))


def changes_of(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row per change: kind, baseline, current (structs, null where a side is missing) and tier (identity, a, b or null).

    Of repeated identities in the baseline the last counts and the others vanish; of repeated ones in the current result
    the first pairs, the others are candidates for relocation or additions. Unchanged functions are modified with
    difference 0.
    """
    if "contributors" not in baseline.columns:
        baseline = baseline.withColumn("contributors", F.lit(None).cast("array<struct<kind:string,increment:bigint,nesting_depth:bigint>>"))
    if "contributors" not in current.columns:
        current = current.withColumn("contributors", F.lit(None).cast("array<struct<kind:string,increment:bigint,nesting_depth:bigint>>"))
    same = Window.partitionBy("f", "q")
    old = _side(baseline, "baseline").withColumn("k", F.row_number().over(same.orderBy(F.desc("o")))).where("k = 1").drop("k")
    new = _side(current, "current").withColumn("k", F.row_number().over(same.orderBy("o")))
    first, rest = new.where("k = 1").drop("k"), new.where("k > 1").drop("k")
    olds = old.select("f", "q", "baseline", F.col("s").alias("bs"), F.col("c").alias("bc"), F.col("o").alias("bo"))
    both = first.join(olds, ["f", "q"], "full_outer").persist()  # read by every tier; recomputed where an executor is lost
    paired = both.where("baseline IS NOT NULL AND current IS NOT NULL").select(F.lit("modified").alias("kind"), F.lit("identity").alias("tier"), "baseline", "current")
    left_old = both.where("current IS NULL").select("f", "q", F.col("bs").alias("s"), F.col("bc").alias("c"), F.col("bo").alias("o"), "baseline")
    left_new = both.where("baseline IS NULL").select("f", "q", "s", "c", "o", "current").unionByName(rest.select("f", "q", "s", "c", "o", "current"))
    tier_a = _unique_pairs(left_old, left_new, ["q", "s"], "a")
    left_old, left_new = (x.persist() for x in _without(left_old, left_new, tier_a))
    tier_b = _unique_pairs(left_old.where("c > 1"), left_new.where("c > 1"), ["s"], "b")
    left_old, left_new = _without(left_old, left_new, tier_b)
    moved = tier_a.unionByName(tier_b)
    removed = left_old.select(F.lit("removed").alias("kind"), F.lit(None).cast("string").alias("tier"), "baseline", F.lit(None).cast(current_type(paired)).alias("current"))
    added = left_new.select(F.lit("added").alias("kind"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast(baseline_type(paired)).alias("baseline"), "current")
    return paired.unionByName(added).unionByName(moved).unionByName(removed)


def current_type(rows: DataFrame):
    return rows.schema["current"].dataType


def baseline_type(rows: DataFrame):
    return rows.schema["baseline"].dataType


def _unique_pairs(old: DataFrame, new: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Pairs of the keys that each side has once. Counted by aggregation, so a key that many rows share is pre-aggregated."""
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("baseline").alias("baseline")).where("n = 1").drop("n")
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("current").alias("current")).where("n = 1").drop("n")
    return a.join(b, keys).select(F.lit("renamed").alias("kind"), F.lit(tier).alias("tier"), "baseline", "current")


def _without(old: DataFrame, new: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return old.join(pairs.select(F.col("baseline.ordinal").alias("o")), "o", "left_anti"), new.join(pairs.select(F.col("current.ordinal").alias("o")), "o", "left_anti")


def described(changes: DataFrame) -> DataFrame:
    """Changes with file_path, qualified_name, baseline_crap, current_crap, score_delta and signed_impact."""
    moved = F.col("kind").isin("modified", "renamed")
    delta = F.when(moved, F.col("current.crap") - F.col("baseline.crap"))
    return changes.withColumns(
        {
            "file_path": F.coalesce("current.file_path", "baseline.file_path"),
            "qualified_name": F.coalesce("current.qualified_name", "baseline.qualified_name"),
            "baseline_crap": F.col("baseline.crap"),
            "current_crap": F.col("current.crap"),
            "score_delta": delta,
            "signed_impact": F.when(F.col("kind") == "added", F.col("current.crap")).when(F.col("kind") == "removed", -F.col("baseline.crap")).otherwise(delta),
        }
    )


def new_violation(epsilon: float) -> Column:
    """Whether a change brings a function over its threshold: for an added one beyond the band of epsilon, for a paired one unless both sides lie in the band."""
    now = within_band(F.col("current.crap"), F.col("current.threshold"), epsilon)
    then = within_band(F.col("baseline.crap"), F.col("baseline.threshold"), epsilon)
    added = F.col("current.exceeds") & ~now
    paired = ~F.col("baseline.exceeds") & F.col("current.exceeds") & ~(now & then)
    return F.when(F.col("kind") == "added", added).when(F.col("kind") == "removed", F.lit(False)).otherwise(paired)


def delta_summary(changes: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """One row of counts; passed: no new violation beyond epsilon. The movement cut-off is 0.005 on the difference as it is."""
    if not (math.isfinite(epsilon) and epsilon >= 0):
        raise ValueError("epsilon must be a finite number of 0 or more")
    rows = described(changes).withColumns({"violation": new_violation(epsilon), "strict": new_violation(0.0)})
    counts = rows.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.count_if(F.col("score_delta") >= MOVEMENT).alias("regressions"),
        F.count_if(F.col("score_delta") <= -MOVEMENT).alias("improvements"),
        F.count_if("violation").alias("new_violations"),
        (F.count_if("strict") - F.count_if("violation")).alias("jitter_suppressed"),
    )
    return counts.withColumns({"jitter_active": F.lit(epsilon > 0), "passed": F.col("new_violations") == 0})


@dataclass(frozen=True)
class DeltaViewSpec:
    """kinds (None: all); bounds of the score difference, which added and removed functions always pass; sort; limit."""

    kinds: frozenset[str] | None = None
    min_delta: float | None = None
    max_delta: float | None = None
    sort: str = "score_delta"
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.sort not in DELTA_SORTS:
            raise ValueError(f"unknown sort key {self.sort!r}")
        if self.kinds is not None and not self.kinds <= set(KINDS):
            raise ValueError("unknown kinds of change")


def delta_sort_keys(sort: str) -> list[Column]:
    impact = [F.coalesce(F.isnan("signed_impact"), F.lit(False)).asc(), F.col("signed_impact").desc()]
    missing_last = lambda c: [F.col(c).isNull().asc(), *nan_last(F.col(c), True)]
    keys = {"score_delta": impact, "current_crap": missing_last("current_crap"), "baseline_crap": missing_last("baseline_crap"), "path": [F.col("file_path").asc(), F.col("qualified_name").asc()]}
    return [*keys[sort], *input_order()]


def input_order() -> list[Column]:
    """Modified and added in the current order, renamed by current identity, removed by baseline identity."""
    turn = F.when(F.col("kind") == "modified", 0).when(F.col("kind") == "added", 1).when(F.col("kind") == "renamed", 2).otherwise(3)
    place = F.when(F.col("kind").isin("modified", "added"), F.col("current.ordinal")).otherwise(F.lit(0))
    return [turn.asc(), place.asc(), F.col("file_path").asc(), F.col("qualified_name").asc(), F.coalesce("current.ordinal", "baseline.ordinal").asc()]


def delta_view(changes: DataFrame, spec: DeltaViewSpec = DeltaViewSpec()) -> DataFrame:
    """The described changes to show, in order."""
    rows = described(changes)
    if spec.kinds is not None:
        rows = rows.where(F.col("kind").isin(*sorted(spec.kinds)))
    if spec.min_delta is not None or spec.max_delta is not None:
        d = F.col("score_delta")
        inside = ~F.isnan(d) & (F.abs(d) != math.inf)
        if spec.min_delta is not None:
            inside = inside & (d >= spec.min_delta)
        if spec.max_delta is not None:
            inside = inside & (d <= spec.max_delta)
        rows = rows.where(F.col("kind").isin("added", "removed") | inside)
    rows = rows.orderBy(*delta_sort_keys(spec.sort))
    return rows.limit(spec.limit) if spec.limit else rows


def unchanged_count(changes: DataFrame) -> DataFrame:
    """One row: modified functions that did not move."""
    return described(changes).where("kind = 'modified'").agg(F.count_if(F.abs("score_delta") < MOVEMENT).alias("unchanged"))


def delta_rows(changes: DataFrame) -> DataFrame:
    """Described changes with their section of a report: regressions, improvements or new; the others go."""
    section = (
        F.when(F.col("kind") == "added", F.lit("new"))
        .when(F.col("score_delta") >= MOVEMENT, F.lit("regressions"))
        .when(F.col("score_delta") <= -MOVEMENT, F.lit("improvements"))
    )
    return described(changes).withColumn("section", section).where("section IS NOT NULL")


def kpi_rows(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Before and after of four figures, from two global summaries: name, before, after, change, is_regression."""
    before, after = baseline.select(F.struct("*").alias("b")), current.select(F.struct("*").alias("a"))
    both = before.join(after, how="cross")  # one row each

    def row(name: str, column: str, worse) -> Column:
        b, a = F.coalesce(F.col(f"b.{column}"), F.lit(0)).cast("double"), F.coalesce(F.col(f"a.{column}"), F.lit(0)).cast("double")
        return F.struct(F.lit(name).alias("name"), b.alias("before"), a.alias("after"), (a - b).alias("change"), worse(a - b).alias("is_regression"))

    rows = F.array(
        row("exceeding", "exceeding", lambda d: d > 0),
        row("max_crap", "max_crap", lambda d: d >= MOVEMENT),
        row("avg_crap", "mean_crap", lambda d: d >= MOVEMENT),
        row("avg_coverage", "mean_coverage", lambda d: d <= -0.05),
    )
    return both.select(F.explode(rows).alias("r")).select("r.*")
