"""The risk score and what follows from it, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import glob_regex

#: Upper ends of the risk bands; above the last is "high".
BANDS = (("low", 8.0), ("acceptable", 15.0), ("moderate", 25.0))
RISK_LEVELS = ("low", "acceptable", "moderate", "high")
#: Thresholds of the presets.
PRESETS = {"strict": 8.0, "default": 15.0, "lenient": 25.0}
POLICIES = ("pessimistic", "optimistic", "skip")
METRICS = ("cognitive", "cyclomatic")
#: Fixed value: score differences from here on count as movement.
MOVEMENT = 0.005


def round2(x: Column) -> Column:
    """Two decimals by scaling, rounding half away from zero and scaling back."""
    return F.round(x * F.lit(100.0)) / F.lit(100.0)


def risk_score(complexity: Column, coverage: Column) -> Column:
    """c**2 * (1 - coverage)**3 + c, in two decimals; coverage in percent, clamped. Null where complexity is below 1 or coverage is not finite."""
    c = complexity.cast("double")
    u = F.lit(1.0) - F.least(F.greatest(coverage, F.lit(0.0)), F.lit(100.0)) / F.lit(100.0)
    finite = ~F.isnan(coverage) & (F.abs(coverage) != F.lit(math.inf))
    return F.when((c >= 1) & finite, round2(c * c * (u * u * u) + c))


def checked_risk_score(complexity: Column, coverage: Column) -> Column:
    """risk_score, or an error for invalid input."""
    score = risk_score(complexity, coverage)
    return F.when(score.isNull(), F.raise_error(F.concat(F.lit("invalid complexity or coverage: "), F.coalesce(complexity.cast("string"), F.lit("null")), F.lit(", "), F.coalesce(coverage.cast("string"), F.lit("null")))).cast("double")).otherwise(score)


def risk_level(score: Column) -> Column:
    out = F.when(score <= BANDS[0][1], F.lit(BANDS[0][0]))
    for name, top in BANDS[1:]:
        out = out.when(score <= top, F.lit(name))
    return out.otherwise(F.lit("high"))


def risk_rank(level: Column) -> Column:
    """1 for low to 4 for high."""
    out = F.lit(1)
    for n, name in enumerate(RISK_LEVELS[1:], 2):
        out = F.when(level == name, F.lit(n)).otherwise(out)
    return out


def percent(covered: Column, total: Column, empty: Column) -> Column:
    """covered / total * 100; `empty` where total is 0."""
    return F.when(total > 0, covered.cast("double") / total.cast("double") * F.lit(100.0)).otherwise(empty)


def threshold_of(path: Column, default: float, overrides: Sequence[tuple[str, float]] = ()) -> Column:
    """The threshold of a file: the last override whose glob fits, else the default."""
    out = F.lit(float(default))
    for pattern, value in overrides:
        out = F.when(path.rlike(glob_regex(pattern)), F.lit(float(value))).otherwise(out)
    return out


def is_valid_threshold(value: float) -> bool:
    return math.isfinite(value) and value > 0


def preset_threshold(name: str) -> float:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}: expected one of {', '.join(PRESETS)}")
    return PRESETS[name]


def safe_ratio(score: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, score / threshold).otherwise(F.lit(math.inf))


def within_band(score: Column, threshold: Column, epsilon: float) -> Column:
    return F.abs(score - threshold) < F.lit(float(epsilon))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two spans share a line; both ends belong to a span."""
    return (start <= other_end) & (other_start <= end)


def severity(level: Column) -> Column:
    """Severity of a finding: high error, moderate warning, else note."""
    return F.when(level == "high", F.lit("error")).when(level == "moderate", F.lit("warning")).otherwise(F.lit("note"))


def fingerprint(path: Column, name: Column) -> Column:
    return F.concat_ws(":", path, name)


def coverage_bucket(coverage: Column) -> Column:
    return F.when(coverage >= 80, F.lit("low")).when(coverage >= 60, F.lit("acceptable")).when(coverage >= 40, F.lit("moderate")).otherwise(F.lit("high"))


def complexity_bucket(complexity: Column) -> Column:
    return F.when(complexity <= 3, F.lit("low")).when(complexity <= 6, F.lit("acceptable")).when(complexity <= 10, F.lit("moderate")).otherwise(F.lit("high"))


def bar_width(complexity: Column) -> Column:
    return F.least(complexity * 5, F.lit(100))


def lines_of_code(start: Column, end: Column) -> Column:
    return end - start + 1


def over_by(score: Column, threshold: Column) -> Column:
    return F.greatest(score - threshold, F.lit(0.0))
