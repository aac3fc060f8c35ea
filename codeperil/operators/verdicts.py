"""Scores, verdicts and the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score


def score_functions(matched: DataFrame, threshold: float = score.PRESETS["default"], overrides: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """`matched` with crap, risk_level, threshold and exceeds."""
    for value in (threshold, *(v for _, v in overrides)):
        if not score.is_valid_threshold(value):
            raise ValueError(f"threshold must be a positive number, not {value}")
    rows = matched.withColumn("crap", score.checked_risk_score(F.col("complexity"), F.col("coverage_percent")))
    rows = rows.withColumns({"risk_level": score.risk_level(F.col("crap")), "threshold": score.threshold_of(F.col("file_path"), threshold, overrides)})
    return rows.withColumn("exceeds", F.col("crap") > F.col("threshold"))


def gate(verdicts: DataFrame) -> DataFrame:
    """One row: passed, true unless a function exceeds its threshold."""
    return verdicts.agg(F.coalesce(F.bool_and(~F.col("exceeds")), F.lit(True)).alias("passed"))


def file_coverage_stats(verdicts: DataFrame) -> DataFrame:
    """One row: files, and files in which no function has coverage above 0."""
    files = verdicts.groupBy("file_path").agg(F.bool_or(F.col("coverage_percent") > 0).alias("some"))
    return files.agg(F.count(F.lit(1)).alias("files_analyzed"), F.count_if(~F.col("some")).alias("files_zero_coverage"))


def analysis_counters(extracted: DataFrame, matched: DataFrame, verdicts: DataFrame, files_found: int | None = None, files_unparseable: int = 0) -> DataFrame:
    """One row of counters. extracted: functions before changes are looked at; matched: those after, with has_file, under
    any policy but skip; verdicts: those with a verdict."""
    before = extracted.agg(F.count(F.lit(1)).alias("functions_extracted"), F.count_distinct("file_path").alias("files_with_functions"))
    after = matched.agg(F.count_if("has_file").alias("functions_matched"), F.count_if(~F.col("has_file")).alias("functions_no_coverage"))
    out = before.join(after, how="cross").join(file_coverage_stats(verdicts), how="cross")  # one row each
    return out.select(F.coalesce(F.lit(files_found), F.col("files_with_functions")).cast("long").alias("files_found"), F.lit(files_unparseable).cast("long").alias("files_unparseable"), "functions_extracted", "functions_matched", "functions_no_coverage", "files_analyzed", "files_zero_coverage")


def mostly_uncovered(files_zero: int, files_analyzed: int) -> bool:
    """Whether more than half of the files have no coverage at all."""
    return files_analyzed > 0 and 2 * files_zero > files_analyzed
