"""Summaries: over everything, by file, and the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import RISK_LEVELS
from ..staging import staged
from . import order


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def first_of_largest(value: Column, place: list[Column], **columns: Column) -> Column:
    """An aggregate: struct of value and `columns` of the row that stays if rows, in the order of `place`, give way only to a larger value: the first of the largest.

    NaN is larger than nothing and nothing is larger than NaN: it stays if it comes first and is passed over later. Null
    values are left out; without any other the struct is null.
    """
    kept = F.struct(value.alias("value"), *[c.alias(name) for name, c in columns.items()])
    first = F.min(F.when(value.isNotNull(), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(place)], kept.alias("kept"))))["kept"]
    largest = F.max(F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("v"), *[(-p).alias(f"p{i}") for i, p in enumerate(place)], kept.alias("kept"))))["kept"]
    return F.when(F.isnan(first["value"]), first).otherwise(largest)


def _distribution() -> list[Column]:
    return [F.count_if(F.col("risk_level") == level).alias(f"{level}_count") for level in RISK_LEVELS]


def global_summary(verdicts: DataFrame) -> DataFrame:
    """One row. Without functions all numbers are 0, max_crap and the worst function are null, and the gate passes.

    Of functions with the same largest score the first is the worst. Means of scores take all functions, coverage only
    finite values. Medians are exact, by counts of value ranges.
    """
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    verdicts = staged(verdicts.select("ordinal", "file_path", "qualified_name", "crap", "complexity", "coverage_percent", "risk_level", "exceeds"), "verdicts")
    cov = F.when(finite(F.col("coverage_percent")), F.col("coverage_percent"))
    worst = first_of_largest(F.col("crap"), [F.col("ordinal")], file_path=F.col("file_path"), qualified_name=F.col("qualified_name"))
    out = verdicts.agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if("exceeds").alias("exceeding"),
        zero(F.avg("crap")).alias("mean_crap"),
        worst.alias("worst"),
        *_distribution(),
        F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"),
        zero(F.avg("complexity")).alias("mean_complexity"),
        zero(F.min(cov)).alias("min_coverage"),
        zero(F.avg(cov)).alias("mean_coverage"),
        F.count_distinct("file_path").alias("files"),
        F.coalesce(F.bool_and(~F.col("exceeds")), F.lit(True)).alias("passed"),
    )
    measures = {"crap": F.col("crap"), "complexity": F.col("complexity").cast("double"), "coverage": cov}
    values = verdicts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), x.alias("value")) for name, x in measures.items()])))
    middle = order.medians(values, ["measure"], "value")
    middle = middle.agg(*[zero(F.max(F.when(F.col("measure") == name, F.col("median")))).alias(f"median_{name}") for name in measures])
    out = out.join(middle, how="cross")  # one row each
    return out.withColumns({"max_crap": F.col("worst.value"), "worst_file": F.col("worst.file_path"), "worst_function": F.col("worst.qualified_name")}).drop("worst")


def file_summaries(verdicts: DataFrame) -> DataFrame:
    """A row for each file; first: the ordinal of its first function, the order in which files are listed.

    The median takes finite scores only, the mean all of them; coverage finite values only. A file with a third of all
    functions is pre-aggregated, and for the median dealt by ranges of scores.
    """
    verdicts = staged(verdicts.select("ordinal", "file_path", "crap", "complexity", "coverage_percent", "risk_level", "exceeds"), "verdicts")
    cov = F.when(finite(F.col("coverage_percent")), F.col("coverage_percent"))
    score = F.when(finite(F.col("crap")), F.col("crap"))
    middle = order.medians(verdicts.select("file_path", score.alias("score")), ["file_path"], "score").select(F.col("file_path").alias("f"), F.col("median").alias("m"))
    out = verdicts.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("functions"),
        F.count_if("exceeds").alias("exceeding"),
        F.avg("crap").alias("avg_crap"),
        F.max("crap").alias("max_crap"),
        F.max("complexity").alias("max_complexity"),
        F.coalesce(F.avg(cov), F.lit(0.0)).alias("avg_coverage"),
        *_distribution(),
        F.min("ordinal").alias("first"),
    )
    out = out.join(middle, F.col("file_path").eqNullSafe(F.col("f")), "left").withColumn("median_crap", F.coalesce("m", F.lit(0.0)))
    return out.drop("f", "m")


def scorecard(current: DataFrame, delta_summary: DataFrame | None = None, baseline: DataFrame | None = None, threshold: int = 15) -> DataFrame:
    """One row: status, threshold, delta_count, delta_text, from the summary of the current result and, with a baseline, its summary and the delta's.

    New violations are red, regressions without any yellow, else green. Without a baseline any function over the
    threshold is red.
    """
    now = current.select(F.col("exceeding").alias("now"))
    if delta_summary is None or baseline is None:
        return now.select(
            F.when(F.col("now") > 0, F.lit("Red")).otherwise(F.lit("Green")).alias("status"),
            F.lit(threshold).cast("long").alias("threshold"),
            F.col("now").cast("long").alias("delta_count"),
            F.concat(F.col("now").cast("string"), F.lit(" over threshold (no baseline)")).alias("delta_text"),
        )
    rows = now.join(baseline.select(F.col("exceeding").alias("then")), how="cross").join(delta_summary.select("new_violations", "regressions"), how="cross")  # one row each
    change = (F.col("now") - F.col("then")).cast("long")
    signed = F.concat(F.when(change < 0, F.lit("")).otherwise(F.lit("+")), change.cast("string"))
    red, yellow = F.col("new_violations") > 0, F.col("regressions") > 0
    shift = F.concat(F.col("then").cast("string"), F.lit(" → "), F.col("now").cast("string"))
    bracket = F.concat(F.lit(" ("), signed, F.lit(")"))
    note = F.when(red, bracket).when(yellow, F.lit(" (regressions on existing functions)")).when(change == 0, F.lit("")).otherwise(bracket)
    return rows.select(
        F.when(red, F.lit("Red")).when(yellow, F.lit("Yellow")).otherwise(F.lit("Green")).alias("status"),
        F.lit(threshold).cast("long").alias("threshold"),
        change.alias("delta_count"),
        F.concat(shift, note).alias("delta_text"),
    )
