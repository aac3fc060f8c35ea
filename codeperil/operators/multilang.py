"""Results of several languages side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import MOVEMENT, risk_rank, safe_ratio
from .delta import described
from .summary import first_of_largest


def union_languages(blocks: dict[str, DataFrame]) -> DataFrame:
    """One table of verdicts with language and block, the number of its block."""
    parts = [rows.withColumns({"language": F.lit(name), "block": F.lit(n)}) for n, (name, rows) in enumerate(blocks.items())]
    return reduce(DataFrame.unionByName, parts)


def ranking_keys() -> list[Column]:
    return [F.col("risk_rank").desc(), F.isnan("ratio").asc(), F.col("ratio").desc(), F.col("qualified_name").asc(), F.col("file_path").asc(), F.col("block").asc(), F.col("ordinal").asc()]


def ranked_functions(verdicts: DataFrame, only_exceeding: bool = False) -> DataFrame:
    """Functions of all languages with risk_rank and ratio (score to threshold), the riskiest first."""
    rows = verdicts.where("exceeds") if only_exceeding else verdicts
    return rows.withColumns({"risk_rank": risk_rank(F.col("risk_level")), "ratio": safe_ratio(F.col("crap"), F.col("threshold"))}).orderBy(*ranking_keys())


def combined_summary(verdicts: DataFrame) -> DataFrame:
    """One row over all languages: counts, passed, and the function with the largest ratio (the first of equals; of NaN see first_of_largest)."""
    rows = verdicts.withColumn("ratio", safe_ratio(F.col("crap"), F.col("threshold")))
    worst = first_of_largest(F.col("ratio"), [F.col("block"), F.col("ordinal")], language=F.col("language"), qualified_name=F.col("qualified_name"))
    out = rows.agg(
        F.count_distinct("language").alias("languages"),
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if("exceeds").alias("exceeding"),
        *[F.count_if(F.col("risk_level") == level).alias(f"{level}_count") for level in ("low", "acceptable", "moderate", "high")],
        F.coalesce(F.bool_and(~F.col("exceeds")), F.lit(True)).alias("passed"),
        worst.alias("worst"),
    )
    return out.withColumns({"worst_ratio": F.col("worst.value"), "worst_language": F.col("worst.language"), "worst_function": F.col("worst.qualified_name")}).drop("worst")


def combined_delta_rows(changes: DataFrame) -> DataFrame:
    """Of changes with language and block: regressions of paired functions, and all added ones, ranked like functions by their current side."""
    rows = described(changes).where((F.col("kind") == "added") | (F.col("score_delta") >= MOVEMENT))
    rows = rows.withColumns({"risk_rank": risk_rank(F.col("current.risk_level")), "ratio": safe_ratio(F.col("current.crap"), F.col("current.threshold")), "ordinal": F.col("current.ordinal")})
    return rows.orderBy(*ranking_keys())


def combined_delta_summary(summaries: DataFrame) -> DataFrame:
    """One row from delta summaries: sums of counts, active if any is, passed if all did."""
    counts = ("added", "removed", "modified", "renamed", "regressions", "improvements", "new_violations", "jitter_suppressed")
    return summaries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.bool_or("jitter_active"), F.lit(False)).alias("jitter_active"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def comparable(inputs: dict[str, str | None], baselines: dict[str, str | None]) -> dict[str, str | None]:
    """For each language with a baseline why it can't be compared (None: it can), from the metrics of both sides."""
    out: dict[str, str | None] = {}
    for language, metric in baselines.items():
        if language not in inputs:
            raise ValueError(f"baseline for {language!r} without an input")
        own = inputs[language]
        out[language] = None if metric is None or own is None or metric == own else f"metric of the baseline is {metric}, of the input {own}"
    return out
