"""The whole analysis: sources, coverage, changes, matching, scores, hints and comparison as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import diagnose, match, verdicts
from ..sources import files, gitdiff, istanbul, lcov
from ..sources.lcov import Coverage
from ..sources.paths import resolved_paths


@dataclass(frozen=True)
class Options:
    """What to analyse and how."""

    language: str = "rust"
    roots: tuple[str, ...] = ("src",)
    coverage: str = "lcov.info"
    metric: str = "cognitive"
    threshold: float = 15.0
    overrides: tuple[tuple[str, float], ...] = ()
    policy: str = "pessimistic"
    exclude: tuple[str, ...] = ()
    gitignore: bool = True
    diff: str | None = None
    repository: str | None = None
    hints: bool = False


@dataclass(frozen=True)
class Analysis:
    verdicts: DataFrame
    counters: DataFrame
    diagnostics: DataFrame | None
    unparseable: DataFrame
    coverage: Coverage
    files: Sequence[tuple[str, str]] = field(default_factory=list)


def read_coverage(spark: SparkSession, options: Options, listed: Sequence[tuple[str, str]]) -> Coverage:
    """The report with the functions' paths; Rust paths that lead to no source file stay as they are behind the root."""
    discovered = spark.createDataFrame([(k,) for k, _ in listed], "file_path string")
    if options.language == "typescript":
        return istanbul.read_istanbul(spark, options.coverage, discovered)
    coverage = lcov.read_lcov(spark, options.coverage)
    paths = resolved_paths(coverage.files.select(F.col("file_path").alias("source")), discovered, [str(Path(r).resolve()) for r in options.roots]).drop("how")

    def renamed(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
        met = rows.withColumnRenamed("file_path", "source").join(paths, "source", "left").withColumn("file_path", F.coalesce("file_path", "source"))
        return met.groupBy("file_path", *keys).agg(F.sum(value).alias(value))  # two paths of one file meet

    lines = renamed(coverage.lines, "hits", ["line"])
    return Coverage(lines, renamed(coverage.branches, "taken", ["line", "block", "branch"]), lines.select("file_path").distinct(), coverage.diagnostics)


def analyze(spark: SparkSession, options: Options) -> Analysis:
    """Raises ValueError when there are no source files, or (without a diff) no functions in them."""
    listed = files.discover_roots(options.roots, files.EXTENSIONS[options.language], options.exclude, options.gitignore, options.repository)
    if not listed:
        raise ValueError(f"no source files found in {', '.join(options.roots)}")
    sources = files.read_sources(spark, listed)
    hunks = None
    if options.diff is not None:
        base = options.repository or options.roots[0]
        hunks = gitdiff.read_diff(spark, options.diff, base, [str(Path(r).resolve()) for r in options.roots])
        top = Path(base).resolve()
        mapped = [(p, k) for k, p in ((k, _relative(Path(p).resolve(), top)) for k, p in listed) if p]
        hunks = ch.remapped_changes(hunks, spark.createDataFrame(mapped, "repo_path string, file_path string"))
        sources = ch.changed_files(sources, hunks)
    extracted, unparseable = files.extract(sources, options.language, options.metric)
    if options.diff is None and extracted.isEmpty():
        raise ValueError("no functions extracted from the source files")
    kept = extracted if hunks is None else ch.changed_functions(extracted, hunks)
    coverage = read_coverage(spark, options, listed)
    matched = match.match_functions(kept, coverage.lines, coverage.branches, "pessimistic" if options.policy == "skip" else options.policy, coverage.files)
    judged = matched.where("has_file") if options.policy == "skip" else matched
    scored = verdicts.score_functions(judged, options.threshold, options.overrides)
    counters = verdicts.analysis_counters(extracted, matched, scored, len(listed), unparseable.count())
    hints = diagnose.diagnostics(scored, coverage.lines) if options.hints else None
    return Analysis(scored, counters, hints, unparseable, coverage, listed)


def _relative(path: Path, top: Path) -> str | None:
    return path.relative_to(top).as_posix() if path.is_relative_to(top) else None
