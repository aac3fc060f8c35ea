"""Command line: analyse, write reports, set the exit code (0 passed, 1 failed, 2 error)."""

from __future__ import annotations

import argparse
import subprocess
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .config import ConfigError, FileConfig, Flags, discover_config, effective, load_config, view_preset
from .operators import delta as d
from .operators.multilang import comparable
from .operators.view import ViewSpec
from .plans.analyze import Options, analyze
from .sinks import html, plain, tables
from .sinks.model import Comparison, Report
from .sources import envelope, istanbul, lcov

FORMATS = ("table", "json", "markdown", "csv", "sarif", "advice", "scorecard-row", "html", "github-annotations")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("codeperil", description="Change-risk scores of functions from complexity and coverage.")
    p.add_argument("--language", choices=("rust", "typescript"), default="rust")
    p.add_argument("--coverage")
    p.add_argument("--src", action="append", default=[])
    p.add_argument("--metric", choices=("cognitive", "cyclomatic"))
    p.add_argument("--missing-coverage-policy", choices=("pessimistic", "optimistic", "skip"))
    p.add_argument("--config")
    p.add_argument("--view")
    p.add_argument("--baseline")
    p.add_argument("--format", "-f", default="table", help="FORMAT or FORMAT:FILE, comma-separated")
    p.add_argument("--threshold", type=float)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--lenient", action="store_true")
    p.add_argument("--no-fail", action="store_true")
    p.add_argument("--delta-gate", action="store_true")
    p.add_argument("--threshold-epsilon", type=float)
    p.add_argument("--minimal-view", action="store_true")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--annotation-limit", type=int)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--diff")
    p.add_argument("--only-failing", action="store_true")
    p.add_argument("--min-coverage", type=float)
    p.add_argument("--max-coverage", type=float)
    p.add_argument("--sort-by", choices=("crap", "coverage", "complexity", "path"))
    p.add_argument("--top", type=int)
    p.add_argument("--group-by", choices=("file",))
    p.add_argument("--delta-top", type=int)
    p.add_argument("--delta-sort", choices=("score-delta", "current-crap", "baseline-crap", "path"), default="score-delta")
    p.add_argument("--delta-only")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("--breakdown", action="store_true")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--md-full-table", action="store_true")
    p.add_argument("--md-top", type=int, default=10)
    return p


def formats_of(text: str) -> list[tuple[str, str | None]]:
    out = []
    for spec in text.split(","):
        name, sep, path = spec.strip().partition(":")
        if name not in FORMATS or (sep and not path):
            raise ConfigError(f"unknown format {spec!r}")
        out.append((name, path or None))
    if sum(p is None for _, p in out) > 1:
        raise ConfigError("only one format may go to standard output")
    return out


def view_spec(args: argparse.Namespace, config: FileConfig | None) -> ViewSpec:
    """The view: a flag wins over the preset's value, switches add up."""
    preset = view_preset(config, args.view) if args.view else {}
    pick = lambda flag, name: preset.get(name) if flag is None else flag
    args.no_fail = args.no_fail or preset.get("no_fail", False)
    args.minimal_view = args.minimal_view or preset.get("minimal_view", False)
    return ViewSpec(args.only_failing or preset.get("only_failing", False), pick(args.min_coverage, "min_coverage"), pick(args.max_coverage, "max_coverage"), pick(args.sort_by, "sort") or "crap", pick(args.top, "top"), pick(args.group_by, "group_by") == "file")


def render(report: Report, name: str, args: argparse.Namespace, annotation_limit: int = 10) -> str:
    return {
        "table": lambda: tables.to_table(report, args.breakdown, args.explain),
        "json": lambda: plain.to_json(report, args.minimal_view) + "\n",
        "markdown": lambda: tables.to_markdown(report, args.breakdown, args.explain, args.md_full_table, args.md_top),
        "csv": lambda: plain.to_csv(report),
        "sarif": lambda: plain.to_sarif(report) + "\n",
        "advice": lambda: plain.to_json(report, args.minimal_view) + "\n",
        "scorecard-row": lambda: plain.to_scorecard_row(report),
        "html": lambda: html.to_html(report),
        "github-annotations": lambda: plain.to_annotations(report, annotation_limit),
    }[name]()


def located(path: str) -> str:
    """A path or URI as Spark finds it, whatever folder its process was started in."""
    return path if "://" in path else str(Path(path).resolve())


def git_top(folder: str) -> str | None:
    done = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else None


def run(spark: SparkSession, argv: Sequence[str], out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        return _run(spark, parser().parse_args(argv), out, err)
    except (ConfigError, ValueError, RuntimeError, OSError) as error:
        print(f"error: {error}", file=err)
        return 2


def _run(spark: SparkSession, args: argparse.Namespace, out, err) -> int:
    path = args.config or discover_config(".")
    config = load_config(path) if path else None
    flags = Flags(args.threshold, args.strict, args.lenient, args.metric, args.missing_coverage_policy, tuple(args.src), tuple(args.exclude), args.annotation_limit, args.threshold_epsilon)
    use = effective(flags, config, args.language, "cognitive" if args.language == "rust" else "cyclomatic")
    wanted = formats_of(args.format)
    spec = view_spec(args, config)
    if not args.coverage:
        raise ConfigError("--coverage is required")
    args.coverage, args.baseline = located(args.coverage), args.baseline and located(args.baseline)
    if args.delta_gate and not args.baseline:
        raise ConfigError("--delta-gate requires --baseline")
    for root in use.src:
        if not Path(root).is_dir():
            raise ConfigError(f"source folder {root} does not exist")
    if args.language == "rust" and not lcov.has_data(spark, args.coverage):
        raise ConfigError(f"{args.coverage}: no SF/DA records")
    if args.language != "rust" and not istanbul.has_data(spark, args.coverage):
        raise ConfigError(f"{args.coverage}: no statement coverage records")
    top = git_top(use.src[0]) if len(use.src) > 1 or args.diff else None
    if (len(use.src) > 1 or args.diff) and top is None:
        raise ConfigError("several source folders and --diff need a git work tree")
    hints = any(n in ("advice", "sarif") for n, _ in wanted)
    result = analyze(spark, Options(args.language, use.src, args.coverage, use.metric, use.threshold, use.overrides, use.policy, use.exclude, not args.no_gitignore, args.diff, top, hints))
    scored = result.verdicts.cache()
    counters = result.counters.first()
    comparison = None
    if args.baseline:
        before = envelope.read_envelope(spark, args.baseline)
        if (why := comparable({args.language: use.metric}, {args.language: before.metric})[args.language]) is not None:
            print(f"warning: {why}", file=err)
        if before.policy != use.policy:
            print(f"warning: missing-coverage policy of the baseline is {before.policy}, now it is {use.policy}", file=err)
        kinds = frozenset(args.delta_only.split(",")) if args.delta_only else None
        comparison = Comparison(d.changes_of(before.verdicts, scored), d.DeltaViewSpec(kinds, sort=args.delta_sort.replace("-", "_"), limit=args.delta_top), use.epsilon, before.verdicts, before.tool_version)
    report = Report(
        scored, "codeperil", __version__, args.language, use.metric, use.threshold, use.policy, spec, comparison, result.diagnostics, counters, result.coverage.diagnostics.collect(),
        config.title if config else None, config.subtitle if config else None, str(int(time.time())), args.diff,
    )
    if not args.quiet:
        if args.summary:
            print(plain.to_summary_line(report), file=out)
        else:
            for name, target in wanted:
                text = render(report, name, args, use.annotation_limit)
                if target:
                    Path(target).write_text(text, encoding="utf-8")
                else:
                    out.write(text)
                if name == "advice":
                    err.write(plain.to_advice(report))
    notes(report, args.verbose, err)
    passed = report.summary["passed"] and (not args.delta_gate or comparison is None or comparison.summary["passed"])
    return 0 if passed or args.no_fail else 1


def notes(report: Report, verbose: bool, err) -> None:
    """Warnings about what could not be used, and with `verbose` the counters."""
    c = report.counters
    if c["files_unparseable"]:
        print(f"warning: {c['files_unparseable']} of {c['files_found']} files could not be parsed", file=err)
    if c["files_analyzed"] and 2 * c["files_zero_coverage"] > c["files_analyzed"]:
        print(f"warning: {c['files_zero_coverage']} of {c['files_analyzed']} files have no coverage at all; do the report's paths fit the source folder?", file=err)
    if report.parse_issues:
        print(f"warning: {len(report.parse_issues)} problems in the coverage report", file=err)
    if verbose:
        for name, value in c.asDict().items():
            print(f"{name}: {value}", file=err)
        for r in report.parse_issues:
            print(", ".join(f"{k}={v}" for k, v in r.asDict().items()), file=err)


def main() -> None:
    spark = SparkSession.builder.appName("codeperil").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
