"""Combined report of several results: LANG=FILE documents, each with an optional baseline."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .cli import located
from .operators import delta as d
from .operators.multilang import comparable
from .sinks.html import to_html_multi
from .sinks.model import Comparison, Report
from .sources.envelope import EnvelopeError, read_envelopes


def reports_of(spark: SparkSession, inputs: Sequence[str], baselines: Sequence[str] = (), warn=lambda text: None) -> list[Report]:
    """A report for each document. A baseline of another metric is left out with a warning; the tolerance is that of the document."""
    own, then = read_envelopes(spark, inputs, baselines)
    why = comparable({k: e.metric for k, e in own.items()}, {k: e.metric for k, e in then.items()})
    fallback = max([0.0, *(e.threshold for e in own.values() if e.threshold)])
    out = []
    for language, e in own.items():
        comparison = None
        if language in then:
            if why[language]:
                warn(f"{language}: no comparison: {why[language]}")
            else:
                comparison = Comparison(d.changes_of(then[language].verdicts, e.verdicts), d.DeltaViewSpec(), e.epsilon, then[language].verdicts, then[language].tool_version)
        threshold = e.threshold if e.threshold and e.threshold > 0 else fallback
        out.append(Report(e.verdicts, f"codeperil-{language}", e.tool_version or "?", language, e.metric or "unknown", threshold, e.policy, comparison=comparison))
    return out


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser("codeperil-render")
    p.add_argument("--input", action="append", required=True, help="LANG=FILE")
    p.add_argument("--baseline", action="append", default=[], help="LANG=FILE")
    p.add_argument("--output")
    p.add_argument("--title", default="Combined report")
    args = p.parse_args(argv)
    try:
        here = lambda specs: [f"{k}={located(v)}" for k, _, v in (x.partition("=") for x in specs)]
        text = to_html_multi(reports_of(spark, here(args.input), here(args.baseline), lambda x: print(f"warning: {x}", file=sys.stderr)), args.title)
    except (EnvelopeError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if args.output:
        Path(args.output).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("codeperil-render").getOrCreate(), sys.argv[1:]))
