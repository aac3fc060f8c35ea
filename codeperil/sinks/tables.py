"""The terminal table and the Markdown report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row

from .model import Comparison, Report, number

LEGEND = "_Legend: +1 = base structural increment. +N (nested) = +1 base plus +(N-1) from active nesting depth (if/else, match arms, while/for/loop, let-else diverging branches, closures)._"


def boxed(header: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    """Lines of a table with borders."""
    widths = [max(len(x) for x in column) + 2 for column in zip(header, *rows, strict=True)]
    line = lambda cells: "|" + "|".join(f" {c}".ljust(w) for c, w in zip(cells, widths, strict=True)) + "|"
    outer = "+" + "+".join("-" * w for w in widths) + "+"
    inner = "|" + "+".join("-" * w for w in widths) + "|"
    out = [outer, line(header), "+" + "=" * (sum(widths) + len(widths) - 1) + "+"]
    for n, row in enumerate(rows):
        if n:
            out.append(inner)
        out.append(line(row))
    return [*out, outer]


def threshold_text(report: Report) -> str:
    return f"varied (default: {number(report.threshold)})" if report.varied_thresholds else number(report.threshold)


def header_lines(report: Report) -> list[str]:
    return [*(x for x in (report.title, report.subtitle) if x), f"{report.tool_name} v{report.tool_version} — CRAP Score Analysis"]


def summary_lines(report: Report) -> list[str]:
    s = report.summary
    worst = "N/A" if s["max_crap"] is None else f"{s['max_crap']:.1f}"
    counts = " | ".join(f"{x}: {s[f'{x}_count']}" for x in ("low", "acceptable", "moderate", "high"))
    return ["", f"Summary: {s['total_functions']} functions | {s['exceeding']} above threshold ({threshold_text(report)}) | worst: {worst} | {'PASS' if s['passed'] else 'FAIL'}", f"         avg: {s['mean_crap']:.1f} | median: {s['median_crap']:.1f} | {counts}"]


def view_line(report: Report) -> list[str]:
    """What the view leaves out, if anything."""
    counts, total, spec = report.view_counts, report.summary["total_functions"], report.spec
    if not (counts["eligible_count"] < total or counts["truncated"] or counts["grouped_truncated"]):
        return []
    parts = []
    if spec.bounds is not None:
        bound = lambda x: f"{x:.0f}" if x == int(x) else f"{x:.1f}"
        parts.append(f"coverage {bound(spec.bounds[0])}–{bound(spec.bounds[1])}%")
    if spec.only_failing:
        parts.append("failing only")
    if counts["truncated"]:
        parts.append(f"top {spec.limit}")
    if counts["grouped_truncated"]:
        parts.append(f"top {spec.limit} files")
    return [f"View: showing {counts['shown_count']} of {total} functions" + (f" ({', '.join(parts)})" if parts else "")]


def contributors_of(r: Row) -> list[Row]:
    return list(r["contributors"] or ()) if r["exceeds"] and "contributors" in r else []


def needs_legend(rows: Sequence[Row]) -> bool:
    return any(c["increment"] > 1 for r in rows for c in contributors_of(r))


def optional(x: float | None) -> str:
    return "—" if x is None else f"{x:.2f}"


def delta_lines(c: Comparison) -> list[str]:
    s = c.summary
    out = ["", "Delta vs baseline:", f"  +{s['added']} added, {s['removed']} removed, {s['modified']} modified, {s['renamed']} renamed · {s['regressions']} regressions, {s['improvements']} improvements, {s['new_violations']} new violations"]
    if s["jitter_active"] or s["jitter_suppressed"]:
        out.append(f"  {s['jitter_suppressed']} border-jitter suppressed (threshold crossings within ±epsilon)")
    if not c.shown:
        return [*out, "  (no changes to display)"]
    rows = []
    for x in c.shown:
        moved = "—" if x["score_delta"] is None else f"{'+' if x['score_delta'] > 0 else ''}{x['score_delta']:.2f}"
        rows.append([x["kind"], x["file_path"], x["qualified_name"], optional(x["baseline_crap"]), optional(x["current_crap"]), moved])
    out += ["", *boxed(["Kind", "File", "Function", "Baseline", "Current", "Δ"], rows)]
    if c.truncated:
        out.append(f"  (showing {len(c.shown)} of {c.eligible} changes — use --delta-top 0 to disable)")
    return out


def to_table(report: Report, breakdown: bool = False, explain: bool = False) -> str:
    out = [*header_lines(report), ""]
    if report.summary["total_functions"] == 0:
        out.append("No functions analyzed")
    elif report.grouped is not None:
        rows = [[f["file_path"], str(f["functions"]), str(f["exceeding"]), f"{f['avg_crap']:.2f}", f"{f['max_crap']:.2f}", f["worst_function"]] for f in report.grouped]
        out += [*boxed(["File", "Functions", "Failing", "Avg CRAP", "Worst CRAP", "Worst Fn"], rows), *summary_lines(report), *view_line(report)]
    else:
        with_branches = any(r["branch_coverage_percent"] is not None for r in report.shown)
        header = ["File", "Function", "CC", "Cov%", *["Branch%"] * with_branches, "CRAP", "Risk"]
        rows = []
        for r in report.shown:
            branch = "—" if r["branch_coverage_percent"] is None else f"{r['branch_coverage_percent']:.1f}"
            rows.append([r["file_path"], r["qualified_name"], str(r["complexity"]), f"{r['coverage_percent']:.1f}", *[branch] * with_branches, f"{r['crap']:.2f}", r["risk_level"]])
        lines = boxed(header, rows)
        if breakdown:
            lines = [x for n, line in enumerate(lines) for x in (line, *(breakdown_lines(report.shown[(n - 3) // 2]) if n >= 3 and n % 2 and (n - 3) // 2 < len(rows) else ()))]
        out += lines
        if breakdown and explain and needs_legend(report.shown):
            out += ["", "Legend: +1 = base structural increment.", "        +N (nested) = +1 base plus +(N-1) from active nesting depth.", "        Nesting depth increases inside if/else branches, match arms, while/for/loop bodies, let-else diverging branches, and closures."]
        out += [*summary_lines(report), *view_line(report)]
    if report.comparison is not None:
        out += delta_lines(report.comparison)
    return "\n".join(out) + "\n"


def breakdown_lines(r: Row) -> list[str]:
    return [f"|   L{c['line']} {c['kind']} +{c['increment']}{' (nested)' if c['increment'] > 1 else ''}" for c in contributors_of(r)]


def cell(text: str) -> str:
    """Text inside a Markdown table."""
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("\r", " ")


def code(text: str) -> str:
    return text.replace("\n", " ").replace("\r", " ").replace("`", "'")


def _function_table(rows: Sequence[Row]) -> list[str]:
    out = ["| File | Function | CC | Cov% | CRAP | Risk |", "|------|----------|----|------|------|------|"]
    return out + [f"| {cell(r['file_path'])} | {cell(r['qualified_name'])} | {r['complexity']} | {r['coverage_percent']:.1f} | {r['crap']:.2f} | {r['risk_level']} |" for r in rows]


def _breakdowns(rows: Sequence[Row]) -> list[str]:
    out = []
    for r in rows:
        if own := contributors_of(r):
            out += [f"`{code(r['qualified_name'])}` — `{code(r['file_path'])}`", "", *(f"  - L{c['line']} {c['kind']} +{c['increment']}" for c in own), ""]
    return ["", "<details><summary>Show breakdown</summary>", "", *out, "</details>"] if out else []


def _by_score(rows: Sequence[Row], n: int) -> list[Row]:
    return sorted(rows, key=lambda r: -r["crap"])[:n]


def to_markdown(report: Report, breakdown: bool = False, explain: bool = False, full_table: bool = False, top: int = 10) -> str:
    """Summary, then files, all functions or the worst ones, then the comparison."""
    s = report.summary
    tool = f"{report.tool_name} v{report.tool_version} — CRAP Score Analysis"
    out = [f"<!-- {report.tool_name}:scorecard -->", ""]
    if report.title:
        out += [f"# {report.title}", "", *([report.subtitle, ""] if report.subtitle else []), f"## {tool}"]
    else:
        out += [*([report.subtitle, ""] if report.subtitle else []), f"# {tool}"]
    out.append("")
    if s["total_functions"] == 0:
        out.append("No functions analyzed.")
    else:
        limit = threshold_text(report)
        out += [
            "## Summary",
            "",
            f"**Result:** {'PASS' if s['passed'] else 'FAIL'} · **Functions:** {s['total_functions']} · **Above threshold ({limit}):** {s['exceeding']}",
            "",
            "| Metric     | Worst | Average | Median |",
            "|------------|------:|--------:|-------:|",
            f"| CRAP       | {'—' if s['max_crap'] is None else format(s['max_crap'], '.2f')} | {s['mean_crap']:>7.2f} | {s['median_crap']:>6.2f} |",
            f"| Complexity | {s['max_complexity']:>5} | {s['mean_complexity']:>7.1f} | {s['median_complexity']:>6.1f} |",
            f"| Coverage   | {s['min_coverage']:>4.1f}% | {s['mean_coverage']:>6.1f}% | {s['median_coverage']:>5.1f}% |",
            "",
            "**Risk distribution:** " + " · ".join(f"{x} {s[f'{x}_count']}" for x in ("low", "acceptable", "moderate", "high")),
            "",
        ]
        legend = ["", LEGEND] if breakdown and explain and needs_legend(report.shown) else []
        if report.grouped is not None:
            out += ["## Per-file aggregates", "", "| File | Functions | Failing | Avg CRAP | Worst CRAP | Worst Fn |", "|------|-----------|---------|----------|------------|----------|"]
            out += [f"| {cell(f['file_path'])} | {f['functions']} | {f['exceeding']} | {f['avg_crap']:.2f} | {f['max_crap']:.2f} | {cell(f['worst_function'])} |" for f in report.grouped]
        elif full_table:
            out += ["## All functions", "", *_function_table(report.shown), *(_breakdowns(report.shown) if breakdown else []), *legend]
        elif s["exceeding"] == 0:
            worst = _by_score(report.shown, top)
            if worst:
                head = f"Top {len(worst)} worst by CRAP"
                out += [f"<details><summary>{head}</summary>" if breakdown else f"## {head}", "", *_function_table(worst), *([""] + ["</details>"] if breakdown else []), *legend, "", "_All functions are within threshold._"]
        else:
            failing = _by_score([r for r in report.shown if r["exceeds"]], top)
            head = f"Failures (top {len(failing)} of {s['exceeding']} above threshold {limit})" if s["exceeding"] > len(failing) else f"Failures ({s['exceeding']} above threshold {limit})"
            out += [f"## {head}", "", *_function_table(failing), *(_breakdowns(failing) if breakdown else []), *legend]
    if report.comparison is not None:
        out += ["", *markdown_delta(report.comparison)]
    return "\n".join(out) + "\n"


def markdown_delta(c: Comparison) -> list[str]:
    s = c.summary
    out = [
        "## CRAP Scorecard",
        "",
        f"- **Delta status:** {'PASS' if s['passed'] else 'FAIL'}",
        f"- **Changes:** +{s['added']} added, {s['removed']} removed, {s['modified']} modified, {s['renamed']} renamed",
        f"- **Regressions:** {s['regressions']} · **Improvements:** {s['improvements']} · **New violations:** {s['new_violations']}",
    ]
    if s["jitter_active"] or s["jitter_suppressed"]:
        out.append(f"- **Border-jitter suppressed:** {s['jitter_suppressed']} (threshold crossings within ±epsilon, not counted as new violations)")
    worse = [x for x in c.shown if x["score_delta"] is not None and x["score_delta"] >= 0.005]
    if worse:
        out += ["", "### Regressions", "", "| File | Function | Baseline CRAP | Current CRAP | Δ |", "|------|----------|--------------:|-------------:|--:|"]
        out += [f"| {cell(x['file_path'])} | {cell(x['qualified_name'])} | {x['baseline_crap']:.2f} | {x['current_crap']:.2f} | +{x['score_delta']:.2f} |" for x in worse]
    new = [x for x in c.shown if x["violation"]]
    if new:
        out += ["", "### New violations", "", "| File | Function | Current CRAP |", "|------|----------|-------------:|"]
        out += [f"| {cell(x['file_path'])} | {cell(x['qualified_name'])} | {x['current_crap']:.2f} |" for x in new]
    return out
