"""The line-oriented sinks: CSV, annotations, advice, summary line, scorecard row, SARIF, JSON."""

from __future__ import annotations

import json
import math
import os
from typing import Any

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..operators import view as v
from ..operators.summary import global_summary, scorecard
from .model import SPAN, Report, number

#: Headers of the three kinds of CSV.
FUNCTION_HEADER = "file,function,start_line,end_line,complexity,complexity_metric,coverage_percent,crap_score,risk_level,exceeds_threshold"
DELTA_HEADER = "change_kind,file,function,baseline_complexity,baseline_coverage_percent,baseline_crap,current_complexity,current_coverage_percent,current_crap,score_delta,complexity_metric"
FILE_HEADER = "file,function_count,exceeding_count,average_crap,max_crap,worst_function,distribution_low,distribution_acceptable,distribution_moderate,distribution_high"


def csv_field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def change_line(c: Row | dict, metric: str) -> str:
    side = lambda s: f"{s['complexity']},{s['coverage_percent']:.1f},{s['crap']:.2f}" if s is not None else ",,"
    moved = "" if c["score_delta"] is None else f"{c['score_delta']:.2f}"
    return f"{c['kind']},{csv_field(c['file_path'])},{csv_field(c['qualified_name'])},{side(c['baseline'])},{side(c['current'])},{moved},{metric}"


def file_line(f: Row | dict, metric: str) -> str:
    return ",".join([csv_field(f["file_path"]), str(f["functions"]), str(f["exceeding"]), f"{f['avg_crap']:.2f}", f"{f['max_crap']:.2f}", csv_field(f["worst_function"]), *(str(f[f"{x}_count"]) for x in ("low", "acceptable", "moderate", "high"))])


def function_line(r: Row | dict, metric: str) -> str:
    return ",".join([csv_field(r["file_path"]), csv_field(r["qualified_name"]), str(r["start_line"]), str(r["end_line"]), str(r["complexity"]), metric, f"{r['coverage_percent']:.1f}", f"{r['crap']:.2f}", r["risk_level"], str(r["exceeds"]).lower()])


def to_csv(report: Report) -> str:
    """Changes if there is a comparison, else files if grouped, else functions."""
    if report.comparison is not None:
        head, line, rows = DELTA_HEADER, change_line, report.comparison.shown
    elif report.grouped is not None:
        head, line, rows = FILE_HEADER, file_line, report.grouped
    else:
        head, line, rows = FUNCTION_HEADER, function_line, report.shown
    return "\n".join([head, *(line(r, report.metric) for r in rows)]) + "\n"


def finding(r: Row) -> str:
    """The sentence about a function over its threshold."""
    return f"Function `{r['qualified_name']}` has CRAP {r['crap']:.2f} (complexity={r['complexity']}, coverage={r['coverage_percent']:.1f}%) which exceeds threshold {r['threshold']:.1f}"


def annotation_text(text: str) -> str:
    for c, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = text.replace(c, code)
    return text


def annotation_property(text: str) -> str:
    return annotation_text(text).replace(":", "%3A").replace(",", "%2C")


def to_annotations(report: Report, limit: int = 10) -> str:
    """Workflow commands for the worst functions of the whole result, and a notice of how many more there are."""
    over = report.verdicts.where("exceeds")
    rows = over.orderBy(*v.nan_last(F.col("crap"), True), "file_path", "start_line", "ordinal").limit(limit).collect() if limit else []
    total = report.summary["exceeding"]
    here = os.getcwd().rstrip("/") + "/"
    lines = []
    for r in rows:
        path = r["file_path"].removeprefix(here)
        lines.append(f"::warning file={annotation_property(path)},line={r['start_line']},title=CRAP {r['crap']:.1f}::{annotation_text(finding(r))}")
    if total > len(rows):
        lines.append(f"::notice::{total - len(rows)} more functions exceed threshold; see scorecard for the full list")
    return "".join(line + "\n" for line in lines)


def to_advice(report: Report) -> str:
    """A line for each shown function over its threshold, with its suggested actions."""
    lines = []
    for r in report.shown:
        if r["exceeds"]:
            actions = (r["actions"] if "actions" in r else None) or ["none"]
            lines.append(f"[crap={r['crap']:.2f}] {r['file_path']}:{r['start_line']}-{r['end_line']} {r['qualified_name']} [actions: {','.join(actions)}]")
    return "".join(line + "\n" for line in lines)


def to_summary_line(report: Report) -> str:
    s = report.summary
    return f"{'PASS' if s['passed'] else 'FAIL'}: {s['total_functions']} functions | {s['exceeding']} above threshold ({number(report.threshold)}) | worst: {s['max_crap'] or 0.0:.1f} | avg: {s['mean_crap']:.1f}"


def scorecard_data(report: Report) -> dict[str, Any]:
    """The scorecard's row. Its list of violators leaves renamed functions out and takes no tolerance, unlike its status."""
    threshold = max(0, math.floor(report.threshold + 0.5))
    c = report.comparison
    now = global_summary(report.verdicts)
    if c is not None and c.baseline is not None:
        spark = report.verdicts.sparkSession
        row = scorecard(now, spark.createDataFrame([c.summary]), global_summary(c.baseline), threshold).first()
    else:
        row = scorecard(now, threshold=threshold).first()
    out = row.asDict()
    detail = None
    if row["status"] == "Red" and c is not None:
        rows = c.changes.where("(kind = 'added' AND current.exceeds) OR (kind = 'modified' AND NOT baseline.exceeds AND current.exceeds)").orderBy(F.desc("current.crap"), F.when(F.col("kind") == "modified", 0).otherwise(1), "current.ordinal").toLocalIterator()
        detail = f"**New CRAP threshold violations (>{threshold}):**\n"
        for r in rows:
            before = "newly added" if r["baseline"] is None else f"was {r['baseline']['crap']:.1f}"
            n = r["current"]
            detail += f"- `{n['qualified_name']}` — `{n['file_path']}:{n['start_line']}` — CRAP {n['crap']:.1f} ({before})\n"
    elif row["status"] == "Red":
        detail = f"**Functions over CRAP threshold (>{threshold}):**\n"
        for n in report.verdicts.where("exceeds").orderBy(F.desc("crap"), "ordinal").toLocalIterator():
            detail += f"- `{n['qualified_name']}` — `{n['file_path']}:{n['start_line']}` — CRAP {n['crap']:.1f}\n"
    out["failure_detail_md"] = detail
    return out


def to_scorecard_row(report: Report) -> str:
    data = scorecard_data(report)
    wire = {"type": "CrapDelta", "id": "crap_delta", "label": "CRAP Δ", "anchor": "crap-delta", "status": data["status"], "threshold": data["threshold"], "delta_count": data["delta_count"], "delta_text": data["delta_text"]}
    if data["failure_detail_md"] is not None:
        wire["failure_detail_md"] = data["failure_detail_md"]
    return json.dumps(wire, ensure_ascii=False, indent=2) + "\n"


def diagnostic_json(r: Row) -> dict[str, Any] | None:
    """A function's remediation hint, or None where none was computed."""
    if "root_cause" not in r or r["root_cause"] is None:
        return None
    gaps = [{"start": g["start"], "end": g["end"]} for g in r["coverage_gaps"]]
    splits = [{"line_range": {"start": s["start"], "end": s["end"]}, "complexity_contribution": s["complexity_contribution"], "branch_path": s["branch_path"], "kind": s["kind"], "recommended": s["recommended"]} for s in r["splits"]]
    more: dict[str, dict[str, Any]] = {"add_tests_for_lines": {"lines": gaps}, "extract_function": {"candidates": splits}, "simplify_branching": {"drivers": [r["dominant"]]}, "accept_inherent_complexity": {}}
    actions = [{"kind": k, **more[k], "applicability": "unspecified"} for k in r["actions"]]
    return {"coverage_gaps": gaps, "complexity_drivers": contributors_json(r), "suggested_actions": actions, "root_cause": r["root_cause"]}


def contributors_json(r: Row) -> list[dict[str, Any]]:
    return [dict(c) if isinstance(c, dict) else c.asDict() for c in (r["contributors"] or ())] if "contributors" in r else []


def sarif_result(r: Row | dict) -> dict[str, Any]:
    region = {"startLine": r["start_line"], "endLine": r["end_line"]}
    if r["start_column"] > 0 and r["end_column"] > 0:
        region |= {"startColumn": r["start_column"], "endColumn": r["end_column"] + 1}
    result: dict[str, Any] = {
        "ruleId": "crap/threshold-exceeded",
        "level": {"high": "error", "moderate": "warning"}.get(r["risk_level"], "note"),
        "message": {"text": finding(r)},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file_path"]}, "region": region}}],
        "partialFingerprints": {"functionIdentity": f"{r['file_path']}:{r['qualified_name']}"},
    }
    if (hint := diagnostic_json(r)) is not None:
        result["properties"] = {"diagnostic": hint}
    return result


def to_sarif(report: Report, info_uri: str = "", help_uri: str = "") -> str:
    """SARIF 2.1.0 of all functions over their threshold, whatever the view."""
    return json.dumps(sarif_log(report, [sarif_result(r) for r in report.exceeding()], info_uri, help_uri), ensure_ascii=False, indent=2)


def sarif_log(report: Report, results: list, info_uri: str = "", help_uri: str = "") -> dict[str, Any]:
    rule = {
        "id": "crap/threshold-exceeded",
        "name": "ThresholdExceeded",
        "shortDescription": {"text": "Function CRAP score exceeds the configured threshold."},
        "fullDescription": {"text": "Functions whose CRAP score (complexity * complexity * (1 - coverage)^3 + complexity) exceeds the threshold are change-risk hot spots: cover them first, then extract sub-functions if complexity remains the driver."},
        "helpUri": help_uri,
    }
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": report.tool_name, "version": report.tool_version, "informationUri": info_uri, "rules": [rule]}}, "results": results}]}


def verdict_json(r: Row) -> dict[str, Any]:
    scored: dict[str, Any] = {
        "identity": identity_json(r),
        "complexity": r["complexity"],
        "complexity_metric": r["metric"],
        "coverage_percent": r["coverage_percent"],
    }
    if r["branch_coverage_percent"] is not None:
        scored["branch_coverage_percent"] = r["branch_coverage_percent"]
    scored |= {"crap": {"value": r["crap"], "risk_level": r["risk_level"]}, "contributors": contributors_json(r)}
    out: dict[str, Any] = {"scored": scored, "threshold": r["threshold"], "exceeds": r["exceeds"]}
    if (hint := diagnostic_json(r)) is not None:
        out["diagnostic"] = hint
    return out


def identity_json(r: Row) -> dict[str, Any]:
    return {"file_path": r["file_path"], "qualified_name": r["qualified_name"], "span": {c: r[c] for c in SPAN}}


def file_json(f: Row) -> dict[str, Any]:
    """A file's summary in a grouped view."""
    worst = f["worst"]
    return {
        "file_path": f["file_path"],
        "function_count": f["functions"],
        "exceeding_count": f["exceeding"],
        "average_crap": f["avg_crap"],
        "median_crap": f["median_crap"],
        "max_crap": {"value": worst["crap"], "risk_level": worst["risk_level"]},
        "worst_function": identity_json(worst),
        "distribution": {x: f[f"{x}_count"] for x in ("low", "acceptable", "moderate", "high")},
        "average_coverage": f["avg_coverage"],
        "max_complexity": f["max_complexity"],
    }


def summary_json(s: Row, worst: Row | None) -> dict[str, Any]:
    return {
        "total_functions": s["total_functions"],
        "exceeding_threshold": s["exceeding"],
        "average_crap": s["mean_crap"],
        "median_crap": s["median_crap"],
        "max_crap": None if worst is None else {"value": worst["crap"], "risk_level": worst["risk_level"]},
        "worst_function": None if worst is None else identity_json(worst),
        "distribution": {x: s[f"{x}_count"] for x in ("low", "acceptable", "moderate", "high")},
        "max_complexity": s["max_complexity"],
        "average_complexity": s["mean_complexity"],
        "median_complexity": s["median_complexity"],
        "min_coverage": s["min_coverage"],
        "average_coverage": s["mean_coverage"],
        "median_coverage": s["median_coverage"],
        "total_files": s["files"],
    }


def view_json(report: Report, minimal: bool = False) -> dict[str, Any]:
    spec, counts = report.spec, report.view_counts
    filters = {"only_failing": spec.only_failing, "coverage_range": None if spec.bounds is None else {"min": spec.bounds[0], "max": spec.bounds[1]}}
    out: dict[str, Any] = {"spec": {"filters": filters, "sort": spec.sort, "limit": spec.limit, "group_by": "file" if spec.group_by_file else None}, "eligible_count": counts["eligible_count"], "truncated": counts["truncated"]}
    if not minimal:
        out["shown"] = [verdict_json(r) for r in report.shown]
    shown = v.shown(report.verdicts, spec)
    out["shown_summary"] = summary_json(global_summary(shown).first(), shown.orderBy(*v.sort_keys("crap")).limit(1).first())
    out["grouped"] = None if report.grouped is None else {"files": [file_json(f) for f in report.grouped], "truncated": counts["grouped_truncated"]}
    return out


def delta_json(report: Report) -> dict[str, Any] | None:
    c = report.comparison
    if c is None:
        return None
    s = c.summary
    names = ("added", "removed", "modified", "renamed", "regressions", "improvements", "new_violations")
    return {
        "summary": {**{n: s[n] for n in names}, "passed": s["passed"], "border_jitter_suppressed": s["jitter_suppressed"], "border_jitter_active": s["jitter_active"]},
        "eligible_count": c.eligible,
        "truncated": c.truncated,
        "baseline_ref": None,
        "baseline_tool_version": c.baseline_tool_version,
        "baseline_timestamp": c.baseline_timestamp,
        "shown": [{"kind": x["kind"], "file_path": x["file_path"], "qualified_name": x["qualified_name"], "baseline_crap": x["baseline_crap"], "current_crap": x["current_crap"], "score_delta": x["score_delta"]} for x in c.shown],
    }


def document(report: Report, functions: list, minimal_view: bool = False) -> dict[str, Any]:
    """The JSON document, with these functions."""
    out: dict[str, Any] = {
        "schema_version": 2,
        "tool_version": report.tool_version,
        "language": report.language,
        "timestamp": report.timestamp,
        "metric": report.metric,
        "threshold": report.threshold,
        "diff_ref": report.diff_ref,
        "result": {"functions": functions, "summary": summary_json(report.summary, report.worst), "passed": report.summary["passed"]},
        "view": view_json(report, minimal_view),
    }
    if (compared := delta_json(report)) is not None:
        out["delta"] = compared
    if report.counters is not None:
        out["diagnostics"] = {**report.counters.asDict(), "parse_diagnostics": [r.asDict() for r in report.parse_issues]}
    if report.policy != "pessimistic":
        out["missing_coverage_policy"] = report.policy
    if report.comparison is not None and report.comparison.epsilon:
        out["epsilon"] = report.comparison.epsilon
    return out


def to_json(report: Report, minimal_view: bool = False) -> str:
    """The whole result, its view and its comparison in one document; sources.envelope reads it."""
    rows = report.verdicts if report.diagnostics is None else report.verdicts.join(report.diagnostics, "ordinal", "left")
    functions = [verdict_json(r) for r in rows.orderBy("ordinal").toLocalIterator()]
    return json.dumps(document(report, functions, minimal_view), ensure_ascii=False, indent=2)


def write_rows(report: Report, path: str, kind: str = "parquet") -> None:
    """All verdicts as a table of files, written by the executors: the sink for results of any size."""
    report.verdicts.write.mode("error").format(kind).save(path)
