"""HTML reports of one or several languages: a page without outside resources.

Files are listed by their worst function; a page holds the functions of the view, so a limit bounds it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import escape

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..operators import delta as d
from ..operators import multilang
from ..operators.summary import global_summary
from .model import Comparison, Report

STYLE = """
body{font:15px/1.5 system-ui,sans-serif;margin:0 auto;max-width:72em;padding:1em;color:#222;background:#fff}
table{border-collapse:collapse;width:100%}td,th{padding:.25em .6em;text-align:left;border-bottom:1px solid #ddd}
.tiles{display:flex;flex-wrap:wrap;gap:1em}.tile{border:1px solid #ccc;border-radius:6px;padding:.6em 1em;min-width:11em}
.tile b{display:block;font-size:1.6em}.pass{color:#176b2c}.fail{color:#a11}.low{color:#176b2c}.acceptable{color:#5b6b17}.moderate{color:#a35c00}.high{color:#a11}
.bar{background:#eee;height:.6em;width:8em}.bar i{display:block;height:100%;background:#668}details{margin:.6em 0}small{color:#666}
"""


def coverage_bucket(x: float) -> str:
    return "low" if x >= 80 else "acceptable" if x >= 60 else "moderate" if x >= 40 else "high"


def complexity_bucket(x: int) -> str:
    return "low" if x <= 3 else "acceptable" if x <= 6 else "moderate" if x <= 10 else "high"


def glyph(name: str) -> str:
    """A letter or digit for an adapter: the first of its name."""
    m = re.search(r"[A-Za-z0-9]", name)
    return m[0].upper() if m else "?"


def ratio_text(x: float) -> str:
    return "∞" if x == float("inf") else f"{x:.2f}"


def signed(x: float, digits: int = 2) -> str:
    return f"{'+' if x > 0 else '−' if x < 0 else '±'}{abs(x):.{digits}f}"


def direction(x: float) -> str:
    return "up" if x > 0 else "down" if x < 0 else "flat"


def table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """Cells are HTML already."""
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return "<table><thead><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr></thead><tbody>{body}</tbody></table>"


def tile(label: str, value: str, foot: str = "") -> str:
    return f'<div class="tile"><span>{escape(label)}</span><b>{value}</b><small>{foot}</small></div>'


def level(name: str) -> str:
    return f'<span class="{name}">{name}</span>'


def page(title: str, body: str) -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><title>{escape(title)}</title><style>{STYLE}</style></head>\n<body>\n{body}\n</body></html>\n'


def verdict(passed: bool) -> str:
    return '<span class="pass">✓ PASS</span>' if passed else '<span class="fail">✕ FAIL</span>'


def function_rows(rows: Sequence[Row]) -> list[list[str]]:
    out = []
    for r in rows:
        over = max(r["crap"] - r["threshold"], 0.0)
        bar = f'<div class="bar"><i style="width:{min(r["complexity"] * 5, 100)}%"></i></div>'
        out.append(
            [
                escape(r["qualified_name"]), f"{r['start_line']}–{r['end_line']}", str(r["end_line"] - r["start_line"] + 1), f'<span class="{complexity_bucket(r["complexity"])}">{r["complexity"]}</span>{bar}',
                f'<span class="{coverage_bucket(r["coverage_percent"])}">{r["coverage_percent"]:.1f}%</span>', f"{r['crap']:.2f}", level(r["risk_level"]), f"+{over:.2f}" if r["exceeds"] else "",
            ]
        )
    return out


FUNCTION_HEAD = ("Function", "Lines", "LOC", "Complexity", "Coverage", "CRAP", "Risk", "Over by")


def file_order(report: Report) -> list[tuple[str, list[Row]]]:
    """Files with their shown functions: in the order of the groups if grouped, else by largest score, then path."""
    files: dict[str, list[Row]] = {}
    for r in report.shown:
        files.setdefault(r["file_path"], []).append(r)
    if report.grouped is not None:
        return [(f["file_path"], files.get(f["file_path"], [])) for f in report.grouped]
    return sorted(files.items(), key=lambda x: (-max(r["crap"] for r in x[1]), x[0]))


def delta_panel(c: Comparison, current: Row) -> str:
    s = c.summary
    parts = [f"<h2>Comparison with the baseline {verdict(s['passed'])}</h2>", f"<p>+{s['added']} added, {s['removed']} removed, {s['modified']} modified, {s['renamed']} renamed; {s['regressions']} regressions, {s['improvements']} improvements, {s['new_violations']} new violations</p>"]
    if s["jitter_active"] or s["jitter_suppressed"]:
        parts.append(f"<p>{s['jitter_suppressed']} threshold crossings within the tolerance are not counted.</p>")
    if c.baseline is not None:
        spark = c.changes.sparkSession
        kpis = d.kpi_rows(global_summary(c.baseline), spark.createDataFrame([current])).collect()
        parts.append(table(("Figure", "Before", "After", "Change"), [[escape(k["name"]), f"{k['before']:.2f}", f"{k['after']:.2f}", f'<span class="{"fail" if k["is_regression"] else direction(k["change"])}">{signed(k["change"])}</span>'] for k in kpis]))
    sections: dict[str, list[list[str]]] = {"regressions": [], "improvements": [], "new": []}
    for x in c.shown:
        moved = x["score_delta"]
        where = "new" if x["kind"] == "added" else "regressions" if moved is not None and moved >= 0.005 else "improvements" if moved is not None and moved <= -0.005 else None
        if where:
            show = lambda v: "—" if v is None else f"{v:.2f}"
            sections[where].append([escape(x["file_path"]), escape(x["qualified_name"]), show(x["baseline_crap"]), show(x["current_crap"]), "new" if moved is None else signed(moved)])
    for name, rows in sections.items():
        if rows:
            parts.append(f"<h3>{name.capitalize()}</h3>" + table(("File", "Function", "Baseline", "Current", "Change"), rows))
    unchanged = d.unchanged_count(c.changes).first()["unchanged"]
    parts.append(f"<p><small>{unchanged} unchanged</small></p>")
    return "\n".join(parts)


def panel(report: Report) -> str:
    s = report.summary
    total = s["total_functions"]
    if not total:
        return "<p>No functions analyzed.</p>"
    share = 100 * s["exceeding"] / total
    tiles = [
        tile("Exceeding threshold", f"{s['exceeding']} / {total}", f"{share:.1f}% over CRAP {report.threshold:.2f}"),
        tile("Average CRAP", f"{s['mean_crap']:.2f}", f"median {s['median_crap']:.2f} · max {s['max_crap']:.2f}"),
        tile("Avg line coverage", f"{s['mean_coverage']:.1f}%", f"median {s['median_coverage']:.1f}%"),
        tile("Avg complexity", f"{s['mean_complexity']:.1f}", f"median {s['median_complexity']:.1f} · max {s['max_complexity']} {report.metric}"),
    ]
    parts = [f'<div class="tiles">{"".join(tiles)}</div>', "<h2>Risk distribution</h2>", table(("Low", "Acceptable", "Moderate", "High"), [[str(s[f"{x}_count"]) for x in ("low", "acceptable", "moderate", "high")]])]
    files = file_order(report)
    worst = sorted((r for _, rows in files for r in rows), key=lambda r: -round(r["crap"], 2))[:4]
    parts += ["<h2>Worst offenders</h2>", table(("Rank", "File", *FUNCTION_HEAD), [[str(n), escape(r["file_path"]), *cells] for n, (r, cells) in enumerate(zip(worst, function_rows(worst), strict=True), 1)]), "<h2>Files</h2>"]
    for path, rows in files:
        over = sum(r["exceeds"] for r in rows)
        parts.append(f"<details{' open' if over else ''}><summary><code>{escape(path)}</code> — {len(rows)} functions, {over} over threshold</summary>{table(FUNCTION_HEAD, function_rows(rows))}</details>")
    if report.comparison is not None:
        parts.append(delta_panel(report.comparison, s))
    return "\n".join(parts)


def to_html(report: Report) -> str:
    tool = f"{report.tool_name} v{report.tool_version}"
    title = f"{report.title} — {tool}" if report.title else f"{tool} — CRAP score analysis"
    head = f"<h1>{escape(report.title or f'{report.tool_name} report')} {verdict(report.summary['passed'])}</h1>" + (f"<p>{escape(report.subtitle)}</p>" if report.subtitle else "") + f"<p><small>{escape(tool)} · {report.language} · {report.metric} complexity</small></p>"
    return page(title, head + panel(report))


def to_html_multi(reports: Sequence[Report], title: str = "Combined report", top: int = 50) -> str:
    """Several languages: a combined view with a ranking over all, the combined comparison, and a panel for each; one language gets its own page."""
    if len(reports) == 1:
        return to_html(reports[0])
    union = multilang.union_languages({r.language: r.verdicts for r in reports})
    s = multilang.combined_summary(union).first()
    names = {r.language: r.tool_name for r in reports}
    ranked = multilang.ranked_functions(union).limit(top).collect()
    rows = [[glyph(names[r["language"]]), escape(r["language"]), escape(r["file_path"]), escape(r["qualified_name"]), f"{r['crap']:.2f}", level(r["risk_level"]), ratio_text(r["ratio"])] for r in ranked]
    parts = [
        f"<h1>{escape(title)} {verdict(s['passed'])}</h1>",
        f"<p>{s['exceeding']} of {s['total_functions']} functions in {s['languages']} languages exceed their threshold; the largest ratio is {ratio_text(s['worst_ratio'] or 0.0)} ({escape(s['worst_function'] or '—')}).</p>",
        "<h2>Ranking</h2>",
        table(("", "Language", "File", "Function", "CRAP", "Risk", "Ratio"), rows),
    ]
    compared = [(n, r) for n, r in enumerate(reports) if r.comparison is not None]
    if compared:
        spark = union.sparkSession
        whole = multilang.combined_delta_summary(spark.createDataFrame([r.comparison.summary for _, r in compared])).first()
        parts.append(f"<h2>Combined comparison {verdict(whole['passed'])}</h2><p>{whole['regressions']} regressions, {whole['improvements']} improvements, {whole['new_violations']} new violations</p>")
        changes = None
        for n, r in compared:
            own = r.comparison.changes.withColumns({"language": F.lit(r.language), "block": F.lit(n)})
            changes = own if changes is None else changes.unionByName(own)
        moved = multilang.combined_delta_rows(changes).limit(top).collect()
        parts.append(table(("Language", "Change", "File", "Function", "Current", "Difference"), [[escape(x["language"]), x["kind"], escape(x["file_path"]), escape(x["qualified_name"]), f"{x['current_crap']:.2f}", "new" if x["score_delta"] is None else signed(x["score_delta"])] for x in moved]))
    for r in reports:
        parts.append(f"<h2>{escape(r.language)} {verdict(r.summary['passed'])}</h2>{panel(r)}")
    tools = " · ".join(f"{glyph(r.tool_name)} {escape(r.tool_name)} v{escape(r.tool_version)}" for r in reports)
    return page(title, "\n".join(parts) + f"<p><small>{tools}</small></p>")
