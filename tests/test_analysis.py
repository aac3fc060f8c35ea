"""Operators on small cases, sinks, and the command line from source files to reports."""

import io
import json
import math
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeperil import cli, render
from codeperil.functions import score
from codeperil.operators import delta, diagnose, match, multilang, summary, verdicts, view
from codeperil.schema import FUNCTIONS
from codeperil.sinks import html, plain, tables
from codeperil.sinks.model import Comparison, Report
from codeperil.sources import envelope


def functions(spark, *rows):
    """(file, name, start, end, complexity[, contributors])"""
    return spark.createDataFrame([(n, r[0], r[1], r[2], r[3], 0, 0, r[4], "cognitive", list(r[5]) if len(r) > 5 else []) for n, r in enumerate(rows)], FUNCTIONS)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, line long, hits long")


@pytest.mark.parametrize("c, cov, want", [(1, 100, 1.0), (1, 0, 2.0), (10, 100, 10.0), (10, 0, 110.0), (5, 50, 8.13), (15, 90, 15.23), (5, 200, 5.0), (5, -3, 30.0)])
def test_worked_scores(spark, c, cov, want):
    row = spark.range(1).select(score.risk_score(F.lit(c), F.lit(float(cov))).alias("s")).first()
    assert row["s"] == want


def test_invalid_scores(spark):
    assert spark.range(1).select(score.risk_score(F.lit(0), F.lit(1.0)).alias("s")).first()["s"] is None
    with pytest.raises(Exception, match="invalid complexity or coverage"):
        spark.range(1).select(score.checked_risk_score(F.lit(1), F.lit(math.nan)).alias("s")).collect()


def test_bands_are_closed_above_and_thresholds_open(spark):
    got = spark.createDataFrame([(x,) for x in (8.0, 8.01, 15.0, 15.01, 25.0, 25.01)], "x double").select(score.risk_level(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == ["low", "acceptable", "acceptable", "moderate", "moderate", "high"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 99), st.floats(0, 100)), min_size=1, max_size=30))
def test_score_properties(spark, rows):
    df = spark.createDataFrame(rows, "c long, v double")
    full, none = F.lit(100.0), F.lit(0.0)
    for r in df.select("c", "v", score.risk_score(F.col("c"), F.col("v")).alias("s"), score.risk_score(F.col("c"), full).alias("full"), score.risk_score(F.col("c"), none).alias("none")).collect():
        assert r["full"] == r["c"] <= r["s"] <= r["none"] == r["c"] ** 2 + r["c"] and r["s"] >= 1


def test_matching_and_policies(spark):
    f = functions(spark, ("a", "hit", 1, 3, 2), ("a", "empty", 50, 60, 2), ("gone", "none", 1, 9, 2), ("a", "wide", 1, 200, 2))
    cover = lines(spark, ("a", 1, 1), ("a", 2, 0), ("a", 3, 5), ("a", 4, 0), ("a", 200, 1), ("b", 2, 1))
    branches = spark.createDataFrame([("a", 2, 1), ("a", 2, 0), ("a", 3, None), ("gone", 2, 1)], "file_path string, line long, taken long")
    got = {r["qualified_name"]: r for r in match.match_functions(f, cover, branches).collect()}
    assert (got["hit"]["covered"], got["hit"]["total"]) == (2, 3) and got["hit"]["branch_coverage_percent"] == 50.0
    assert got["empty"]["coverage_percent"] == 100.0 and got["empty"]["branch_coverage_percent"] is None
    assert got["none"]["coverage_percent"] == 0.0 and not got["none"]["has_file"] and got["none"]["branch_coverage_percent"] is None
    assert (got["wide"]["covered"], got["wide"]["total"]) == (3, 5)
    optimistic = {r["qualified_name"]: r["coverage_percent"] for r in match.match_functions(f, cover, policy="optimistic").collect()}
    assert optimistic["none"] == 100.0
    assert {r["qualified_name"] for r in match.match_functions(f, cover, policy="skip").collect()} == {"hit", "empty", "wide"}


def scored(spark, *rows):
    """(file, name, complexity, coverage[, contributors])"""
    f = functions(spark, *[(r[0], r[1], 10 * n + 1, 10 * n + 5, r[2], *r[4:]) for n, r in enumerate(rows)])
    cov = spark.createDataFrame([(n, float(r[3])) for n, r in enumerate(rows)], "ordinal long, coverage_percent double")
    base = f.join(cov, "ordinal").withColumns({"covered": F.lit(0), "total": F.lit(0), "branch_coverage_percent": F.lit(None).cast("double"), "has_file": F.lit(True)})
    return verdicts.score_functions(base)


def test_empty_result(spark):
    empty = scored(spark, ("a", "f", 1, 0)).limit(0)
    s = summary.global_summary(empty).first()
    assert s["total_functions"] == 0 and s["max_crap"] is None and s["worst_function"] is None and s["mean_crap"] == 0.0 == s["median_coverage"] and s["passed"]
    assert verdicts.gate(empty).first()["passed"]


def test_views(spark):
    rows = scored(spark, ("b", "x", 5, 0), ("a", "y", 5, 0), ("a", "z", 2, 90)).withColumn("crap", F.when(F.col("qualified_name") == "z", F.lit(math.nan)).otherwise(F.col("crap")))
    names = lambda spec: [r["qualified_name"] for r in view.shown(rows, spec).collect()]
    assert names(view.ViewSpec()) == ["x", "y", "z"]  # ties keep their order, not a number comes last
    assert names(view.ViewSpec(sort="path")) == ["y", "z", "x"]
    assert names(view.ViewSpec(sort="coverage", limit=1)) == ["x"]
    assert names(view.ViewSpec(min_coverage=90)) == ["z"]
    assert names(view.ViewSpec(limit=0)) == ["x", "y", "z"]
    files = view.grouped(rows.where("crap = crap AND NOT isnan(crap)"), view.ViewSpec(group_by_file=True, limit=1)).collect()
    assert [f["file_path"] for f in files] == ["b"]
    c = view.view_counts(rows, view.ViewSpec(limit=2)).first()
    assert (c["eligible_count"], c["shown_count"], c["truncated"]) == (3, 2, True)
    for bad in ({"sort": "x"}, {"min_coverage": -1}, {"min_coverage": 60, "max_coverage": 50}, {"limit": -1}):
        with pytest.raises(ValueError):
            view.ViewSpec(**bad)


C = ("if-branch", 1, 1, 1, 3, 0)


def test_delta_pairs(spark):
    old = scored(spark, ("a", "same", 3, 0), ("a", "moved", 4, 0, [C]), ("a", "renamed", 5, 0, [C, C]), ("a", "gone", 1, 0), ("a", "dup", 2, 0), ("a", "dup", 9, 0), ("a", "worse", 3, 100))
    new = scored(spark, ("a", "same", 3, 0), ("b", "moved", 4, 0, [C]), ("c", "other", 5, 0, [C, C]), ("a", "fresh", 6, 0), ("a", "dup", 9, 0), ("a", "dup", 2, 0), ("a", "worse", 3, 0))
    changes = delta.changes_of(old, new)
    got = sorted((r["kind"], r["tier"] or "", r["qualified_name"]) for r in delta.described(changes).collect())
    assert got == sorted([("modified", "identity", "same"), ("modified", "identity", "dup"), ("modified", "identity", "worse"), ("renamed", "a", "moved"), ("renamed", "b", "other"), ("added", "", "fresh"), ("added", "", "dup"), ("removed", "", "gone")])
    s = delta.delta_summary(changes).first()
    assert (s["added"], s["removed"], s["modified"], s["renamed"], s["regressions"], s["improvements"], s["new_violations"], s["passed"]) == (2, 1, 3, 2, 1, 0, 1, False)
    same = delta.delta_summary(delta.changes_of(old.where("qualified_name <> 'dup'"), old.where("qualified_name <> 'dup'"))).first()
    assert (same["modified"], same["added"], same["removed"], same["regressions"], same["passed"]) == (5, 0, 0, 0, True)


@pytest.mark.parametrize("epsilon, new, suppressed", [(0.0, 1, 0), (4.0, 1, 0), (9.0, 0, 1)])
def test_tolerance_needs_both_sides(spark, epsilon, new, suppressed):
    old, now = scored(spark, ("a", "f", 4, 33)), scored(spark, ("a", "f", 4, 0))
    s = delta.delta_summary(delta.changes_of(old, now), epsilon).first()
    assert (s["new_violations"], s["jitter_suppressed"]) == (new, suppressed)


def test_hints(spark):
    deep = [("for-loop", 2, 1, 1, 9, 0), ("if-branch", 3, 1, 2, 6, 1), ("if-branch", 4, 1, 3, 5, 2)]
    flat = [("match-arm", 12, 1, 1, 12, 0)] * 5
    f = functions(spark, ("a", "deep", 1, 10, 9, deep), ("a", "flat", 11, 20, 9, flat), ("a", "plain", 21, 30, 9), ("a", "fine", 31, 40, 1))
    cover = lines(spark, *[("a", n, 0 if n in (2, 3, 4, 7, 9, 10) else 1) for n in range(1, 41)])
    rows = verdicts.score_functions(match.match_functions(f, cover), 5.0)
    got = {r["ordinal"]: r for r in diagnose.diagnostics(rows, cover).collect()}
    assert set(got) == {0, 1, 2}
    assert [(g["start"], g["end"]) for g in got[0]["coverage_gaps"]] == [(2, 4), (7, 7), (9, 10)]
    assert [(s["start"], s["end"], s["kind"], s["recommended"], s["complexity_contribution"], s["branch_path"]) for s in got[0]["splits"]] == [(4, 5, "deepest_nesting", True, 3, "for-loop/if-branch"), (2, 9, "highest_branch_count", False, 6, "")]
    assert (got[0]["actions"], got[0]["root_cause"]) == (["add_tests_for_lines", "extract_function"], "both")
    assert (got[1]["actions"], got[1]["dominant"], got[1]["root_cause"]) == (["simplify_branching"], "match-arm", "high_complexity")
    assert (got[2]["actions"], got[2]["root_cause"]) == (["accept_inherent_complexity"], "high_complexity")


def report(spark, **more):
    rows = scored(spark, ("src/a|b.rs", "big,fn", 20, 30, [C]), ("src/b.rs", "mid", 6, 72.5), ("src/c.rs", "small", 2, 95)).cache()
    return Report(rows, "tool", "0.4.0", "rust", threshold=15.0, **more)


def test_text_sinks(spark):
    r = report(spark)
    table = tables.to_table(r).splitlines()
    assert table[0] == "tool v0.4.0 — CRAP Score Analysis" and table[2] == "+------------+----------+----+------+--------+------+"
    assert table[5] == "| src/a|b.rs | big,fn   | 20 | 30.0 | 157.20 | high |"
    assert "Summary: 3 functions | 1 above threshold (15) | worst: 157.2 | FAIL" in table
    assert plain.to_csv(r).splitlines()[1] == 'src/a|b.rs,"big,fn",1,5,20,cognitive,30.0,157.20,high,true'
    assert plain.to_summary_line(r) == "FAIL: 3 functions | 1 above threshold (15) | worst: 157.2 | avg: 55.3"
    assert plain.to_annotations(r) == "::warning file=src/a|b.rs,line=1,title=CRAP 157.2::Function `big,fn` has CRAP 157.20 (complexity=20, coverage=30.0%25) which exceeds threshold 15.0\n"
    md = tables.to_markdown(r, breakdown=True)
    assert md.startswith("<!-- tool:scorecard -->\n\n# tool v0.4.0") and "| src/a\\|b.rs | big,fn | 20 | 30.0 | 157.20 | high |" in md and "  - L1 if-branch +1" in md
    row = json.loads(plain.to_scorecard_row(r))
    assert row["status"] == "Red" and row["delta_text"] == "1 over threshold (no baseline)" and "`big,fn`" in row["failure_detail_md"]
    sarif = json.loads(plain.to_sarif(r))["runs"][0]["results"]
    assert [x["level"] for x in sarif] == ["error"] and "startColumn" not in sarif[0]["locations"][0]["physicalLocation"]["region"]
    grouped = report(spark, spec=view.ViewSpec(group_by_file=True, limit=2))
    assert "View: showing 3 of 3 functions (top 2 files)" in tables.to_table(grouped)
    first = plain.view_json(grouped)["grouped"]["files"][0]
    assert list(first) == ["file_path", "function_count", "exceeding_count", "average_crap", "median_crap", "max_crap", "worst_function", "distribution", "average_coverage", "max_complexity"]
    assert first["worst_function"]["qualified_name"] == "big,fn" and first["max_crap"] == {"value": 157.2, "risk_level": "high"} and sum(first["distribution"].values()) == first["function_count"]
    assert plain.to_csv(grouped).splitlines()[1] == 'src/a|b.rs,1,1,157.20,157.20,"big,fn",0,0,0,1'
    top = report(spark, spec=view.ViewSpec(limit=1))
    assert "View: showing 1 of 3 functions (top 1)" in tables.to_table(top)
    empty = Report(r.verdicts.limit(0), "t", "1", "rust")
    assert "No functions analyzed" in tables.to_table(empty) and "No functions analyzed." in tables.to_markdown(empty) and "No functions" in html.to_html(empty)


def test_comparison_sinks_and_round_trip(spark, tmp_path):
    r = report(spark)
    path = tmp_path / "base.json"
    path.write_text(plain.to_json(r))
    back = envelope.read_envelope(spark, str(path))
    assert (back.language, back.metric, back.threshold, back.policy) == ("rust", "cognitive", 15.0, "pessimistic")
    columns = ["ordinal", "file_path", "qualified_name", "complexity", "coverage_percent", "crap", "risk_level", "threshold", "exceeds"]
    assert sorted(map(str, back.verdicts.select(*columns).collect())) == sorted(map(str, r.verdicts.select(*columns).collect()))
    now = scored(spark, ("src/a|b.rs", "big,fn", 20, 30, [C]), ("src/b.rs", "mid", 6, 0), ("src/d.rs", "new", 1, 0))
    c = Comparison(delta.changes_of(back.verdicts, now), baseline=back.verdicts)
    two = Report(now, "tool", "0.4.0", "rust", comparison=c)
    assert plain.to_csv(two).splitlines()[1].startswith("modified,src/b.rs,mid,6,72.5,6.75,6,0.0,42.00,35.25,")
    assert "  +1 added, 1 removed, 2 modified, 0 renamed · 1 regressions, 0 improvements, 1 new violations" in tables.to_table(two)
    assert "### New violations" in tables.to_markdown(two)
    assert json.loads(plain.to_scorecard_row(two))["delta_text"] == "1 → 2 (+1)"
    assert json.loads(plain.to_json(two))["delta"]["summary"]["regressions"] == 1
    page = html.to_html(two)
    assert "Comparison with the baseline" in page and "+35.25" in page
    other = tmp_path / "ts.json"
    other.write_text(plain.to_json(Report(now, "tool", "1", "typescript", metric="cyclomatic")))
    texts = []
    both = render.reports_of(spark, [f"rust={path}", f"typescript={other}"], [f"rust={path}", f"typescript={path}"], texts.append)
    assert len(texts) == 1 and both[0].comparison is not None and both[1].comparison is None
    assert "Ranking" in html.to_html_multi(both)
    for bad in ("nothing.json", "bad.json", "old.json"):
        (tmp_path / "bad.json").write_text("{")
        (tmp_path / "old.json").write_text('{"schema_version": 9}')
        with pytest.raises(envelope.EnvelopeError):
            envelope.read_envelope(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        envelope.read_envelopes(spark, ["a=x"], ["b=y"])


def test_languages(spark):
    rows = multilang.union_languages({"rust": scored(spark, ("a", "f", 5, 0)), "ts": scored(spark, ("a", "f", 5, 0), ("b", "g", 9, 0))})
    assert [(r["language"], r["qualified_name"]) for r in multilang.ranked_functions(rows).collect()] == [("ts", "g"), ("rust", "f"), ("ts", "f")]
    s = multilang.combined_summary(rows).first()
    assert (s["languages"], s["total_functions"], s["worst_language"], s["worst_ratio"]) == (2, 3, "ts", 6.0)
    assert multilang.comparable({"a": "x"}, {"a": "y"})["a"]
    assert html.glyph("_crap") == "C" and html.glyph("é") == "?" and html.ratio_text(math.inf) == "∞"


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    code = "fn good() {}\n\nfn bad(x: bool) {\n    if x { loop { if x { break; } } }\n}\n"
    (tmp_path / "src/a.rs").write_text(code)
    (tmp_path / "src/broken.rs").write_text("fn (")
    (tmp_path / "lcov.info").write_text("SF:/ci/src/a.rs\nDA:1,1\nDA:3,0\nDA:4,0\nend_of_record\n")

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.run(spark, ["--coverage", "lcov.info", *args], out, err), out.getvalue(), err.getvalue()

    status, text, notes = run("--format", "table,json:base.json")
    assert status == 1 and "| a.rs | bad " in text and "1 of 2 files could not be parsed" in notes
    assert run("--no-fail", "--summary")[:2] == (0, "FAIL: 2 functions | 1 above threshold (15) | worst: 72.0 | avg: 36.5\n")
    assert run("--threshold", "100")[0] == 0
    status, text, notes = run("--format", "advice", "--no-fail")
    assert "[actions: add_tests_for_lines" in notes and json.loads(text)["result"]["functions"][1]["diagnostic"]["root_cause"]
    (tmp_path / "src/a.rs").write_text(code + "fn more(x: bool) { if x { if x { if x { loop { } } } } }\n")
    (tmp_path / "lcov.info").write_text("SF:src/a.rs\nDA:1,1\nDA:3,0\nDA:4,1\nDA:6,0\n")
    assert run("--baseline", "base.json", "--delta-gate", "--threshold", "100", "--format", "csv")[:2] == (1, run("--baseline", "base.json", "--threshold", "100", "--format", "csv", "--no-fail")[1])
    for bad in (["--strict", "--lenient"], ["--format", "x"], ["--format", "csv,json"], ["--delta-gate"], ["--src", "nowhere"], ["--view", "x"], ["--threshold", "-1"]):
        assert run(*bad)[0] == 2, bad
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    git("add", "src")
    git("commit", "-qm", "x")
    (tmp_path / "src/a.rs").write_text(code.replace("fn good() {}", "fn good() { let _x = 1; }"))
    status, text, _ = run("--diff", "HEAD", "--format", "csv")
    assert status == 0 and [line.split(",")[1] for line in text.splitlines()[1:]] == ["good"]
