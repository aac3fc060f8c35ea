"""Members of JSON objects from files read in small splits, against the whole text."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeperil.sources import istanbul, jsonparts


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_marks_compose_at_any_cut():
    r = random.Random(2)
    for _ in range(300):
        text = json.dumps({'a"\\': ["}{", {"b\\\\": '"path":', "c": [1, {"d": "\\"}]}], "é{": {"e": '\\"'}}, ensure_ascii=r.random() < 0.5).encode()
        whole = jsonparts.marks(np.frombuffer(text, np.uint8), 0, 0)
        assert whole.state == 0 and whole.depth[-1] == 0 and whole.depth.min() == 0
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(5)))
        state = depth = 0
        outside, depths = [], []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            m = jsonparts.marks(np.frombuffer(text[a:b], np.uint8), state, depth)
            outside += m.outside.tolist()
            depths += m.depth.tolist()
            state, depth = m.state, depths[-1] if depths else 0
        assert outside == whole.outside.tolist() and depths == whole.depth.tolist() and state == 0


def loc(n):
    return {"start": {"line": n, "column": None}, "end": {"line": n, "column": 3}}


def entry(path, n, seed):
    r = random.Random(seed)
    return {"path": path, "s": {str(i): r.randrange(5) for i in range(n)}, "statementMap": {str(i): loc(r.randrange(1, 40)) for i in range(n)}, "b": {"0": [1, 0], "odd": [r.randrange(3)]}, "branchMap": {"0": {"loc": loc(7)}}, "text": '"path": {,}\\'}


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def same(spark, path, text):
    got, want = istanbul.read_istanbul(spark, str(path)), istanbul.parse_reports(spark.createDataFrame([(text,)], "text string"))
    assert rows(got.lines, "file_path", "line", "hits") == rows(want.lines, "file_path", "line", "hits")
    assert rows(got.branches, "file_path", "line", "branch", "arm", "taken") == rows(want.branches, "file_path", "line", "branch", "arm", "taken")
    assert rows(got.files, "file_path") == rows(want.files, "file_path")
    assert rows(got.diagnostics, "file_path", "kind", "message") == rows(want.diagnostics, "file_path", "kind", "message")
    return got


@pytest.mark.parametrize("shape", ["flat", "indented", "wrapped", "path last"])
def test_files_in_splits_equal_whole_texts(spark, tmp_path, small_splits, shape):
    entries = {f"/w/{i}é.ts": entry(f"/w/{i}é.ts", i % 5 * 7, i) for i in range(7)}
    entries["/w/{odd}\\\"},.ts"] = entry("/w/odd.ts", 3, 99)
    if shape == "path last":
        entries = {k: {**{x: y for x, y in e.items() if x != "path"}, "path": e["path"]} for k, e in entries.items()}
    text = json.dumps({"coverage-final": entries} if shape == "wrapped" else entries, indent=2 if shape == "indented" else None)
    path = tmp_path / "report.json"
    path.write_text(text)
    assert len(text) > 2000
    got = same(spark, path, text)
    assert got.lines.count() > 30 and istanbul.has_data(spark, str(path))
    parts = jsonparts.Parts(spark, str(path), "path")
    (name,) = parts.reports
    members = parts.members({name: 2 if shape == "wrapped" else 1})
    assert {k for t in members.select("text").collect() for k in json.loads("{" + t["text"] + "}")} == set(entries)


@pytest.mark.parametrize("text", ["{}", " { } \n", '{"x": {}}', '{"x": 1, "a": [2]}', '{"x": {"path": null}}', '{"w": {"a": {"path": "p"}}, "v": {}}', '{"w": {"a": {"path": "p"}}, "v": 3}', "nothing", "", "{", '{"a": {"path": "p", "s": {"0": 1}}}', '{"a": {"path": "p"}}', '[{"path": "p"}]', '{"a": {"path": "p", "s": 3}}'])
def test_small_and_odd_files(spark, tmp_path, text):
    path = tmp_path / "report.json"
    path.write_text(text)
    if text:  # an empty file has no rows at all
        same(spark, path, text)
    assert not istanbul.has_data(spark, str(path))


def test_an_entry_over_many_splits_is_one_row(spark, tmp_path, small_splits):
    path = tmp_path / "report.json"
    entries = {"a": entry("a", 2, 1), "big": entry("big", 400, 2), "z": entry("z", 2, 3)}
    path.write_text(json.dumps(entries))
    parts = jsonparts.Parts(spark, str(path), "path")
    (name,) = parts.reports
    got = {k: v for t in parts.members({name: 1}).select("text").collect() for k, v in json.loads("{" + t["text"] + "}").items()}
    assert got == entries and parts.reports[name] == jsonparts.Report(1, True)
    assert istanbul.read_istanbul(spark, str(path)).lines.where(F.col("file_path") == "big").count() > 20


def test_entries_meet_by_their_keys_alone(spark, tmp_path):
    """Maps of other orders and of other keys, two entries of one file, and no entry carried through a shuffle."""
    a, b = entry("src/a.ts", 12, 1), entry("src/b.ts", 9, 2)
    a["statementMap"] = dict(reversed(a["statementMap"].items()))
    del b["statementMap"]["4"]
    text = json.dumps({"k1": {**entry("src/c.ts", 5, 3)}, "k2": a, "k3": b, "k4": entry("src/c.ts", 7, 4)})
    path = tmp_path / "r.json"
    path.write_text(text)
    got = same(spark, path, text)
    assert got.lines.where("file_path = 'src/b.ts'").count() < 9
    for df in (got.lines, got.branches, got.diagnostics):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "max_by" not in plan and "collect_list" not in plan


def test_members_inside_a_range_are_not_shuffled(spark, tmp_path, small_splits):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({f"k{i}": {"path": f"p{i}", "s": {}, "x": "," * (i % 3)} for i in range(200)}))
    parts = jsonparts.Parts(spark, str(path), "path")
    ((name, report),) = parts.reports.items()
    made = jsonparts.staged
    seen = []
    jsonparts.staged = lambda df, label: seen.append(made(df, label)) or seen[-1]
    try:
        got = sorted(json.loads("{" + r["text"] + "}").popitem()[0] for r in parts.members({name: report.depth}).collect())
    finally:
        jsonparts.staged = made
    assert got == sorted(f"k{i}" for i in range(200))
    assert seen[0].where("whole").count() > 100
