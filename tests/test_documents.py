"""Documents that executors write, against those that the text sinks make, and read back by ranges."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeperil.operators import delta, verdicts, view
from codeperil.sinks import documents, plain
from codeperil.sinks.model import Comparison, Report
from codeperil.sources import envelope

FUNCTIONS = "ordinal long, file_path string, qualified_name string, start_line long, end_line long, start_column long, end_column long, complexity long, metric string, contributors array<struct<kind:string,line:bigint,column:bigint,increment:bigint,end_line:bigint,nesting_depth:bigint>>, coverage_percent double, branch_coverage_percent double"


def scored(spark, n, shift=0):
    names = ['a"b', "qualified_name", '"qualified_name": {', "x\\", "é,\n"]
    rows = [(i * 3, f"src/{i % 4}.rs", f"{names[i % 5]}{i + shift * (i % 6 == 0)}", i, i + 5, 1, 2, 1 + (i + shift) % 19, "cognitive", [("if-branch", i, None, 1, i, 0)] * (i % 3), i % 101 + 0.125, None if i % 2 else 50.0) for i in range(n)]
    return verdicts.score_functions(spark.createDataFrame(rows, FUNCTIONS), 15.0).cache()


def text_of(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("n", [0, 1, 90])
def test_json_and_sarif(spark, tmp_path, small_splits, n):
    report = Report(scored(spark, n), "tool", '1"functions": [', "rust", policy="optimistic")
    documents.write_document(report, str(tmp_path / "json"), "json")
    got, want = json.loads(text_of(tmp_path / "json")), json.loads(plain.to_json(report, minimal_view=True))
    assert got == want and len(got["result"]["functions"]) == n
    documents.write_document(report, str(tmp_path / "sarif"), "sarif")
    assert json.loads(text_of(tmp_path / "sarif")) == json.loads(plain.to_sarif(report))
    whole = tmp_path / "whole.json"
    whole.write_text(plain.to_json(report))  # with the view's rows, whose functions don't count
    columns = ["file_path", "qualified_name", "start_line", "end_line", "complexity", "coverage_percent", "branch_coverage_percent", "crap", "threshold", "exceeds", F.size("contributors")]
    for path in (tmp_path / "json", whole):
        back = envelope.read_envelope(spark, str(path))
        assert (back.language, back.policy, back.tool_version, back.threshold) == ("rust", "optimistic", '1"functions": [', 15.0)
        assert back.verdicts.select(F.col("ordinal") * 3, *columns).orderBy("ordinal").collect() == report.verdicts.select("ordinal", *columns).orderBy("ordinal").collect()


def test_csv_of_three_kinds(spark, tmp_path):
    now, then = scored(spark, 60, 1), scored(spark, 50)
    reports = [
        Report(now, "t", "1", "rust", spec=view.ViewSpec(sort="path")),
        Report(now, "t", "1", "rust", spec=view.ViewSpec(only_failing=True, limit=7)),
        Report(now, "t", "1", "rust", spec=view.ViewSpec(group_by_file=True, sort="complexity")),
        Report(now, "t", "1", "rust", comparison=Comparison(delta.changes_of(then, now), delta.DeltaViewSpec(min_delta=0.5))),
        Report(now.where("false"), "t", "1", "rust"),
    ]
    for i, report in enumerate(reports):
        documents.write_document(report, str(tmp_path / str(i)), "csv")
        assert text_of(tmp_path / str(i)) == plain.to_csv(report)
    with pytest.raises(ValueError):
        documents.write_document(reports[0], str(tmp_path / "x"), "xml")


@pytest.mark.parametrize(("text", "kind"), [("", "Parse"), ("{", "Parse"), ("[]", "Parse"), ('{"schema_version": 3}', "UnsupportedSchemaVersion"), ('{"schema_version": 2, "result": {"functions": [{"scored": 3}]}}', "Parse"), ('{"schema_version": x}', "Parse"), (None, "NotFound")])
def test_no_documents(spark, tmp_path, text, kind):
    if text is not None:
        (tmp_path / "a.json").write_text(text)
    with pytest.raises(envelope.EnvelopeError) as error:
        envelope.read_envelope(spark, str(tmp_path / "a.json"))
    assert error.value.kind == kind


def test_rows_become_texts_a_few_at_a_time():
    """A large batch is not held as Python objects as a whole."""
    import pyarrow as pa

    from codeperil.sinks import documents

    batch = pa.RecordBatch.from_pylist([{"rank": i + 1, "x": i} for i in range(3201)])
    out = list(documents._formed(lambda r: str(r["x"]), ",")(iter([batch])))
    assert max(map(len, out)) <= 500 and sum(map(len, out)) == 3201
    assert [t for b in out for t in b.column(1).to_pylist()] == ["0", *(f",{i}" for i in range(1, 3201))]
