"""Range joins by nodes, places and medians over all rows, and the batch parser of LCOV, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from codeperil import staging
from codeperil.operators import changes, dyadic, match, order, summary, view
from codeperil.sources import lcov


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_are_disjoint_and_few(spark):
    r = random.Random(1)
    ranges = [(0, 0), (1, 1), (5, 4), (7, 8), (1, 10**9), (-9, 9), (0, 8**6 - 1), (None, 3), (3, None), (-(2**59), 2**59)]
    ranges += [(a := r.randrange(-50, 2000), a + r.randrange(0, 600)) for _ in range(200)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "id int, a long, b long")
    for row in rows.select("a", "b", dyadic.nodes(F.col("a"), F.col("b")).alias("nodes")).collect():
        if row["a"] is None or row["b"] is None or row["a"] > row["b"]:
            assert not row["nodes"]
            continue
        spans = sorted((x["node"] * 8 ** x["level"], (x["node"] + 1) * 8 ** x["level"] - 1) for x in row["nodes"])
        assert spans[0][0] == row["a"] and spans[-1][1] == row["b"]
        assert all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:], strict=False))
        levels = [x["level"] for x in row["nodes"]]
        assert len(levels) <= 14 * (max(levels) + 1) and 8 ** max(levels) <= row["b"] - row["a"] + 1


def functions_and_points(spark, seed, wide):
    r = random.Random(seed)
    span = lambda: (a := r.randrange(1, 10**9 if wide else 300), a + (10 ** r.randrange(0, 10) if wide else r.randrange(-2, 90)))
    functions = [(i, f"f{r.randrange(3)}", *span()) for i in range(120)]
    points = [(f"f{r.randrange(4)}", r.randrange(1, 2 * 10**9 if wide else 400), r.choice([0, 0, 1, 5])) for _ in range(500)]
    points += [("f0", None, 1), ("f1", functions[0][2], 2), ("f1", functions[0][3], 0)]
    hunks = [(f"f{r.randrange(4)}", False, *span()) for _ in range(25)] + [("f2", True, None, None)] * (seed % 2)
    return functions, points, hunks, spark.createDataFrame(functions, "ordinal long, file_path string, start_line long, end_line long"), spark.createDataFrame(points, "file_path string, line long, hits long"), spark.createDataFrame(hunks, "file_path string, is_new boolean, start_line long, end_line long")


@pytest.mark.parametrize("wide", [False, True])
def test_range_joins(spark, wide):
    functions, points, hunks, f, p, h = functions_and_points(spark, 4 + wide, wide)
    inside = [(o, line, hits) for o, path, a, b in functions for at, line, hits in points if at == path and line is not None and a <= line <= b]
    met = match.in_spans(f, p)
    assert sorted(map(tuple, met.select("ordinal", "line", "hits").collect())) == sorted(inside)
    counted = match.counts_in_spans(f, p, {"n": F.count(F.lit(1)), "total": F.sum("hits")})
    want = {o: (sum(x[0] == o for x in inside), sum(x[2] for x in inside if x[0] == o)) for o in {x[0] for x in inside}}
    assert {r["ordinal"]: (r["n"], r["total"]) for r in counted.collect()} == want
    new = {x[0] for x in hunks if x[1]}
    changed = {o for o, path, a, b in functions if path in new or any(x[0] == path and not x[1] and a <= b and x[2] <= x[3] and x[2] <= b and a <= x[3] for x in hunks)}
    got = changes.changed_functions(f, h)
    assert sorted(r["ordinal"] for r in got.collect()) == sorted(changed)
    for df in (met, counted, got):
        assert "BroadcastNestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_without_rows(spark):
    *_, f, p, h = functions_and_points(spark, 4, False)
    none_f, none_p, none_h = f.where("false"), p.where("false"), h.where("false")
    assert match.in_spans(none_f, p).count() == match.in_spans(f, none_p).count() == 0
    assert match.counts_in_spans(none_f, p, {"n": F.count(F.lit(1))}).count() == 0
    assert changes.changed_functions(f, none_h).count() == changes.changed_functions(none_f, h).count() == 0


def test_places_of_all_rows(spark):
    r = random.Random(8)
    rows = [(i, r.choice([1.0, 2.0, 2.0, math.nan, None]), r.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, rank string").withColumnRenamed("rank", "name")
    keys = [F.col("x").desc_nulls_last(), F.col("name").asc(), F.col("id").desc()]
    got = order.with_rank(df, keys)
    key = lambda t: (t[1] is None, 0 if t[1] is None else -math.inf if math.isnan(t[1]) else -t[1], t[2], -t[0])
    want = {t[0]: n for n, t in enumerate(sorted(rows, key=key), 1)}
    assert {t["id"]: t["rank"] for t in got.collect()} == want
    assert "Window" not in plan_of(got)
    assert order.with_rank(df.where("false"), keys).count() == 0
    assert sorted(t["rank"] for t in order.with_rank(df.select(F.lit(1).alias("same")), [F.col("same").asc()]).collect()) == list(range(1, 3001))
    cut = view.with_rank(df, keys, 10)
    assert {t["id"]: t["rank"] for t in cut.collect()} == {i: n for i, n in want.items() if n <= 10}
    big = view.with_rank(df, keys, view.FEW + 1)
    assert big.count() == 3000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 999, 1000])
def test_medians(spark, n):
    r = random.Random(n)
    rows = [(g, r.choice([None, 1.0, -5.5, float(r.randrange(50))])) for g in ("a", "b", None) for _ in range(n + (g == "b"))]
    rows += [("void", None)] * 3
    got = order.medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")

    def middle(values):
        values = sorted(values)
        return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2

    want = {g: middle([x for h, x in rows if h == g and x is not None]) for g in {h for h, x in rows if x is not None}}
    assert {t["g"]: t["median"] for t in got.collect()} == want
    assert "percentile" not in plan_of(got)


def test_medians_of_two_keys_and_of_infinity(spark):
    rows = [("a", 1, math.inf), ("a", 1, math.inf), ("a", 2, -math.inf), ("a", 2, 3.0), ("a", 2, 4.0)]
    got = order.medians(spark.createDataFrame(rows, "g string, h long, x double"), ["g", "h"], "x").collect()
    assert {(t["g"], t["h"]): t["median"] for t in got} == {("a", 1): math.inf, ("a", 2): 3.0}


@pytest.mark.parametrize("scores", [[math.nan, 5.0, 9.0], [5.0, math.nan, 9.0, 9.0], [None, 2.0], [None, None], [math.nan, math.nan], [1.0, 7.0, 7.0, math.nan]])
def test_worst_is_what_a_fold_keeps(spark, scores):
    best = None
    for i, x in enumerate(scores):
        if x is not None and (best is None or x > best[0]):
            best = (x, i)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i long, x double")
    got = rows.repartition(3).agg(summary.first_of_largest(F.col("x"), [F.col("i")], at=F.col("i")).alias("w")).first()["w"]
    assert (got is None and best is None) or got["at"] == best[1] and (got["value"] == best[0] or math.isnan(got["value"]) and math.isnan(best[0]))


def brute_lcov(text):
    lines, branches, found, source = {}, {}, [], None
    number = lambda x, most: int(x) if re.fullmatch(r"\+?[0-9]+", x) and int(x) <= most else None
    for nth, raw in enumerate(text.split("\n"), 1):
        raw = raw.removesuffix("\r")
        if raw.startswith("SF:"):
            source = raw[3:]
            if not source:
                found.append(("EmptySourceFile", nth, None))
        elif not source:
            continue
        elif raw.startswith("DA:"):
            f = raw[3:].split(",")
            line, hits = number(f[0], 2**63 - 1), number(f[1], 2**64 - 1) if len(f) > 1 else None
            if line and hits is not None:
                lines[source, line] = min(lines.get((source, line), 0) + hits, 2**64 - 1)
            else:
                found.append(("MalformedRecord", nth, raw))
        elif raw.startswith("BRDA:"):
            f = raw[5:].split(",", 3)
            parts = [number(x, m) for x, m in zip(f[:3], (2**63 - 1, 2**32 - 1, 2**32 - 1), strict=False)]
            taken = number(f[3], 2**64 - 1) if len(f) == 4 and f[3] != "-" else None
            if len(f) < 4 or None in parts or not parts[0] or (f[3] != "-" and taken is None):
                found.append(("MalformedRecord", nth, raw))
                continue
            key = (source, *parts)
            old = branches.get(key)
            branches[key] = old if taken is None else min((old or 0) + taken, 2**64 - 1)
    return lines, branches, found


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lcov_batches_against_line_by_line(spark, tmp_path, end):
    r = random.Random(3)
    odd = ["DA:", "DA:1", "DA:x,1", "DA:0,1", "DA:00,1", "DA:+7,+007", "DA:7,-1", "DA:5,18446744073709551615", "DA:5,18446744073709551616", "DA:9223372036854775807,1", "DA:9223372036854775808,1", "DA:3,1,a,b", "DA:3,", "DA:3, 1",
           "DA:5,0000000000000000000000000004", "BRDA:1,0,0,-", "BRDA:1,0,0,3", "BRDA:1,0,0", "BRDA:1,0,0,", "BRDA:1,0,0,1,2", "BRDA:1,4294967295,0,1", "BRDA:1,4294967296,0,1", "BRDA:0,0,0,1", "BRDA:2,1,+1,-", "BRDA:2,1,1,--",
           "BRDA:1,0,0,18446744073709551615", "FN:1,f", "end_of_record", "", "xDA:1,1", "SF:", "SF:a.rs", "SF:b é.rs", "DA:2,5", "DA:2,7"]
    texts = [end.join(r.choice(odd) for _ in range(400)) for _ in range(3)] + ["", "DA:1,1", "SF:only", f"SF:a{end}DA:1,1{end}"]
    for i, text in enumerate(texts):
        path = tmp_path / f"{i}.info"
        path.write_bytes(text.encode())
        lines, branches, found = brute_lcov(text)
        ways = [lcov.parse_blocks(lcov.blocks_of(spark.createDataFrame([("r", text)], "report string, text string")))]
        ways += [lcov.read_lcov(spark, str(path))] * bool(text)
        for got in ways:
            assert {(t["file_path"], t["line"]): int(t["hits"]) for t in got.lines.collect()} == lines
            assert {(t["file_path"], t["line"], t["block"], t["branch"]): t["taken"] if t["taken"] is None else int(t["taken"]) for t in got.branches.collect()} == branches
            assert sorted(map(str, map(tuple, got.diagnostics.collect()))) == sorted(map(str, found))
            assert {t["file_path"] for t in got.files.collect()} == {f for f, _ in lines}


def test_lcov_in_splits(spark, tmp_path):
    path = tmp_path / "big.info"
    text = "".join(f"SF:f{i % 7}\nDA:{i % 50 + 1},{i % 4}\nDA:x\nend_of_record\n" for i in range(4000))
    path.write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        got = lcov.read_lcov(spark, str(path))
        lines, _, found = brute_lcov(text)
        assert {(t["file_path"], t["line"]): int(t["hits"]) for t in got.lines.collect()} == lines
        assert sorted(map(tuple, got.diagnostics.collect())) == sorted(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_staged_tables_go_on_release(spark):
    rows = staging.staged(spark.range(5), "five")
    assert rows.count() == 5 and staging.made(spark)
    staging.release(spark)
    assert staging.made(spark) == []
    with pytest.raises(Exception, match="."):
        rows.count()


def test_lcov_blocks_stay_with_the_task_that_reads_them(spark, tmp_path):
    """No block and no block's path goes through a shuffle, and line numbers hold over reports and splits."""
    texts = {"a": "TN:\n\nSF:a.rs\nDA:1,-1\nend_of_record\n" * 40, "b": "SF:b.rs\nDA:x,1\nend_of_record\nSF:\nDA:1,1\nend_of_record\n" * 40}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = lcov.read_lcov(spark, str(tmp_path))
        want = [("MalformedRecord", n + 1, line) for text in texts.values() for n, line in enumerate(text.split("\n")) if line in ("DA:1,-1", "DA:x,1")]
        want += [("EmptySourceFile", n + 1, None) for n, line in enumerate(texts["b"].split("\n")) if line == "SF:"]
        assert sorted(map(str, got.diagnostics.select("kind", "line_number", "content").collect())) == sorted(str(Row(kind=k, line_number=n, content=c)) for k, n, c in want)
        assert "Join LeftOuter" in got.files._jdf.queryExecution().optimizedPlan().toString()
        assert "SortMergeJoin" not in got.files._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in got.files._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nodes_of_points_are_compiled(spark):
    """Nodes of points come without a lambda for each point, and are those of all levels in use."""
    points = spark.createDataFrame([("a", 9), ("a", None)], "f string, line long")
    got = dyadic.at_nodes(points, "line", spark.createDataFrame([(1, 70)], "a long, b long"), "a", "b", ["f"])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert sorted(map(tuple, got.collect())) == [("a", 0, 9), ("a", 1, 1), ("a", 2, 0)]
