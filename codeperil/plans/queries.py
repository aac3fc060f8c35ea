"""One query for each operator family over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import score
from ..operators import changes, delta, diagnose, match, multilang, order, summary, verdicts, view
from ..sinks import documents, plain
from ..sinks.model import Comparison, Report
from ..sources import envelope, files, gitdiff, istanbul, jsonparts, lcov, paths
from . import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

OVERRIDES = (("src/f1*.rs", 8.0), ("**/f12.rs", 25.0))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def matched(spark: SparkSession, d: str, policy: str = "pessimistic", with_branches: bool = False) -> DataFrame:
    return match.match_functions(bridge.functions(spark, d), bridge.lines(spark, d), bridge.branches(spark, d) if with_branches else None, policy)


def scored(spark: SparkSession, d: str, policy: str = "pessimistic", overrides=()) -> DataFrame:
    return verdicts.score_functions(matched(spark, d, policy), 15.0, overrides)


def _level(x: str) -> str:
    return f"CASE WHEN {x} <= 8 THEN 'low' WHEN {x} <= 15 THEN 'acceptable' WHEN {x} <= 25 THEN 'moderate' ELSE 'high' END"


def verdicts_sql(policy: str = "pessimistic", threshold: str = "15.0e0") -> str:
    """CTEs up to verdicts."""
    missing = "100.0e0" if policy == "optimistic" else "0.0e0"
    return f"""WITH {bridge.FUNCTIONS}, {bridge.LINES},
    present AS (SELECT DISTINCT file_path FROM lines),
    counted AS (
        SELECT f.ordinal, count(l.line) AS total, count(CASE WHEN l.hits > 0 THEN 1 END) AS covered
        FROM functions f LEFT JOIN lines l ON f.file_path = l.file_path AND l.line BETWEEN f.start_line AND f.end_line GROUP BY f.ordinal),
    matched AS (
        SELECT f.*, c.total, c.covered, p.file_path IS NOT NULL AS has_file,
               CASE WHEN p.file_path IS NULL THEN {missing} WHEN c.total > 0 THEN CAST(c.covered AS DOUBLE) / CAST(c.total AS DOUBLE) * 100.0e0 ELSE 100.0e0 END AS coverage_percent
        FROM functions f JOIN counted c USING (ordinal) LEFT JOIN present p ON f.file_path = p.file_path{" WHERE p.file_path IS NOT NULL" if policy == "skip" else ""}),
    scored AS (
        SELECT *, round((complexity * complexity * ((1.0e0 - coverage_percent / 100.0e0) * (1.0e0 - coverage_percent / 100.0e0) * (1.0e0 - coverage_percent / 100.0e0)) + complexity) * 100.0e0) / 100.0e0 AS crap,
               {threshold} AS threshold FROM matched),
    verdicts AS (SELECT *, {_level("crap")} AS risk_level, crap > threshold AS exceeds FROM scored)
    """


VERDICT_COLUMNS = ("ordinal", "file_path", "qualified_name", "complexity", "covered", "total", "coverage_percent", "crap", "risk_level", "threshold", "exceeds")
_LIST = ", ".join(VERDICT_COLUMNS)


@query(verdicts_sql() + f"SELECT {_LIST} FROM verdicts", "verdicts")
def _verdicts(spark, d):
    return scored(spark, d).select(*VERDICT_COLUMNS)


@query(verdicts_sql("optimistic") + f"SELECT {_LIST} FROM verdicts")
def verdicts_optimistic(spark, d):
    return scored(spark, d, "optimistic").select(*VERDICT_COLUMNS)


@query(verdicts_sql("skip") + f"SELECT {_LIST} FROM verdicts")
def verdicts_skip(spark, d):
    return scored(spark, d, "skip").select(*VERDICT_COLUMNS)


@query(
    f"""WITH {bridge.FUNCTIONS}, {bridge.LINES}, {bridge.BRANCHES}, present AS (SELECT DISTINCT file_path FROM lines)
    SELECT f.ordinal, CASE WHEN count(b.taken) > 0 THEN count(CASE WHEN b.taken > 0 THEN 1 END) END AS branch_covered, CASE WHEN count(b.taken) > 0 THEN count(b.taken) END AS branch_total,
           CASE WHEN count(b.taken) > 0 THEN CAST(count(CASE WHEN b.taken > 0 THEN 1 END) AS DOUBLE) / CAST(count(b.taken) AS DOUBLE) * 100.0e0 END AS branch_coverage_percent
    FROM functions f LEFT JOIN present p ON f.file_path = p.file_path
    LEFT JOIN branches b ON p.file_path = b.file_path AND b.line BETWEEN f.start_line AND f.end_line GROUP BY f.ordinal"""
)
def branch_ratio(spark, d):
    return matched(spark, d, with_branches=True).select("ordinal", "branch_covered", "branch_total", "branch_coverage_percent")


@query(verdicts_sql() + "SELECT risk_level, count(*) AS n FROM verdicts GROUP BY risk_level")
def risk_distribution(spark, d):
    return scored(spark, d).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


SUMMARY = """count(*) AS total_functions, count(CASE WHEN exceeds THEN 1 END) AS exceeding,
    round(CAST(sum(CAST(round(crap * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 6) AS mean_crap, quantile_cont(crap, 0.5) AS median_crap, max(crap) AS max_crap,
    count(CASE WHEN risk_level = 'low' THEN 1 END) AS low_count, count(CASE WHEN risk_level = 'acceptable' THEN 1 END) AS acceptable_count,
    count(CASE WHEN risk_level = 'moderate' THEN 1 END) AS moderate_count, count(CASE WHEN risk_level = 'high' THEN 1 END) AS high_count"""


def _summary_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean_crap", F.round("mean_crap", 6))


@query(
    verdicts_sql()
    + f"""SELECT {SUMMARY}, max(complexity) AS max_complexity, round(CAST(sum(complexity) AS DOUBLE) / count(*), 6) AS mean_complexity, quantile_cont(complexity, 0.5) AS median_complexity,
    min(coverage_percent) AS min_coverage, round(avg(coverage_percent), 6) AS mean_coverage, quantile_cont(coverage_percent, 0.5) AS median_coverage,
    count(DISTINCT file_path) AS files, coalesce(bool_and(NOT exceeds), true) AS passed FROM verdicts"""
)
def summary_global(spark, d):
    rows = summary.global_summary(scored(spark, d))
    return _summary_columns(rows).withColumns({"mean_complexity": F.round("mean_complexity", 6), "mean_coverage": F.round("mean_coverage", 6)}).drop("worst_file", "worst_function")


@query(verdicts_sql() + "SELECT qualified_name AS worst_function, file_path AS worst_file, crap AS max_crap FROM verdicts ORDER BY crap DESC, ordinal LIMIT 1")
def worst_function(spark, d):
    return summary.global_summary(scored(spark, d)).select("worst_function", "worst_file", "max_crap")


NAN_FIRST = """(WITH s AS (SELECT *, CASE WHEN {nan} THEN CAST('NaN' AS DOUBLE) ELSE crap END AS score FROM verdicts),
    f AS (SELECT file_path, arg_min(isnan(score), ordinal) AS nan_first, min(ordinal) AS first FROM s GROUP BY file_path),
    best AS (SELECT file_path, score, ordinal FROM s JOIN f USING (file_path) WHERE CASE WHEN nan_first THEN ordinal = first ELSE NOT isnan(score) END QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, ordinal) = 1)
    SELECT file_path, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, ordinal FROM best)"""


@query(verdicts_sql() + f"SELECT * FROM {NAN_FIRST.format(nan='ordinal % 7 = 3 OR ordinal < 9')}")
def worst_by_file_with_nan(spark, d):
    """The worst function of each file where some scores are not a number, as the fold takes it; such a worst score is shown as null."""
    k = F.col("ordinal")
    rows = scored(spark, d).withColumn("crap", F.when((k % 7 == 3) | (k < 9), F.lit(float("nan"))).otherwise(F.col("crap")))
    worst = rows.groupBy("file_path").agg(summary.first_of_largest(F.col("crap"), [k], ordinal=k).alias("w"))
    return worst.select("file_path", F.when(~F.isnan("w.value"), F.col("w.value")).alias("score"), "w.ordinal")


FILE_SQL = """files AS (SELECT file_path, count(*) AS functions, count(CASE WHEN exceeds THEN 1 END) AS exceeding,
    round(CAST(sum(CAST(round(crap * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 6) AS avg_crap, quantile_cont(crap, 0.5) AS median_crap, max(crap) AS max_crap, max(complexity) AS max_complexity,
    round(avg(coverage_percent), 6) AS avg_coverage, count(CASE WHEN risk_level = 'low' THEN 1 END) AS low_count, count(CASE WHEN risk_level = 'acceptable' THEN 1 END) AS acceptable_count,
    count(CASE WHEN risk_level = 'moderate' THEN 1 END) AS moderate_count, count(CASE WHEN risk_level = 'high' THEN 1 END) AS high_count, min(ordinal) AS first FROM verdicts GROUP BY file_path)"""


@query(verdicts_sql() + f", {FILE_SQL} SELECT *, row_number() OVER (ORDER BY first) AS rank FROM files")
def summary_by_file(spark, d):
    rows = summary.file_summaries(scored(spark, d)).withColumns({"avg_crap": F.round("avg_crap", 6), "avg_coverage": F.round("avg_coverage", 6)})
    return view.with_rank(rows, [F.col("first")])


@query(verdicts_sql(threshold="CASE WHEN file_path LIKE '%/f12.rs' THEN 25.0e0 WHEN file_path LIKE 'src/f1%.rs' THEN 8.0e0 ELSE 15.0e0 END") + "SELECT ordinal, threshold, exceeds FROM verdicts")
def threshold_overrides(spark, d):
    return scored(spark, d, overrides=OVERRIDES).select("ordinal", "threshold", "exceeds")


@query(verdicts_sql() + "SELECT coalesce(bool_and(NOT exceeds), true) AS passed FROM verdicts")
def gate(spark, d):
    return verdicts.gate(scored(spark, d))


@query(verdicts_sql() + "SELECT count(*) AS files_analyzed, count(CASE WHEN NOT covered_any THEN 1 END) AS files_zero_coverage FROM (SELECT file_path, bool_or(coverage_percent > 0) AS covered_any FROM verdicts GROUP BY file_path)")
def file_coverage_stats(spark, d):
    return verdicts.file_coverage_stats(scored(spark, d))


CHANGED = f"""{bridge.HUNKS},
    changed AS (SELECT f.* FROM functions f WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file_path = f.file_path AND (h.is_new OR (f.start_line <= h.end_line AND h.start_line <= f.end_line))))"""


@query(f"WITH {bridge.FUNCTIONS}, {CHANGED} SELECT ordinal, file_path FROM changed")
def diff_overlap_semijoin(spark, d):
    return changes.changed_functions(bridge.functions(spark, d), bridge.hunks(spark, d)).select("ordinal", "file_path")


WIDE = """wide AS (SELECT p_partkey AS ordinal, 'src/f' || CAST(p_partkey % 40 AS VARCHAR) || '.rs' AS file_path, p_partkey * 7919 % 1000000007 + 1 AS start_line,
    p_partkey * 7919 % 1000000007 + CAST(pow(10, p_partkey % 10) AS BIGINT) AS end_line FROM part)"""


def _wide(spark, d) -> DataFrame:
    """Functions of 1 to 10 ** 9 lines, in steps of ten, the tenth of each kind."""
    k = F.col("p_partkey")
    start = k * 7919 % 1000000007
    return spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("ordinal"), F.concat(F.lit("src/f"), (k % 40).cast("string"), F.lit(".rs")).alias("file_path"), (start + 1).alias("start_line"), (start + F.pow(F.lit(10), k % 10).cast("long")).alias("end_line")
    )


@query(
    f"""WITH {WIDE}, far AS (SELECT 'src/f' || CAST(l_suppkey % 40 AS VARCHAR) || '.rs' AS file_path, l_orderkey * 104729 % 1100000009 + 1 AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS hits FROM lineitem)
    SELECT ordinal, count(line) AS total, count(CASE WHEN hits > 0 THEN 1 END) AS covered FROM wide LEFT JOIN far ON wide.file_path = far.file_path AND line BETWEEN start_line AND end_line GROUP BY ordinal"""
)
def span_counts_wide(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("src/f"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".rs")).alias("file_path"), (F.col("l_orderkey") * 104729 % 1100000009 + 1).alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("hits")
    )
    counted = match.counts_in_spans(_wide(spark, d), rows, {"total": F.count(F.lit(1)), "covered": F.count_if(F.col("hits") > 0)})
    return _wide(spark, d).select("ordinal").join(counted, "ordinal", "left").na.fill(0, ["total", "covered"])


@query(
    f"""WITH {WIDE}, changed AS (SELECT 'src/f' || CAST(o_custkey % 50 AS VARCHAR) || '.rs' AS file_path, o_orderkey * 15485863 % 2000000011 + 1 AS a, o_orderkey * 15485863 % 2000000011 + CAST(pow(10, o_orderkey % 5) AS BIGINT) AS b FROM orders)
    SELECT ordinal, file_path FROM wide w WHERE EXISTS (SELECT 1 FROM changed c WHERE c.file_path = w.file_path AND c.a <= w.end_line AND w.start_line <= c.b)"""
)
def diff_overlap_wide(spark, d):
    start = F.col("o_orderkey") * 15485863 % 2000000011
    stretches = spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("src/f"), (F.col("o_custkey") % 50).cast("string"), F.lit(".rs")).alias("file_path"), F.lit(False).alias("is_new"), (start + 1).alias("start_line"), (start + F.pow(F.lit(10), F.col("o_orderkey") % 5).cast("long")).alias("end_line")
    )
    return changes.changed_functions(_wide(spark, d), stretches).select("ordinal", "file_path")


@query(f"WITH {bridge.FUNCTIONS}, {bridge.HUNKS} SELECT DISTINCT file_path FROM functions WHERE file_path IN (SELECT file_path FROM hunks)")
def diff_changed_files(spark, d):
    return changes.changed_files(bridge.functions(spark, d).select("file_path").distinct(), bridge.hunks(spark, d))


@query(
    verdicts_sql()
    + f""", {CHANGED}, kept AS (SELECT v.* FROM verdicts v JOIN changed c USING (ordinal))
    SELECT (SELECT count(DISTINCT file_path) FROM functions) AS files_found, CAST(0 AS BIGINT) AS files_unparseable, (SELECT count(*) FROM functions) AS functions_extracted,
           count(CASE WHEN has_file THEN 1 END) AS functions_matched, count(CASE WHEN NOT has_file THEN 1 END) AS functions_no_coverage, count(DISTINCT file_path) AS files_analyzed,
           (SELECT count(*) FROM (SELECT file_path FROM kept GROUP BY file_path HAVING NOT bool_or(coverage_percent > 0))) AS files_zero_coverage FROM kept"""
)
def analysis_counters(spark, d):
    extracted = bridge.functions(spark, d)
    kept = match.match_functions(changes.changed_functions(extracted, bridge.hunks(spark, d)), bridge.lines(spark, d))
    return verdicts.analysis_counters(extracted, kept, verdicts.score_functions(kept))


def _view(spec: view.ViewSpec, *columns: str):
    def run(spark, d):
        rows = view.filtered(scored(spark, d), spec)
        return view.with_rank(rows, view.sort_keys(spec.sort), spec.limit).select("rank", "ordinal", *columns)

    return run


def _ranked_sql(order: str, columns: str, where: str = "", limit: int | None = None) -> str:
    inner = f"SELECT row_number() OVER (ORDER BY {order}) AS rank, ordinal, {columns} FROM verdicts {where}"
    return verdicts_sql() + (f"SELECT * FROM ({inner}) WHERE rank <= {limit}" if limit else inner)


query(_ranked_sql("crap DESC, ordinal", "crap, risk_level", limit=50), "view_top_crap")(_view(view.ViewSpec(limit=50), "crap", "risk_level"))
query(_ranked_sql("coverage_percent, ordinal", "coverage_percent", "WHERE coverage_percent BETWEEN 20 AND 80"), "view_coverage_band")(_view(view.ViewSpec(min_coverage=20, max_coverage=80, sort="coverage"), "coverage_percent"))
query(_ranked_sql("crap DESC, ordinal", "crap", "WHERE exceeds"), "view_only_failing")(_view(view.ViewSpec(only_failing=True), "crap"))
query(_ranked_sql("file_path, crap DESC, ordinal", "file_path, crap"), "view_sort_path")(_view(view.ViewSpec(sort="path"), "file_path", "crap"))
query(_ranked_sql("complexity DESC, ordinal", "complexity", limit=100), "view_sort_complexity")(_view(view.ViewSpec(sort="complexity", limit=100), "complexity"))


@query(verdicts_sql() + f", {FILE_SQL} SELECT * FROM (SELECT row_number() OVER (ORDER BY max_complexity DESC, first) AS rank, file_path, functions, exceeding, max_complexity, median_crap FROM files) WHERE rank <= 10")
def group_by_file_top(spark, d):
    spec = view.ViewSpec(group_by_file=True, sort="complexity", limit=10)
    rows = view.with_rank(summary.file_summaries(view.filtered(scored(spark, d), spec)), view.file_sort_keys(spec.sort), spec.limit)
    return rows.select("rank", "file_path", "functions", "exceeding", "max_complexity", "median_crap")


@query(verdicts_sql() + "SELECT count(*) AS eligible_count, least(count(*), 25) AS shown_count, count(*) > 25 AS truncated, false AS grouped_truncated FROM verdicts WHERE exceeds")
def view_counts(spark, d):
    return view.view_counts(scored(spark, d), view.ViewSpec(only_failing=True, limit=25))


# coverage reports

LCOV = """lcov AS (
    SELECT l_orderkey % 97 = 0 AS nameless, l_orderkey % 89 = 0 AS broken, 'src/f' || CAST(l_suppkey % 50 AS VARCHAR) || '.rs' AS file_path, l_partkey % 450 + 1 AS line,
           CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS hits, CAST(l_linenumber AS BIGINT) AS block, l_orderkey % 3 AS branch, l_linestatus = 'O' AS dash,
           row_number() OVER (PARTITION BY l_orderkey // 20000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)"""


def _report(spark, d) -> lcov.Coverage:
    return lcov.read_lcov(spark, bridge.lcov_reports(spark, d))


@query(f"WITH {LCOV} SELECT file_path, line, CAST(sum(hits) AS BIGINT) AS hits FROM lcov WHERE NOT nameless AND NOT broken GROUP BY file_path, line")
def lcov_line_merge(spark, d):
    return _report(spark, d).lines.select("file_path", "line", F.col("hits").cast("long").alias("hits"))


@query(f"WITH {LCOV} SELECT file_path, line, block, branch, CAST(sum(CASE WHEN NOT dash THEN hits END) AS BIGINT) AS taken FROM lcov WHERE NOT nameless AND (dash OR NOT broken) GROUP BY file_path, line, block, branch")
def lcov_branch_merge(spark, d):
    return _report(spark, d).branches.select("file_path", "line", "block", "branch", F.col("taken").cast("long").alias("taken"))


@query(
    f"""WITH {LCOV}
    SELECT 'EmptySourceFile' AS kind, (n - 1) * 4 + 1 AS line_number, NULL AS content FROM lcov WHERE nameless
    UNION ALL SELECT 'MalformedRecord', (n - 1) * 4 + 2, 'DA:' || CAST(line AS VARCHAR) || ',-3' FROM lcov WHERE broken AND NOT nameless
    UNION ALL SELECT 'MalformedRecord', (n - 1) * 4 + 3, 'BRDA:' || CAST(line AS VARCHAR) || ',' || CAST(block AS VARCHAR) || ',' || CAST(branch AS VARCHAR) || ',-3' FROM lcov WHERE broken AND NOT nameless AND NOT dash"""
)
def lcov_diagnostics(spark, d):
    return _report(spark, d).diagnostics.select("kind", F.col("line_number").cast("long").alias("line_number"), "content")


@query(f"WITH {LCOV} SELECT DISTINCT file_path FROM lcov WHERE NOT nameless AND NOT broken")
def lcov_files(spark, d):
    return _report(spark, d).files


NAMED = """named AS (SELECT p_partkey AS k, CASE p_partkey % 9
        WHEN 0 THEN '/w/repo/src/m' || p_partkey % 50 || '/f' || p_partkey % 300 || '.rs' WHEN 1 THEN 'm' || p_partkey % 50 || '//./f' || p_partkey % 300 || '.rs'
        WHEN 2 THEN '/ci/build/src/m' || p_partkey % 50 || '/f' || p_partkey % 300 || '.rs' WHEN 3 THEN '/w/repo/src/../out/f' || p_partkey % 300 || '.rs'
        WHEN 4 THEN 'C:\\w\\m' || p_partkey % 50 || '\\f' || p_partkey % 300 || '.rs' WHEN 5 THEN '../m' || p_partkey % 50 || '/f' || p_partkey % 300 || '.rs'
        WHEN 6 THEN '/w/repo/src/x/f' || p_partkey % 300 || '.rs' WHEN 7 THEN '/w/repo/srcs/none' || p_partkey || '.rs' ELSE '/w/repo/src/gone/g' || p_partkey || '.rs' END AS source FROM part),
    known AS (SELECT DISTINCT 'm' || p_partkey % 50 || '/f' || p_partkey % 300 || '.rs' AS file_path FROM part WHERE p_partkey % 4 <> 1 UNION SELECT DISTINCT 'f' || p_partkey % 300 || '.rs' FROM part WHERE p_partkey % 6 = 2)"""


def _named(spark, d) -> tuple[DataFrame, DataFrame]:
    """Paths of reports in nine shapes, and the files that there are."""
    k = F.col("p_partkey")
    s = lambda *x: F.concat(*[y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x])
    m, f = k % 50, k % 300
    shapes = [
        s("/w/repo/src/m", m, "/f", f, ".rs"), s("m", m, "//./f", f, ".rs"), s("/ci/build/src/m", m, "/f", f, ".rs"), s("/w/repo/src/../out/f", f, ".rs"), s("C:\\w\\m", m, "\\f", f, ".rs"),
        s("../m", m, "/f", f, ".rs"), s("/w/repo/src/x/f", f, ".rs"), s("/w/repo/srcs/none", k, ".rs"), s("/w/repo/src/gone/g", k, ".rs"),
    ]
    part = spark.read.parquet(f"{d}/part.parquet")
    source = F.element_at(F.array(*shapes), (k % 9 + 1).cast("int"))
    known = part.where(k % 4 != 1).select(s("m", m, "/f", f, ".rs").alias("file_path")).union(part.where(k % 6 == 2).select(s("f", f, ".rs")))
    return part.select(source.alias("source")), known


@query(
    f"""WITH {NAMED}, p AS (SELECT DISTINCT source, replace(source, '\\', '/') AS fwd FROM named),
    q AS (SELECT *, list_filter(string_split(fwd, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p),
    r AS (SELECT *, starts_with(fwd, '/') AND parts[1:3] = ['w', 'repo', 'src'] AS under FROM q),
    t AS (SELECT source, 0 AS turn, CASE WHEN under THEN parts[4:] ELSE parts END AS tail FROM r WHERE under OR NOT starts_with(fwd, '/')
          UNION ALL SELECT source, i, parts[i:] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM r)),
    best AS (SELECT source, arg_min(file_path, turn) AS file_path, min(turn) AS turn FROM (SELECT source, turn, array_to_string(tail, '/') AS file_path FROM t WHERE NOT list_contains(tail, '..')) JOIN known USING (file_path) GROUP BY source)
    SELECT source, coalesce(file_path, CASE WHEN under THEN array_to_string(parts[4:], '/') ELSE fwd END) AS file_path, CASE WHEN turn IS NULL THEN 'fallback' WHEN turn = 0 THEN 'lexical' ELSE 'suffix' END AS how
    FROM r LEFT JOIN best USING (source)"""
)
def lcov_paths(spark, d):
    return paths.resolved_paths(*_named(spark, d), ["/w/repo/src"])


def _istanbul(spark, d) -> istanbul.Coverage:
    return istanbul.read_istanbul(spark, bridge.istanbul_reports(spark, d))


@query("SELECT 'src/s' || CAST(l_suppkey AS VARCHAR) || '.ts' AS file_path, l_partkey % 450 + 1 AS line, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS hits FROM lineitem GROUP BY ALL")
def istanbul_line_min(spark, d):
    return _istanbul(spark, d).lines.select("file_path", "line", F.col("hits").cast("long").alias("hits"))


@query("SELECT 'src/s' || CAST(l_suppkey AS VARCHAR) || '.ts' AS file_path, count(*) AS orphans FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY ALL")
def istanbul_branch_orphans(spark, d):
    return _istanbul(spark, d).diagnostics.where("kind = 'BranchMismatch'").groupBy("file_path").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT 'src/s' || CAST(l_suppkey AS VARCHAR) || '.ts' AS file_path, l_partkey % 450 + 1 AS line, 2 * count(*) AS arms, count(CASE WHEN l_returnflag <> 'R' AND CAST(l_quantity AS BIGINT) > 0 THEN 1 END) AS taken FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL")
def istanbul_branches(spark, d):
    return _istanbul(spark, d).branches.groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("arms"), F.count_if(F.col("taken") > 0).alias("taken"))


@query(f"WITH {bridge.HUNKS}, new AS (SELECT DISTINCT file_path FROM hunks WHERE is_new) SELECT file_path, false AS is_new, start_line, end_line FROM hunks WHERE NOT is_new AND file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT file_path, true, NULL, NULL FROM new")
def diff_parse(spark, d):
    rows = bridge.hunks(spark, d)
    size = F.col("end_line") - F.col("start_line") + 1
    count = F.when(size == 1, F.lit("")).otherwise(F.concat(F.lit(","), size.cast("string")))
    head = F.concat(F.lit("diff --git "), "file_path", F.lit(" "), "file_path", F.when(F.col("is_new"), F.lit("\nnew file mode 100644")).otherwise(F.lit("")), F.lit("\n--- x\n+++ "), "file_path")
    hunk = F.when(F.col("is_new"), F.lit("\n@@ -0,0 +1,9 @@\n+x")).otherwise(F.concat(F.lit("\n@@ -1,2 +"), F.col("start_line").cast("string"), count, F.lit(" @@ fn\n+x\n@@ -7 +7,0 @@\n-y")))
    return gitdiff.parse_diff(rows.select(F.concat(head, hunk, F.lit("\n")).alias("text")))


# comparison of two results


def _changes(spark, d) -> DataFrame:
    def side(current: bool) -> DataFrame:
        return verdicts.score_functions(bridge.snapshot(spark, d, current), 15.0)

    return delta.changes_of(side(False), side(True))


DELTA = f"""WITH {bridge.snapshot_sql("old_all", False)}, {bridge.snapshot_sql("new_all", True)},
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, qualified_name ORDER BY ordinal DESC) AS k FROM old_all) WHERE k = 1),
    new_ AS (SELECT *, row_number() OVER (PARTITION BY file_path, qualified_name ORDER BY ordinal) AS k FROM new_all),
    paired AS (SELECT 'modified' AS kind, 'identity' AS tier, o.ordinal AS baseline, n.ordinal AS current FROM old o JOIN new_ n ON o.file_path = n.file_path AND o.qualified_name = n.qualified_name AND n.k = 1),
    lo AS (SELECT * FROM old WHERE ordinal NOT IN (SELECT baseline FROM paired)), ln AS (SELECT * FROM new_ WHERE ordinal NOT IN (SELECT current FROM paired)),
    ta AS (SELECT 'renamed' AS kind, 'a' AS tier, o.ordinal AS baseline, n.ordinal AS current
           FROM (SELECT *, count(*) OVER (PARTITION BY qualified_name, sig) AS c FROM lo) o JOIN (SELECT *, count(*) OVER (PARTITION BY qualified_name, sig) AS c FROM ln) n
           ON o.qualified_name = n.qualified_name AND o.sig = n.sig AND o.c = 1 AND n.c = 1),
    lo2 AS (SELECT * FROM lo WHERE ordinal NOT IN (SELECT baseline FROM ta)), ln2 AS (SELECT * FROM ln WHERE ordinal NOT IN (SELECT current FROM ta)),
    tb AS (SELECT 'renamed' AS kind, 'b' AS tier, o.ordinal AS baseline, n.ordinal AS current
           FROM (SELECT *, count(*) OVER (PARTITION BY sig) AS c FROM lo2 WHERE complexity > 1) o JOIN (SELECT *, count(*) OVER (PARTITION BY sig) AS c FROM ln2 WHERE complexity > 1) n
           ON o.sig = n.sig AND o.c = 1 AND n.c = 1),
    changes AS (SELECT * FROM paired UNION ALL SELECT * FROM ta UNION ALL SELECT * FROM tb
        UNION ALL SELECT 'removed', NULL, ordinal, NULL FROM lo2 WHERE ordinal NOT IN (SELECT baseline FROM tb)
        UNION ALL SELECT 'added', NULL, NULL, ordinal FROM ln2 WHERE ordinal NOT IN (SELECT current FROM tb)),
    sides AS (SELECT c.*, o.crap AS baseline_crap, n.crap AS current_crap, o.exceeds AS baseline_exceeds, n.exceeds AS current_exceeds, coalesce(n.file_path, o.file_path) AS file_path,
        coalesce(n.qualified_name, o.qualified_name) AS qualified_name, CASE WHEN kind IN ('modified', 'renamed') THEN n.crap - o.crap END AS score_delta
        FROM changes c LEFT JOIN old_all o ON c.baseline = o.ordinal LEFT JOIN new_all n ON c.current = n.ordinal)
    """


@query(DELTA + "SELECT kind, tier, baseline, current, file_path, qualified_name, round(score_delta, 6) AS score_delta FROM sides")
def delta_changes(spark, d):
    return delta.described(_changes(spark, d)).select("kind", "tier", F.col("baseline.ordinal").alias("baseline"), F.col("current.ordinal").alias("current"), "file_path", "qualified_name", F.round("score_delta", 6).alias("score_delta"))


def _tally(eps: float) -> str:
    def violation(e: float) -> str:
        now, then = f"abs(current_crap - 15) < {e}", f"abs(baseline_crap - 15) < {e}"
        return f"CASE WHEN kind = 'added' THEN current_exceeds AND NOT ({now}) WHEN kind = 'removed' THEN false ELSE NOT baseline_exceeds AND current_exceeds AND NOT (({now}) AND ({then})) END"

    count = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
    return (
        DELTA
        + "SELECT "
        + ", ".join(f"{count(f"kind = '{k}'")} AS {k}" for k in delta.KINDS)
        + f", {count('score_delta >= 0.005')} AS regressions, {count('score_delta <= -0.005')} AS improvements, {count(violation(eps))} AS new_violations, {count(violation(0))} - {count(violation(eps))} AS jitter_suppressed, {'true' if eps else 'false'} AS jitter_active, {count(violation(eps))} = 0 AS passed FROM sides"
    )


@query(_tally(0.0))
def delta_summary(spark, d):
    return delta.delta_summary(_changes(spark, d), 0.0)


@query(_tally(3.5))
def delta_summary_epsilon(spark, d):
    return delta.delta_summary(_changes(spark, d), 3.5)


@query(DELTA + "SELECT baseline, current FROM changes WHERE tier = 'a'")
def delta_renamed_tier_a(spark, d):
    return _changes(spark, d).where("tier = 'a'").select(F.col("baseline.ordinal").alias("baseline"), F.col("current.ordinal").alias("current"))


@query(DELTA + "SELECT baseline, current FROM changes WHERE tier = 'b'")
def delta_renamed_tier_b(spark, d):
    return _changes(spark, d).where("tier = 'b'").select(F.col("baseline.ordinal").alias("baseline"), F.col("current.ordinal").alias("current"))


@query(
    DELTA
    + """SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE kind WHEN 'added' THEN current_crap WHEN 'removed' THEN -baseline_crap ELSE score_delta END DESC,
        CASE kind WHEN 'modified' THEN 0 WHEN 'added' THEN 1 WHEN 'renamed' THEN 2 ELSE 3 END, CASE WHEN kind IN ('modified', 'added') THEN current ELSE 0 END, file_path, qualified_name, coalesce(current, baseline)) AS rank, kind, file_path, qualified_name
        FROM sides WHERE kind IN ('added', 'removed') OR score_delta >= 1) WHERE rank <= 60"""
)
def delta_view_sorted(spark, d):
    spec = delta.DeltaViewSpec(min_delta=1.0)
    return view.with_rank(delta.delta_view(_changes(spark, d), spec), delta.delta_sort_keys(spec.sort), 60).select("rank", "kind", "file_path", "qualified_name")


@query(DELTA + "SELECT count(*) AS unchanged FROM sides WHERE kind = 'modified' AND abs(score_delta) < 0.005")
def delta_unchanged(spark, d):
    return delta.unchanged_count(_changes(spark, d))


@query(DELTA + "SELECT CASE WHEN kind = 'added' THEN 'new' WHEN score_delta >= 0.005 THEN 'regressions' ELSE 'improvements' END AS section, file_path, qualified_name FROM sides WHERE kind = 'added' OR abs(score_delta) >= 0.005")
def delta_sections(spark, d):
    return delta.delta_rows(_changes(spark, d)).select("section", "file_path", "qualified_name")


SIDES = f"""WITH {bridge.snapshot_sql("old_all", False)}, {bridge.snapshot_sql("new_all", True)}"""


@query(
    SIDES
    + """ SELECT 'exceeding' AS name, CAST((SELECT count(*) FROM old_all WHERE exceeds) AS DOUBLE) AS before, CAST((SELECT count(*) FROM new_all WHERE exceeds) AS DOUBLE) AS after
    UNION ALL SELECT 'max_crap', (SELECT max(crap) FROM old_all), (SELECT max(crap) FROM new_all)
    UNION ALL SELECT 'avg_crap', (SELECT round(avg(crap), 6) FROM old_all), (SELECT round(avg(crap), 6) FROM new_all)
    UNION ALL SELECT 'avg_coverage', (SELECT round(avg(coverage_percent), 6) FROM old_all), (SELECT round(avg(coverage_percent), 6) FROM new_all)"""
)
def delta_kpis(spark, d):
    old, new = (summary.global_summary(verdicts.score_functions(bridge.snapshot(spark, d, c), 15.0)) for c in (False, True))
    return delta.kpi_rows(old, new).select("name", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(
    DELTA
    + """, t AS (SELECT count(CASE WHEN kind = 'added' THEN CASE WHEN current_exceeds THEN 1 END WHEN kind <> 'removed' AND NOT baseline_exceeds AND current_exceeds THEN 1 END) AS nv, count(CASE WHEN score_delta >= 0.005 THEN 1 END) AS rg,
        (SELECT count(*) FROM old_all WHERE exceeds) AS b, (SELECT count(*) FROM new_all WHERE exceeds) AS a FROM sides)
    SELECT CASE WHEN nv > 0 THEN 'Red' WHEN rg > 0 THEN 'Yellow' ELSE 'Green' END AS status, CAST(15 AS BIGINT) AS threshold, a - b AS delta_count,
        CAST(b AS VARCHAR) || ' → ' || CAST(a AS VARCHAR) || CASE WHEN nv = 0 AND rg > 0 THEN ' (regressions on existing functions)' WHEN nv = 0 AND a = b THEN '' ELSE ' (' || CASE WHEN a >= b THEN '+' ELSE '' END || CAST(a - b AS VARCHAR) || ')' END AS delta_text FROM t"""
)
def scorecard_status(spark, d):
    old, new = (verdicts.score_functions(bridge.snapshot(spark, d, c), 15.0) for c in (False, True))
    return summary.scorecard(summary.global_summary(new), delta.delta_summary(delta.changes_of(old, new)), summary.global_summary(old))


# order and medians of other values


MEASURED = """measured AS (SELECT l_suppkey % 7 AS kind, CASE WHEN l_suppkey % 7 = 6 THEN NULL WHEN l_suppkey % 7 < 2 THEN CAST(l_quantity AS DOUBLE) ELSE CAST(l_partkey * 7919 % 10007 AS DOUBLE) - 5000 END AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def _measured(spark, d) -> DataFrame:
    k = F.col("l_suppkey") % 7
    value = F.when(k == 6, F.lit(None)).when(k < 2, F.col("l_quantity").cast("double")).otherwise((F.col("l_partkey") * 7919 % 10007).cast("double") - 5000)
    return spark.read.parquet(f"{d}/lineitem.parquet").select(k.alias("kind"), value.alias("value"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH {MEASURED} SELECT kind, quantile_cont(value, 0.5) AS median FROM measured WHERE value IS NOT NULL GROUP BY kind")
def median_by_kind(spark, d):
    return order.medians(_measured(spark, d), ["kind"], "value")


@query(f"WITH {MEASURED} SELECT kind, value, l_orderkey, l_linenumber, row_number() OVER (ORDER BY value DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM measured")
def rank_of_every_row(spark, d):
    keys = [F.col("value").desc_nulls_last(), *(F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return order.with_rank(_measured(spark, d), keys).select("kind", "value", "l_orderkey", "l_linenumber", "rank")


# languages


def _languages(spark, d) -> DataFrame:
    rows = scored(spark, d)
    return multilang.union_languages({"rust": rows.where("ordinal % 2 = 0"), "typescript": rows.where("ordinal % 2 = 1")})


RANKED = "CASE risk_level WHEN 'high' THEN 4 WHEN 'moderate' THEN 3 WHEN 'acceptable' THEN 2 ELSE 1 END"


@query(verdicts_sql() + f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {RANKED} DESC, crap / threshold DESC, qualified_name, file_path, ordinal % 2, ordinal) AS rank, CASE WHEN ordinal % 2 = 0 THEN 'rust' ELSE 'typescript' END AS language, qualified_name FROM verdicts) WHERE rank <= 80")
def combined_ranking(spark, d):
    return view.with_rank(multilang.ranked_functions(_languages(spark, d)), multilang.ranking_keys(), 80).select("rank", "language", "qualified_name")


@query(verdicts_sql() + "SELECT CAST(2 AS BIGINT) AS languages, count(*) AS total_functions, count(CASE WHEN exceeds THEN 1 END) AS exceeding, bool_and(NOT exceeds) AS passed, max(crap / threshold) AS worst_ratio FROM verdicts")
def combined_summary(spark, d):
    return multilang.combined_summary(_languages(spark, d)).select("languages", "total_functions", "exceeding", "passed", "worst_ratio")


@query(
    DELTA
    + f"""SELECT row_number() OVER (ORDER BY {RANKED.replace("risk_level", _level("current_crap"))} DESC, current_crap / 15 DESC, qualified_name, file_path, current) AS rank, kind, qualified_name, file_path
    FROM sides WHERE kind = 'added' OR score_delta >= 0.005"""
)
def combined_delta(spark, d):
    rows = _changes(spark, d).withColumns({"language": F.lit("rust"), "block": F.lit(0)})
    return view.with_rank(multilang.combined_delta_rows(rows), multilang.ranking_keys()).select("rank", "kind", "qualified_name", "file_path")


# remediation


@query(
    verdicts_sql()
    + """, open_lines AS (SELECT v.ordinal, l.line, l.line - row_number() OVER (PARTITION BY v.ordinal ORDER BY l.line) AS island FROM verdicts v JOIN lines l ON v.file_path = l.file_path AND l.line BETWEEN v.start_line AND v.end_line WHERE v.exceeds AND l.hits = 0)
    SELECT ordinal, min(line) AS start, max(line) AS "end" FROM open_lines GROUP BY ordinal, island"""
)
def coverage_gaps(spark, d):
    return diagnose.coverage_gaps(scored(spark, d).where("exceeds"), bridge.lines(spark, d))


@query(
    f"""WITH {bridge.FUNCTIONS}, c AS (SELECT ordinal, complexity - 1 AS total, unnest(range(1, complexity)) AS i FROM functions WHERE complexity > 1),
    k AS (SELECT ordinal, total, CASE WHEN ordinal % 3 = 0 THEN 'if-branch' ELSE list_extract(['if-branch', 'for-loop', 'while-loop', 'logical-operator', 'match'], CAST((ordinal + i) % 5 + 1 AS BIGINT)) END AS kind FROM c)
    SELECT ordinal, kind, count(*) AS n, max(total) AS total FROM k GROUP BY ordinal, kind HAVING count(*) * 100 > max(total) * 70"""
)
def dominant_kind(spark, d):
    return diagnose.dominant_kinds(bridge.functions(spark, d))


@query(
    verdicts_sql()
    + """, v AS (SELECT * FROM verdicts WHERE exceeds),
    c AS (
        SELECT ordinal, start_line, end_line, complexity - 1 AS total, start_line + i AS a, start_line + i + (ordinal + i) % 4 AS b, (ordinal + i) % 3 AS depth,
               CASE WHEN ordinal % 3 = 0 THEN 'if-branch' ELSE list_extract(['if-branch', 'for-loop', 'while-loop', 'logical-operator', 'match'], CAST((ordinal + i) % 5 + 1 AS BIGINT)) END AS kind
        FROM (SELECT *, unnest(range(1, complexity)) AS i FROM v)),
    facts AS (
        SELECT x.ordinal, x.start_line, x.end_line, x.a, x.b, x.depth, count(CASE WHEN y.a BETWEEN x.a AND x.b THEN 1 END) AS share,
               coalesce(string_agg(CASE WHEN y.a < x.a AND x.a <= y.b THEN y.kind END, '/' ORDER BY y.depth, y.a), '') AS path
        FROM c x JOIN c y ON x.ordinal = y.ordinal WHERE x.b > x.a GROUP BY ALL),
    rules AS (
        SELECT *, 1 AS rule, 'deepest_nesting' AS rule_kind, depth AS key FROM facts WHERE depth > 0
        UNION ALL SELECT *, 2, 'highest_branch_count', share - 1 FROM facts UNION ALL SELECT *, 3, 'largest_subblock', b - a FROM facts),
    picked AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY ordinal, rule ORDER BY key DESC, a) = 1),
    viable AS (SELECT * FROM picked WHERE a >= start_line AND b <= end_line AND NOT (a = start_line AND b = end_line) AND share >= 1 AND (rule <> 2 OR key > 0)),
    own AS (SELECT * FROM viable QUALIFY row_number() OVER (PARTITION BY ordinal, a, b ORDER BY rule) = 1),
    split AS (
        SELECT ordinal, count(*) AS n, '[' || string_agg('{"start":' || a || ',"end":' || b || ',"complexity_contribution":' || share || ',"branch_path":"' || path || '","kind":"' || rule_kind
               || '","recommended":' || CASE WHEN rule = first_rule THEN 'true' ELSE 'false' END || '}', ',' ORDER BY rule) || ']' AS splits
        FROM (SELECT *, min(rule) OVER (PARTITION BY ordinal) AS first_rule FROM own) GROUP BY ordinal),
    open_lines AS (SELECT v.ordinal, l.line - row_number() OVER (PARTITION BY v.ordinal ORDER BY l.line) AS island FROM v JOIN lines l ON v.file_path = l.file_path AND l.line BETWEEN v.start_line AND v.end_line WHERE l.hits = 0),
    gap AS (SELECT ordinal, count(DISTINCT island) AS n FROM open_lines GROUP BY ordinal),
    most AS (SELECT ordinal, kind FROM c GROUP BY ordinal, kind HAVING count(*) * 100 > max(total) * 70),
    facets AS (SELECT v.ordinal, coalesce(gap.n, 0) AS gaps, coalesce(split.n, 0) AS n_splits, coalesce(splits, '[]') AS splits, most.kind AS kind FROM v LEFT JOIN gap USING (ordinal) LEFT JOIN split USING (ordinal) LEFT JOIN most USING (ordinal))
    SELECT ordinal, CAST(gaps AS INTEGER) AS gaps, CAST(n_splits AS INTEGER) AS n_splits, splits, CASE WHEN n_splits = 0 THEN kind END AS dominant,
           concat_ws(',', CASE WHEN gaps > 0 THEN 'add_tests_for_lines' END, CASE WHEN n_splits > 0 THEN 'extract_function' WHEN kind IS NOT NULL THEN 'simplify_branching' END,
                     CASE WHEN gaps = 0 AND n_splits = 0 AND kind IS NULL THEN 'accept_inherent_complexity' END) AS actions,
           CASE WHEN gaps > 0 AND (n_splits > 0 OR kind IS NOT NULL) THEN 'both' WHEN gaps > 0 THEN 'low_coverage' ELSE 'high_complexity' END AS root_cause FROM facets"""
)
def remediation(spark, d):
    rows = diagnose.diagnostics(scored(spark, d), bridge.lines(spark, d))
    return rows.select("ordinal", F.size("coverage_gaps").alias("gaps"), F.size("splits").alias("n_splits"), F.to_json("splits").alias("splits"), "dominant", F.array_join("actions", ",").alias("actions"), "root_cause")


# rows of sinks


def _written(spark, report: Report, kind: str) -> str:
    path = staging.new_path(spark, kind)
    documents.write_document(report, path, kind)
    return path


def _report_of(spark, d, **more) -> Report:
    return Report(scored(spark, d), "tool", "1", "rust", **more)


@query(verdicts_sql() + "SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, file_path, qualified_name, start_line, end_line, complexity, coverage_percent, crap, risk_level, threshold, exceeds, complexity - 1 AS n_contributors FROM verdicts")
def json_document(spark, d):
    """All functions, written as one JSON document and read back."""
    back = envelope.read_envelope(spark, _written(spark, _report_of(spark, d), "json")).verdicts
    return back.select("ordinal", "file_path", "qualified_name", "start_line", "end_line", "complexity", "coverage_percent", "crap", "risk_level", "threshold", "exceeds", F.size("contributors").cast("long").alias("n_contributors"))


@query(verdicts_sql() + "SELECT row_number() OVER (ORDER BY ordinal) - 1 AS place, file_path AS uri, start_line, end_line, CASE risk_level WHEN 'high' THEN 'error' WHEN 'moderate' THEN 'warning' ELSE 'note' END AS level, file_path || ':' || qualified_name AS fingerprint FROM verdicts WHERE exceeds")
def sarif_document(spark, d):
    """The functions over their threshold, written as one SARIF document and read back."""
    parts = jsonparts.Parts(spark, _written(spark, _report_of(spark, d), "sarif"), "ruleId", folder=True)
    kind = "level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint, endLine: bigint>>>>, partialFingerprints struct<functionIdentity: string>"
    results = parts.members(dict.fromkeys(parts.reports, 4)).where("inside = 'results'").select("place", F.from_json("text", kind).alias("v"))
    at = F.col("v.locations")[0]["physicalLocation"]
    rows = envelope.numbered(results)
    return rows.select(F.col("ordinal").alias("place"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), at["region"]["endLine"].alias("end_line"), "v.level", F.col("v.partialFingerprints.functionIdentity").alias("fingerprint"))


def _csv_back(spark, report: Report, header: str) -> DataFrame:
    names = header.split(",")
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(_written(spark, report, "csv")).where(F.col(names[0]) != names[0])


@query(verdicts_sql() + "SELECT file_path AS file, qualified_name AS \"function\", CAST(start_line AS VARCHAR) AS start_line, CAST(complexity AS VARCHAR) AS complexity, format('{:.1f}', coverage_percent) AS coverage, format('{:.2f}', crap) AS score, risk_level, CASE WHEN exceeds THEN 'true' ELSE 'false' END AS over FROM verdicts WHERE exceeds")
def csv_document(spark, d):
    rows = _csv_back(spark, _report_of(spark, d, spec=view.ViewSpec(only_failing=True, sort="path")), plain.FUNCTION_HEADER)
    return rows.select("file", "function", "start_line", "complexity", F.col("coverage_percent").alias("coverage"), F.col("crap_score").alias("score"), "risk_level", F.col("exceeds_threshold").alias("over"))


@query(verdicts_sql() + f", {FILE_SQL} SELECT file_path AS file, CAST(functions AS VARCHAR) AS functions, CAST(exceeding AS VARCHAR) AS exceeding, format('{{:.2f}}', max_crap) AS max_crap, (SELECT arg_max(qualified_name, (crap, -ordinal)) FROM verdicts v WHERE v.file_path = files.file_path) AS worst_function, CAST(low_count AS VARCHAR) AS low FROM files")
def csv_files(spark, d):
    rows = _csv_back(spark, _report_of(spark, d, spec=view.ViewSpec(group_by_file=True)), plain.FILE_HEADER)
    return rows.select("file", F.col("function_count").alias("functions"), F.col("exceeding_count").alias("exceeding"), "max_crap", "worst_function", F.col("distribution_low").alias("low"))


@query(DELTA + "SELECT kind, file_path AS file, qualified_name AS \"function\", format('{:.2f}', baseline_crap) AS before, format('{:.2f}', current_crap) AS after, format('{:.2f}', score_delta) AS moved FROM sides")
def csv_changes(spark, d):
    rows = _csv_back(spark, _report_of(spark, d, comparison=Comparison(_changes(spark, d))), plain.DELTA_HEADER)
    return rows.select(F.col("change_kind").alias("kind"), "file", "function", F.col("baseline_crap").alias("before"), F.col("current_crap").alias("after"), F.col("score_delta").alias("moved"))


@query(verdicts_sql() + "SELECT file_path || ':' || qualified_name AS fingerprint, CASE risk_level WHEN 'high' THEN 'error' WHEN 'moderate' THEN 'warning' ELSE 'note' END AS level, start_line, end_line FROM verdicts WHERE exceeds")
def sarif_rows(spark, d):
    rows = scored(spark, d).where("exceeds")
    return rows.select(score.fingerprint(F.col("file_path"), F.col("qualified_name")).alias("fingerprint"), score.severity(F.col("risk_level")).alias("level"), "start_line", "end_line")


@query(verdicts_sql() + "SELECT * FROM (SELECT row_number() OVER (ORDER BY crap DESC, file_path, start_line, ordinal) AS rank, file_path, start_line, crap FROM verdicts WHERE exceeds) WHERE rank <= 10")
def annotations_topk(spark, d):
    keys = [*view.nan_last(F.col("crap"), True), F.col("file_path"), F.col("start_line"), F.col("ordinal")]
    return view.with_rank(scored(spark, d).where("exceeds"), keys, 10).select("rank", "file_path", "start_line", "crap")


@query(verdicts_sql() + 'SELECT file_path AS file, qualified_name AS "function", start_line, end_line, complexity, \'cognitive\' AS complexity_metric, coverage_percent, crap AS crap_score, risk_level, exceeds AS exceeds_threshold FROM verdicts')
def csv_rows(spark, d):
    return scored(spark, d).select(
        F.col("file_path").alias("file"), F.col("qualified_name").alias("function"), "start_line", "end_line", "complexity", F.col("metric").alias("complexity_metric"), "coverage_percent", F.col("crap").alias("crap_score"), "risk_level", F.col("exceeds").alias("exceeds_threshold")
    )


@query(verdicts_sql() + "SELECT ordinal, CASE WHEN coverage_percent >= 80 THEN 'low' WHEN coverage_percent >= 60 THEN 'acceptable' WHEN coverage_percent >= 40 THEN 'moderate' ELSE 'high' END AS coverage_bucket, CASE WHEN complexity <= 3 THEN 'low' WHEN complexity <= 6 THEN 'acceptable' WHEN complexity <= 10 THEN 'moderate' ELSE 'high' END AS complexity_bucket, least(complexity * 5, 100) AS bar, end_line - start_line + 1 AS loc, round(greatest(crap - threshold, 0), 6) AS over_by FROM verdicts")
def html_buckets(spark, d):
    return scored(spark, d).select(
        "ordinal", score.coverage_bucket(F.col("coverage_percent")).alias("coverage_bucket"), score.complexity_bucket(F.col("complexity")).alias("complexity_bucket"),
        score.bar_width(F.col("complexity")).alias("bar"), score.lines_of_code(F.col("start_line"), F.col("end_line")).alias("loc"), F.round(score.over_by(F.col("crap"), F.col("threshold")), 6).alias("over_by"),
    )


# complexity of generated sources


def _sources(spark, d, text) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".ts")).alias("file_path"), k.alias("place"), text(k, F.col("p_size")).alias("text"))


def _times(text: str, n):
    return F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i > 0, F.lit(text)).otherwise(F.lit(""))), "")


@query("SELECT 'm::f_' || CAST(p_partkey AS VARCHAR) AS qualified_name, CAST(1 + p_size % 5 + 3 * (p_size % 3) + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS complexity, CAST(1 AS BIGINT) + 2 AS start_line FROM part")
def rust_complexity(spark, d):
    body = lambda k, n: F.concat(F.lit("// if\nmod m {\nfn f_"), k.cast("string"), F.lit("(x: bool) { let s = \"if\";\n"), _times("if x { } ", n % 5), _times("while x { if x { } } ", n % 3), F.when(k % 2 == 0, F.lit("x && x && x;")).otherwise(F.lit("'a';")), F.lit("}}\n"))
    functions, _ = files.extract(_sources(spark, d, body), "rust", "cognitive")
    return functions.select("qualified_name", "complexity", "start_line")


@query("SELECT 'C.f' || CAST(p_partkey AS VARCHAR) AS qualified_name, CAST(1 + p_size % 5 + 2 * (p_size % 3) AS BIGINT) AS complexity, CAST(1 AS BIGINT) AS start_line FROM part WHERE p_partkey % 10 <> 3")
def typescript_complexity(spark, d):
    body = lambda k, n: F.when(k % 10 == 3, F.lit("class {{")).otherwise(F.concat(F.lit("class C { f"), k.cast("string"), F.lit("(x?: boolean): void { /if/.test('if');"), _times("x?.y; ", n % 5), _times("for (;;) { x ??= a ? 1 : 2 } ", n % 3), F.lit("} }")))
    functions, _ = files.extract(_sources(spark, d, body), "typescript", "cyclomatic")
    return functions.select("qualified_name", "complexity", "start_line")


@query("SELECT 'f' || CAST(p_partkey AS VARCHAR) || '.ts' AS file_path FROM part WHERE p_partkey % 10 = 3")
def unparseable_sources(spark, d):
    body = lambda k, n: F.when(k % 10 == 3, F.lit("function (")).otherwise(F.lit("let x = 1;"))
    return files.extract(_sources(spark, d, body), "typescript", "cyclomatic")[1].select("file_path")
