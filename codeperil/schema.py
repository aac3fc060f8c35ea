"""Schemas of the tables between operators, and of the result document."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of contributors to a function's complexity.
CONTRIBUTOR_KINDS = (
    "if-branch", "for-loop", "while-loop", "do-while-loop", "catch", "logical-operator", "match", "match-arm", "try",
    "let-else", "loop", "break", "continue", "unsafe", "switch", "case-branch", "ternary", "optional-chain",
)

CONTRIBUTOR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
        T.StructField("increment", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("nesting_depth", T.LongType()),
    ]
)
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start_line", "end_line", "start_column", "end_column")])
FUNCTIONS = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        *SPAN.fields,
        T.StructField("complexity", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("contributors", T.ArrayType(CONTRIBUTOR)),
    ]
)
LINES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("hits", T.DecimalType(20, 0))])
BRANCHES = T.StructType([*LINES.fields[:2], T.StructField("taken", T.DecimalType(20, 0))])
CHANGES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("is_new", T.BooleanType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])

IDENTITY = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("qualified_name", T.StringType()), T.StructField("span", SPAN)])
SCORED = T.StructType(
    [
        T.StructField("identity", IDENTITY),
        T.StructField("complexity", T.LongType()),
        T.StructField("complexity_metric", T.StringType()),
        T.StructField("coverage_percent", T.DoubleType()),
        T.StructField("branch_coverage_percent", T.DoubleType()),
        T.StructField("crap", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("risk_level", T.StringType())])),
        T.StructField("contributors", T.ArrayType(CONTRIBUTOR)),
    ]
)
VERDICT = T.StructType([T.StructField("scored", SCORED), T.StructField("threshold", T.DoubleType()), T.StructField("exceeds", T.BooleanType())])
ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("tool_version", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("diff_ref", T.StringType()),
        T.StructField("result", T.StructType([T.StructField("functions", T.ArrayType(VERDICT)), T.StructField("passed", T.BooleanType())])),
        T.StructField("missing_coverage_policy", T.StringType()),
        T.StructField("epsilon", T.DoubleType()),
    ]
)
#: Versions of the result document that can be read.
SCHEMA_VERSIONS = (1, 2)
