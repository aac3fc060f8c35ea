"""Istanbul JSON coverage reports: one object of files, bare or under one wrapping key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .jsonparts import Parts
from .lcov import Coverage, longest_suffix_paths

_LOC = "struct<start: struct<line: bigint>>"
ENTRY = f"struct<path: string, s: map<string, bigint>, statementMap: map<string, {_LOC}>, b: map<string, array<bigint>>, branchMap: map<string, struct<loc: {_LOC}, line: bigint>>>"
FLAT = f"map<string, {ENTRY}>"
WRAPPED = f"map<string, map<string, {ENTRY}>>"
DIAGNOSTICS = "file_path string, kind string, message string"


def _usable(m: Column) -> Column:
    """Whether a map of entries has a path in each."""
    return m.isNotNull() & F.forall(F.map_values(m), lambda e: e.isNotNull() & e["path"].isNotNull())


def _unknown(keys: Column) -> list[Column]:
    """The diagnostic of a report with these top-level keys (null: none can be told)."""
    named = F.array_join(F.array_sort(keys), ", ")
    received = F.coalesce(F.when(named == "", F.lit("{}")).otherwise(F.concat(F.lit("["), named, F.lit("]"))), F.lit("none"))
    text = F.concat(F.lit("top-level shape not recognized as Istanbul; expected `{[path]: { path, s, statementMap, … }}`; received keys: "), received)
    return [F.lit("").alias("file_path"), F.lit("SchemaUnrecognized").alias("kind"), text.alias("message")]


def parse_reports(texts: DataFrame, discovered: DataFrame | None = None) -> Coverage:
    """Coverage from a table of reports (text), small ones. discovered: file_path of the source files; report paths become the
    discovered path that is their longest suffix, and unresolved entries go with a diagnostic. Without it paths stay.

    A file's hits on a line are the smallest of the statements that begin there. An entry with only one of s and
    statementMap filled goes with a diagnostic; with both empty its file is present without lines. Arms of a branch
    without an entry in branchMap go with a diagnostic. An unrecognised report has no coverage but a diagnostic.
    """
    # each report is parsed as it lies; what isn't of that shape is looked at again under its only key
    flat = texts.select("text", F.explode(F.array(F.from_json("text", FLAT))).alias("entries")).withColumn("usable", _usable(F.col("entries")))
    others = flat.where("usable IS NULL OR NOT usable").select("text", F.explode(F.array(F.from_json("text", WRAPPED))).alias("wrapped"))
    others = others.select("text", F.when(F.size("wrapped") == 1, F.get(F.map_values("wrapped"), F.lit(0))).alias("entries")).withColumn("usable", _usable(F.col("entries")))
    entries = flat.where("usable").unionByName(others.where("usable"))
    unknown = others.where("usable IS NULL OR NOT usable").select(*_unknown(F.json_object_keys("text")))
    return coverage_of(entries.select(F.explode("entries").alias("key", "e")), unknown, discovered)


def coverage_of(entries: DataFrame, unknown: DataFrame, discovered: DataFrame | None) -> Coverage:
    """Coverage from entries (key, e, and at, which tells entries apart, where there are many) and the diagnostics of reports without any."""
    rows = entries.select("key", *[c for c in entries.columns if c == "at"], "e.*")
    for c in ("s", "statementMap", "b", "branchMap"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.from_json(F.lit("{}"), rows.schema[c].dataType)))
    if discovered is not None:
        resolved = longest_suffix_paths(rows.select(F.col("path").alias("source")), discovered).withColumnRenamed("source", "path")
        rows = rows.join(resolved, "path", "left")
    else:
        rows = rows.withColumn("file_path", F.col("path"))
    unresolved = rows.where("file_path IS NULL").select(F.col("path").alias("file_path"), F.lit("PathUnresolved").alias("kind"), F.concat(F.lit("path '"), "path", F.lit("' does not resolve to a discovered source file")).alias("message"))
    rows = rows.where("file_path IS NOT NULL")
    half = (F.size("s") == 0) != (F.size("statementMap") == 0)
    present = F.when(F.size("s") == 0, F.lit("statementMap")).otherwise(F.lit("s"))
    absent = F.when(F.size("s") == 0, F.lit("s")).otherwise(F.lit("statementMap"))
    missing = rows.where(half).select(F.col("path").alias("file_path"), F.lit("MissingField").alias("kind"), F.concat(F.lit("entry for '"), "path", F.lit("' has `"), present, F.lit("` records but `"), absent, F.lit("` is empty; one half of the statement-coverage pair is missing")).alias("message"))
    # of entries that resolve to one file the last key counts
    rows = rows.where(~half)
    if "at" in rows.columns:
        # entries stay where they are: only keys are compared, and what is joined are the files with several entries
        last = F.max(F.struct("key", "at")).alias("last")
        twice = staged(rows.groupBy("file_path").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1").select("file_path", "last"), "twice")
        rows = rows.join(twice, "file_path", "left").where(F.col("last").isNull() | F.struct("key", "at").eqNullSafe(F.col("last")))
    else:
        rows = rows.groupBy("file_path").agg(F.max_by(F.struct("path", "s", "statementMap", "b", "branchMap"), "key").alias("e")).select("file_path", "e.*")
    # statements and their places are paired before they become rows; as a rule both maps have the same keys in the same order
    keys = F.map_keys("s")
    alike = (keys == F.map_keys("statementMap")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    line_of = lambda at, hits: F.struct(at["start"]["line"].alias("line"), hits.alias("hits"))
    looked_up = F.transform(F.map_entries("s"), lambda x: line_of(F.try_element_at("statementMap", x["key"]), x["value"]))
    zipped = F.zip_with(F.map_values("statementMap"), F.map_values("s"), line_of)
    lines = rows.select("file_path", F.explode(F.when(alike, zipped).otherwise(looked_up)).alias("x")).select("file_path", "x.*").where("line IS NOT NULL")
    lines = lines.groupBy("file_path", "line").agg(F.min("hits").cast("decimal(20,0)").alias("hits"))
    arm = F.transform(F.map_entries("b"), lambda x: F.struct(x["key"].alias("branch"), x["value"].alias("taken"), F.try_element_at("branchMap", x["key"]).alias("at")))
    arms = rows.select("file_path", "path", F.explode(arm).alias("x")).select("file_path", "path", "x.*")
    orphans = arms.where("at IS NULL").select(F.col("path").alias("file_path"), F.lit("BranchMismatch").alias("kind"), F.concat(F.lit("branch coverage record for branchId `"), "branch", F.lit("` references no entry in branchMap")).alias("message"))
    branches = arms.where("at IS NOT NULL").select("file_path", F.coalesce("at.line", "at.loc.start.line").alias("line"), "branch", F.posexplode("taken").alias("arm", "hits"))
    branches = branches.select("file_path", "line", "branch", F.col("arm").cast("long").alias("arm"), F.col("hits").cast("decimal(20,0)").alias("taken"))
    problems = unknown.unionByName(unresolved).unionByName(missing).unionByName(orphans)
    return Coverage(lines, branches, rows.select("file_path").distinct(), problems)


def read_istanbul(spark: SparkSession, path: str | list[str], discovered: DataFrame | None = None) -> Coverage:
    """parse_reports of files. A file may be larger than a task's memory; its entries are rows."""
    parts = Parts(spark, path, "path")
    shaped = {name: r.depth for name, r in parts.reports.items() if r.closed and r.depth in (1, 2)}
    one = F.explode(F.array(F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), FLAT)))
    members = parts.members(shaped).select("report", "place", one.alias("one"))
    good = F.coalesce(_usable(F.col("one")), F.lit(False)) & (F.size("one") == 1)
    # parsed once; what reads lines takes only their columns from what is written
    members = staged(members.select("report", F.struct("report", "place").alias("at"), good.alias("good"), F.get(F.map_keys("one"), F.lit(0)).alias("key"), F.get(F.map_values("one"), F.lit(0)).alias("e")), "entries")
    bad = {r["report"] for r in members.where("NOT good").select("report").distinct().collect()}  # files, not entries
    odd = sorted(n for n in parts.reports if n not in shaped or n in bad)
    unknown = _unknown_reports(parts, odd) if odd else spark.createDataFrame([], DIAGNOSTICS)
    fine = members.where(~F.col("report").isin(sorted(bad))) if bad else members
    return coverage_of(fine.select("key", "at", "e"), unknown, discovered)


def _unknown_reports(parts: Parts, names: list[str]) -> DataFrame:
    """Diagnostics of reports that aren't of either shape, but for objects without entries, bare or under one key."""
    spark = parts.spark
    tops = parts.members({n: 1 for n in names if parts.reports[n].closed})
    own = F.json_object_keys(F.concat(F.lit("{"), F.col("text"), F.lit("}")))
    tops = tops.groupBy("report").agg(F.flatten(F.collect_list(own)).alias("keys"), F.bool_and(F.col("text").rlike(r'^\s*"[^"]*"\s*:\s*\{\s*\}\s*$')).alias("void"))
    bare = parts.rows.groupBy("report").agg(F.count_if(~F.col("text").rlike(r"^\s*\{\s*\}\s*$")).alias("other")).where("other = 0")
    named = spark.createDataFrame([(n,) for n in names], "report string").join(tops, "report", "left").join(bare, "report", "left_anti")
    return named.where("NOT (coalesce(void, false) AND size(keys) = 1)").select(*_unknown(F.col("keys")))


def has_data(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the report has a recognised shape and a filled statementMap.

    A report without anything like a filled statementMap is turned down at that; else entries are parsed up to the first that has one.
    """
    texts = spark.read.option("lineSep", '"statementMap"').text(path)
    if texts.where(F.col("value").rlike(r'^\s*:\s*\{\s*"')).limit(1).isEmpty():
        return False
    return not read_istanbul(spark, path).lines.limit(1).isEmpty()
