"""Unified diffs (``git diff --unified=0 --no-prefix``) as changed stretches of files."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a hunk's header.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_text(reference: str, folder: str = ".", paths: Sequence[str] = ()) -> str:
    """The diff of the working tree in `folder` against `reference`."""
    if reference.startswith("-") or not reference:
        raise ValueError(f"not a reference: {reference!r}")
    command = ["git", "diff", "--unified=0", "--no-prefix", "--no-color", "--diff-filter=ACMR", reference, "--", *paths]
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return done.stdout


def parse_diff(diffs: DataFrame) -> DataFrame:
    """file_path, is_new, start_line, end_line from a table of diffs (text): a row for each new file, and for each changed stretch.

    A file's part of a diff begins at its header. Hunks that only delete have no stretch, an omitted count is 1, a deleted
    file has no rows; a file that is new anywhere is new.
    """
    parts = diffs.select(F.explode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=diff --git)", -1)).alias("part"))
    parts = parts.select(F.split("part", r"\r?\n", -1).alias("lines"))
    is_new = F.exists("lines", lambda x: x.startswith("new file mode"))
    target = F.get(F.filter("lines", lambda x: x.startswith("+++ ")), F.lit(0))
    parts = parts.select(F.translate(F.substring(target, 5, 1 << 30), "\\", "/").alias("file_path"), is_new.alias("is_new"), F.filter("lines", lambda x: x.startswith("@@ ")).alias("hunks"))
    parts = parts.where("file_path IS NOT NULL AND file_path <> '/dev/null' AND size(hunks) > 0")
    new = parts.where("is_new").select("file_path").distinct()
    hunks = parts.where("NOT is_new").select("file_path", F.explode("hunks").alias("h")).where(F.col("h").rlike(HUNK))
    start = F.regexp_extract("h", HUNK, 1).cast("long")
    size = F.when(F.regexp_extract("h", HUNK, 2) == "", 1).otherwise(F.regexp_extract("h", HUNK, 2).try_cast("long"))
    spans = hunks.select("file_path", start.alias("start_line"), size.alias("n")).where("n > 0").join(new, "file_path", "left_anti")
    spans = spans.select("file_path", F.lit(False).alias("is_new"), "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))
    none = F.lit(None).cast("long")
    return spans.unionByName(new.select("file_path", F.lit(True).alias("is_new"), none.alias("start_line"), none.alias("end_line")))


def read_diff(spark: SparkSession, reference: str, folder: str = ".", paths: Sequence[str] = ()) -> DataFrame:
    return parse_diff(spark.createDataFrame([(diff_text(reference, folder, paths),)], "text string"))
