"""Restriction of files and functions to what a diff touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dyadic import at_nodes, nodes


def changed_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files (file_path, ...) that the diff has."""
    return files.join(changes.select("file_path").distinct(), "file_path", "left_semi")


def changed_functions(functions: DataFrame, changes: DataFrame) -> DataFrame:
    """Functions of new files, and those whose span overlaps a changed stretch (both ends included).

    Two stretches overlap if one begins in the other. So a function is changed if a node of its span holds the first line of
    a stretch, or its own first line lies in a node of one: two semi joins on nodes, which pair nothing.
    """
    new = changes.where("is_new").select("file_path").distinct()
    of_new = functions.join(new, "file_path", "left_semi").select("ordinal")
    hunks = changes.where("NOT is_new AND start_line IS NOT NULL AND start_line <= end_line").select("file_path", "start_line", "end_line")
    own = functions.where("start_line <= end_line").select("ordinal", "file_path", "start_line", "end_line")
    keys, place = ["file_path", "level", "node"], ["ordinal", "file_path"]
    begins = at_nodes(hunks, "start_line", own, "start_line", "end_line", ["file_path"]).distinct()
    holding = own.select(*place, F.inline(nodes(F.col("start_line"), F.col("end_line")))).join(begins.hint("merge"), keys, "left_semi")
    touched = hunks.select("file_path", F.inline(nodes(F.col("start_line"), F.col("end_line")))).distinct()
    inside = at_nodes(own, "start_line", hunks, "start_line", "end_line", place).join(touched.hint("merge"), keys, "left_semi")
    met = holding.select("ordinal").unionByName(inside.select("ordinal"))
    return functions.join(of_new.unionByName(met).distinct(), "ordinal", "left_semi").select(*functions.columns)


def remapped_changes(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """Changes with a repository path turned into the path that functions have; others go. paths: repo_path, file_path."""
    return changes.withColumnRenamed("file_path", "repo_path").join(paths, "repo_path").select("file_path", "is_new", "start_line", "end_line")
