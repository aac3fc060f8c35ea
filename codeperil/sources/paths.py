"""Paths that reports name, as the paths that source files have below their root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The parts of a path, without empty ones and `.`."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def resolved_paths(sources: DataFrame, files: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """source, file_path and how: what each path of `sources` (source) means among `files` (file_path, below a root).

    In this order: what is left of the path behind the first of `roots` that it lies under, if that is a file (lexical); the
    longest of the path's ends that is a file (suffix); else what is left behind the root, or the path as it is (fallback).
    What holds `..` is never looked up, so no path leads out of a root, but an end behind it may be. Backslashes count as
    slashes. Nulls go; repeated paths give one row. A path has an end for each of its parts, and these meet the files by
    equality.
    """
    forward = F.translate("source", "\\", "/")
    rows = sources.where("source IS NOT NULL").select("source").distinct().withColumns({"forward": forward, "parts": components(forward), "absolute": forward.startswith("/")})
    strip, under = F.lit(0), F.lit(False)
    for root in reversed([r.replace("\\", "/") for r in roots]):
        own = [p for p in root.split("/") if p not in ("", ".")]
        fits = (F.col("absolute") == root.startswith("/")) & (F.slice("parts", 1, max(1, len(own))) == F.array(*map(F.lit, own)).cast("array<string>") if own else F.lit(True))
        strip, under = F.when(fits, F.lit(len(own))).otherwise(strip), fits | under
    rows = rows.withColumns({"strip": strip, "under": under})
    rest = F.slice("parts", F.col("strip") + 1, F.greatest(F.size("parts") - F.col("strip"), F.lit(0)))
    rows = rows.withColumns({"rest": rest, "lexical": F.when(F.col("under"), F.array_join(rest, "/")).otherwise(F.col("forward"))})
    ends = F.transform(F.col("parts"), lambda _, i: F.struct((i + 1).alias("turn"), F.slice("parts", i + 1, F.size("parts")).alias("end")))
    first = F.when(F.col("under") | ~F.col("absolute"), F.array(F.struct(F.lit(0).alias("turn"), F.col("rest").alias("end")))).otherwise(F.array().cast("array<struct<turn:int,end:array<string>>>"))
    tries = F.filter(F.concat(first, ends), lambda t: ~F.array_contains(t["end"], ".."))
    tried = rows.select("source", F.inline(F.transform(tries, lambda t: F.struct(t["turn"].alias("turn"), F.array_join(t["end"], "/").alias("file_path")))))
    known = files.select("file_path").where("file_path <> ''").distinct()
    best = tried.join(known, "file_path").groupBy("source").agg(F.min(F.struct("turn", "file_path")).alias("best"))
    how = F.when(F.col("best").isNull(), F.lit("fallback")).when(F.col("best.turn") == 0, F.lit("lexical")).otherwise(F.lit("suffix"))
    return rows.select("source", "lexical").join(best, "source", "left").select("source", F.coalesce("best.file_path", "lexical").alias("file_path"), how.alias("how"))
