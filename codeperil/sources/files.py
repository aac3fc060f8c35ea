"""Source files: which there are, their text, and the functions in them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FUNCTIONS
from ..shipping import ship

EXTENSIONS = {"rust": ("rs",), "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs")}


def _ignore_regex(pattern: str, base: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of an ignore file below `base` (a relative folder): pattern, whether it takes back, whether for folders only."""
    line = pattern.rstrip("\n").rstrip(" ") if not pattern.endswith("\\ ") else pattern.rstrip("\n")
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line.removeprefix("\\")
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out, at = out + "/.*", at + 3
        elif line[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif line[at] == "?":
            out, at = out + "[^/]", at + 1
        elif line[at] == "[" and "]" in line[at + 2 :]:
            end = line.index("]", at + 2)
            body = line[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, at = out + re.escape(line[at]), at + 1
    prefix = re.escape(base + "/") if base else ""
    return re.compile(prefix + ("" if anchored else "(?:.*/)?") + out + r"\Z"), back, folders


def _ignored(rules: Sequence[tuple[re.Pattern, bool, bool]], path: str, folder: bool) -> bool:
    hit = False
    for rx, back, folders in rules:
        if (folder or not folders) and rx.match(path):
            hit = not back
    return hit


def discover(root: str | Path, extensions: Sequence[str], exclude: Sequence[str] = (), gitignore: bool = True) -> list[Path]:
    """Regular files below `root` with one of the extensions (case counts), sorted. Hidden entries, ignored ones (in a git
    work tree, unless gitignore is off) and those that an exclude glob fits are left out."""
    root = Path(root)
    in_git = any((p / ".git").exists() for p in (root.resolve(), *root.resolve().parents))
    excluded = [r for r in (_ignore_regex(p, "") for p in exclude) if r]
    found: list[Path] = []

    def walk(folder: Path, relative: str, rules: list) -> None:
        names = [".ignore"] + [".gitignore"] * (gitignore and in_git)
        own = list(rules)
        for name in reversed(names):
            if (folder / name).is_file():
                own += [r for r in (_ignore_regex(x, relative) for x in (folder / name).read_text(errors="replace").splitlines()) if r]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{relative}/{entry.name}" if relative else entry.name
            is_folder = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or _ignored(own, path, is_folder) or _ignored(excluded, path, is_folder):
                continue
            if is_folder:
                walk(Path(entry.path), path, own)
            elif entry.is_file(follow_symlinks=False) and entry.name.rpartition(".")[2] in extensions and "." in entry.name[1:]:
                found.append(Path(entry.path))

    walk(root, "", [])
    return sorted(found)


def discover_roots(roots: Sequence[str | Path], extensions: Sequence[str], exclude: Sequence[str] = (), gitignore: bool = True, base: str | Path | None = None) -> list[tuple[str, str]]:
    """(file_path, path) of all roots. One root: paths relative to it. More: relative to `base` (the repository); of a file
    below several roots the first counts. Sorted by path."""
    seen: dict[str, str] = {}
    for root in roots:
        for path in discover(root, extensions, exclude, gitignore):
            key = path.resolve().relative_to(Path(base).resolve()) if len(roots) > 1 and base is not None else path.relative_to(root)
            seen.setdefault(key.as_posix(), str(path))
    return sorted(seen.items(), key=lambda x: x[1])


def read_sources(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """file_path, place and text of listed files. The list is joined by path, the texts are read by the executors."""
    schema = "file_path string, path string, place long"
    listed = spark.createDataFrame([(k, Path(p).resolve().as_uri(), n) for n, (k, p) in enumerate(files)], schema)
    if not files:
        return listed.select("file_path", "place", F.lit("").alias("text"))
    texts = spark.read.text([str(Path(p).resolve()) for _, p in files], wholetext=True).select(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("at"), F.col("value").alias("text"))
    return listed.withColumn("at", F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:///", "file:/"), r"\+", "%2B"))).join(texts.withColumn("at", F.regexp_replace("at", "^file:///", "file:/")), "at").select("file_path", "place", "text")


EXTRACTED = "file_path string, place long, n long, error string, qualified_name string, start_line long, end_line long, start_column long, end_column long, complexity long, metric string, contributors array<struct<kind: string, line: long, column: long, increment: long, end_line: long, nesting_depth: long>>"
_ONE = pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("line", "column", "increment", "end_line", "nesting_depth"))])
ARROW = pa.schema([("file_path", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("error", pa.string()), ("qualified_name", pa.string()), *((n, pa.int64()) for n in ("start_line", "end_line", "start_column", "end_column", "complexity")), ("metric", pa.string()), ("contributors", pa.list_(_ONE))])


class MetricNotSupported(ValueError):
    """The language has no such metric."""


def extract(sources: DataFrame, language: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """The functions of source texts (schema FUNCTIONS), and the files that can't be parsed (file_path, error)."""
    if language == "typescript" and metric != "cyclomatic":
        raise MetricNotSupported(f"{metric} complexity is not yet supported for {language}")
    if language not in EXTENSIONS:
        raise ValueError(f"unknown language {language!r}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        from codeperil.sources import rust, typescript

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = {"file_path": r["file_path"], "place": r["place"]}
                try:
                    found = rust.rust_functions(r["text"] or "", metric) if language == "rust" else typescript.script_functions(r["text"] or "", r["file_path"])
                    rows += [{**key, "n": n, **f} for n, f in enumerate(found)]
                except (ValueError, RecursionError) as error:
                    rows.append({**key, "n": 0, "error": str(error) or type(error).__name__})
            yield from pa.Table.from_pylist(rows, ARROW).to_batches()

    ship(sources.sparkSession)
    # parsing takes far longer than reading, and a small table of many files may lie in one partition
    context = sources.sparkSession.sparkContext
    parts = max(4 * context.defaultParallelism, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sources.select("file_path", "place", "text").repartition(parts, "place").mapInArrow(parse, EXTRACTED)
    functions = rows.where("error IS NULL").withColumn("ordinal", F.col("place") * F.lit(1 << 24) + F.col("n")).select(*FUNCTIONS.fieldNames())
    return functions, rows.where("error IS NOT NULL").select("file_path", "error")
