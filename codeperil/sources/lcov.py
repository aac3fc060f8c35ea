"""LCOV coverage reports.

A report is read split at the lines that name a source file, so each row is one file's block and nothing has to be
carried from line to line; reports of any size are read in parallel, and blocks are parsed by the tasks that read them,
in their order. Line numbers are needed for diagnostics only: a task counts the lines of the stretch of a report that it
reads, and the stretches' running sums, a small table, join back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Hits are unsigned 64-bit numbers; sums stop at the largest.
MOST_HITS = (1 << 64) - 1
MOST_LINE = (1 << 63) - 1
DECIMAL = "decimal(20,0)"
LINE_NO = r"\+?0*[1-9][0-9]{0,18}"
NUMBER = r"\+?[0-9]+"
_LINE = r"\+?0*(?P<line>[1-9][0-9]{0,18})"
_U32 = r"\+?0*(?P<{}>[0-9]{{1,10}})"
_HITS = r"\+?0*(?P<hits>[0-9]{1,20})"


@dataclass(frozen=True)
class Coverage:
    """lines: file_path, line, hits. branches: file_path, line, block, branch, taken (null: never evaluated), or None
    where the source can't have any. files: file_path of all files with coverage. diagnostics: kind, line_number, content."""

    lines: DataFrame
    branches: DataFrame
    files: DataFrame
    diagnostics: DataFrame


def read_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """report, place (order of blocks in a report), block (a file's path, a line end, its records) and leads (whether it stands before the first file)."""
    rows = spark.read.option("lineSep", "\nSF:").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("report"), F.struct(F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("id")).alias("place"), F.col("value").alias("block"))
    firsts = rows.groupBy("report").agg(F.min("place").alias("place")).withColumn("begins", F.lit(True))
    rows = rows.join(F.broadcast(firsts), ["report", "place"], "left")  # a row for each file, and blocks stay in their order
    begins, opens = F.coalesce("begins", F.lit(False)), F.col("block").startswith("SF:")
    return rows.select("report", "place", F.when(begins & opens, F.substring(F.col("block"), 4, 1 << 30)).otherwise(F.col("block")).alias("block"), (begins & ~opens).alias("leads"))


def blocks_of(texts: DataFrame) -> DataFrame:
    """The same from a table of whole reports (report, text), small ones."""
    parts = texts.select("report", F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), "\nSF:", -1)).alias("pos", "block"))
    place = F.struct(F.lit(0).cast("long").alias("offset"), F.col("pos").cast("long").alias("id")).alias("place")
    # what stands before the first file begins with the line end that was put in front
    block = F.when(F.col("pos") == 0, F.substring(F.col("block"), 2, 1 << 30)).otherwise(F.col("block"))
    return parts.where("pos > 0 OR block <> ''").select("report", place, block.alias("block"), (F.col("pos") == 0).alias("leads"))


def parse_blocks(blocks: DataFrame, path_of=None) -> Coverage:
    """Coverage from blocks. path_of: a column function that turns a report's path into the functions' path.

    Records other than DA and BRDA are ignored, as is the end of a block: it ends where the next file begins. Records
    before the first file go silently; a file without a name gives a diagnostic and its records go. Malformed records
    give a diagnostic and the rest counts. Hits of one line, in any number of blocks, add up; so do branches, where null
    (never evaluated) adds nothing.

    Batches of blocks are parsed as a whole, each kind of record by itself and only if something reads it. A file's block
    is one row, so it must fit in a task's memory. A stretch's blocks (of one report and offset) lie in one partition, in
    their order, as read_blocks and blocks_of give them.
    """
    ship(blocks.sparkSession)
    named = blocks.where("NOT leads")
    path = path_of(F.col("source")) if path_of else F.col("source")
    total = lambda x: F.sum(f"{x}_high").cast("decimal(25,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.sum(f"{x}_low").cast("decimal(25,0)")
    capped = lambda x: F.when(F.count(f"{x}_low") > 0, F.least(total(x), F.lit(str(MOST_HITS)).cast("decimal(38,0)"))).cast(DECIMAL)
    lines = named.select("block").mapInArrow(_parsed(_line_columns), "source string, line long, hits_high long, hits_low long")
    lines = lines.select(path.alias("file_path"), "line", "hits_high", "hits_low").groupBy("file_path", "line").agg(capped("hits").alias("hits"))
    branches = named.select("block").mapInArrow(_parsed(_branch_columns), "source string, line long, block long, branch long, taken_high long, taken_low long")
    branches = branches.withColumn("file_path", path).groupBy("file_path", "line", "block", "branch").agg(capped("taken").alias("taken"))
    found = blocks.select("block", "report", "place.offset", "leads").mapInArrow(_faults, "report string, offset long, kind string, nth long, content string")
    found = found.join(line_bases(blocks), ["report", "offset"])
    found = found.select("kind", (F.col("before") + F.col("nth")).alias("line_number"), "content")
    return Coverage(lines, branches, lines.select("file_path").distinct(), found)


@dataclass(frozen=True)
class _Lines:
    """The lines of a batch's blocks: text, the block that each is of, its number there from 0; and the blocks' sources."""

    text: pa.Array
    block: np.ndarray
    number: np.ndarray
    source: pa.Array

    def of(self, prefix: str) -> _Lines:
        """Those with a prefix, of blocks that have a source."""
        named = pc.not_equal(self.source, "").to_numpy(zero_copy_only=False)
        some = pc.starts_with(self.text, prefix).to_numpy(zero_copy_only=False) & named[self.block] & (self.number > 0)
        return _Lines(self.text.filter(pa.array(some)), self.block[some], self.number[some], self.source)


def _lines_of(blocks: pa.Array) -> _Lines:
    lists = pc.split_pattern(blocks, "\n")
    text = lists.flatten()
    if pc.any(pc.ends_with(text, "\r")).as_py():
        text = pc.replace_substring_regex(text, "\r$", "")
    starts = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:-1]]).astype(np.int64)
    block = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return _Lines(text, block, np.arange(len(text)) - starts[block], text.take(pa.array(starts)))


def _number(digits: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers without leading zeros, and whether each is there and at most `most`."""
    size, width = pc.binary_length(digits), len(str(most))
    fits = pc.or_(pc.less(size, width), pc.and_(pc.equal(size, width), pc.less_equal(digits, str(most))))
    fits = pc.fill_null(pc.and_(fits, pc.greater(size, 0)), False)
    return pc.if_else(fits, digits, "0").cast(pa.uint64()).to_numpy(zero_copy_only=False), fits.to_numpy(zero_copy_only=False)


def _da(lines: _Lines) -> tuple[_Lines, np.ndarray, list[np.ndarray]]:
    """The DA records, whether each is well-formed, and line and hits."""
    some = lines.of("DA:")
    parts = pc.extract_regex(some.text, rf"^DA:{_LINE},{_HITS}(?:,.*)?$")
    (line, line_ok), (hits, hits_ok) = _number(parts.field("line"), MOST_LINE), _number(parts.field("hits"), MOST_HITS)
    return some, line_ok & hits_ok & parts.is_valid().to_numpy(zero_copy_only=False), [line, hits]


def _brda(lines: _Lines) -> tuple[_Lines, np.ndarray, list[np.ndarray]]:
    """The BRDA records, whether each is well-formed, and line, block, branch, taken and whether it was evaluated."""
    some = lines.of("BRDA:")
    parts = pc.extract_regex(some.text, rf"^BRDA:{_LINE},{_U32.format('block')},{_U32.format('branch')},(?:(?P<dash>-)|{_HITS})$")
    numbers = [_number(parts.field(name), most) for name, most in (("line", MOST_LINE), ("block", (1 << 32) - 1), ("branch", (1 << 32) - 1), ("hits", MOST_HITS))]
    dash = pc.fill_null(pc.equal(parts.field("dash"), "-"), False).to_numpy(zero_copy_only=False)
    ok = numbers[0][1] & numbers[1][1] & numbers[2][1] & (numbers[3][1] | dash) & parts.is_valid().to_numpy(zero_copy_only=False)
    return some, ok, [*(n for n, _ in numbers), ~dash]


def _parsed(columns: Callable[[_Lines], dict[str, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                named = columns(_lines_of(batch.column(0)))
                yield pa.RecordBatch.from_arrays(list(named.values()), list(named))

    return parse


def _halves(name: str, x: np.ndarray, there: np.ndarray | None = None) -> dict[str, pa.Array]:
    """Sums of 64-bit numbers stay exact if their halves are added up."""
    absent = None if there is None else ~there
    return {f"{name}_high": pa.array((x >> np.uint64(32)).astype(np.int64), mask=absent), f"{name}_low": pa.array((x & np.uint64(0xFFFFFFFF)).astype(np.int64), mask=absent)}


def _line_columns(lines: _Lines) -> dict[str, pa.Array]:
    some, ok, (line, hits) = _da(lines)
    return {"source": some.source.take(pa.array(some.block[ok])), "line": pa.array(line[ok].astype(np.int64)), **_halves("hits", hits[ok])}


def _branch_columns(lines: _Lines) -> dict[str, pa.Array]:
    some, ok, (line, block, branch, taken, evaluated) = _brda(lines)
    whole = {name: pa.array(x[ok].astype(np.int64)) for name, x in (("line", line), ("block", block), ("branch", branch))}
    return {"source": some.source.take(pa.array(some.block[ok])), **whole, **_halves("taken", taken[ok], evaluated[ok])}


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Diagnostics of blocks (block, report, offset, leads), which come in their order; nth: the line of the stretch, from 1."""
    now, passed = None, 0  # the stretch, and its lines so far
    for batch in batches:
        if not len(batch):
            continue
        base = np.zeros(len(batch), np.int64)
        sizes = pc.add(pc.count_substring(batch.column(0), "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(sizes) - sizes
        report, offset = batch.column(1), batch.column(2)
        new = pc.or_(pc.not_equal(report[1:], report[:-1]), pc.not_equal(offset[1:], offset[:-1])) if len(batch) > 1 else pa.array([], pa.bool_())
        heads = np.concatenate([[0], np.flatnonzero(pc.fill_null(new, False).to_numpy(zero_copy_only=False)) + 1])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(batch)], strict=True):
            here = (report[a].as_py(), offset[a].as_py())
            passed = passed if here == now else 0
            base[a:b] = before[a:b] - before[a] + passed
            now, passed = here, passed + int(sizes[a:b].sum())
        counts = ~batch.column(3).to_numpy(zero_copy_only=False)
        batch, base = batch.filter(pa.array(counts)), base[counts]
        if not len(batch):
            continue
        lines = _lines_of(batch.column(0))
        nameless = np.flatnonzero(pc.equal(lines.source, "").to_numpy(zero_copy_only=False))
        found = [(nameless, np.zeros(len(nameless), np.int64), pa.nulls(len(nameless), pa.string()), "EmptySourceFile")]
        for some, ok, _ in (_da(lines), _brda(lines)):
            found.append((some.block[~ok], some.number[~ok], some.text.filter(pa.array(~ok)), "MalformedRecord"))
        for block, number, content, kind in found:
            at = pa.array(block)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in (1, 2)), pa.array([kind] * len(block), pa.string()), pa.array(base[block] + number + 1), content.cast(pa.string())],
                ["report", "offset", "kind", "nth", "content"],
            )


def line_bases(blocks: DataFrame) -> DataFrame:
    """report, offset and before (the lines of a report before a stretch that was read together)."""
    whole = blocks.select("report", F.col("place.offset").alias("offset"), (F.regexp_count("block", F.lit("\n")) + 1).alias("n")).groupBy("report", "offset").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("report").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    return whole.select("report", "offset", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))


def read_lcov(spark: SparkSession, path: str | list[str], path_of=None) -> Coverage:
    return parse_blocks(read_blocks(spark, path), path_of)


def has_data(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the report has a well-formed DA record behind a file's name; as a rule it looks no further than the first two."""
    well_formed = F.col("block").rlike(rf"\nDA:{LINE_NO},{NUMBER}(?:,|\r?\n|\r?$)")
    blocks = spark.read.option("lineSep", "\nSF:").text(path).select(F.col("value").alias("block"), F.col("_metadata.file_path").alias("report"))
    some = blocks.where(well_formed).select("report", F.col("block").startswith("SF:").alias("opens")).limit(2).collect()
    if any(r["opens"] for r in some) or (len(some) == 2 and some[0]["report"] == some[1]["report"]):
        return True  # of a report's blocks only its first can stand before a file's name
    return bool(some) and not read_blocks(spark, path).where("NOT leads").where(well_formed).limit(1).isEmpty()


def longest_suffix_paths(sources: DataFrame, discovered: DataFrame) -> DataFrame:
    """source and file_path: a report's path and the discovered path that is its longest suffix.

    The suffixes of report paths (a handful each) join with the discovered paths by equality. Without a match, or with
    `..` in what matches, there is no row.
    """
    clean = F.translate("source", "\\", "/")
    parts = F.split(clean, "/")
    suffixes = sources.select("source").distinct().select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("file_path"))
    met = suffixes.where("file_path <> '' AND NOT array_contains(split(file_path, '/'), '..')").join(discovered.select("file_path").distinct(), "file_path")
    best = met.groupBy("source").agg(F.max_by("file_path", F.length("file_path")).alias("file_path"))
    return best
