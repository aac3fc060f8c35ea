"""Members of large JSON objects as rows, whatever the size of the object.

A file is read split at a word that comes about once in each member, so any number of tasks reads it by byte ranges. What a
quote or a brace means depends on all that stands before it: whether a string is open, and how many braces are. Each task
first works out, for its range and each way in which it may begin, how it ends and how deep it goes; these results, one
small row for each range, are composed in order and tell every range how it begins. A second reading then cuts each range
at the commas between members, and the pieces of a member, which may lie in several ranges, meet in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import staged

#: How a range may begin: outside strings, in one, in one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
#: Bits of an offset; above them stands the number of the part, where a folder is one file.
_FILE_BITS = 40
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


@dataclass(frozen=True)
class Marks:
    """Of some text: where it is outside strings, the depth behind each byte, and how it ends."""

    outside: np.ndarray
    depth: np.ndarray
    state: int


def marks(data: np.ndarray, state: int, depth: int) -> Marks:
    if not len(data):
        return Marks(np.zeros(0, bool), np.zeros(0, np.int64), state)
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, place, -1))  # the last byte up to here that is no backslash
    run = np.concatenate([[0], place[:-1] - plain[:-1]])  # backslashes right before each byte
    if state == ESCAPED:
        run[np.concatenate([[-1], plain[:-1]]) < 0] += 1
    quote = (data == _QUOTE) & (run % 2 == 0)
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1  # behind each byte
    outside = ~inside & ~quote
    depths = depth + np.cumsum(np.where(outside, _STEP[data], 0), dtype=np.int64)
    left = len(data) - 1 - int(plain[-1]) + (state == ESCAPED and plain[-1] < 0)
    return Marks(outside, depths, (ESCAPED if left % 2 else INSIDE) if inside[-1] else OUTSIDE)


@dataclass(frozen=True)
class Report:
    """A file: the depth of the members asked for (that of the shallowest key `word`, less one; 0 if there is none), and whether it begins with a brace and all strings and braces close."""

    depth: int
    closed: bool


class Parts:
    """The members of the JSON objects in files. word: a key that each member has. folder: the files of a folder, part-00000 and so on, are one."""

    def __init__(self, spark: SparkSession, path: str | list[str], word: str, folder: bool = False):
        self.spark, self.token = spark, f'"{word}"'
        ship(spark)
        rows = spark.read.option("lineSep", self.token).text(path)
        report, offset = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        if folder:
            report = F.regexp_replace(report, "/[^/]*$", "")
            part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1)
            offset = offset + F.coalesce(part.try_cast("long"), F.lit(0)) * (1 << _FILE_BITS)
        self.rows = rows.select(report.alias("report"), offset.alias("offset"), F.col("value").alias("text"))
        ranges = self.rows.mapInArrow(_summaries(self.token), "report string, offset long, opens boolean, ends array<int>, rises array<long>, keys array<long>").collect()  # a row for each range
        by_report: dict[str, list] = {}
        for r in sorted(ranges, key=lambda r: (r["report"], r["offset"])):
            by_report.setdefault(r["report"], []).append(r)
        self.reports: dict[str, Report] = {}
        self.begins: dict[tuple[str, int], tuple[int, int]] = {}
        for report, some in by_report.items():
            state = depth = 0
            keys = []
            for r in some:
                self.begins[report, r["offset"]] = (state, depth)
                if r["keys"][state] is not None:
                    keys.append(depth + r["keys"][state])
                state, depth = r["ends"][state], depth + r["rises"][state]
            self.reports[report] = Report(min(keys, default=1) - 1, some[0]["opens"] and (state, depth) == (OUTSIDE, 0))

    def members(self, depth_of: dict[str, int], shallow: bool = False) -> DataFrame:
        """Members at the depth that is named for each report: report, place (offset of a range, number in it), text (a key, a colon and its value, or an array's element) and inside (the key of the object or array around).

        Number -1 stands for a comma further up, between the objects around. shallow: 0 stands for each object or array in
        a member.
        """
        held = self.spark.sparkContext.broadcast({key: (*begin, depth_of[key[0]]) for key, begin in self.begins.items() if key[0] in depth_of})
        pieces = staged(self.rows.mapInArrow(_pieces(self.token, held, shallow), "report string, offset long, number long, nth long, text string, inside string, whole boolean"), "pieces")
        named = F.max(F.when(F.col("inside").isNotNull(), F.struct("number", "inside")))["inside"]
        last = {(r["report"], r["offset"]): r for r in pieces.where("number > 0").groupBy("report", "offset").agg(F.max("number").alias("n"), named.alias("inside")).collect()}  # a row for each range
        owners, before = [], {}
        for report, offset in sorted(held.value):
            first, number, inside = before.get(report, (offset, 0, None))
            owners.append((report, offset, first, number, inside))
            if (r := last.get((report, offset))) is not None:
                before[report] = (offset, r["n"], inside if r["inside"] is None else r["inside"])
        owner = self.spark.createDataFrame(owners, "report string, offset long, first long, n long, around string")
        placed = pieces.join(owner, ["report", "offset"]).withColumn("place", F.when(F.col("number") == 0, F.struct(F.col("first").alias("offset"), F.col("n").alias("number"))).otherwise(F.struct("offset", "number")))
        # only what a range's ends cut is shuffled
        ready = placed.where("whole").select("report", "place", "text", F.coalesce("inside", "around").alias("inside"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "nth", "text"))), lambda p: p["text"]), "")
        met = placed.where("NOT whole").groupBy("report", "place").agg(whole.alias("text"), F.max(F.when(F.col("number") >= 0, F.coalesce("inside", "around"))).alias("inside"))
        return ready.unionByName(met).where(~F.col("text").rlike("^\\s*$") | (F.col("place.number") < 0))


def _ranges(batches: Iterator[pa.RecordBatch], token: str) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """(report, offset), text and whether it begins with the token, in order."""
    now = None
    for batch in batches:
        for report, offset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            head = offset % (1 << _FILE_BITS) == 0 and (report, offset) != now  # what stands before a file's first token
            now = (report, offset)
            yield now, (text.as_py() if head else token + text.as_py()).encode(), not head


def _summaries(token: str):
    size = len(token)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opens, ends, rises, keys = None, False, [0, 0, 0], [0, 0, 0], [None, None, None]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"report": [now[0]], "offset": pa.array([now[1]], pa.int64()), "opens": [opens], "ends": pa.array([ends], pa.list_(pa.int32())), "rises": pa.array([rises], pa.list_(pa.int64())), "keys": pa.array([keys], pa.list_(pa.int64()))}
            )

        for place, text, leads in _ranges(batches, token):
            if place != now:
                if now is not None:
                    yield done()
                now, ends, rises, keys = place, [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0], [None, None, None]
                opens = not leads and text.lstrip()[:1] == b"{"
            data = np.frombuffer(text, np.uint8)
            is_key = leads and text[size:].lstrip()[:1] == b":"
            seen: dict[int, Marks] = {}
            for i in range(3):
                state = ends[i]
                if is_key and state == OUTSIDE:
                    keys[i] = rises[i] if keys[i] is None else min(keys[i], rises[i])
                if state not in seen:
                    seen[state] = marks(data, state, 0)
                ends[i] = seen[state].state
                rises[i] += int(seen[state].depth[-1]) if len(data) else 0
        if now is not None:
            yield done()

    return work


def _pieces(token: str, held, shallow: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        member: list[str] = []  # the text of the member that is open, so far
        within = False
        for place, text, _ in _ranges(batches, token):
            if place not in held.value:
                continue
            if place != now:
                if within:
                    out.append((*now, number, began, "".join(member), inside, False))
                now, number, nth, began, inside, member = place, 0, 0, 0, None, []
                state, depth, at = held.value[place]
                within = depth >= at
            data = np.frombuffer(text, np.uint8)
            m = marks(data, state, depth)
            comma = m.outside & (data == _COMMA)
            opens, closes = m.outside & (_STEP[data] > 0), m.outside & (_STEP[data] < 0)
            cut = np.flatnonzero((comma & (m.depth == at)) | (opens & (m.depth == at)) | (closes & (m.depth == at - 1)))
            if (comma & (m.depth < at) & (m.depth > 0)).any():
                out.append((*place, -1, nth, "", None, False))
            deep = opens & (m.depth == at + 1)
            stays = (m.depth <= at) & ~(closes & (m.depth == at)) | deep if shallow else None
            a = 0
            for b in [*cut.tolist(), len(data)]:
                if within and b > a:
                    piece = text[a:b]
                    if shallow:
                        piece = np.where(deep[a:b], ord("0"), data[a:b])[stays[a:b]].astype(np.uint8).tobytes()
                    if piece:
                        member.append(piece.decode())
                nth += 1
                if b < len(data):
                    if within:
                        out.append((*place, number, began, "".join(member), inside, number > 0))
                        size += len(out[-1][4])
                    member, began = [], nth
                    within = not closes[b]
                    number += int(within)
                    if opens[b]:
                        named = _NAME.search(text[max(0, b - 1000) : b])
                        inside = named[1].decode() if named else ""
                    a = b + 1
            if len(data):
                state, depth = m.state, int(m.depth[-1])
            if size > 1 << 22 or len(out) > 10_000:
                yield _piece_batch(out)
                out, size = [], 0
        if within:
            out.append((*now, number, began, "".join(member), inside, False))
        if out:
            yield _piece_batch(out)

    return work


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["report", "offset", "number", "nth", "text", "inside", "whole"])
