"""Periodic runs of words: stretches that repeat a period again and again.

A run is a stretch of consecutive words with smallest period q, long enough, that no neighbouring word extends keeping
period q. Each text is searched on its own, on the executors:

1. Words that can't lie in a run go first: in a run every group of g neighbouring words comes back often enough, so stretches
   are cut where a group is too rare. This is exact; only what is left goes on.
2. A suffix automaton of the stretch is built word by word. Its states are merged from long to short, the smaller ordered
   set of end positions into the larger. Two end positions that become neighbours in a state of length n, d apart, end
   equal stretches of n words: if n >= d these words and the d before them form a square of period d. The state's length
   is the longest common one, so the square's first word is also that of its run.
3. The squares of one first word and period reach up to the run's last word; a period goes if a smaller one divides it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship

#: Groups of so many words are counted before the automaton is built.
GROUPS = (3, 5)
#: Positions in a block of an ordered set; a block of twice as many is split.
BLOCK = 512


@dataclass(frozen=True)
class Runs:
    """A run has at least `least_words` words and `exponent` times its period (2 or more)."""

    least_words: int = 6
    exponent: int = 4

    def __post_init__(self) -> None:
        if self.exponent < 2 or self.least_words < 2:
            raise ValueError("exponent and least_words must be 2 or more")

    def needed(self, g: int) -> int:
        """How often a group of g words of a run comes in it, at least: at distances of the period q, in max(least_words, exponent * q) words."""
        return min((max(self.least_words, self.exponent * q) - g + 1) // q for q in range(1, g + self.least_words + 1))


class EndPositions:
    """An ordered set of whole numbers in blocks, so that adding one moves few others."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks = [[position]]
        self.firsts = [position]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def neighbours(self, x: int) -> tuple[int, int]:
        """The largest below and the smallest above x, which is not in the set; -1 where there is none."""
        b = bisect_right(self.firsts, x) - 1
        if b < 0:
            return -1, self.firsts[0]
        block = self.blocks[b]
        i = bisect_left(block, x)
        if i < len(block):
            return block[i - 1], block[i]
        return block[-1], self.firsts[b + 1] if b + 1 < len(self.firsts) else -1

    def add(self, x: int) -> None:
        b = max(0, bisect_right(self.firsts, x) - 1)
        block = self.blocks[b]
        insort(block, x)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) >= 2 * BLOCK:
            self.blocks.insert(b + 1, block[BLOCK:])
            del block[BLOCK:]
            self.firsts.insert(b + 1, self.blocks[b + 1][0])


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: each state's length, its suffix link (the root is state 0, its link -1), and the end position that made it (-1 for copies)."""
    length, link, end = [0], [-1], [-1]
    follow: list[dict[int, int]] = [{}]
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        follow.append({})
        p = last
        while p >= 0 and word not in (there := follow[p]):
            there[word] = new
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                follow.append(follow[q].copy())
                link[q] = link[new] = copy
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = copy
                    p = link[p]
        last = new
    return length, link, end


def runs_of(words: list[int], how: Runs) -> list[tuple[int, int, int]]:
    """start, length and period of all runs, by start and period."""
    length, link, end = automaton(words)
    times, least = how.exponent - 1, how.least_words
    squares: dict[tuple[int, int], int] = {}  # first word and period: last word

    def seed(low: int, high: int, common: int) -> None:
        d = high - low
        if low >= 0 and high >= 0 and d * times <= common and common + d >= least:
            key = (low - common + 1, d)
            if squares.get(key, -1) < high:
                squares[key] = high

    sets: list[EndPositions | None] = [EndPositions(e) if e >= 0 else None for e in end]
    for state in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        own, up = sets[state], link[state]
        sets[state] = None
        if own is None or up < 0 or length[up] < times:  # above, no distance is short enough
            continue
        other = sets[up]
        if other is None:
            sets[up] = own
            continue
        large, small = (own, other) if own.size > other.size else (other, own)
        common, added = length[up], list(small)
        for x in added:  # all of them before any is added: only pairs from both sides share no more than `common` words
            below, above = large.neighbours(x)
            seed(below, x, common)
            seed(x, above, common)
        for x in added:
            large.add(x)
        sets[up] = large
    found: dict[int, list[tuple[int, int]]] = {}
    for (start, d), last in sorted(squares.items()):
        smaller = found.setdefault(start, [])
        if not any(d % q == 0 and reach >= start + d - 1 for q, reach in smaller):
            smaller.append((d, last))
    return [(start, last - start + 1, d) for start, some in found.items() for d, last in some]


def stretches(codes: np.ndarray, how: Runs) -> list[tuple[int, int]]:
    """Where runs can be: parts (begin, end) of a text in which every group of words is frequent enough. Equal words have equal codes."""
    out, todo = [], [(0, len(codes))]
    filters = [(g, n) for g in GROUPS if g <= how.least_words and (n := how.needed(g)) > 1]
    while todo:
        a, b = todo.pop()
        if b - a < max(how.least_words, how.exponent):
            continue
        for g, needed in filters:
            groups = codes[a : b - g + 1].copy()
            for i in range(1, g):
                groups *= np.uint64(0x9E3779B97F4A7C15)
                groups += codes[a + i : b - g + 1 + i]
            _, place, count = np.unique(groups, return_inverse=True, return_counts=True)
            good = count[place] >= needed
            if not good.all():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
                todo += [(a + int(u), a + int(v) + g - 1) for u, v in zip(edges[::2], edges[1::2], strict=True)]
                break
        else:
            out.append((a, b))
    return sorted(out)


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a whole text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []  # of bytes, split() knows just these six blanks


def text_runs(words: list[bytes], how: Runs) -> list[tuple[int, int, int]]:
    """start, length and period of all runs of a text, by start and period."""
    if len(words) < max(how.least_words, how.exponent):
        return []
    out = []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for a, b in stretches(codes, how):
        number: dict[bytes, int] = {}
        found = runs_of([number.setdefault(w, len(number)) for w in words[a:b]], how)
        out += [(a + start, size, period) for start, size, period in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run contains after its first period."""
    if runs:
        stays = np.ones(len(words), bool)
        for start, size, period in runs:
            stays[start + period : start + size] = False
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, how: Runs | None = None, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: id_col, n_words, runs (array of start, length, period, by start and period), collapsed (the text without repeats).

    edit: makes the words to search from the identifier and the words. Null and empty texts have no words and no runs.
    Repeated rows come out alike, null identifiers stay, an empty table gives an empty result. Other columns are not
    looked at. A text is one piece of work; the automaton takes about half a kilobyte for each word of a stretch that
    repeats itself.
    """
    ship(docs.sparkSession)
    how = how or Runs()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                n_words, found, short = [], [], []
                for i in range(len(texts)):
                    words = words_of(texts[i].as_py())
                    if edit is not None:
                        words = edit(ids[i].as_py(), words)
                    runs = text_runs(words, how)
                    n_words.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    short.append(collapsed(words, runs))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(found, _RUNS), pa.array(short, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])
        finally:
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(search, f"`{id_col}` {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def summarised(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of find_runs: id_col, n_runs; the run with the most words (the first of equals, then the shortest period); digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("most"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    top = found.withColumn("top", longest)
    return top.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.most")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * -top.most div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's texts: of a tenth of all documents, by crc32 of the identifier, the words from some place on repeat a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]
