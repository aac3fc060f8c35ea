"""Substring de-duplication over sliding spans of sentences.

A text is cut into sentences, behind closing punctuation or at a line end; a sentence of more than `long_words` words is
cut further behind its commas, and what is longer still behind words that a hash marks, so that a shared stretch is cut
alike wherever it stands. From every sentence the shortest run of at least `run` sentences and `least_words` words is a
span, hashed over its lower-case words; with `both_ways` so is the shortest such run that ends with every sentence. Both
together cover every sentence of any repeated passage of that size: what lies behind the first run from the passage's
begin ends a run inside the passage. In scripts without blanks a character counts as a word, and a full-width mark ends a
sentence whatever follows. Sentences without words neither begin nor end a span. Spans meet in one global join on the hash. The first occurrence of a span, by identifier, then
by place, keeps its text; sentences that any other occurrence covers are removed.

A span is a row of 24 bytes, written once; one that occurs once leaves after the first aggregation, one of a
passage that a third of all texts share is pre-aggregated and joined as a hot key.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_aware_join, ship, written


@dataclass(frozen=True)
class Spans:
    """Parameters; the query's are PRODUCTION."""

    run: int = 2
    least_words: int = 20
    long_words: int = 16
    cut_every: int = 8
    both_ways: bool = False


#: Whatever repeats of two sentences and 10 words, so all runs of three sentences and 10 words and of two and 20 too.
PRODUCTION = Spans(least_words=10, both_ways=True)

#: A search skips to a mark or line feed; nothing is tried twice: closing marks are looked at from their first one, a line end from its line feed.
_END = re.compile(r"[.!?…。！？\n](?:(?<=\n)\s*|(?<![.!?…。！？][.!?…。！？])[.!?…。！？]*+[\"'»”)\]]*+(?:\s+|$))")
_COMMA = re.compile(r"[,;:]\s+")
#: Full-width marks, and what is cut in texts that have some: behind them no blank is needed.
_WIDE = re.compile(r"[。！？｡，、；：]")
_WIDE_END = re.compile(rf"[。！？｡][.!?…。！？｡]*[\"'»”’）」』】》〉)\]]*\s*|{_END.pattern}")
_WIDE_COMMA = re.compile(rf"[，、；：]\s*|{_COMMA.pattern}")
#: Letters and signs of scripts without blanks: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED_CHAR = re.compile(f"[{_UNSPACED}]")
#: Words of texts with such characters: each with the marks behind it, or what stands between blanks and them.
_UNIT = re.compile(rf"[{_UNSPACED}][^\s\w{_UNSPACED}]*|[^\s{_UNSPACED}]+")
_SPACED = re.compile(r"\S+\s*")
_SPACED_UNIT = re.compile(rf"(?:{_UNIT.pattern})\s*")
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
REMEMBERED = 300_000


#: White space, as str.split and \s have it; the last is that of all higher characters.
_BLANK = np.array([*(chr(c).isspace() for c in range(0x3001)), False])


class _Marks(dict):
    """Whether a long sentence is cut behind a word."""

    def __init__(self, cut_every: int):
        super().__init__()
        self.cut_every = cut_every

    def __missing__(self, word: str) -> bool:
        n = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        marked = n % self.cut_every == 0
        if len(self) < REMEMBERED:
            self[word] = marked
        return marked


class _Spaced:
    """A text whose words stand between blanks: its lower case, and where its words begin and end."""

    def __init__(self, low: str):
        self.low = low
        self.codes = np.frombuffer(low.encode(), np.uint8) if low.isascii() else np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.ones(len(low) + 2, bool)
        blank[1:-1] = _BLANK[self.codes if low.isascii() else np.minimum(self.codes, len(_BLANK) - 1)]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.begins, self.ends = edge[::2], edge[1::2]


def _spaced(text: str) -> _Spaced | None:
    """None if other scripts or marks are in the text, or if its lower case depends on what stands around a character or moves others."""
    if not text.isascii() and (_UNSPACED_CHAR.search(text) or _WIDE.search(text) or "Σ" in text):
        return None
    low = text.lower()
    return _Spaced(low) if len(low) == len(text) else None


def _word_hashes(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the `sizes` characters from `begins` on."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, n)[:n], out=sums[1:])
    h = (sums[begins + sizes] - sums[begins]) * _powers(_INVERSE, n)[begins] + sizes.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _unspaced(text: str) -> bool:
    return not text.isascii() and _UNSPACED_CHAR.search(text) is not None


def _words(text: str, unspaced: bool) -> list[str]:
    """Lower-case words; on a stretch without characters of `_UNSPACED` both ways are one."""
    return _UNIT.findall(text.lower()) if unspaced else text.lower().split()


def _n_words(text: str, unspaced: bool) -> int:
    """The number of _words: lower case makes no blanks."""
    return len(_words(text, True)) if unspaced else len(text.split())


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n modulo 2**64; the longest table so far is kept, up to 8 MB."""
    held = _tables.get(base)
    if held is not None and len(held) > n:
        return held[: n + 1]
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n < 1 << 20:
        _tables[base] = out
    return out


class Splitter:
    """Sentences and spans of a text."""

    def __init__(self, how: Spans):
        self.how = how
        self.marks = _Marks(how.cut_every)

    def sentences(self, text: str) -> list[tuple[int, int]]:
        """Begin and end (with the white space behind) of every sentence; they cover the text without gaps."""
        bounds = self._bounds(text, _spaced(text))
        return list(zip(bounds, bounds[1:], strict=False))

    def _bounds(self, text: str, spaced: _Spaced | None) -> list[int]:
        """0 and the end of every sentence; spaced: _spaced of the text."""
        wide = spaced is None and not text.isascii() and _WIDE.search(text) is not None
        out = [0, *(m.end() for m in (_WIDE_END if wide else _END).finditer(text))]
        if out[-1] < len(text):
            out.append(len(text))
        if spaced is not None:
            return self._parted(text, out, spaced)
        unspaced = _unspaced(text)
        limit = (1 if unspaced else 2) * self.how.long_words  # no sentence of fewer characters is long
        parted = [0]
        for b, e in zip(out, out[1:], strict=False):
            if e - b > limit and _n_words(text[b:e], unspaced) > self.how.long_words:
                parted.extend(y for _, y in self._parts(text, b, e, unspaced, wide))
            else:
                parted.append(e)
        return parted

    def _parted(self, text: str, bounds: list[int], spaced: _Spaced) -> list[int]:
        """Bounds with those inside long sentences; every bound is where a word begins or the text ends."""
        most = self.how.long_words
        words = np.searchsorted(spaced.begins, bounds)  # before each bound
        long = np.flatnonzero(words[1:] - words[:-1] > most).tolist()
        if not long:
            return bounds
        begins = spaced.begins.tolist()
        marks = self.marks.__getitem__
        out, done = [], 0
        for n in long:
            out += bounds[done : n + 1]
            done = n + 1
            x, e = bounds[n], bounds[n + 1]
            i = int(words[n])
            ends = [m.end() for m in _COMMA.finditer(text, x, e)]
            if not ends or ends[-1] < e:
                ends.append(e)
            for y in ends:
                j = bisect_left(begins, y, i)
                if j - i > most:
                    behind = [*begins[i + 1 : j], y]  # each word
                    out += [place for place, marked in zip(behind, map(marks, spaced.low[x:y].split()), strict=True) if marked]
                if out[-1] < y:
                    out.append(y)
                x, i = y, j
            out.pop()  # the sentence's end, which comes with the bounds
        return out + bounds[done:]

    def _parts(self, text: str, b: int, e: int, unspaced: bool, wide: bool) -> list[tuple[int, int]]:
        pieces, begin = [], b
        for m in (_WIDE_COMMA if wide else _COMMA).finditer(text, b, e):
            pieces.append((begin, m.end()))
            begin = m.end()
        if begin < e:
            pieces.append((begin, e))
        out = []
        for x, y in pieces:
            if _n_words(text[x:y], unspaced) <= self.how.long_words:
                out.append((x, y))
                continue
            begin = x
            for m in (_SPACED_UNIT if unspaced else _SPACED).finditer(text[x:y]):
                if self.marks[m[0].strip().lower()]:
                    out.append((begin, x + m.end()))
                    begin = x + m.end()
            if begin < y:
                out.append((begin, y))
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first sentence and number of sentences of every span."""
        spaced = _spaced(text)
        bounds = self._bounds(text, spaced)
        run = self.how.run
        if len(bounds) <= run:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if spaced is not None:
            before = np.searchsorted(spaced.begins, bounds)
            counts = before[1:] - before[:-1]
            h = _word_hashes(spaced.codes, spaced.begins, spaced.ends - spaced.begins)
        else:
            unspaced = _unspaced(text)
            own = [_words(text[b:e], unspaced) for b, e in zip(bounds, bounds[1:], strict=False)]
            counts = np.array([len(x) for x in own], np.int64)
            flat = [w for x in own for w in x]
            sizes = np.array([len(w) for w in flat], np.int64)
            h = _word_hashes(np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes, sizes)
        ends = np.cumsum(counts)
        begins = ends - counts
        powers = _powers(_FACTOR, len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])])
        own = np.flatnonzero(counts)  # sentences with words
        heads, tails, n = begins[own], ends[own], len(own)
        # the last sentence of each span: at least run - 1 further on, and where the words suffice
        stop = np.maximum(np.arange(n) + run - 1, np.searchsorted(tails, heads + self.how.least_words))
        start = np.flatnonzero(stop < n)
        if self.how.both_ways:
            # the first sentence of the spans that end with each: the last one from which the words suffice
            begin = np.minimum(np.arange(n) - run + 1, np.searchsorted(heads, tails - self.how.least_words, "right") - 1)
            more = np.flatnonzero(begin >= 0)
            more = more[stop[begin[more]] != more]  # the others are there already
            start, stop = np.concatenate([start, begin[more]]), np.concatenate([stop[start], more])
        else:
            stop = stop[start]
        first, last = heads[start], tails[stop]
        back = _powers(_INVERSE, len(h))
        span = (sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)
        span ^= span >> np.uint64(32)
        span *= np.uint64(0xD6E8FEB86659FD93)
        span ^= span >> np.uint64(29)
        return span, own[start].astype(np.int32), (own[stop] - own[start] + 1).astype(np.int32)


def remove_repeated_spans(docs: DataFrame, how: Spans = Spans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, text (without the sentences of non-first repeated spans), n_removed (sentences), removed (places and lengths of the stretches removed, in characters).

    First is the smallest identifier (null before others), then the row, then the place. Null and empty texts stay as they
    are; a text that is removed whole becomes empty. Repeated rows are texts like others: the later one loses what it
    shares. An empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(how)
        for batch in batches:
            texts, uids = batch.column(1), batch.column(0).to_pylist()
            hashes, places, sizes, owners = [], [], [], []
            held = 0
            for n in range(len(texts)):
                h, p, z = splitter.spans(texts[n].as_py() or "")
                hashes.append(h.view(np.int64))
                places.append(p)
                sizes.append(z)
                owners.append(np.full(len(h), uids[n], np.int64))
                held += len(h)
                if held > 100_000 or n + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))], ["span", "uid", "place", "size"])
                    hashes, places, sizes, owners, held = [], [], [], [], 0

    kind = docs.schema[id_col].dataType
    rows = written(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text")), "texts")
    ranks = rows.select("uid", "id")
    spans = written(rows.select("uid", "text").mapInArrow(cut, "span long, uid long, place int, size int"), "all-spans")
    # an identifier's order: only spans that occur more than once need it, so it joins after the first aggregation
    counted = spans.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("low")).where("n > 1")
    counted = written(counted, "spans")
    met = hot_aware_join(spans, counted.select("span", "n"), ["span"], "n", F.xxhash64("uid", "place")).where("n IS NOT NULL").select("span", "uid", "place", "size", "n")
    met = written(met.join(ranks, "uid"), "repeated")
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "uid", "place")
    firsts = written(met.groupBy("span").agg(F.min(order).alias("first"), F.first("n").alias("n")).select("span", F.col("first.uid").alias("first_uid"), F.col("first.place").alias("first_place"), "n"), "firsts")
    again = hot_aware_join(met.select("span", "uid", "place", "size"), firsts, ["span"], "n", F.xxhash64("uid", "place"))
    again = again.where(~((F.col("uid") == F.col("first_uid")) & (F.col("place") == F.col("first_place"))))
    covered = again.groupBy("uid").agg(F.collect_list(F.struct("place", "size")).alias("places"))  # a text's own places
    both = rows.join(covered, "uid", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(how)
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            found = lists.is_valid().to_pylist()
            bounds = lists.offsets.to_pylist()
            places, sizes = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "size"))
            new, gone, stretches = [], [], []
            for n in range(len(texts)):
                text = texts[n].as_py()
                if not found[n]:  # stays as it is
                    new.append(text)
                    gone.append(0)
                    stretches.append([])
                    continue
                parts = splitter.sentences(text or "")
                own = slice(bounds[n], bounds[n + 1])
                steps = np.bincount(places[own], minlength=len(parts) + 1) - np.bincount(places[own] + sizes[own], minlength=len(parts) + 1)
                dropped = np.cumsum(steps)[: len(parts)] > 0
                runs = _runs(dropped)
                spots = [(parts[a][0], parts[b - 1][1] - parts[a][0]) for a, b in runs]
                if spots:
                    kept, at = [], 0
                    for s, size in spots:
                        kept.append(text[at:s])
                        at = s + size
                    text = "".join([*kept, text[at:]])
                new.append(text)
                gone.append(int(dropped.sum()))
                stretches.append([{"at": s, "size": z} for s, z in spots])
            spot = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(gone, pa.int64()), pa.array(stretches, spot)], [id_col, "text", "n_removed", "removed"])

    out = f"`{id_col}` {kind.simpleString()}, text string, n_removed long, removed array<struct<at: long, size: long>>"
    return both.select("id", "text", "places").mapInArrow(remove, out)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
