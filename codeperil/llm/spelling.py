"""Spelling variants: words that differ by one inserted, deleted or replaced character.

Pairs are found by positional q-gram inverted indexes. All words of a pair are equal outside a window around the edit, so
words are dealt into shards by a length, a window, and what they have outside it: first the two halves of the word, and
where a shard has more words than `Variants.most_words`, the halves of its window, and so on. A window of one character
has no more words than there are characters, so no shard is large and none is cut short.

In a shard the words of its length are indexed by their q-grams and where they stand; only q-grams that touch the window
are looked at, for the others are known to agree. For each word of that length or one longer, the postings of its q-grams
at the places that one edit allows are merged by a heap; words in as many of them as one edit must leave untouched are
candidates and are compared. Each pair counts in the shard whose window holds the first character that differs, so it comes
once.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, UPPER_ASCII, give_back, ship, written

_LOWER = str.maketrans(UPPER_ASCII, LOWER_ASCII)
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000


@dataclass(frozen=True)
class Variants:
    """letters: the class of a word's characters; words have `least_length` characters and come `least_count` times; a word's form is `factor` times as frequent; q; words of a shard that isn't parted."""

    letters: str = "A-Za-zÀ-ÿ"
    least_length: int = 6
    least_count: int = 5
    factor: int = 5
    q: int = 2
    most_words: int = 512

    def __post_init__(self) -> None:
        if self.q < 1 or self.most_words < 1 or self.least_length < 2:
            raise ValueError("q and most_words must be 1 or more, least_length 2 or more")


def with_slips(doc_id: object, counts: Counter[str]) -> Counter[str]:
    """The contract's words: of one in 199 runs of a document, by crc32 of `<doc_id>:<run>`, a character is missing."""
    base = zlib.crc32(f"{doc_id}:".encode())
    out: Counter[str] = Counter()
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), base)
        if h % 199 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, how: Variants, id_col: str = "doc_id", text_col: str = "text", edit=None) -> DataFrame:
    """word, n: how often each word of `least_length` characters comes in all documents; tasks pass on what they have counted.

    edit: makes a document's counts from its identifier and the counts of its runs; it may shorten runs.
    """
    ship(docs.sparkSession)
    pattern = re.compile(f"[{how.letters}]{{{how.least_length},}}")  # no letter stands before a match, so it is a whole run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(texts)):
                words: Counter[str] = Counter()
                for word, n in Counter(pattern.findall(texts[i].as_py() or "")).items():
                    words[word.translate(_LOWER)] += n
                if edit is not None:
                    words = edit(ids[i].as_py(), words)
                for word, n in words.items():
                    if len(word) >= how.least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield from _parts(held)
                    held = Counter()
        yield from _parts(held)
        give_back()

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(held: Counter[str]) -> Iterator[pa.RecordBatch]:
    rows = list(held.items())
    for a in range(0, len(rows), 20_000):
        some = rows[a : a + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])


def _shards(rows: DataFrame, windows: Column) -> DataFrame:
    """Rows (word, n, size, longer) in the shards of the windows (array of struct<low, high>)."""
    parted = rows.select("word", "n", "size", "longer", F.inline(windows))
    outside = F.concat(F.expr("substring(word, 1, low)"), F.lit("\0"), F.expr("substring(word, high + longer + 1)"))
    return parted.withColumn("key", F.concat_ws(":", "size", "low", "high", outside))


def _window(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2)
    return F.array(_window(low, middle), _window(middle, high))


def near_pairs(words: DataFrame, how: Variants) -> DataFrame:
    """word, near, near_n: all pairs of `words` (word, n; each word once) that are one edit apart, both ways round."""
    spark = words.sparkSession
    ship(spark)
    rows = words.select("word", "n", F.length("word").alias("length"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.withColumn("size", F.col("length") - F.col("longer")).where(F.col("size") >= how.least_length)
    shards = written(_shards(rows, _halves(F.lit(0), F.col("size"))), "shards")
    done: DataFrame | None = None
    while True:
        full = shards.where("longer = 0 AND high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > how.most_words).select("key")
        full = written(full, "full")
        if full.isEmpty():
            done = shards if done is None else done.unionByName(shards)
            break
        small = shards.join(full.hint("merge"), "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        shards = written(_shards(shards.join(full.hint("merge"), "key", "left_semi").select("word", "n", "size", "longer", F.col("low").alias("from"), F.col("high").alias("to")), _halves(F.col("from"), F.col("to"))), "shards")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("word", "n", "size", "low", "high", "longer", "key")
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        out: list[tuple[str, str, int]] = []
        for _, shard in groupby(rows, key=lambda r: r[6]):
            index = None
            for word, n, size, low, high, longer, _ in shard:  # words of the shard's own length come first
                if index is None:
                    if longer:
                        break
                    index = Index(size, low, high, how.q)
                for near, near_n in index.near(word, longer):
                    out += [(word, near, near_n), (near, word, n)]
                if not longer:
                    index.add(word, n)
            if len(out) > 20_000:
                yield _pair_batch(out)
                out = []
        if out:
            yield _pair_batch(out)
        give_back()

    dealt = done.repartition("key").sortWithinPartitions("key", "longer", "word")
    return dealt.mapInArrow(pairs, "word string, near string, near_n long")


def _pair_batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])


class Index:
    """Words of `size` characters that agree outside the window from `low` to `high`, by their q-grams and places."""

    def __init__(self, size: int, low: int, high: int, q: int):
        self.size, self.low, self.high, self.q = size, low, high, q
        self.words: list[tuple[str, int]] = []
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        #: q-grams that lie outside the window, so that all words here share them.
        self.shared = max(0, low - q + 1) + max(0, size - high - q + 1)

    def places(self, size: int, high: int) -> range:
        """Where q-grams begin that touch the window."""
        return range(max(0, self.low - self.q + 1), min(size - self.q, high - 1) + 1)

    def add(self, word: str, n: int) -> None:
        number = len(self.words)
        self.words.append((word, n))
        for i in self.places(self.size, self.high):
            self.postings[word[i : i + self.q], i].append(number)

    def candidates(self, word: str, longer: int) -> Iterator[int]:
        """Indexed words in at least as many postings as one edit leaves: it spoils q of the longer word's q-grams at most."""
        needed = self.size + longer - 2 * self.q + 1 - self.shared
        if needed <= 0:
            yield from range(len(self.words))
            return
        lists = []
        for i in self.places(self.size + longer, self.high + longer):
            gram = word[i : i + self.q]
            for place in (i, i - 1)[: 1 + longer]:  # behind an inserted character all stand one place further
                if found := self.postings.get((gram, place)):
                    lists.append(found)
        if len(lists) >= needed:
            for number, same in groupby(heapq.merge(*lists)):
                if sum(1 for _ in same) >= needed:
                    yield number

    def near(self, word: str, longer: int) -> Iterator[tuple[str, int]]:
        """The indexed words one edit from `word` whose first difference lies in the window."""
        for number in self.candidates(word, longer):
            other, n = self.words[number]
            at = self.low
            while at < self.high and word[at] == other[at]:
                at += 1
            if at == self.high and (not longer or at < self.size):  # no difference in the window, or in the next one's
                continue
            if word[at + 1 :] == other[at + 1 - longer :]:
                yield other, n


def variant_groups(words: DataFrame, how: Variants | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for `words` (word, n), which should be a written table.

    form: of the words one edit away the most frequent (of equals the first in code-point order), if it is `factor` times
    as frequent; else null, as form_n is. root: the last word on the way from form to form, the word itself if it has no
    form. Rows with a null word or null count go; of repeated words the counts are added. An empty table gives an empty
    result.
    """
    how = how or Variants()
    words = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words.where((F.length("word") >= how.least_length) & (F.col("n") >= how.least_count)), "words")
    near = near_pairs(words, how).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    follows = -F.col("best.less") >= how.factor * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(follows, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, -F.col("best.less")).alias("form_n"),
    )
    rows = written(rows, "forms")
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("up")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word and the end (up) of its chain of links; each round doubles what a link spans, so there are few: counts grow along a chain."""
    while True:
        on = links.select(F.col("word").alias("up"), F.col("up").alias("next"))
        far = written(links.join(on.hint("merge"), "up", "left"), "links")
        links = far.select("word", F.coalesce("next", "up").alias("up"))
        if far.where("next IS NOT NULL").isEmpty():
            return links


def spelling_variants(docs: DataFrame, how: Variants | None = None, id_col: str = "doc_id", text_col: str = "text", edit=None) -> DataFrame:
    """variant_groups of the words of all documents: runs of letters, A-Z in lower case.

    Null and empty texts have no words; repeated rows count as often as they come; null identifiers count too. Other columns
    are not looked at.
    """
    how = how or Variants()
    return variant_groups(count_words(docs, how, id_col, text_col, edit), how)
