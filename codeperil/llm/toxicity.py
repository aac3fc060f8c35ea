"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms and case, homoglyphs of Latin letters, marks, and digits and signs that stand
for letters inside a word. The lexicon holds whole words and word beginnings with weights (log odds of toxic against
other labelled texts), learned from labelled rows; an Aho-Corasick automaton finds all of them in one pass. Exception
phrases, word pairs around a lexicon entry that harmless texts have so much more often than toxic ones that chance does
not explain it, cancel the hit inside them. The sum of the
weights, normalised by the length of the text, becomes a score by a fitted logistic curve.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written

#: Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ʏ": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɩ": "i", "ɑ": "a", "ɴ": "n", "ʀ": "r", "ʟ": "l", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴛ": "t", "ᴜ": "u",
}
#: Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_TABLE = str.maketrans({**HOMOGLYPHS, "­": None, "​": None, "‌": None, "‍": None, "﻿": None})
_LEET_TABLE = str.maketrans(LEET)
#: A word with a letter and, before its last letter, a digit or sign that may stand for a letter. It begins where no letter stands before, so long words are looked at once.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[0134578 9@$!|+](?:[0134578 9@$!|+]|[^\W\d_])*+".replace(" ", ""))
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case words between single blanks, with a blank before and behind; homoglyphs, marks and digit substitutions undone."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
        if any("̀" <= c <= "ͯ" for c in text):
            text = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
            text = unicodedata.normalize("NFC", text)

    def undo(m: re.Match) -> str:
        word = m[0]
        core = word.rstrip("!|+$@")
        if not core or core.isalpha() or not any(c.isalpha() for c in core):
            return word
        return core.translate(_LEET_TABLE) + word[len(core) :]

    text = _DISGUISED.sub(undo, text)
    return " " + " ".join(_WORD.findall(text)) + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries and their weights: "word" for a whole word, "begin*" for a word's beginning; exception phrases; the curve.

    The score is 1 / (1 + exp(-(slope * x + offset))), where x = sum of weights * 100 / (100 + words) + log(1 + hits).
    """

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -3.0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Lexicon:
        raw = json.loads(text)
        return Lexicon(raw["weights"], tuple(raw["exceptions"]), raw["slope"], raw["offset"])


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            pattern = " " + entry[:-1] if entry.endswith("*") else f" {entry} "
            self.automaton.add_word(pattern, (len(pattern), weight, False))
        for phrase in lexicon.exceptions:
            pattern = f" {phrase} "
            self.automaton.add_word(pattern, (len(pattern), 0.0, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Place and weight of every word that an entry fits, the largest weight of a word's entries, without those inside an exception phrase."""
        if not len(self.automaton):
            return []
        best: dict[int, float] = {}
        spared = []
        for end, (size, weight, exempt) in self.automaton.iter(folded):
            start = end - size + 1
            if exempt:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, -math.inf), weight)
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return sorted((s, w) for s, w in best.items() if not (n := bisect_right(begins, s)) or s >= reach[n - 1])

    def measure(self, text: str) -> tuple[float, int]:
        """x of the curve, and the number of hits."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0
        words = folded.count(" ") - 1
        return sum(w for _, w in found) * 100 / (100 + words) + math.log1p(len(found)), len(found)

    def score(self, text: str) -> tuple[float, int]:
        x, hits = self.measure(text)
        z = self.lexicon.slope * x + self.lexicon.offset
        return (1 / (1 + math.exp(-z)) if z > -700 else 0.0), hits


def held_out(id_column: Column, parts: int = 4, held: int = 2) -> Column:
    """Whether crc32 of the identifier as text leaves remainder `held`."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == held, F.lit(False))


#: Word beginnings of these lengths may become entries.
STEMS = range(4, 9)


def features(text: str) -> set[str]:
    """The words of a text, and their beginnings with a star."""
    words = set(fold(text).split())
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 16_000, most_entries: int = 3_000, least_docs: int = 4, least_odds: float = 4.0, most_false: float = 0.01) -> Lexicon:
    """A lexicon from at most `most_rows` labelled rows (those of the smallest identifier hash) that are not held out.

    Entries are found in at least `least_docs` toxic texts, `least_odds` times as often as in others, and so often that by
    chance no more than `most_false` features in all would be; exceptions are word pairs around their hits for which the same
    holds with harmless and toxic texts exchanged. A text counts once for a feature or pair. Null labels,
    identifiers and texts are left out; of conflicting labels, of an identifier or of equal texts, the larger holds.
    """
    ship(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = written(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy("text").agg(F.max("label").alias("label")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[1 if label else 0].update(features(text))
        names = list({*seen[0], *seen[1]})
        for a in range(0, len(names), 50_000):
            some = names[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": some, "t": pa.array([seen[1][f] for f in some], pa.int64()), "b": pa.array([seen[0][f] for f in some], pa.int64())})

    totals = texts.agg(F.count_if(F.col("label") > 0).alias("t"), F.count_if(F.col("label") == 0).alias("b")).first()
    if not totals["t"] or not totals["b"]:
        return Lexicon()
    table = texts.select("text", "label").mapInArrow(count, "feature string, t long, b long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    table = written(table.where(F.col("t") + F.col("b") >= least_docs), "features")
    share = totals["t"] / (totals["t"] + totals["b"])
    n, t, b = F.col("t") + F.col("b"), F.col("t"), F.col("b")
    # Chernoff's bound on the chance that so many of n texts are toxic, held against the number of features looked at
    evidence = t * F.log(t / n / share) + F.when(b > 0, b * F.log(b / n / (1 - share))).otherwise(0.0)
    odds = ((t + 0.1) / totals["t"]) / ((b + 0.1) / totals["b"])
    needed = math.log(max(1, table.count()) / most_false)
    table = table.where((t >= least_docs) & (t / n > share)).withColumns({"odds": odds, "evidence": evidence})
    found = table.where((F.col("odds") >= least_odds) & (F.col("evidence") >= needed)).orderBy(F.col("evidence").desc(), "feature").limit(most_entries).collect()
    weights = _pruned({r["feature"]: (r["t"], r["b"], math.log(r["odds"])) for r in found})

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(weights))
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                rows.append(list({" ".join(p) for s, _ in matcher.hits(folded) for p in _pairs(folded, s)}))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), batch.column(1)], ["phrases", "y"])

    pairs = texts.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("y")).mapInArrow(around, "phrases array<string>, y int").select(F.explode("phrases").alias("phrase"), "y")
    pairs = written(pairs.groupBy("phrase").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("b")), "pairs")
    evidence = b * F.log(b / n / (1 - share)) + F.when(t > 0, t * F.log(t / n / share)).otherwise(0.0)
    needed = math.log(max(1, pairs.count()) / most_false)
    harmless = pairs.where((b >= 3 * least_docs) & (b / n > 1 - share) & (1 / odds >= least_odds)).withColumn("evidence", evidence).where(F.col("evidence") >= needed)
    exceptions = tuple(r["phrase"] for r in harmless.orderBy(F.desc("evidence"), "phrase").limit(most_entries // 3).collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(weights, exceptions))
        for batch in batches:
            x = [matcher.measure(text)[0] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "y"])

    measured = texts.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("y")).mapInArrow(measure, "x double, y int")
    points = measured.groupBy(F.round("x", 2).alias("x"), "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").limit(2 * most_rows).collect()
    slope, offset = _curve([(r["x"], r["y"], r["n"]) for r in points])
    return Lexicon(weights, exceptions, slope, offset)


def _pairs(folded: str, start: int) -> list[tuple[str, str]]:
    """The word pairs with the word that begins behind `start`."""
    end = folded.find(" ", start + 1)
    word = folded[start + 1 : end]
    left = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
    right = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
    return [(left, word)] * bool(left) + [(word, right)] * bool(right)


def _pruned(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Beginnings that cover clearly more texts than any one word with them, and what such a beginning doesn't cover as well."""
    most: dict[str, int] = {}
    for word, (t, _, _) in found.items():
        if not word.endswith("*"):
            for n in STEMS:
                most[word[:n]] = max(most.get(word[:n], 0), t)
    stems: dict[str, float] = {}
    for stem in sorted((x for x in found if x.endswith("*")), key=lambda x: (len(x), x)):
        t, _, weight = found[stem]
        if t > 1.2 * most.get(stem[:-1], 0) and not any(stems.get(stem[:n], -math.inf) >= weight - 0.7 for n in STEMS if n < len(stem) - 1):
            stems[stem[:-1]] = weight
    words = {w: f[2] for w, f in found.items() if not w.endswith("*") and not any(stems.get(w[:n], -math.inf) >= f[2] - 0.7 for n in STEMS if n < len(w))}
    return {x: round(w, 4) for x, w in [*words.items(), *((f"{s}*", w) for s, w in stems.items())]}


def _curve(points: list[tuple[float, int, int]], ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, slightly held back so that parted classes stay finite."""

    def loss(slope: float, offset: float) -> float:
        total = ridge * (slope * slope + offset * offset) / 2
        for x, y, n in points:
            z = slope * x + offset
            total += n * (max(z, 0.0) + math.log1p(math.exp(-abs(z))) - y * z)
        return total

    slope, offset = 1.0, -2.0
    now = loss(slope, offset)
    for _ in range(100):
        g0, g1, h00, h01, h11 = ridge * offset, ridge * slope, ridge, 0.0, ridge
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            w = n * p * (1 - p)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = 1.0
        while step > 1e-6 and loss(slope - step * d1, offset - step * d0) > now:
            step /= 2
        slope, offset = slope - step * d1, offset - step * d0
        before, now = now, loss(slope, offset)
        if before - now < 1e-9 * max(1.0, before):
            break
    return max(slope, 0.0), offset


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id_col, score, predicted (1 if score >= threshold), hits.

    Null and empty texts have no hits and the curve's score of 0 hits. Repeated rows score alike; an empty table gives an
    empty result. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon.to_json())  # most_entries entries at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon.from_json(held.value))
        for batch in batches:
            texts = batch.column(1)
            scored = [matcher.score(texts[n].as_py() or "") for n in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array([int(s >= threshold) for s, _ in scored], pa.int32()), pa.array([h for _, h in scored], pa.int64())],
                [id_col, "score", "predicted", "hits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double, predicted int, hits long")
