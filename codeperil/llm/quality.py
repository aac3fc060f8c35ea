"""Quality rules: text measures and a learned decision list (DataFrame functions only).

The list is learned by sequential covering from the measures of labelled rows: a rule is a conjunction of thresholds,
grown literal by literal on two thirds of the rows (the gain counts rows of low quality won against rows of good quality
let in), pruned on the last third, kept if it is precise enough there; the rows that it covers are set aside and the
next rule is grown. The rules become one ordered CASE WHEN over the measures.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "#*$%&|<>"
#: The measures that rules may test.
MEASURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "distinct_share", "line_words")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with word_chars, n_symbols, n_dup_lines, n_repeat_words and the columns of MEASURES. A null text counts as empty; shares of nothing are 0.

    Every layer of columns is used more than once by the next, so Spark computes it once per row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the columns of `docs` in one, so that none has a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text.alias("__text"), F.array_remove(F.split(text, SPACES, -1), "").alias("__words"))
    words = F.col("__words")
    windows = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "__lines": lines,
            "__windows": F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            "__upper": F.regexp_count("__text", F.lit("\\p{Lu}")),
            "__digits": F.regexp_count("__text", F.lit("[0-9]")),
            "__bangs": F.length("__text") - F.length(F.replace("__text", F.lit("!"), F.lit(""))),
            "__distinct": F.size(F.array_distinct(words)),
        }
    )
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(repeated, F.sort_array(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__placed": placed, "__n_lines": F.size("__lines")})
    at = F.col("__placed")
    same = F.filter(at, lambda x, i: x["h"].eqNullSafe(F.get(at, i - 1)["h"]) | x["h"].eqNullSafe(F.get(at, i + 1)["h"]))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    per_char, per_word = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    measures = {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("n_dup_lines"),
        "n_repeat_words": F.col("n_repeat_words"),
        "mean_word": F.col("word_chars") / per_word,
        "symbol_share": F.col("n_symbols") / per_char,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / per_word,
        "upper_share": F.col("__upper") / per_char,
        "bang_share": F.col("__bangs") / per_char,
        "digit_share": F.col("__digits") / per_char,
        "distinct_share": F.col("__distinct") / per_word,
        "line_words": F.col("n_words") / F.greatest("__n_lines", F.lit(1)),
    }
    # A generator of one row: filters on the measures stay above it. Pushed down, they would hold the whole expressions,
    # and the word array would be made anew for every word.
    return rows.select("__row.*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in measures.items()]))))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    """`measure` above `cut`, or at most `cut`."""

    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.measure) > self.cut if self.above else F.col(self.measure) <= self.cut

    def holds(self, row: Mapping[str, float]) -> bool:
        return (row[self.measure] > self.cut) == self.above


@dataclass(frozen=True)
class Rule:
    """A conjunction, and how many rows of low and of good quality it covered among those that reached it."""

    literals: tuple[Literal, ...]
    low: int
    good: int

    def column(self) -> Column:
        out = self.literals[0].column()
        for x in self.literals[1:]:
            out = out & x.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{x.measure} {'>' if x.above else '<='} {x.cut:.6g}" for x in self.literals) + f"  [{self.low} low, {self.good} good]"


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that fits (from 0), or null."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(n)).otherwise(out)
    return out


def learn_rules(rows: list[Mapping[str, float]], low: list[bool], measures: tuple[str, ...] = MEASURES, cuts: int = 24, most_literals: int = 3, most_rules: int = 12, precision: float = 0.95, least_cover: int = 5) -> list[Rule]:
    """Sequential covering over rows of measures. Row sets are bit sets: rows must be a bounded sample."""
    literals = []
    masks = []
    for m in measures:
        values = sorted(r[m] for r in rows)
        places = {values[min(len(values) - 1, k * len(values) // cuts)] for k in range(cuts)} if values else set()
        low_values = sorted(r[m] for r, x in zip(rows, low, strict=True) if x)
        places |= {low_values[min(len(low_values) - 1, k * len(low_values) // cuts)] for k in range(cuts)} if low_values else set()
        for cut in sorted(places):
            above = _bits(r[m] > cut for r in rows)
            for side in (True, False):
                literals.append(Literal(m, side, cut))
                masks.append(above if side else ~above & ((1 << len(rows)) - 1))
    bad = _bits(low)
    good = ~bad & ((1 << len(rows)) - 1)
    prune = _bits(n % 3 == 2 for n in range(len(rows)))
    left = (1 << len(rows)) - 1
    rules: list[Rule] = []
    while len(rules) < most_rules and left & bad:
        grow = left & ~prune
        chosen: list[int] = []
        mask = grow
        p0, n0 = (grow & bad).bit_count(), (grow & good).bit_count()
        while len(chosen) < most_literals and n0 and p0:
            best, gain_of_best = None, 0.0
            for k, own in enumerate(masks):
                p = (mask & own & bad).bit_count()
                if p < least_cover:
                    continue
                n = (mask & own & good).bit_count()
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if gain > gain_of_best + 1e-9:
                    best, gain_of_best = k, gain
            if best is None:
                break
            chosen.append(best)
            mask &= masks[best]
            p0, n0 = (mask & bad).bit_count(), (mask & good).bit_count()
        if not chosen:
            break
        chosen = _pruned(chosen, masks, left & prune, bad, good)
        chosen = [_centred(k, chosen, literals, masks, left, bad, rows) for k in dict.fromkeys(chosen)]
        covered = left
        for k in chosen:
            covered &= masks[k]
        p, n = (covered & bad).bit_count(), (covered & good).bit_count()
        tp, tn = (covered & prune & bad).bit_count(), (covered & prune & good).bit_count()
        if p < least_cover or p < precision * (p + n) or tp + 1 < precision * (tp + tn + 1):
            break
        rules.append(Rule(tuple(literals[k] for k in chosen), p, n))
        left &= ~covered
    return rules


def _bits(flags) -> int:
    return int("".join("1" if x else "0" for x in flags)[::-1] or "0", 2)


def _centred(k: int, chosen: list[int], literals: list[Literal], masks: list[int], left: int, bad: int, rows: list[Mapping[str, float]]) -> int:
    """The literal with its cut moved half-way from the rows that fail it to the nearest twentieth of the low rows that the rule covers: of all cuts that part them the one that leaves both the most room."""
    own = literals[k]
    rule = left & bad
    for x in chosen:
        rule &= masks[x]
    inside = sorted(r[own.measure] for n, r in enumerate(rows) if rule >> n & 1)
    outside = [r[own.measure] for n, r in enumerate(rows) if not masks[k] >> n & 1]
    if not inside or not outside:
        return k
    near = inside[len(inside) // 20] if own.above else inside[-1 - len(inside) // 20]
    cut = (near + (max(outside) if own.above else min(outside))) / 2
    moved = Literal(own.measure, own.above, cut)
    literals.append(moved)
    masks.append(_bits(moved.holds(r) for r in rows))
    return len(literals) - 1


def _pruned(chosen: list[int], masks: list[int], held: int, bad: int, good: int) -> list[int]:
    """The beginning of the rule that does best on the held-out rows, the longer one of equals."""

    def worth(some: list[int]) -> float:
        mask = held
        for k in some:
            mask &= masks[k]
        p, n = (mask & bad).bit_count(), (mask & good).bit_count()
        return (p - n) / (p + n) if p + n else -1.0

    return max((chosen[:n] for n in range(1, len(chosen) + 1)), key=lambda some: (worth(some), len(some)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 12_000, **options) -> list[Rule]:
    """Rules for rows labelled 0 that pass the base, learned from at most `most_rows` labelled rows, those of the smallest identifier hash.

    Null labels and identifiers are left out; of conflicting labels of one identifier the smaller holds. Without labels
    there are no rules.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    sample = marked.orderBy(*order).limit(most_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id")
    rows = with_measures(rows, "__t").where(~base_failed()).select("__id", "__label", *MEASURES).orderBy(*order, *MEASURES).limit(most_rows).collect()
    return learn_rules([r.asDict() for r in rows], [r["__label"] == 0 for r in rows], **options)


def judge_quality(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """`docs` with the measures, base_failed, rule (number of the rule that fits, or null) and kept.

    Every row gives one row: empty and null texts have no words, so their base fails. Columns of `docs` with the names of
    new ones are replaced, all others stay, whatever their names. An empty table gives an empty result.
    """
    clash = [c for c in docs.columns if c in {*MEASURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"}]
    rows = with_measures(docs.drop(*clash), text_col)
    rows = rows.withColumns({"base_failed": base_failed(), "rule": decision_list(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
