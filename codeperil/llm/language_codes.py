"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier tells the languages with a 1 from those with a 0
by the character n-grams of the text: the weight of an n-gram is the logarithm of how much likelier it is on one side, each
language counting alike, and a logistic curve turns the mean weight of a text into log odds of the bit. A text gets the
language whose codeword lies nearest: the logistic losses of its bits are added up, each weighted by how well the bit's
classifier did on texts of that language that it wasn't made from. Wrong bits are thus corrected by the others; a text is
flagged as ambiguous if more bits are wrong than the code corrects, or if the second language is nearly as near.

Texts are read whole: letters in lower case, whatever stands between them as one break.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship, written
from .toxicity import held_out as _held_out

#: Lengths of the n-grams.
ORDERS = (2, 3, 4)
#: n-grams are counted by a hash of so many values; row BINS of the weights is for none.
BINS = 1 << 15
#: n-grams that are looked up at once.
SLICE = 1 << 17
#: A text counts for learning like one of so many n-grams, if it has more.
HEAVY = 4000
#: The language of texts without a letter.
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_column):
    """Whether the identifier's row is kept from learning: crc32 of the identifier as text leaves 1 by 3."""
    return _held_out(id_column, 3, 1)


def codewords(languages: int) -> np.ndarray:
    """A matrix of -1 and 1, a row for each language.

    Up to seven languages every way to part them is a column; for more, the best of some random matrices of 10 columns for
    each doubling, the same at every call.
    """
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        columns = np.arange(1, 1 << (languages - 1))
        return np.where(columns[None, :] >> np.arange(languages)[:, None] & 1, -1, 1).astype(np.int8)
    draw, best, most = np.random.default_rng(11), None, -1
    for _ in range(20):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, 10 * (languages - 1).bit_length()))
        uneven = np.abs(code.sum(0, dtype=np.int64)) == languages
        code[0, uneven] *= -1
        least = distance(code)
        if least > most:
            best, most = code, least
    return best


def distance(code: np.ndarray) -> int:
    """The smallest number of bits in which two codewords differ."""
    if len(code) < 2:
        return code.shape[1]
    agree = code.astype(np.int32) @ code.T.astype(np.int32)
    np.fill_diagonal(agree, -code.shape[1])
    return int((code.shape[1] - agree.max()) // 2)


@dataclass(frozen=True)
class CodeModel:
    """languages; their codewords; weights of n-gram hashes by bit; slope and offset of each bit's curve; trust in each bit for each language, rows that sum to 1."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    curves: np.ndarray
    trust: np.ndarray


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its letter in lower case, or 0."""
    if not _letters:
        _letters.append(np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def folded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and breaks of all texts behind one another, and where each text begins and, at last, ends. A text begins with a break, and ends with one if it has a letter."""
    raw = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    letters = letter_table()[raw]
    stays = letters > 0
    stays[1:] |= letters[:-1] > 0
    stays[bounds[:-1]] = True
    ends = np.cumsum(stays)[bounds[1:] - 1]
    return letters[stays], np.concatenate([[0], ends]).astype(np.int64)


def grams(letters: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of n-gram hashes with the texts they are of. Those that leave their text get the hash BINS."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for a in range(0, len(letters), SLICE):
        part = letters[a : a + SLICE + ORDERS[-1] - 1].astype(np.uint64)
        own = owner[a : a + SLICE + ORDERS[-1] - 1]
        hashes = part.copy()
        for n in range(2, ORDERS[-1] + 1):
            hashes = hashes[:-1] * _MIX + part[n - 1 :]
            if n not in ORDERS or not len(hashes):
                continue
            size = min(SLICE, len(hashes))
            mixed = hashes[:size] ^ (hashes[:size] >> np.uint64(31))
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            bins = (mixed >> np.uint64(64 - 15)).astype(np.int32)
            bins[own[:size] != own[n - 1 : n - 1 + size]] = BINS
            yield bins, own[:size]


def gram_counts(bounds: np.ndarray) -> np.ndarray:
    """The number of n-grams of each text."""
    sizes = np.diff(bounds)
    return sum(np.maximum(0, sizes - n + 1) for n in ORDERS)


def means(texts: Sequence[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean weight for each bit, and whether it has a letter."""
    letters, bounds = folded(texts)
    total = np.zeros((len(texts), weights.shape[1]))
    for bins, own in grams(letters, bounds):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[first]] += np.add.reduceat(weights[bins], first, axis=0)
    return total / np.maximum(1, gram_counts(bounds))[:, None], np.diff(bounds) > 1


def groups(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters together, or one longer text."""
    a, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield a, i
            a, size = i, 0
        size += len(text) + 2
    if size:
        yield a, len(texts)


def log_odds(counts: np.ndarray, code: np.ndarray, smooth: float = 0.5, most: float = 6.0) -> np.ndarray:
    """Weights of the bits' classifiers from each language's n-gram counts; the last row, of no n-gram, is 0."""
    share = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BINS)
    out = np.zeros((BINS + 1, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        up, down = code[:, bit] > 0, code[:, bit] < 0
        if up.any() and down.any():
            out[:BINS, bit] = np.clip(np.log(share[up].mean(0)) - np.log(share[down].mean(0)), -most, most)
    return out


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (0 or more) and offset of the logistic curve by damped Newton steps, held back by `ridge` so that parted classes stay finite."""

    def loss(p: np.ndarray) -> float:
        z = p[0] * x + p[1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (p @ p) / 2)

    at = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w, r = weight * p * (1 - p), weight * (p - y)
        gradient = np.array([(r * x).sum(), r.sum()]) + ridge * at
        hessian = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + ridge * np.eye(2)
        step, scale, now = np.linalg.solve(hessian, gradient), 1.0, loss(at)
        while scale > 1e-6 and loss(at - scale * step) > now:
            scale /= 2
        at = at - scale * step
        if now - loss(at) < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def learn_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 3000, most_languages: int = 200) -> CodeModel:
    """A model from the rows that are not held out and have a language and a text with a letter.

    Of each language about `most_rows` rows are taken, those of the smallest identifier hashes; of more than
    `most_languages` languages those with the most rows. Three quarters of the rows give the n-grams' counts (added up by
    the executors), the others the curves and the trust. Without rows there is a model without languages.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = usable.groupBy(F.col(lang_col).cast("string").alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(most_languages).collect()
    languages = tuple(sorted(r["language"] for r in rows))
    code = codewords(len(languages))
    if not languages:
        return CodeModel((), code, np.zeros((BINS + 1, 1), np.float32), np.array([[1.0, 0.0]]), np.ones((0, 1)))
    number = {name: i for i, name in enumerate(languages)}
    table = spark.createDataFrame([(r["language"], number[r["language"]], min(1.0, most_rows / r["n"])) for r in rows], "language string, number int, share double")
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / (1 << 30)
    some = usable.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("language"), place.alias("place"), (F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(4)) == 0).alias("other"))
    some = written(some.join(F.broadcast(table), "language").where(F.col("place") < F.col("share")).select("text", "number", "other"), "languages")  # the table has most_languages rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: kinds[i])
            texts, kinds = [texts[i] for i in order], np.array([kinds[i] for i in order])
            for a, b in groups(texts):
                letters, bounds = folded(texts[a:b])
                sizes = gram_counts(bounds)
                heft = np.maximum(1, 256 * np.minimum(1, HEAVY / np.maximum(1, sizes))).astype(np.int64)  # whole numbers: sums don't depend on their order
                for bins, own in grams(letters, bounds):
                    of = kinds[a:b][own]
                    for kind in np.unique(of).tolist():
                        mine = of == kind
                        total = totals.setdefault(kind, np.zeros(BINS + 1, np.int64))
                        total += np.bincount(bins[mine], heft[own[mine]], BINS + 1).astype(np.int64)
        for kind, total in totals.items():
            full = np.flatnonzero(total[:BINS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), pa.array(total[full])], ["number", "bin", "n"])
        give_back()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x, known = _all_means(texts, held.value)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1), pa.array(known)], ["x", "number", "known"])
        give_back()

    sums = some.where("NOT other").select("text", "number").mapInArrow(count, "number int, bin int, n long").groupBy("number", "bin").agg(F.sum("n").alias("n")).toArrow()  # a row for each language and hash at most
    counts = np.zeros((len(languages), BINS))
    counts[sums["number"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy() / 256
    weights = log_odds(counts, code)
    held = spark.sparkContext.broadcast(weights)  # BINS rows of as many bits as the code has
    points = some.where("other").select("text", "number").mapInArrow(measure, "x array<double>, number int, known boolean").where("known").toArrow()  # a quarter of the sample's rows
    x = np.array(points["x"].to_pylist()).reshape(len(points), code.shape[1])
    of = points["number"].to_numpy().astype(np.int64)
    size = np.bincount(of, minlength=len(languages))
    weight = 100 / np.maximum(1, size)[of]
    curves = np.array([curve(x[:, bit], code[of, bit] > 0, weight) for bit in range(code.shape[1])])
    right = ((x * curves[:, 0] + curves[:, 1]) * code[of] > 0).astype(float)
    trust = np.ones(code.shape)  # a bit that never failed for a language and one of which nothing is known count alike
    for i in np.flatnonzero(size):
        trust[i] = (right[of == i].sum(0) + 1) / (size[i] + 1)
    return CodeModel(languages, code, weights, curves, trust / trust.sum(1, keepdims=True))


def _all_means(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, known = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), bool)
    for a, b in groups(texts):
        x[a:b], known[a:b] = means(texts[a:b], weights)
    return x, known


def decode(x: np.ndarray, model: CodeModel, near: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' mean weights: the nearest language's number, its score, the second's number, and whether the text is ambiguous (score below `near`, or more wrong bits than the code corrects)."""
    z = np.clip(x * model.curves[:, 0] + model.curves[:, 1], -20, 20)
    loss = np.stack([(np.logaddexp(0, -z * row) * trust).sum(1) for row, trust in zip(model.code, model.trust, strict=True)], 1) * model.code.shape[1]
    order = np.argsort(loss, 1, kind="stable")
    best, second = order[:, 0], order[:, min(1, loss.shape[1] - 1)]
    score = 1 / np.exp(loss[np.arange(len(x)), best][:, None] - loss).sum(1)
    wrong = ((z > 0) != (model.code[best] > 0)).sum(1)
    return best, score, second, (score < near) | (wrong > (distance(model.code) - 1) // 2)


def identify_languages(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, lang_pred, score (0 to 1), second (the next language), ambiguous.

    Texts that are null or have no letter, and all texts if the model has no language, get `und`, score 0, no second
    and are not ambiguous. Repeated rows come out alike; null identifiers stay; an empty table gives an empty result. Other
    columns are not looked at.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            x, known = _all_means(texts, own.weights)
            if own.languages:
                best, score, second, unsure = decode(x, own)
            else:
                best, score, second, unsure, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
            best = np.where(known, best, len(names) - 1)
            nexts = [names[s] if k and s != b else None for s, k, b in zip(second, known, best, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(nexts, pa.string()), pa.array(known & unsure)],
                [id_col, "lang_pred", "score", "second", "ambiguous"],
            )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(identify, f"`{id_col}` {kind}, lang_pred string, score double, second string, ambiguous boolean")
