"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text's shingles are its runs of `width` lower-case words. A shingle weighs its number of occurrences times its inverse
document frequency, which comes from a count-min sketch of all documents: fixed in size, so its error is a fixed share of
all shingles at any scale, and a shingle rarer than that share has the full weight. Each of bands * rows samples is the
shingle (and level of its weight) with the smallest of Ioffe's values; `rows` samples make a band, equal bands a bucket.

Texts of equal words are one node. In every bucket the most central node (the one whose buckets are largest) leads, and
the others are compared with it by exact weighted Jaccard; verified links are contracted to components. In buckets that
still hold several components all pairs of different components are looked at block by block, in the first band that they
share, by how many of their samples agree; those whose samples could be of a similar pair (a pair at the limit fails that
by chance once in 10,000) are compared exactly, in place, unless found links connect them by then. So no pair that shares a bucket stays undecided unless it is connected already. Components, links
and buckets stay distributed; a bucket of any size is cut into blocks of `block` nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hot_aware_join, ship, written


@dataclass(frozen=True)
class NearDup:
    """Parameters."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 15
    rows: int = 4
    sketch_bits: int = 18
    seed: int = 20_240_501
    #: Comparisons with one leader that a task gets at once, and nodes in a block of a bucket.
    leader_share: int = 200
    block: int = 512

    @property
    def least_agreeing(self) -> int:
        """Samples that agree in all but one in 10,000 pairs at the limit of similarity."""
        n = self.bands * self.rows
        below, k = 0.0, 0
        while True:
            below += math.comb(n, k) * self.similarity**k * (1 - self.similarity) ** (n - k)
            if below > 1e-4:
                return k
            k += 1


SKETCH_ROWS = 2
BLOCK = 4096
#: Bytes of text that are shingled at once.
CHUNK = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of shingles, many texts at once."""

    def __init__(self, width: int):
        self.width = width
        self.factors = [np.uint64(pow(_BASE, n + 1, 1 << 64)) for n in range(width)]
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[bytes | None]]]:
        """The number of the first text, each text's shingles in order, and a digest of its words (None: no words); CHUNK bytes or one text at a time."""
        own, size, first = [], 0, 0
        for n in range(len(texts)):
            own.append((texts[n].as_py() or "").lower().encode("utf-8", "surrogatepass"))
            size += len(own[-1])
            if size >= CHUNK or n + 1 == len(texts):
                yield first, *self.shingles(own)
                own, size, first = [], 0, n + 1

    def shingles(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes | None]]:
        """A hash for every run of `width` words between ASCII blanks; of fewer words, one for them all; of none, none."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(self.powers) < len(data) + 1:
            self.powers, self.inverses = _powers(_BASE, len(data) + 1), _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        blank = _BLANK[data]
        before = np.concatenate([[True], blank[:-1]])
        starts = np.flatnonzero(~blank & before)
        ends = np.flatnonzero(blank & ~before)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        at = np.searchsorted(starts, bounds)
        padded = np.concatenate([words, np.zeros(self.width, np.uint64)])
        runs = np.zeros(len(words), np.uint64)
        for k, f in enumerate(self.factors):
            runs += padded[k : k + len(words)] * f
        runs = _mix(runs)
        keep = data.copy()
        keep[blank] = 32
        kept = ~blank | np.concatenate([~blank[1:], [False]])  # the words with one blank before each
        flat = keep[kept].tobytes()
        upto = np.concatenate([[0], np.cumsum(kept)])[bounds].tolist()
        out: list[np.ndarray] = []
        digests: list[bytes | None] = []
        for n, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            count = b - a
            if count >= self.width:
                out.append(runs[a : b - self.width + 1])
            elif count:
                short = np.concatenate([words[a:b], np.full(self.width - count, count, np.uint64)])
                out.append(_mix((short * np.array(self.factors)).sum(keepdims=True, dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            digests.append(hashlib.blake2b(flat[upto[n] : upto[n + 1]].strip(b" "), digest_size=16).digest() if count else None)
        return out, digests


def document_frequency(docs: DataFrame, how: NearDup, text_col: str = "text") -> tuple[np.ndarray, int]:
    """The sketch (rows x 2 ** bits counts of documents) over all documents, and their number."""
    ship(docs.sparkSession)
    cells = 1 << how.sketch_bits
    mask = np.uint64(cells - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.width)
        held = np.zeros((SKETCH_ROWS, cells), np.int64)
        n = 0
        for batch in batches:
            for _, lists, _ in shingler.chunks(batch.column(0)):
                n += len(lists)
                own = np.concatenate([np.unique(x) for x in lists])
                for r in range(SKETCH_ROWS):
                    held[r] += np.bincount((own >> np.uint64(20 * r) & mask).astype(np.int64), minlength=cells)
        if n:
            yield _blocks(held, n)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _unpacked(counts)
                total[block] = total[block] + own if block in total else own
        if total:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "counts": pa.array([_packed(x) for x in total.values()], pa.binary())})

    schema = "block int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema)
    # first by groups of tasks, then all: no task gets a block from more than about the root of their number
    blocks = SKETCH_ROWS * cells // BLOCK
    some = parts.withColumn("part", F.floor(F.spark_partition_id() / 64)).repartition("block", "part").drop("part").mapInArrow(add, schema)
    whole = some.repartition(min(16, blocks), "block").mapInArrow(add, schema).collect()  # rows x 2 ** bits counts, whatever the input
    sketch = np.zeros(SKETCH_ROWS * cells, np.int64)
    n_docs = 0
    for r in whole:
        own = _unpacked(bytes(r["counts"]))
        if r["block"] < 0:
            n_docs = int(own[0])
        else:
            sketch[r["block"] * BLOCK : r["block"] * BLOCK + len(own)] = own
    return sketch.reshape(SKETCH_ROWS, cells), n_docs


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    """The counts of a block: one (the number of documents) or BLOCK."""
    raw = pa.CompressedInputStream(pa.BufferReader(packed), "zstd").read()
    return np.frombuffer(raw, np.int64)


def _blocks(held: np.ndarray, n: int) -> pa.RecordBatch:
    flat = held.reshape(-1)
    at = [k for k in range(len(flat) // BLOCK) if flat[k * BLOCK : (k + 1) * BLOCK].any()]
    counts = [_packed(flat[k * BLOCK : (k + 1) * BLOCK]) for k in at]
    return pa.RecordBatch.from_pydict({"block": pa.array([-1, *at], pa.int32()), "counts": pa.array([_packed(np.array([n])), *counts], pa.binary())})


def idf_levels(sketch: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequencies in sixteenths, one byte for each cell: ln(1 + n / count)."""
    idf = np.log1p(n_docs / np.maximum(sketch, 1))
    return np.clip(np.rint(idf * 16), 1, 255).astype(np.uint8)


class Sampler:
    """Weights and samples."""

    def __init__(self, levels: np.ndarray, how: NearDup):
        self.levels, self.how = levels, how
        self.mask = np.uint64(levels.shape[1] - 1)
        rng = np.random.default_rng(how.seed)
        self.r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        self.beta = rng.random(1 << 16).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, how.bands * how.rows, dtype=np.uint64) | np.uint64(1)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """A shingle's inverse document frequency: the larger of the sketch's rows, whose counts err upwards only."""
        out = self.levels[0][(hashes & self.mask).astype(np.int64)]
        for r in range(1, SKETCH_ROWS):
            out = np.maximum(out, self.levels[r][(hashes >> np.uint64(20 * r) & self.mask).astype(np.int64)])
        return out

    def bands(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands (int64) of texts whose shingles begin at `starts`, and 16 bits of each sample: a row for each text."""
        log_w = np.log(weights).astype(np.float32)
        picked = np.empty((len(self.seeds), len(starts)), np.uint64)
        place = np.arange(len(hashes), dtype=np.int64)
        low = np.uint64(0xFFFF)
        for k, seed in enumerate(self.seeds):
            h = hashes * seed
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            r = self.r[(h & low).astype(np.int64)]
            beta = self.beta[(h >> np.uint64(16) & low).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            value = self.log_c[(h >> np.uint64(48)).astype(np.int64)] - r * (t - beta) - r
            order = value.view(np.int32).astype(np.int64)
            order ^= (order >> 63) & 0x7FFFFFFF  # floats in the order of integers
            best = np.minimum.reduceat((order << 32) | place, starts) & 0xFFFFFFFF
            picked[k] = hashes[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out = np.zeros((self.how.bands, len(starts)), np.uint64)
        for b in range(self.how.bands):
            for k in range(b * self.how.rows, (b + 1) * self.how.rows):
                out[b] = _mix(out[b] * np.uint64(0x9E3779B97F4A7C15) + picked[k] + np.uint64(b + 1))
        return out.T.astype(np.int64), np.ascontiguousarray((_mix(picked) & low).T.astype(np.uint16))


SKETCHED = "uid long, words binary, n_shingles int, bands array<long>, samples binary, shingles binary, levels binary"


def sketched(docs: DataFrame, how: NearDup, id_col: str, text_col: str) -> DataFrame:
    """id, uid, words (a digest of the words), n_shingles, bands, samples (two bytes each), and the shingles in order: four bytes and a level each."""
    sketch, n_docs = document_frequency(docs, how, text_col)
    held = docs.sparkSession.sparkContext.broadcast(idf_levels(sketch, n_docs))  # SKETCH_ROWS << sketch_bits bytes

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(how.width), Sampler(held.value, how)

        def sampled(ids: pa.Array, uids: list, digests: list, lists: list[np.ndarray]) -> pa.RecordBatch:
            bands: list[list[int] | None] = [None] * len(lists)
            samples: list[bytes | None] = [None] * len(lists)
            unique = [np.unique(x, return_counts=True) for x in lists]
            full = [n for n, x in enumerate(lists) if len(x)]
            if full:
                hashes = np.concatenate([unique[n][0] for n in full])
                tf = np.concatenate([unique[n][1] for n in full])
                sizes = np.array([len(unique[n][0]) for n in full])
                own, picked = sampler.bands(hashes, tf * (sampler.level(hashes) / 16.0), np.cumsum(sizes) - sizes)
                for n, row, some in zip(full, own.tolist(), picked, strict=True):
                    bands[n], samples[n] = row, some.tobytes()
            flat = np.concatenate(lists)
            shown, weights = (flat >> np.uint64(32)).astype(np.uint32), sampler.level(flat)
            shingles, levels, at = [], [], 0
            for x in lists:
                order = np.argsort(shown[at : at + len(x)], kind="stable")
                shingles.append(shown[at : at + len(x)][order].tobytes())
                levels.append(weights[at : at + len(x)][order].tobytes())
                at += len(x)
            kinds = {"id": ids, "uid": pa.array(uids, pa.int64()), "words": pa.array(digests, pa.binary()), "n_shingles": pa.array([len(x) for x in lists], pa.int32()), "bands": pa.array(bands, pa.list_(pa.int64())), "samples": pa.array(samples, pa.binary()), "shingles": pa.array(shingles, pa.binary()), "levels": pa.array(levels, pa.binary())}
            return pa.RecordBatch.from_arrays(list(kinds.values()), list(kinds))

        for batch in batches:
            uids = batch.column(1).to_pylist()
            for first, lists, digests in shingler.chunks(batch.column(2)):
                yield sampled(batch.column(0).slice(first, len(lists)), uids[first : first + len(lists)], digests, lists)
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(sample, f"id {kind}, {SKETCHED}"), "sketched")


def weighted_jaccard(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Of two multisets of shingles, each (four-byte hashes in order, levels)."""
    ha, hb = np.frombuffer(a[0], np.uint32), np.frombuffer(b[0], np.uint32)
    la, lb = np.frombuffer(a[1], np.uint8), np.frombuffer(b[1], np.uint8)
    if not len(ha) or not len(hb):
        return 0.0
    keys = np.concatenate([ha, hb])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    of_a = np.concatenate([np.ones(len(ha)), np.zeros(len(hb))])[order]
    in_a = np.add.reduceat(of_a, first)
    in_b = np.add.reduceat(1 - of_a, first)
    level = np.concatenate([la, lb])[order][first].astype(np.float64)
    return float((np.minimum(in_a, in_b) * level).sum() / (np.maximum(in_a, in_b) * level).sum())


def verified(edges: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame:
    """`edges` (a, b; written) with their weighted Jaccard similarity. nodes: node, shingles, levels.

    A node with many edges on its side a is copied to as many tasks as it has `leader_share` edges.
    """
    most = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / how.leader_share).cast("int").alias("parts"))
    left = nodes.join(most, nodes["node"] == most["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sa"), F.col("levels").alias("la"))
    counted = written(most, "leaders")
    dealt = hot_aware_join(edges, counted.withColumn("n_edges", F.col("parts").cast("long") * how.leader_share), ["a"], "n_edges", F.xxhash64("b"))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    right = dealt.join(nodes, dealt["b"] == nodes["node"]).select("a", "b", "part", F.col("shingles").alias("sb"), F.col("levels").alias("lb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(2, 6)]
            sims = [weighted_jaccard((sa, la), (sb, lb)) for sa, la, sb, lb in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return right.join(left, ["a", "part"]).select("a", "b", "sa", "la", "sb", "lb").mapInArrow(compare, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes of `edges` (a, b), by alternating large and small stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: u, v. Large: the larger neighbours of u go to its smallest; small: u and its smaller neighbours do."""
        smallest = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        met = hot_aware_join(pairs, smallest, ["u"], "n", F.xxhash64("v")).drop("n")
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(star(both, True).distinct(), "large")
        now = written(star(large.where("u > v"), False).distinct(), "small")
        new = state(now)
        if new == seen:
            break
        seen = new
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def drop_near_copies(docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class, all columns as they were, whatever their names: of the class's smallest identifier and, of rows that repeat it, one.

    Null and empty texts all stay; null identifiers come after others; an empty table stays empty.
    """
    names = docs.columns
    rows = written(docs.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("__uid")), "rows")
    kept = near_classes(rows.select(F.struct(F.col(f"row.{id_col}").isNull().alias("none"), F.col(f"row.{id_col}").alias("id"), F.col("__uid").alias("uid")).alias("__id"), F.col(f"row.{text_col}").alias("__text")), how, "__id", "__text")
    stay = kept.where("kept").select(F.col("__id.uid").alias("__uid"))
    return rows.join(stay.hint("merge"), "__uid", "left_semi").select("row.*")  # by shuffle at every size


def near_classes(docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, class_id, class_size, n_links, kept.

    class_id is the smallest identifier of the class, n_links the number of verified links of the row's text, kept true
    for one row of each class: the smallest identifier, of repeated rows one. Texts of equal words are in one class; a text
    without words (null, empty, blank) is a class of its own. Null identifiers come after others. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = sketched(docs, how, id_col, text_col)
    full = rows.where("n_shingles > 0")
    groups = written(full.groupBy("words").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    own = full.join(groups.select("node").hint("merge"), full["uid"] == groups["node"])  # by shuffle at every size
    placed = own.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = written(sizes, "buckets")
    placed = written(hot_aware_join(placed, sizes, ["band", "value"], "size", F.xxhash64("node")).where("size > 1"), "placed")
    central = placed.groupBy("node").agg(F.sum("size").alias("centre"))
    # what is compared: nodes that share a bucket with another
    nodes = written(own.join(central, "node").select("node", "centre", "bands", "samples", "shingles", "levels"), "nodes")
    placed = written(placed.join(nodes.select("node", "centre"), "node"), "members")
    edges = written(_led(placed), "edges")
    links = None
    if not edges.isEmpty():
        checked = written(verified(edges, nodes, how), "checked")
        links = checked.where(F.col("similarity") >= how.similarity)
        parts = placed.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        links = written(links.unionByName(_rest(written(parts, "parts"), nodes, how)), "links")
    if links is None:
        spark = docs.sparkSession
        links = spark.createDataFrame([], "a long, b long, similarity double")
    found = written(components(links), "components")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = groups.join(found, "node", "left").join(ends, "node", "left")
    classes = written(classes.select("words", "n_rows", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    met = hot_aware_join(rows.select("id", "uid", "words", "n_shingles"), classes, ["words"], "n_rows", F.xxhash64("uid"))
    met = written(met.select("id", "uid", F.coalesce("component", "uid").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "members")
    first = met.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("top"), F.count(F.lit(1)).alias("class_size"))
    out = hot_aware_join(met, written(first, "classes"), ["component"], "class_size", F.xxhash64("uid"))
    return out.select(F.col("id").alias(id_col), F.col("top.id").alias("class_id"), "class_size", "n_links", (F.col("uid") == F.col("top.uid")).alias("kept"))


def _led(placed: DataFrame) -> DataFrame:
    """Pairs of each bucket's most central node with its others."""
    heads = placed.groupBy("band", "value").agg(F.min(F.struct((-F.col("centre")).alias("centre"), "node")).alias("head"), F.count(F.lit(1)).alias("n_rows"))
    heads = written(heads.select("band", "value", F.col("head.node").alias("leader"), "n_rows"), "heads")
    met = hot_aware_join(placed, heads, ["band", "value"], "n_rows", F.xxhash64("node")).where("leader <> node")
    return met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def _rest(parts: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame:
    """Verified links (a, b, similarity) between different components in a bucket, as many as it takes to connect what is connected.

    A bucket of n nodes is cut into c blocks by a hash of the node; each pair of blocks is one piece of work, of about
    2 * block nodes. First the samples are compared, which finds the nodes that need an exact look; only their shingles
    are sent to the second pass.
    """
    open_ = parts.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n_rows")).where("low <> high")
    open_ = written(open_.select("band", "value", "n_rows", F.ceil(F.col("n_rows") / how.block).cast("int").alias("blocks")), "open")
    rows = hot_aware_join(parts.select("band", "value", "node", "component"), open_, ["band", "value"], "n_rows", F.xxhash64("node")).where("blocks IS NOT NULL")
    own = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component")
    least, limit, n_bands = how.least_agreeing, how.similarity, how.bands

    def candidates(table: pa.Table, a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Row i, the rows whose samples agree with it often enough, and how often, in the piece of rows a to b."""
        x, y, band = table.column(2)[a].as_py(), table.column(3)[a].as_py(), table.column(0)[a].as_py()
        own, component = table.column(4).to_numpy()[a:b], table.column(6).to_numpy()[a:b]
        samples = np.frombuffer(b"".join(table.column(7).slice(a, b - a).to_pylist()), np.uint16).reshape(b - a, -1)
        bands = np.array(table.column(8).slice(a, b - a).combine_chunks().flatten()).reshape(-1, n_bands)[:, :band]
        left = np.arange(b - a) if x == y else np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        for n, i in enumerate(left):
            others = right[n + 1 :] if x == y else right
            others = others[component[others] != component[i]]
            agree = np.count_nonzero(samples[others] == samples[i], axis=1)
            fits = agree >= least
            others, agree = others[fits], agree[fits]
            first = ~(bands[others] == bands[i]).any(axis=1)
            if first.any():
                yield int(i), others[first], agree[first]

    def look(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        needed = np.zeros(table.num_rows, bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i, others, _ in candidates(table, a, b):
                needed[a + i] = True
                needed[a + others] = True
        return table.select(range(6)).filter(pa.array(needed)).combine_chunks()

    def compare(table: pa.Table, bounds: list[int]) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        node, component = table.column(5).to_numpy(), table.column(6).to_numpy()
        shingles, levels = table.column(9), table.column(10)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            pairs = sorted(((-int(k), a + i, a + int(j)) for i, others, agree in candidates(table, a, b) for j, k in zip(others, agree, strict=True)))
            top: dict[int, int] = {}

            def root(c: int, top: dict[int, int] = top) -> int:
                while top.get(c, c) != c:
                    top[c] = c = top.get(top[c], top[c])
                return c

            for _, i, j in pairs:
                ci, cj = root(int(component[i])), root(int(component[j]))
                if ci == cj:
                    continue
                sim = weighted_jaccard((shingles[i].as_py(), levels[i].as_py()), (shingles[j].as_py(), levels[j].as_py()))
                if sim >= limit:
                    top[ci] = cj
                    found.append((int(node[i]), int(node[j]), sim))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    keys = ["band", "value", "x", "y"]
    first = rows.join(nodes.select("node", "samples", "bands"), "node").select(*keys, "own", "node", "component", "samples", "bands")
    needed = _by_piece(first, keys, look, "band int, value long, x int, y int, own int, node long")
    needed = written(needed, "needed")
    second = needed.join(nodes.select("node", "samples", "bands", "shingles", "levels"), "node").join(parts.select("node", "component").distinct(), "node")
    second = second.select(*keys, "own", "node", "component", "samples", "bands", "shingles", "levels")
    return _by_piece(second, keys, compare, "a long, b long, similarity double")


def _by_piece(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(table, bounds) on tables of whole pieces: the rows of equal `keys`, the first columns, lie together, between bounds."""

    def bounds_of(table: pa.Table) -> list[int]:
        marks = [table.column(n).to_numpy() for n in range(len(keys))]
        return (np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                table = pa.Table.from_batches(held)
                change = bounds_of(table)
                if change:  # the last piece may go on
                    yield from work(table.slice(0, change[-1]).combine_chunks(), [0, *change]).to_batches()
                    held = table.slice(change[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, [0, *bounds_of(table), table.num_rows]).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
