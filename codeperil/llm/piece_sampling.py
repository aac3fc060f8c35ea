"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed A-star search over the lattice.

The segmentations of a text are the leaves of a tree: a node is a prefix of pieces, its children are the lattice's edges
at the place reached. Every leaf has the perturbed score log p + Gumbel noise, and the k leaves with the largest scores
are k distinct segmentations drawn without replacement. They are found best first. A node's largest score below it has
a known distribution, since the lattice's backward sums give the exact mass below (the search's heuristic, and its exact
bound): the root's is drawn first, the child that attains it is drawn by its share of the mass, and all other children
together form one group whose largest score is drawn below the node's. Groups wait in a queue; the best of them is opened
next, so its new child is the next best leaf of all. The (k+1)-th value gives each leaf's inclusion probability,
1 - exp(-exp(log p - value)).

All draws are hashes of the row's key, the sample and the place, so a row's samples depend on nothing else. Words (pieces
never span them) are sampled side by side, edge by edge, in numpy arrays. What lies behind a place depends on the rest of
its word only, so words that end alike share these places, and a task's texts share one lattice.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SPACE = 0x2581
_BASE = 0x9E3779B97F4A7C15
#: Characters in a chunk.
CHUNK = 200_000
#: Places that a board holds before it begins anew; a place with its edges takes about 120 bytes.
REMEMBERED = 600_000
#: The place behind every word.
END = 0


@dataclass(frozen=True)
class Sampling:
    """k segmentations of each text; theta: the power to which piece probabilities are raised; a BPE model's pieces, which
    have merge ranks for scores, get probabilities in proportion to 1 / (rank + rank_offset)."""

    k: int = 3
    theta: float = 1.0
    rank_offset: float = 50.0
    seed: int = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    out = (x >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64; the longest table so far is kept, up to 8 MB."""
    held = _tables.get(base)
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 1 << 20:
        _tables[base] = out
    return out


class Pieces:
    """A model's pieces with log probabilities, and look-up of all pieces of one length at once."""

    def __init__(self, model: bytes, how: Sampling):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, n = self.processor, self.processor.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.texts = {i: sp.id_to_piece(i) for i in ids}
        score = np.array([sp.get_score(i) for i in ids])
        ranked = bool(len(ids)) and bool((np.rint(score) == score).all()) and score.min() < -100
        log_p = -np.log(np.maximum(-score, 0) + how.rank_offset) if ranked else score
        if ranked and len(ids):
            log_p = log_p - np.logaddexp.reduce(log_p)
        self.log_p = np.full(n, -np.inf)
        self.log_p[ids] = log_p * how.theta
        self.byte_ids = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.unknown = sp.unk_id()
        self.fallback = (float(log_p.min()) if len(ids) else 0.0) * how.theta - 2.0
        #: Whether a word may be cut off before every blank behind another character.
        self.words_apart = not any(chr(SPACE) in t.lstrip(chr(SPACE)) for t in self.texts.values())
        self.longest = max(map(len, self.texts.values()), default=1)
        # the table holds all beginnings of pieces; those that are no piece have number -1
        known = {t: i for i, t in self.texts.items()}
        for t in list(known):
            for n in range(1, len(t)):
                known.setdefault(t[:n], -1)
        self.bits = max(4, (4 * len(known)).bit_length())
        size = 1 << self.bits
        self.mask = size - 1
        self.keys = np.zeros(size, np.uint64)
        self.ids = np.full(size, -1, np.int64)
        by_length: dict[int, list[str]] = {}
        for t in known:
            by_length.setdefault(len(t), []).append(t)
        for length, own in by_length.items():
            self._insert(own, length, np.array([known[t] for t in own], np.int64))
        self._read_back()

    def _insert(self, texts: list[str], length: int, ids: np.ndarray) -> None:
        """Put texts of one length, not empty, into the table."""
        if not length:
            return
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
        h = self._final((codes.astype(np.uint64) * _powers(_BASE, length)).sum(axis=1, dtype=np.uint64), length)
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            at = slot[left]
            free = left[self.keys[at] == 0]
            _, first = np.unique(slot[free], return_index=True)  # one for each free slot
            won = free[first]
            self.keys[slot[won]], self.ids[slot[won]] = h[won], ids[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _read_back(self) -> None:
        """The text of every piece behind another one, by the library's decoder, in UTF-8; a byte's piece is that byte, others have a byte that no text has."""
        texts = [b"\xff"] * len(self.log_p)
        before = next((i for i, t in self.texts.items() if chr(SPACE) not in t), None)
        if before is not None:
            head = len(self.processor.decode([before]))
            for i, t in zip(self.texts, self.processor.decode([[before, i] for i in self.texts]), strict=True):
                texts[i] = t[head:].encode("utf-8", "surrogatepass")
            for b, i in self.byte_ids.items():
                texts[i] = bytes([b])
        self.written = np.array(texts)

    @staticmethod
    def _final(h: np.ndarray, length: int) -> np.ndarray:
        """A polynomial hash with its length mixed in; 0 is no key."""
        out = h ^ np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
        out[out == 0] = 1
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(_BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the polynomial hashes h are beginnings of pieces, of `length` characters, and the pieces that they are or -1."""
        h = self._final(h, length)
        slot = self._slot(h)
        key = self.keys[slot]
        hit = key == h
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            key = self.keys[slot[open_]]
            found = key == h[open_]
            hit[open_[found]] = True
            open_ = open_[~found & (key != 0)]
        at = np.flatnonzero(hit)
        return at, self.ids[slot[at]]

    def normal(self, text: str) -> str:
        """The text as the model sees it, with blanks marked."""
        return self.processor.normalize(text) if text else ""

    def decodes(self, segmentations: list[np.ndarray], normals: list[str]) -> list[bool]:
        """For each segmentation whether its ids' text is the normalised text beside it, without the blank that is put before it.

        The texts that the library gave for the single pieces are joined and compared. Where they differ (a piece without a text
        of its own, a 0 in the text) or several blanks lead, the library decodes the ids.
        """
        wide: dict[str, tuple[str, bytes]] = {}
        out = []
        for ids, normal in zip(segmentations, normals, strict=True):
            if normal not in wide:
                want = normal.replace(chr(SPACE), " ")
                wide[normal] = want, want.encode("utf-8", "surrogatepass")
            want, coded = wide[normal]
            same = self.written[ids].tobytes().translate(None, b"\0") == coded and not want.startswith("  ")
            out.append(same or self.processor.decode(ids.tolist()) == want.removeprefix(" "))
        return out


_models: dict[tuple[bytes, Sampling], Pieces] = {}


def pieces_of(model: bytes, how: Sampling) -> Pieces:
    """This worker process's table of a model's pieces, which serves later tasks too."""
    key = hashlib.sha256(model).digest(), how
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model, how)
    return _models[key]


class Board:
    """The lattice of a task's words: a place for every ending of a word, its edges by length, backward sums and conditional shares."""

    KINDS = {"src": np.int32, "dst": np.int64, "ids": np.int32, "log_share": np.float64, "below": np.float64, "log_rest": np.float64, "closing": np.bool_}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.first, self.beta = np.zeros(2, np.int64), np.zeros(1)
        for name, kind in self.KINDS.items():
            setattr(self, name, np.zeros(0, kind))
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # endings, sorted by hash
        self.places, self.edges = END + 1, 0
        self.more: dict[int, list[int]] = {}  # edges of several ids

    def _room(self, places: int, edges: int) -> None:
        def grown(x: np.ndarray, n: int) -> np.ndarray:
            return x if len(x) >= n else np.concatenate([x, np.zeros(n + n // 2 - len(x), x.dtype)])

        self.first, self.beta = grown(self.first, places + 1), grown(self.beta, places)
        for name in self.KINDS:
            setattr(self, name, grown(getattr(self, name), edges))

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The places of endings, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.numbers[at[known]]
        return out

    def lay(self, words: Words) -> np.ndarray:
        """The place of every word of a chunk; places of earlier chunks may not hold any more."""
        if self.places > REMEMBERED:
            self._empty()
        out = self._look(words.hashes)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            self._put(words, missing)
            out[missing] = self._look(words.hashes[missing])
        return out

    def _put(self, words: Words, chosen: np.ndarray) -> None:
        """Add the endings of the chosen words that are not here."""
        at, left, hashes = words.endings(chosen)
        hashes, seen, which = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._look(hashes)
        new = np.flatnonzero(number < 0)
        p = self.places
        number[new] = p + np.arange(len(new))
        place_at = np.full(len(words.codes), END, np.int64)  # of every character's ending
        place_at[at] = number[which]
        self._connect(words.codes, at[seen[new]], left[seen[new]], place_at)
        spot = np.searchsorted(self.hashes, hashes[new])
        self.hashes, self.numbers = np.insert(self.hashes, spot, hashes[new]), np.insert(self.numbers, spot, number[new])

    def _connect(self, codes: np.ndarray, at: np.ndarray, left: np.ndarray, place_at: np.ndarray) -> None:
        """Add places for the endings of `left` characters at `at`, with their edges."""
        pieces, n, p, e = self.pieces, len(at), self.places, self.edges
        powers = _powers(_BASE, pieces.longest + 1)
        # edges by place, then by length; a place's edges are counted length by length
        found = []
        number = np.zeros(n, np.int64)
        own = np.arange(n)
        hashes = np.zeros(n, np.uint64)  # of the characters from each place on
        for length in range(1, pieces.longest + 1):
            inside = np.flatnonzero(left[own] >= length)
            own, hashes = own[inside], hashes[inside]
            if not len(own):
                break
            hashes += codes[at[own] + (length - 1)].astype(np.uint64) * powers[length - 1]
            hit, ids = pieces.find(hashes, length)
            hashes = hashes[hit]
            if length == 1:  # characters outside the vocabulary: their bytes, or the unknown piece
                all_ids = np.full(n, -1, np.int64)
                all_ids[hit] = ids
                found.append((own, all_ids, number[own]))
                own = own[hit]
                number += 1
            else:
                own = own[hit]  # no piece goes on from where none begins
                is_piece = np.flatnonzero(ids >= 0)
                has = own[is_piece]
                found.append((has, ids[is_piece], number[has]))
                number[has] += 1
        first = np.concatenate([[0], np.cumsum(number)])
        n_edges = int(first[-1])
        src, dst, ids = (np.empty(n_edges, np.int64) for _ in range(3))
        for length, (has, some, rank) in enumerate(found, 1):
            spot = first[has] + rank
            src[spot], ids[spot] = has, some
            inner = np.flatnonzero(left[has] > length)
            dst[spot] = END
            dst[spot[inner]] = place_at[at[has[inner]] + length]
        score = pieces.log_p[np.maximum(ids, 0)]
        for k in np.flatnonzero(ids < 0).tolist():
            several = [pieces.byte_ids.get(b, pieces.unknown) for b in chr(int(codes[at[src[k]]])).encode("utf-8", "surrogatepass")] if pieces.byte_ids else [pieces.unknown]
            ids[k] = several[0] if len(several) == 1 else -2 - len(self.more)
            if len(several) > 1:
                self.more[-2 - len(self.more)] = several
            score[k] = pieces.fallback * len(several)
        self._room(p + n, e + n_edges)
        # backward sums, from the words' last places to their first; 0 at a word's end
        beta = self.beta
        longest = int(left.max()) if n else 0
        height = left.astype(np.uint16 if longest < 1 << 16 else np.int64)[src]  # 16 bits sort by radix
        by_height = np.argsort(height, kind="stable")
        bounds = np.searchsorted(height[by_height], np.arange(1, longest + 2))
        value = np.empty(n_edges)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            edges = by_height[a:b]
            v = score[edges] + beta[dst[edges]]
            value[edges] = v
            places = src[edges]
            heads = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            beta[p + places[heads]] = np.logaddexp.reduceat(v, heads)
        log_share = value - beta[p + src]
        share = np.exp(log_share)
        below = np.zeros(n_edges)  # shares of a place's earlier edges, summed place by place, so they don't depend on other words
        several = np.flatnonzero(number > 1)
        edge, end, so_far = first[several] + 1, first[several + 1], share[first[several]]
        while len(edge):
            below[edge] = so_far
            so_far = so_far + share[edge]
            edge = edge + 1
            more = np.flatnonzero(edge < end)
            edge, end, so_far = edge[more], end[more], so_far[more]
        with np.errstate(divide="ignore"):
            log_rest = np.log(np.maximum(1.0 - share, 0.0))
        log_rest[first[:-1][number == 1]] = -np.inf  # the only edge of its place
        self.first[p : p + n + 1] = first + e
        for name, own in (("src", src + p), ("dst", dst), ("ids", ids), ("log_share", log_share), ("below", below), ("log_rest", log_rest), ("closing", dst == END)):
            getattr(self, name)[e : e + n_edges] = own
        self.places, self.edges = p + n, e + n_edges

    def draw(self, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one path from each of `starts` to its word's end, one after the other, and their numbers; drawn with hashes of `keys`."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        active = np.arange(n)
        at = starts
        rounds = []
        step = 0
        while len(active):
            u = uniform(mix(keys + np.uint64((step + 1) * 0xA0761D6478BD642F % (1 << 64))))
            edge = self.first[at + 1] - 1  # a place's long pieces are last, and most paths take these
            open_ = np.flatnonzero(u < self.below[edge])
            rest = u[open_]
            while len(open_):
                edge[open_] -= 1
                more = rest < self.below[edge[open_]]
                open_, rest = open_[more], rest[more]
            rounds.append((active, edge))
            at = self.dst[edge]
            live = np.flatnonzero(at != END)
            active, at, keys = active[live], at[live], keys[live]
            step += 1
        for who, _ in rounds:
            counts[who] += 1
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (who, edge) in enumerate(rounds):
            out[begin[who] + k] = edge
        return out, counts


class Words:
    """The words of some texts: `unit` numbers each word in order, among the distinct ones by hash; text n has the units first[n] to first[n + 1]."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        n = len(self.codes)
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        if pieces.words_apart and n:
            cut[1:-1] |= (self.codes[1:] == SPACE) & (self.codes[:-1] != SPACE)
        begins = np.flatnonzero(cut[:-1])
        sizes = np.append(begins[1:], n) - begins if len(begins) else np.zeros(0, np.int64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:-1], out=self.sums[1:])
        self.hashes, seen, self.unit = np.unique(self._hash(begins, sizes), return_index=True, return_inverse=True)
        self.begins, self.sizes = begins[seen], sizes[seen]
        self.first = np.searchsorted(begins, bounds)

    def _hash(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the `sizes` characters at `at`."""
        powers = _powers(pow(_BASE, -1, 1 << 64), len(self.sums))
        return mix((self.sums[at + sizes] - self.sums[at]) * powers[at] + sizes.astype(np.uint64))

    def endings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The endings of the chosen distinct words, whole ones too: first character, length and hash."""
        sizes = self.sizes[chosen]
        done = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, left = np.repeat(self.begins[chosen], sizes) + done, np.repeat(sizes, sizes) - done
        return at, left, self._hash(at, left)


def _mix_int(x: int) -> int:
    """mix of one number."""
    x %= 1 << 64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


def _uniform_int(x: int) -> float:
    """uniform of one hash."""
    return ((x >> 11) + 0.5) * 2.0**-53


def _below(loc: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at `loc`, given that they are below `top`."""
    with np.errstate(divide="ignore", over="ignore"):
        return loc - np.log(np.exp(loc - top) - np.log(u))


class _Text:
    """A text's search: its queue of groups, and its leaves so far."""

    def __init__(self, key: int, first_unit: int, n_units: int):
        self.key, self.first_unit, self.n_units = key, first_unit, n_units
        self.queue: list[tuple] = []
        self.leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []  # edges, their log shares and sums of these, perturbed value


def sample_chunk(pieces: Pieces, how: Sampling, keys: list[int], texts: list[str], board: Board | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its leaves in order: ids, log p, perturbed value, log of the inclusion probability."""
    words = Words(pieces, texts)
    lattice = board or Board(pieces)
    word_start, unit = lattice.lay(words), words.unit
    states = [_Text(k, int(words.first[n]), int(words.first[n + 1] - words.first[n])) for n, k in enumerate(keys)]
    # the first leaves
    for s in states:
        s.key = _mix_int(s.key * 0x9E3779B97F4A7C15 + how.seed)
    wanted = [(s, -math.log(-math.log(_uniform_int(_mix_int(s.key)))), None, 0, None) for s in states]
    for leaf in range(how.k):
        _extend(lattice, how, wanted, unit, word_start, leaf)
        if leaf + 1 == how.k:
            break
        wanted = [x for x in (_open(lattice, s, leaf + 1) for s in states) if x is not None]
    out = []
    for s in states:
        threshold = -s.queue[0][0] if s.queue else -math.inf
        own = []
        for edges, _, sums, value in s.leaves:
            log_p = float(sums[-1]) if len(sums) else 0.0
            x = log_p - threshold
            log_inclusion = 0.0 if x == math.inf or x > 30 else (x - math.exp(x) / 2 if x < -20 else math.log(-math.expm1(-math.exp(x))))
            own.append((_ids(lattice, edges), log_p, value, log_inclusion))
        out.append(own)
    return out


def _ids(lattice: Board, edges: np.ndarray) -> np.ndarray:
    ids = lattice.ids[edges]
    if len(lattice.more) and (ids < -1).any():
        return np.array([i for x in ids.tolist() for i in (lattice.more[x] if x < -1 else (x,))], np.uint32)
    return ids.astype(np.uint32)


def _extend(lattice: Board, how: Sampling, wanted: list[tuple], unit: np.ndarray, word_start: np.ndarray, leaf: int) -> None:
    """Draw the rest of each path: (text, value, (leaf, edges taken of it, next edge) or None, words passed, place in the next word or None), and queue the groups beside it."""
    if not wanted:
        return
    spans = np.array([s.n_units - done for s, _, _, done, _ in wanted], np.int64)
    heads = np.cumsum(spans) - spans
    passed = np.arange(int(spans.sum())) + np.repeat(np.array([done for _, _, _, done, _ in wanted], np.int64) - heads, spans)
    starts = word_start[unit[passed + np.repeat(np.array([s.first_unit for s, *_ in wanted], np.int64), spans)]]
    for n, (_, _, _, _, place) in enumerate(wanted):
        if place is not None and spans[n]:
            starts[heads[n]] = place
    own = np.array([(s.key + (leaf + 1) * 0xE7037ED1A0B428DB) % (1 << 64) for s, *_ in wanted], np.uint64)
    edges, counts = lattice.draw(mix(np.repeat(own, spans) + passed.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)), starts)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *spans])].tolist()
    # all texts' new edges, one after the other: the next edge of an opened group, and what was drawn behind it
    parts, sizes = [], []
    for n, (_, _, opened, _, _) in enumerate(wanted):
        if opened is not None:
            parts.append(np.array([opened[2]], np.int64))
        parts.append(edges[ends[n] : ends[n + 1]])
        sizes.append(ends[n + 1] - ends[n] + (opened is not None))
    fresh = np.concatenate(parts)
    share, sums = lattice.log_share[fresh], np.empty(len(fresh))
    a = 0
    for (s, value, opened, _, _), size in zip(wanted, sizes, strict=True):
        b = a + size
        if opened is None or not opened[1]:
            np.cumsum(share[a:b], out=sums[a:b])
            s.leaves.append((fresh[a:b], share[a:b], sums[a:b], value))
        else:
            of, k, _ = opened
            path, shares, upto, _ = s.leaves[of]
            sums[a:b] = np.cumsum(np.concatenate([upto[k - 1 : k], share[a:b]]))[1:]
            s.leaves.append((np.concatenate([path[:k], fresh[a:b]]), np.concatenate([shares[:k], share[a:b]]), np.concatenate([upto[:k], sums[a:b]]), value))
        a = b
    _queue(lattice, how, wanted, fresh, np.array(sizes, np.int64), sums - share + lattice.log_rest[fresh], leaf)


def _queue(lattice: Board, how: Sampling, wanted: list[tuple], fresh: np.ndarray, sizes: np.ndarray, loc: np.ndarray, leaf: int) -> None:
    """Queue the best groups beside each text's new edges, as many as leaves or thresholds are still to come; loc: a group's log p."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.array([opened[1] if opened is not None else 0 for _, _, opened, _, _ in wanted], np.int64)  # of the new edges in their paths
    at = np.arange(len(fresh)) + np.repeat(begins - bounds[:-1], sizes)
    own = np.array([(s.key + (leaf + 1) * 0x589965CC75374CC3) % (1 << 64) for s, *_ in wanted], np.uint64)
    u = uniform(mix(np.repeat(own, sizes) + at.astype(np.uint64) * np.uint64(0x1D8E4E27C47D124F)))
    got = _below(loc, np.repeat(np.array([value for _, value, *_ in wanted]), sizes), u)
    got[bounds[:-1][[opened is not None for _, _, opened, _, _ in wanted]]] = -np.inf  # what is beside an opened group's edge is queued already
    for (s, *_), begin, a, b in zip(wanted, begins.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        need = how.k + 1 - len(s.leaves)
        some = got[a:b]
        top = np.argpartition(some, len(some) - need)[-need:] if len(some) > need else np.arange(len(some))
        for v, k in sorted(zip(some[top].tolist(), top.tolist(), strict=True), reverse=True):
            if v > -math.inf:
                heappush(s.queue, (-v, len(s.leaves) - 1, begin + k, (int(fresh[a + k]),)))


def _open(lattice: Board, s: _Text, leaf: int) -> tuple | None:
    """Open the best group: its new child, and the smaller group that is left."""
    if not s.queue:
        return None
    low, of, k, shut = heappop(s.queue)
    value = -low
    path, path_shares = s.leaves[of][:2]
    place = int(lattice.src[path[k]])
    edges = [e for e in range(int(lattice.first[place]), int(lattice.first[place + 1])) if e not in shut]
    shares = np.exp(lattice.log_share[edges])
    upto = np.cumsum(shares)
    u = _uniform_int(_mix_int(s.key + (leaf + 1) * 0x2D358DCCAA6C78A5 + k)) * upto[-1]
    pick = min(int(np.searchsorted(upto, u, "right")), len(edges) - 1)
    chosen = edges[pick]
    rest = float(upto[-1] - shares[pick]) if len(edges) > 1 else 0.0
    if rest > 0:
        loc = float(path_shares[:k].sum()) + math.log(rest)
        u = _uniform_int(_mix_int(s.key + (leaf + 1) * 0x8BB84B93962EACC9 + k + 1))
        heappush(s.queue, (-float(_below(np.array([loc]), value, np.array([u]))[0]), of, k, (*shut, chosen)))
    passed = int(np.count_nonzero(lattice.closing[path[:k]]))  # words: each word's path ends at its end
    target = int(lattice.dst[chosen])
    if target == END:
        return s, value, (of, k, chosen), passed + 1, None
    return s, value, (of, k, chosen), passed, target


def sample_segmentations(docs: DataFrame, model: bytes, how: Sampling = Sampling(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, decoded: bool = False) -> DataFrame:
    """A row for each sampled segmentation: id_col, sample (0 is the best), n_pieces, log_p, value, log_inclusion, ids_crc32 and, if asked for, ids and decodes (whether the ids decode to the normalised text).

    A text has how.k rows, or as many as it has segmentations. Null and empty texts have one, the empty one. Repeated rows
    have the same samples, since draws depend on the identifier and the text only; a null identifier is a key like
    others. An empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file
    kind = docs.schema[id_col].dataType

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(held.value, how)
        board = Board(pieces)
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            first, size, own = 0, 0, []
            for n in range(len(texts)):
                own.append(pieces.normal(texts[n].as_py() or ""))
                size += len(own[-1])
                if size >= CHUNK or n + 1 == len(texts):
                    yield rows(ids.slice(first, len(own)), sample_chunk(pieces, how, keys[first : n + 1], own, board), pieces, own)
                    first, size, own = n + 1, 0, []

    def rows(ids: pa.Array, sampled: list, pieces: Pieces, texts: list[str]) -> pa.RecordBatch:
        at = [n for n, leaves in enumerate(sampled) for _ in leaves]
        flat = [x for leaves in sampled for x in leaves]
        columns = [
            ids.take(pa.array(at, pa.int64())),
            pa.array([k for leaves in sampled for k in range(len(leaves))], pa.int32()),
            pa.array([len(x[0]) for x in flat], pa.int64()),
            *[pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)],
            pa.array([zlib.crc32(x[0].astype("<u4").tobytes()) for x in flat], pa.int64()),
        ]
        names = [id_col, "sample", "n_pieces", "log_p", "value", "log_inclusion", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([x[0].astype(np.int32) for x in flat], pa.list_(pa.int32())))
            names.append("ids")
        if decoded:
            columns.append(pa.array(pieces.decodes([x[0] for x in flat], [texts[n] for n in at]), pa.bool_()))
            names.append("decodes")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind.simpleString()}, sample int, n_pieces long, log_p double, value double, log_inclusion double, ids_crc32 long" + ", ids array<int>" * with_ids + ", decodes boolean" * decoded
    return docs.select(F.col(id_col), F.xxhash64(id_col).alias("__key"), F.col(text_col)).mapInArrow(sample, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """`rows` with the column decoded: the text of the pieces in `ids_col` (null: null)."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "decoded"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        for batch in batches:
            lists = batch.column(names.index(ids_col)).to_pylist()
            texts = [None if x is None else processor.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.select(*names).mapInArrow(read, StructType([*rows.select(*names).schema.fields, StructField("decoded", StringType())]))
