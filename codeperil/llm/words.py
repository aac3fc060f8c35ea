"""Fast, exact whole-text encoding with the tokenizers library (Python side, no Spark)."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True  # comma and full stop
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True  # ASCII digits and letters
#: Pieces that the library encodes at once: an encoding takes about a kilobyte until its ids are read.
LEARNT = 4096


class WordEncoder:
    """Encode whole texts; equal pieces between blanks are encoded by the library once.

    A tokenizer whose pre-tokenizer drops white space gives the pieces between ASCII blanks, one by one, the ids that
    they have in the whole text: no token spans a blank and nothing composes with one. `blanks_part` says whether a
    tokenizer file is of this kind; other files get whole texts. A closing comma or full stop behind an ASCII letter or
    digit is a token run of its own, and such files lower-case, so pieces are looked up without it and in lower case.
    Texts with a special token's opening or with a combining mark behind a blank are always encoded whole.

    Pieces are known by a 64-bit hash of their bytes and length, in an open-addressing table of numpy arrays. `limit`
    bounds the pieces that are remembered (memory), not what is encoded.
    """

    def __init__(self, tokenizer_json: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        config = json.loads(tokenizer_json)
        self.apart = blanks_part(config)
        self.openings = sorted({t["content"].encode()[:2] for t in config.get("added_tokens", [])})
        self.limit = limit
        self.mask = (1 << max(10, (2 * limit - 1).bit_length())) - 1
        self.powers = self.inverses = np.zeros(0, np.uint64)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.numbers = np.zeros(self.mask + 1, np.int32)
        self.n = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.powers, self.inverses = (_powers(b, n) for b in (_BASE, inverse))

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The number of every hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        hit = key == hashes
        out[hit] = self.numbers[slot[hit]]
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.numbers[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray, first: int) -> None:
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]
            won = self.keys[at] == hashes[left]
            self.numbers[at[won]] = first + left[won]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        lists: list[list[int]] = []
        for a in range(0, len(words), LEARNT):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + LEARNT], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self.begin[self.n : self.n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + len(words)] = sizes
        self._insert(hashes, self.n)
        self.used += total
        self.n += len(words)

    def mark_whole(self, hashes: np.ndarray) -> None:
        """Texts with these pieces are encoded whole, now and later: the pieces keep a number below 0 in the table."""
        for h in hashes:
            slot = int(h) & self.mask
            while self.keys[slot] != h:
                slot = (slot + 1) & self.mask
            self.numbers[slot] = -2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as uint32 arrays."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        return self.encode_arrow(pa.array(texts, pa.large_string())) if texts else []

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_arrow(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a string array (null: empty)."""
        if not len(texts):
            return []
        if not self.apart:
            return [self._whole(t or "") for t in texts.to_pylist()]
        wide = pa.types.is_large_string(texts.type)
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if bounds[-1] == bounds[0]:
            return [np.zeros(0, np.uint32)] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        odd = self._odd(data, bounds)
        ids, ends, more = self._encode(data, bounds)
        out = np.split(ids, ends[:-1])
        for n in sorted({*odd, *more}):
            out[n] = self._whole(texts[n].as_py() or "")
        return out

    def _odd(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Texts with a special token's opening."""
        places = [np.flatnonzero((data[:-1] == x[0]) & (data[1:] == x[1])) for x in self.openings if len(x) == 2]
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        return np.unique(np.searchsorted(bounds, at, "right") - 1).tolist()

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """All ids, each text's end in them, and the texts that must be encoded whole."""
        if self.n > self.limit:
            self._empty()
        self._grown(len(data) + 1)
        blank = _BLANK[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[bounds] = True
        before = np.concatenate([[True], blank[:-1]]) | edge[:-1]
        after = np.concatenate([blank[1:], [True]]) | edge[1:]
        starts = np.flatnonzero(~blank & before)
        ends = np.flatnonzero(~blank & after) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64), []
        lowered = _LOWER[data]
        marked = _MARK[data[ends - 1]] & (ends - starts > 1)
        marked &= _LETTER[data[np.maximum(ends - 2, 0)]]
        # units: each word without its closing mark, and behind it the mark
        place = np.arange(len(starts)) + np.cumsum(marked) - marked
        n_units = len(starts) + int(marked.sum())
        a, b = np.empty(n_units, np.int64), np.empty(n_units, np.int64)
        a[place], b[place] = starts, ends - marked
        a[place[marked] + 1], b[place[marked] + 1] = ends[marked] - 1, ends[marked]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        hashes = (sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64)
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        hashes[hashes == 0] = 1
        at = self._look(hashes)
        whole = np.unique(np.searchsorted(bounds, a[at == -2], "right") - 1).tolist()
        missed = np.flatnonzero(at == -1)
        if len(missed):
            new, first = np.unique(hashes[missed], return_index=True)
            units = missed[first]
            raw = lowered.tobytes()
            words = [raw[i:j].decode() for i, j in zip(a[units].tolist(), b[units].tolist(), strict=True)]
            self._learn(new, words)
            odd = [n for n, w in enumerate(words) if not w[0].isascii() and unicodedata.combining(w[0])]
            if odd:
                hit = np.flatnonzero(np.isin(hashes, new[odd]))
                whole += np.unique(np.searchsorted(bounds, a[hit], "right") - 1).tolist()
                self.mark_whole(new[odd])
            at[missed] = self._look(hashes[missed])
        at[at < 0] = 0  # of texts that are encoded whole
        sizes = self.count[at]
        until = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[at] - (until - sizes), sizes) + np.arange(int(until[-1]))]
        text_ends = np.concatenate([[0], until])[np.searchsorted(a, bounds[1:])]
        return ids, text_ends, whole


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """This worker process's encoder for a tokenizer file: what it has learnt serves later tasks."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def blanks_part(config: dict) -> bool:
    """Whether the file's normaliser and pre-tokenizer let blanks part a text: only NFC/NFKC, lower-casing and folding of white space to a blank, then a split on a pattern that keeps no white space."""
    normaliser = config.get("normalizer") or {}
    steps = normaliser.get("normalizers", [normaliser] if normaliser else [])
    for step in steps:
        folds = step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "
        if step["type"] not in ("NFC", "Lowercase") and not folds:
            return False
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre] if pre else [])
    kept_out = any(p["type"] == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in p["pattern"].get("Regex", "") and "[^\\s" in p["pattern"]["Regex"] for p in parts)
    plain = not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in config.get("added_tokens", []))
    return kept_out and plain and any(s["type"] == "Replace" for s in steps) and config.get("post_processor") is None
