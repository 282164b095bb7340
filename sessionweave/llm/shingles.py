"""Word shingles of texts as sorted sets of 52-bit hashes, and MinHash bands over them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_tokens import _Seen

_U = np.uint64
MOST_TEXTS = 4096  # whose numbers fit above the 52 bits of a hash; more are taken in turn


def bands_for(similarity: float, recall: float, most: int = 256, rows: int | None = None) -> tuple[int, int]:
    """Bands and rows a band: the most rows (so the fewest chance candidates) whose bands reach recall within most hashes."""
    for r in range(rows or 16, 0, -1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - similarity**r))
        if b * r <= most:
            return b, r
    raise ValueError("no bands within that many hashes")


class Shingler:
    """Lower-cased words between white space, n in a row; a text of fewer words is one shingle, one without words has none."""

    def __init__(self, n: int = 5, most_words: int = 200_000):
        self.n, self.most = n, most_words
        self._clear()

    def _clear(self):
        self.seen, self.hash = _Seen(), np.zeros(0, _U)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of all texts one after another, each text's in order, and where each begins (with the end)."""
        from xxhash import xxh3_64_intdigest

        if len(texts) > MOST_TEXTS:
            parts = [self.sets(texts.slice(k, MOST_TEXTS)) for k in range(0, len(texts), MOST_TEXTS)]
            base = np.cumsum([0, *(len(h) for h, _ in parts)])
            return np.concatenate([h for h, _ in parts]), np.concatenate([[0], *(c[1:] + b for (_, c), b in zip(parts, base, strict=False))])
        if len(self.seen) > self.most:
            self._clear()
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))))
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(words.values.slice(offsets[0], offsets[-1] - offsets[0]))
        offsets -= offsets[0]
        numbers = np.fromiter(map(self.seen.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.seen.new:
            self.hash = np.concatenate([self.hash, np.array([xxh3_64_intdigest(w.encode()) | 1 if w else 0 for w in self.seen.new], _U)])
            self.seen.new = []
        w = self.hash[numbers[coded.indices.to_numpy()]] if len(coded.dictionary) else np.zeros(0, _U)
        size = np.diff(offsets)
        blank = (size == 1) & (np.append(w, _U(0))[np.minimum(offsets[:-1], len(w))] == 0)  # the one word of a blank text is ""
        count = np.where(blank, 0, np.where(size > 0, np.maximum(size - self.n + 1, 1), 0))
        after = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(np.arange(len(size)), count)
        at = np.arange(after[-1]) - after[owner] + offsets[owner]
        h = np.zeros(len(at), _U)
        last = offsets[1:][owner]
        for k in range(self.n):  # a word's place counts; beyond a short text's end nothing is added
            h = h * _U(0x9E3779B97F4A7C15) + np.where(at + k < last, np.append(w, _U(0))[np.minimum(at + k, len(w))], _U(0))
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        # the text's number above 52 bits of the hash: one plain sort orders every set
        both = np.sort(owner.astype(_U) << _U(52) | h >> _U(12))
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        cut = np.searchsorted(both, np.arange(len(size) + 1).astype(_U) << _U(52))
        both &= _U((1 << 52) - 1)
        return both, cut


def band_hashes(h: np.ndarray, cut: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each set; sets are not empty."""
    rng = np.random.default_rng(7919)
    a, b = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    x, starts = (h >> _U(20)).astype(np.uint32), cut[:-1]
    out = np.zeros((len(starts), bands), _U)
    for k in range(bands):
        mixed = np.full(len(starts), k + 1, _U)
        for j in range(k * rows, (k + 1) * rows):
            least = np.minimum.reduceat(x * a[j] + b[j], starts)
            mixed = (mixed ^ least.astype(_U)) * _U(0x9E3779B97F4A7C15)
            mixed ^= mixed >> _U(32)
        out[:, k] = mixed
    return out.view(np.int64)
