"""Vectorised merge rounds of byte-pair encoding over many words at once.

Words lie in flat numpy arrays of symbols.  In each round the least pair rank of every word is found by a segmented
minimum, the leftmost pair with that rank is merged in all words simultaneously, and the arrays are compacted; words in
which no pair remains leave the arrays.  A round costs time in proportion to the symbols that are still there, and only
the pairs beside a merge are looked up again.

A word of more than LONG symbols would take as many rounds by itself as it has merges.  There a round merges all places of the least
pair from left to right, found from lists of places by rank, so rounds are as many as different pairs and each costs what
it merges.  Where a merge makes a pair of a lesser rank, that round merges the leftmost place only, as the order demands.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int64).max
LONG = 1000


class PairTable:
    """Pairs of symbols that merge: rank (least first) and the symbol that they become."""

    def __init__(self, left, right, rank, merged):
        key = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], np.asarray(rank, np.int64)[order], np.asarray(merged, np.int64)[order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), self.merged[at]


def _long_word(word: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols of one long word when no pair remains."""
    n = len(word)
    sym = np.append(word.astype(np.int64), -1)  # place n is the end
    after, before = np.minimum(np.arange(1, n + 2), n), np.arange(-1, n)
    rank, to = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
    ranks: list[int] = []
    places: dict[int, list[np.ndarray]] = {}

    def look_up(at: np.ndarray) -> None:
        rank[at] = NONE
        at = at[after[at] < n]
        rank[at], to[at] = table(sym[at], sym[after[at]])
        at = at[rank[at] < NONE]
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for some in np.split(at, cuts) if len(at) else ():
            r = int(rank[some[0]])
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(some)

    look_up(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        first = np.concatenate([[True], after[at[:-1]] != at[1:]])  # in a row of one symbol every second place merges
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        new = np.full(len(at), to[at[0]])
        left, right = before[at], after[after[at]]
        inner, outer = left >= 0, right < n
        made = [table(sym[left[inner]], new[inner])[0], table(new[outer], sym[right[outer]])[0], table(new[:1], new[:1])[0]]
        if len(at) > 1 and any((m < r).any() for m in made):
            places[r] = [at[1:]]
            heapq.heappush(ranks, r)
            at, new = at[:1], new[:1]
        gone = after[at]
        sym[at], rank[gone] = new, NONE
        after[at] = after[gone]
        before[after[at]] = at
        sym[gone] = -1
        left = before[at]
        look_up(np.unique(np.concatenate([at, left[left >= 0]])))
    return sym[:n][sym[:n] >= 0]


def merge_words(sym: np.ndarray, word: np.ndarray, table: PairTable, block: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left when no pair remains, and the word of each; word is non-decreasing.

    Words go in blocks of about block symbols, so that the arrays of a round stay in the processor's cache."""
    out, a = [], 0
    while a < len(sym):
        b = min(a + block, len(sym))
        b = int(np.searchsorted(word, word[b - 1], side="right"))
        got, of = _merge_block(sym[a:b], word[a:b] - word[a], table)
        out.append((got, of + word[a]))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _merge_block(sym: np.ndarray, word: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    sym, word = sym.astype(np.int64), word.astype(np.int64)
    done_sym, done_word = [], []
    size = np.bincount(word) if len(word) else np.zeros(0, np.int64)
    if (size > LONG).any():
        long = size[word] > LONG
        for w in np.flatnonzero(size > LONG):
            a, b = np.searchsorted(word, [w, w + 1])
            got = _long_word(sym[a:b], table)
            done_sym.append(got)
            done_word.append(np.full(len(got), w, np.int64))
        sym, word = sym[~long], word[~long]
    rank, to = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], to[inner] = table(sym[inner], sym[inner + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        live = low < NONE
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, to, low = sym[live], word[live], rank[live], to[live], low[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == low)
        at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
        sym[at] = to[at]
        rest = np.ones(len(sym), bool)
        rest[at + 1] = False
        # what a merged symbol is beside changes: its pair to the right and the one to the left
        sym, word, rank, to = sym[rest], word[rest], rank[rest], to[rest]
        at = at - np.arange(len(at))
        rank[at] = NONE
        right = at[(at + 1 < len(sym))]
        right = right[word[right] == word[right + 1]]
        left = at[at > 0] - 1
        left = left[word[left] == word[left + 1]]
        for x in (left, right):
            rank[x], to[x] = table(sym[x], sym[x + 1])
    if not done_sym:
        return sym, word
    out_sym, out_word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(out_word, kind="stable")
    return out_sym[order], out_word[order]
