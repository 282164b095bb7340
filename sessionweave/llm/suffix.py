"""Suffixes sorted to a depth by prefix doubling; suffix arrays by induced sorting, and permuted common prefixes; in numpy.

Suffixes are classified as larger (L) or smaller (S) than the next one; the leftmost S of each run (LMS) cut the text into
substrings.  One pass over the buckets in rising order places the L suffixes behind the LMS ones, one in falling order places
the S suffixes behind the L ones.  A first such pair of passes sorts the LMS substrings; they are named, the string of names is
sorted recursively where names repeat, and a second pair of passes induces the whole array from the sorted LMS suffixes.

A bucket is the unit of vectorisation: all suffixes of a bucket that are known look one place to the left at once, and what they
find is dealt stably to the ends of its buckets.  Suffixes found for the bucket itself are the next round there, so a bucket takes
as many rounds as the longest run of its symbol.  Every suffix is placed once a pass, so a pass is linear.  To keep the number of
buckets small, names are written as two digits in the recursion where they are many.
"""

from __future__ import annotations

import numpy as np

MANY, FEW, SHORT = 1024, 4096, 65536  # names beyond MANY are written as two digits; strings up to SHORT are sorted by doubling


def _bucket_pass(text: np.ndarray, seeds: np.ndarray, cut: np.ndarray, member: np.ndarray, symbols: list[int], size: np.ndarray) -> np.ndarray:
    """Members (a mask of suffixes) in the order in which a scan of the buckets in the order symbols comes to place them.

    seeds[cut[c] : cut[c + 1]] are the suffixes of bucket c that are known already; they come after its members.  size: members
    by symbol.  The result holds the buckets by symbol, each in the scan's order."""
    start = np.cumsum(size) - size
    fill = start.copy()
    out = np.empty(int(size.sum()), np.int32)
    count_up = np.arange(max(len(out), len(seeds)))

    def place(batch: np.ndarray) -> None:
        j = batch - 1
        j = j.compress(member.take(j))
        if not len(j):
            return
        s = text.take(j)
        order = s.argsort(kind="stable")  # a radix sort for symbols of 16 bits
        s = s.take(order)
        if len(size) <= FEW:
            count = np.bincount(s, minlength=len(size))
            to = (fill - count.cumsum() + count).take(s)
            to += count_up[: len(s)]
            out[to] = j.take(order)
            fill.__iadd__(count)
        else:
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            count = np.diff(np.append(first, len(s)))
            named = s[first]
            out[np.repeat(fill[named] - first, count) + count_up[: len(s)]] = j.take(order)
            fill[named] += count

    for c in symbols:
        a = start[c]
        while a < fill[c]:
            batch = out[a : fill[c]]
            a = fill[c]
            place(batch)
        if cut[c] < cut[c + 1]:
            place(seeds[cut[c] : cut[c + 1]])
    return out


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array of a short text, where the recursion ends, by doubling the compared length."""
    n, k = len(text), 1
    rank = text.astype(np.int64)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:-k] += rank[k:] + 1
        order = key.argsort(kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of text (non-negative integers), whose last symbol is its least and occurs once."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if n <= SHORT:
        return _doubled(text)
    sigma = int(text.max()) + 1
    text = text.astype(np.uint16 if sigma <= 1 << 16 else np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    small = np.append(np.repeat(text[change + 1] > text[change], np.diff(change, prepend=-1)), True)
    lms = small.copy()
    lms[0] = False
    lms[1:] &= ~small[:-1]
    where = np.flatnonzero(lms).astype(np.int32)
    total, larger = np.bincount(text, minlength=sigma), np.bincount(text[~small], minlength=sigma)
    smaller = total - larger
    smaller[text[-1]] -= 1  # the closing symbol is known, not induced
    present = np.flatnonzero(total).tolist()
    is_l, is_s = ~small, small.copy()
    is_s[-1] = False
    lms_cut = np.concatenate([[0], np.cumsum(np.bincount(text[where], minlength=sigma))])
    l_cut = np.concatenate([[0], np.cumsum(larger)])

    def induce(sorted_lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """L suffixes in order, and S suffixes by symbol in falling order, from LMS suffixes that are sorted (by symbol at least)."""
        l_part = _bucket_pass(text, sorted_lms, lms_cut, is_l, present, larger)
        # in the falling scan a bucket's L suffixes come after its S suffixes, largest first
        owner = np.repeat(np.arange(sigma), larger)
        falling = l_part[l_cut[owner] + l_cut[owner + 1] - 1 - np.arange(len(l_part))]
        return l_part, _bucket_pass(text, falling, l_cut, is_s, present[::-1], smaller)

    s_end = np.cumsum(smaller)

    def rising(s_part: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(sigma), smaller)
        return s_part[(s_end - smaller)[owner] + s_end[owner] - 1 - np.arange(len(s_part))]

    by_symbol = where[np.argsort(text[where], kind="stable")]
    s_sorted = rising(induce(by_symbol)[1])
    found = np.concatenate([[n - 1], s_sorted[lms[s_sorted]]])  # LMS suffixes sorted by their LMS substrings
    end = np.zeros(n, np.int64)
    end[where] = np.append(where[1:], n - 1)
    length = end[found] - found + 1
    same = length[1:] == length[:-1]
    a, b, k = found[:-1][same], found[1:][same], length[1:][same]
    if len(k):
        first = np.cumsum(k) - k
        step = np.arange(int(k.sum())) - np.repeat(first, k)
        same[np.flatnonzero(same)] = ~np.logical_or.reduceat(text[np.repeat(a, k) + step] != text[np.repeat(b, k) + step], first)
    names = np.zeros(n, np.int64)
    names[found] = np.concatenate([[0], np.cumsum(~same)])
    names = names[where]
    held = int(names.max()) + 1
    if held < len(where):
        if held <= MANY or 2 * len(where) > 0.9 * n:
            order = suffix_array(names)
        else:
            base = int(np.ceil(np.sqrt(held + 1)))
            digits = np.zeros(2 * len(names) + 1, np.int64)
            digits[:-1:2], digits[1::2] = names // base + 1, names % base + 1
            order = suffix_array(digits)
            order = order[(order % 2 == 0) & (order < 2 * len(names))] // 2
        found = where[order]
    l_part, s_part = induce(found)
    out = np.empty(n, np.int64)
    head = np.cumsum(total) - total
    out[0] = n - 1
    owner = np.repeat(np.arange(sigma), larger)
    out[head[owner] + np.arange(len(l_part)) - l_cut[owner]] = l_part
    owner = np.repeat(np.arange(sigma), smaller)
    tail = head + total
    s_part = rising(s_part)
    out[tail[owner] - s_end[owner] + np.arange(len(s_part))] = s_part
    return out


def same_prefix(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes at places (rising, at least length bytes before the end of text, uint8) have their first length bytes in
    common with another of them.

    The suffixes are sorted by those bytes alone, as in a suffix array that is not told apart any deeper; neighbours whose common
    prefix reaches length are marked.  The order by eight bytes gives ranks; the order by two or three times as many comes from the
    ranks at as many places, if those fit 63 bits together.  Only suffixes that a longer prefix is made of are sorted."""
    n, k = len(text), min(8, length)
    bits = (n + 1).bit_length()
    offsets: list[list[int]] = []
    while k < length:
        parts = max(2, 62 // bits)
        to = min(length, parts * k)
        offsets.append(sorted({min(j * k, to - k) for j in range(parts)}))
        k = to
    need = [places]
    for steps in reversed(offsets):
        mask = np.zeros(n, bool)
        for o in steps:
            mask[need[-1] + o] = True
        need.append(np.flatnonzero(mask))
    need.reverse()
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = text
    word = np.zeros(n, np.uint64)
    for j in range(min(8, length)):
        word = word << np.uint64(8) | pad[j : j + n]
    key, rank = word.take(need[0]), np.zeros(n, np.int64)
    order = key.argsort()
    key = key.take(order)
    for before, at, steps in zip(need[:-1], need[1:], offsets, strict=True):
        name = np.zeros(len(before), np.int64)
        np.cumsum(key[1:] != key[:-1], out=name[1:])
        rank[before.take(order)] = name
        key = rank.take(at)
        for o in steps[1:]:
            key = (key << bits) + rank.take(at + o)
        order = key.argsort()
        key = key.take(order)
    equal = np.flatnonzero(key[1:] == key[:-1])
    out = np.zeros(len(places), bool)
    out[order[equal]] = True
    out[order[equal + 1]] = True
    return out


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in sa, by text position (uint8 text).

    Where the symbols before both suffixes agree, the value is that of the position to the left less one; only the other,
    irreducible, positions are compared, eight bytes at a time."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = np.where(phi > 0, text[phi - 1], 0)
    left = np.concatenate([[0], text[:-1]])
    irreducible = (phi <= 0) | (i == 0) | (before != left)
    at = i[irreducible & (phi >= 0)]
    pad = np.concatenate([text, np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= pad[k : k + n + 8] << np.uint64(8 * k)
    value = np.zeros(n, np.int64)
    a, b, got = at.copy(), phi[at], np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        room = n - np.maximum(x, y)
        diff = word[np.minimum(x, n)] ^ word[np.minimum(y, n)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.log2(low.astype(np.float64), where=diff != 0, out=np.zeros(len(diff))).astype(np.int64) // 8)
        got[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]
    value[at] = got
    anchor = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.where(irreducible, value, np.maximum(value[anchor] - (i - anchor), 0))
