"""Windows that occur twice, told by sorting suffixes to a depth, against brute force and the whole suffix array."""

import random
import time
from collections import Counter

import numpy as np

from sessionweave.llm.substring_dedup import repeated_windows
from sessionweave.llm.suffix import permuted_lcp, suffix_array


def test_repeated_windows():
    r = random.Random(3)
    for _ in range(300):
        length = r.choice([1, 2, 7, 8, 9, 17, 40, 200])
        contexts = [bytes(r.choice(b"ab\x00") for _ in range(r.choice([0, length - 1, length, length + 5, 3 * length]))) for _ in range(r.randint(1, 6))]
        contexts += [c[r.randint(0, 2) :] for c in contexts[:3]]
        mask, starts = repeated_windows(contexts, length)
        windows = [(s + k, c[k : k + length]) for s, c in zip(starts, contexts, strict=True) for k in range(len(c) - length + 1)]
        count = Counter(w for _, w in windows)
        assert np.flatnonzero(mask).tolist() == [k for k, w in windows if count[w] > 1]


def test_sorted_no_deeper_than_asked():
    rng = np.random.default_rng(5)
    contexts = [bytes(rng.integers(97, 110, 223, dtype=np.uint8)) for _ in range(1500)]
    flat = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)
    start = time.process_time()
    permuted_lcp(flat, suffix_array(np.append(flat.astype(np.int32) + 1, 0))[1:])
    whole = time.process_time() - start
    start = time.process_time()
    repeated_windows(contexts)
    assert time.process_time() - start < 0.7 * whole
