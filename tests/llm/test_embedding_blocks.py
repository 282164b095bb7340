"""Embedding links of labels of thousands of vectors: none missed, and no table that outgrows its vectors."""

from collections import Counter

import numpy as np

from sessionweave.llm import common


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors():
    """3000 directions, 40 beside them a billionth within or beyond the threshold, 300 copies nearly equal."""
    rng = np.random.default_rng(3)
    x = units(rng.standard_normal((3000, 64)))
    beside = units((z := rng.standard_normal((40, 64))) - (z * x[:40]).sum(axis=1, keepdims=True) * x[:40])
    cos = 0.98 + 1e-9 * np.where(np.arange(40) % 2, 1, -1)[:, None]
    return np.concatenate([x, cos * x[:40] + np.sqrt(1 - cos**2) * beside, x[50] + 1e-3 * rng.standard_normal((300, 64))])


def test_large_label_is_not_stored_many_times(spark, monkeypatch):
    from sessionweave.llm.embedding_dedup import embedding_groups

    x = vectors()
    link = units(x) @ units(x).T >= 0.98
    np.fill_diagonal(link, False)
    assert link[np.arange(40), np.arange(3000, 3040)].tolist() == [False, True] * 20
    kept, keep = {}, common.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for block, copies in ((None, 1), (1000, 4)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(df, block=block).collect()}
        assert {i: n for i, (n, _) in got.items()} == dict(enumerate(link.sum(axis=1).tolist()))
        assert Counter(Counter(c for _, c in got.values()).values()) == {1: len(x) - 20 * 2 - 301, 2: 20, 301: 1}
        assert max(kept.values()) <= copies * len(x), kept


def test_pairs_over_many_tiles():
    from sessionweave.llm.embedding_dedup import linked_pairs

    x = np.concatenate([vectors(), vectors()[::2] * 1e-200])
    link = units(np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]))
    link = link @ link.T >= 0.98
    for first in (0, 1, 3000):
        got = [pair for p, q in linked_pairs(x, first, 0.98) for pair in zip(p.tolist(), q.tolist(), strict=True)]
        want = np.argwhere(np.triu(link, 1) if not first else link[:first, first:]) + [0, first]
        assert len(got) == len(set(got)) and set(got) == set(map(tuple, want.tolist()))
