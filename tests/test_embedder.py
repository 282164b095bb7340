"""The embedder's gradient, training and artefacts."""

import numpy as np
import pytest

from sessionweave.operators.embedder import Embedder, embed_table, triplet_loss


def test_gradient():
    rng = np.random.default_rng(0)
    x, ids = rng.standard_normal((6, 3)), np.array([0, 0, 0, 1, 1, 2])
    _, g = triplet_loss(x, ids)
    for i in range(6):
        for j in range(3):
            y, z = x.copy(), x.copy()
            y[i, j] += 1e-6
            z[i, j] -= 1e-6
            assert g[i, j] == pytest.approx((triplet_loss(y, ids)[0] - triplet_loss(z, ids)[0]) / 2e-6, abs=1e-5)


def test_training_and_embedding(spark):
    rng = np.random.default_rng(1)
    ids = np.repeat(np.arange(3), 20)
    x = rng.standard_normal((60, 5)) + 1.5 * np.eye(5)[ids]
    m = Embedder(list("abcde"), (32, 16, 8))
    losses = m.fit(x, ids, epochs=6, batches=40, rate=3e-3)
    assert losses[-1] < losses[0]
    again = Embedder.loads(m.dumps(), list("abcde"))
    assert np.allclose(again.embed(x), m.embed(x)) and again.fingerprint() == m.fingerprint()
    with pytest.raises(ValueError):
        Embedder.loads(m.dumps(), list("abced"))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    got = {r["id"]: r["embedding"] for r in embed_table(df, m, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(60)], m.embed(x)) and np.allclose(np.linalg.norm(list(got.values()), axis=1), 1)
