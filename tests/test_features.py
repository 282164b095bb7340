"""The feature families against plain loops over small sessions."""

import math

import numpy as np
import pytest

from sessionweave.operators import epochs, features, sequence
from sessionweave.sources import sessions as _  # noqa: F401
from tests import sessions


@pytest.fixture(scope="module")
def raw(spark):
    return sessions.raw(spark).cache()


@pytest.fixture(scope="module")
def windows(spark, raw):
    """Two families of the skeleton's windows; the whole set is only planned, as its many columns take long to compile."""
    skel = features.skeleton(raw).cache()
    w = features._Windows(raw, skel, 15.0, 7.5)
    out = skel
    for frame in [*features.typing_features(w, raw)[:3], features.motion_features(w, raw)[0], features.motion_features(w, raw)[3]]:
        out = out.join(frame, features.KEY, "left")
    return {(r["sessionId"], r["window_index"]): r for r in out.collect()}


def pairs(downs, ups, cancelled=()):
    out, at = [], 0
    for i, d in enumerate(downs):
        while at < len(ups) and ups[at] < d:
            at += 1
        if at == len(ups):
            break
        if ups[at] not in cancelled:
            out.append((d, ups[at]))
        at += 1
    return out


def test_grid_and_columns(raw, windows):
    assert len(features.feature_names()) == 574 == len(set(features.feature_names()))
    # 40 s: four windows; 22.5 s: two; 14.95 s: none
    assert sorted(windows) == [("s1", 0), ("s1", 1), ("s1", 2), ("s1", 3), ("s2", 0), ("s2", 1)]
    assert windows["s1", 0]["typing_afforded"] and not windows["s1", 0]["tapping_observed"]
    assert features.build_windows(raw).columns[-574:] == features.feature_names()


def test_pairing_against_a_loop(spark):
    rng = np.random.default_rng(0)
    rows, expected = [], {}
    for s in range(60):
        n = int(rng.integers(0, 12))
        ev = sorted((int(rng.integers(0, 30)), int(rng.integers(0, 2)), i) for i in range(n))
        rows += [(s, i, float(t), "up" if k else "down") for t, k, i in ev]
        expected[s] = pairs([t for t, k, _ in ev if not k], [t for t, k, _ in ev if k])
    df = spark.createDataFrame(rows, "s int, id int, t double, kind string")
    got = sequence.pair_greedy(df, df.kind == "down", df.kind == "up").collect()
    for s, want in expected.items():
        assert sorted((r["t"], r["up_t"]) for r in got if r["s"] == s) == sorted(want)


def test_typing(raw, windows):
    ev = [r for r in raw.where("sessionId = 's1'").collect()]
    downs = sorted((r["tRelMs"], r["payload_keyClass"]) for r in ev if r["kind"] == "keydown")
    ups = sorted(r["tRelMs"] for r in ev if r["kind"] == "keyup")
    dwell = [(d / 1000, u - d) for d, u in pairs([d for d, _ in downs], ups)]
    w = windows["s1", 0]
    inside = [v for t, v in dwell if 0 <= t < 15]
    assert w["typing_keydown_count"] == sum(t < 15_000 for t, _ in downs)
    assert w["typing_dwell_ms_n"] == len(inside) and math.isclose(w["typing_dwell_ms_mean"], np.mean(inside))
    assert math.isclose(w["typing_dwell_ms_std"], np.std(inside, ddof=1)) and math.isclose(w["typing_dwell_ms_p95"], np.percentile(inside, 95))
    assert math.isclose(w["typing_dwell_ms_slope"], np.polyfit([t for t, _ in dwell if t < 15], inside, 1)[0], abs_tol=1e-9)
    steps = [(b[0] - a[0]) for a, b in zip(downs, downs[1:]) if b[0] < 15_000 and b[0] - a[0] <= 3000 and (a[1], b[1]) == ("LETTER", "SPACE")]
    assert w["typing_transition_letter_space_ms_n"] == len(steps) and math.isclose(w["typing_transition_letter_space_ms_mean"], np.mean(steps))
    assert w["typing_dwell_other_ms_n"] is None


def test_interactions_and_motion(raw, windows):
    got = features.interactions(raw).where("sessionId = 's1'").collect()
    assert len(got) == 13  # one of fourteen is cancelled
    assert {"tap", "drag_swipe", "long_press"} <= {r["gesture"] for r in got}
    w = windows["s1", 0]
    assert 0 <= w["motion_idle_frac"] <= 1 and w["motion_cross_axis_corr_n"] > 0
    assert sum(w[f"typing_share_{k.lower()}"] for k in features.KEY_CLASSES) == pytest.approx(1)


def test_accel_epochs_against_a_loop(raw):
    ev = [r for r in raw.where("sessionId = 's1'").collect()]
    m = sorted((r["tRelMs"], math.sqrt(r["payload_ax"] ** 2 + r["payload_ay"] ** 2 + r["payload_az"] ** 2)) for r in ev if r["kind"] == "devicemotion")
    t, v = np.array([x for x, _ in m]), np.array([y for _, y in m])
    got = {round(r["t_s"] * 1000): r for r in epochs.accel_epochs(raw, "touchstart").where("sessionId = 's1'").collect()}
    for r in (x for x in ev if x["kind"] == "touchstart"):
        t0 = r["tRelMs"]
        sel = (t >= t0 - 300) & (t < t0 + 500)
        rel, x = t[sel] - t0, v[sel]
        base, vp, rp = x[rel < 0].mean(), x[rel >= 0] - x[rel < 0].mean(), rel[rel >= 0]
        g = got[round(t0)]
        assert math.isclose(g["peak"], vp.max(), rel_tol=1e-9, abs_tol=1e-9) and g["latency_ms"] == rp[vp.argmax()]
        clip = np.clip(vp, 0, None)
        assert math.isclose(g["impulse_auc"], float(((clip[1:] + clip[:-1]) / 2 * np.diff(rp)).sum()), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g["snr"], vp.max() / (x[rel < 0].std() + 1e-9), rel_tol=1e-6)
        assert base is not None


def test_phases_against_interp(raw):
    inter = features.interactions(raw)
    got = epochs.phase_epochs(raw, inter).where("sessionId = 's1'").collect()
    ev = [r for r in raw.where("sessionId = 's1' and kind = 'devicemotion'").collect()]
    m = sorted((r["tRelMs"], math.sqrt(r["payload_ax"] ** 2 + r["payload_ay"] ** 2 + r["payload_az"] ** 2)) for r in ev)
    t, v = np.array([x for x, _ in m]), np.array([y for _, y in m])
    bins = np.linspace(-0.3, 1.5, 24)
    holds = {r["t_s"]: r["hold_ms"] for r in inter.where("sessionId = 's1'").collect()}
    assert got
    for r in got:
        t0, dur = r["t_s"] * 1000, holds[r["t_s"]]
        sel = (t >= t0 - 0.3 * dur) & (t < t0 + 1.5 * dur)
        phase = (t[sel] - t0) / dur
        p = np.interp(bins, phase, v[sel] - v[sel][phase < 0].mean(), left=np.nan, right=np.nan)
        assert math.isclose(r["peak_phase_energy"], np.nanmax(p), rel_tol=1e-7, abs_tol=1e-9)


def test_band_power(spark):
    from pyspark.sql import functions as F

    x = [math.sin(i / 3) + 0.2 * (i % 3) for i in range(70)]
    sway, tremor = epochs.band_power(F.col("x"))
    a, b = spark.createDataFrame([(x,)], "x array<double>").select(sway, tremor).first()
    y = np.array(x[:64]) - np.mean(x[:64])
    p = np.abs(np.fft.rfft(y)) ** 2
    f = np.fft.rfftfreq(64, 1 / 20)
    assert math.isclose(a, p[(f > 0) & (f <= 2)].sum() / p[1:].sum()) and math.isclose(b, p[(f >= 8) & (f <= 9.5)].sum() / p[1:].sum())


def test_corrections(raw):
    got = features.orientation_corrections(raw).where("sessionId = 's1'").orderBy("tRelMs").collect()
    assert got[0]["beta_baseline"] is None and got[-1]["beta_baseline"] is not None
    assert got[0]["coverage"] == 0 and got[-1]["coverage"] == 1
