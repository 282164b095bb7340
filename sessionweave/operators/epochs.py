"""Joins of events with the sensor samples around them, and what is measured on such epochs.

Samples fall into time buckets of the epoch's width; an event is copied to the two or three buckets its epoch touches, so the
join is on (session, bucket) with an exact residual.  Measures are window functions over one partitioning by event."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import magnitude
from ..functions.stats import finite, number

PRE_MS, POST_MS, LEAST_PRE, LEAST_POST = 300.0, 500.0, 2, 3
PRE_FRACTION, END_PHASE, PHASES = 0.3, 1.5, 24


def epoch_join(events: DataFrame, samples: DataFrame, low: Column, high: Column, width: float, s: str = "s", t: str = "t", closed: bool = False) -> DataFrame:
    """Pairs of events and samples of a session with low <= sample time < high (or <=, if closed).

    low and high are over events; samples keep their columns, their time as st."""
    left = events.withColumns({"__lo": low, "__hi": high}).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    right = samples.withColumnRenamed(t, "st").withColumn("__b", F.floor(F.col("st") / width))
    inside = (F.col("st") >= F.col("__lo")) & (F.col("st") <= F.col("__hi") if closed else F.col("st") < F.col("__hi"))
    return left.join(right, [s, "__b"]).where(inside).drop("__b", "__lo", "__hi")


def impulse_metrics(pairs: DataFrame, event: str = "ev", t0: str = "t", axes: tuple[str, str, str] | None = None, value: str = "mag", least_total: int = 5, tail_after: float = 150.0) -> DataFrame:
    """One row per event: peak, latency, impulse area, decay, share of the third axis and signal to noise.

    Needs least_total samples, two before the event and three from it on; the baseline is the mean before."""
    order = Window.partitionBy(event).orderBy("rel")  # also where all rows count: sums go in the order of time, so every run rounds alike
    w = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = pairs.withColumn("rel", F.col("st") - F.col(t0))
    pre, post = F.col("rel") < 0, F.col("rel") >= 0
    p = p.withColumns({"base": F.avg(F.when(pre, F.col(value))).over(w), "noise": F.stddev_pop(F.when(pre, F.col(value))).over(w) + 1e-9})
    extra = {f"__{a}": F.abs(F.col(a) - F.avg(F.when(pre, F.col(a))).over(w)) for a in axes or ()}
    p = p.withColumns({"n": F.count(F.lit(1)).over(w), "n_pre": F.count(F.when(pre, 1)).over(w), "n_post": F.count(F.when(post, 1)).over(w), **extra})
    p = p.where((F.col("n") >= least_total) & (F.col("n_pre") >= LEAST_PRE) & (F.col("n_post") >= LEAST_POST) & post)
    p = p.withColumn("vp", F.col(value) - F.col("base"))
    clip = F.greatest(F.col("vp"), F.lit(0.0))
    first = F.max(F.when(F.col("vp").isNotNull(), F.struct("vp", -F.col("rel")))).over(w)  # of equal peaks the first
    p = p.withColumns({"area": (clip + F.lag(clip).over(order)) / 2 * (F.col("rel") - F.lag("rel").over(order)), "lat": -first["col2"]})
    tail = F.when(F.col("rel") >= F.col("lat") + tail_after, F.col("vp"))
    peak = F.max("vp")
    total = sum((F.sum(f"__{a}") for a in axes), F.lit(0.0)) if axes else None
    out = [peak.alias("peak"), F.sum("area").alias("impulse_auc"), F.min("lat").alias("latency_ms"), F.when(peak > 0, F.avg(tail) / peak).alias("decay_ratio"), (peak / F.min("noise")).alias("snr")]
    if axes:
        out.insert(4, F.when(total > 0, F.sum(f"__{axes[2]}") / F.when(total > 0, total)).alias("z_share"))
    return p.groupBy(event).agg(*out)


def motion_samples(raw: DataFrame, least: int) -> DataFrame:
    """s, t (ms), ax, ay, az, mag of finite accelerometer samples, of sessions with at least least of them."""
    m = raw.where("kind = 'devicemotion'").select(F.col("sessionId").alias("s"), F.col("tRelMs").alias("t"), *(number(F.col(f"payload_{a}")).alias(a) for a in ("ax", "ay", "az")))
    m = m.withColumn("mag", finite(magnitude(F.col("ax"), F.col("ay"), F.col("az")))).where("mag is not null and t is not null")
    return m.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("s"))).where(F.col("__n") >= least).drop("__n")


def accel_epochs(raw: DataFrame, kind: str) -> DataFrame:
    """Accelerometer response to events of a kind, in [t0 - 300 ms, t0 + 500 ms)."""
    ev = _events(raw, kind)
    pairs = epoch_join(ev, motion_samples(raw, 10), F.col("t") - PRE_MS, F.col("t") + POST_MS, PRE_MS + POST_MS)
    return _back(ev, impulse_metrics(pairs, axes=("ax", "ay", "az")))


def orient_epochs(raw: DataFrame, kind: str) -> DataFrame:
    """Signed tilt at its largest deviation after events of a kind, in [t0 - 300 ms, t0) against [t0, t0 + 500 ms]."""
    o = raw.where("kind = 'deviceorientation' and tRelMs is not null").select(F.col("sessionId").alias("s"), F.col("tRelMs").alias("t"), number(F.col("payload_beta")).alias("beta"), number(F.col("payload_gamma")).alias("gamma"))
    o = o.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("__n >= 10").drop("__n")
    ev = _events(raw, kind)
    w = Window.partitionBy("ev")
    p = epoch_join(ev, o, F.col("t") - PRE_MS, F.col("t") + POST_MS, PRE_MS + POST_MS, closed=True).withColumn("rel", F.col("st") - F.col("t"))
    p = p.withColumns({"n_pre": F.count(F.when(F.col("rel") < 0, 1)).over(w), "n_post": F.count(F.when(F.col("rel") >= 0, 1)).over(w)}).where((F.col("n_pre") >= LEAST_PRE) & (F.col("n_post") >= LEAST_POST))
    out = []
    for a in ("beta", "gamma"):
        pre = F.when(F.col("rel") < 0, F.col(a))
        ok = F.count(pre).over(w) >= LEAST_PRE
        dev = F.when(ok & (F.col("rel") >= 0), F.col(a) - F.avg(pre).over(w))
        p = p.withColumn(f"{a}_dev", dev)
        enough = F.count(f"{a}_dev") >= LEAST_POST
        key = F.when(F.col(f"{a}_dev").isNotNull(), F.struct(-F.abs(F.col(f"{a}_dev")), F.col("rel")))
        out += [F.when(enough, F.min_by(f"{a}_dev", key)).alias(f"{a}_peak_dev"), F.when(enough, F.min_by("rel", key)).alias(f"{a}_peak_latency_ms")]
    got = p.groupBy("ev").agg(*out).where("beta_peak_dev is not null or gamma_peak_dev is not null")
    return _back(ev, got)


def phase_epochs(raw: DataFrame, interactions: DataFrame) -> DataFrame:
    """Motion over the phases of interactions (0 down, 1 up): interpolated energy at the phase nearest one half, and the most."""
    bins = [-PRE_FRACTION + i * (END_PHASE + PRE_FRACTION) / (PHASES - 1) for i in range(PHASES)]
    mid = min(range(PHASES), key=lambda i: abs(bins[i] - 0.5))
    ev = interactions.where("hold_ms > 0").withColumn("ev", F.struct("sessionId", "eventIndex")).withColumns({"s": F.col("sessionId"), "t": F.col("t_s") * 1000.0})
    pairs = epoch_join(ev.select("ev", "s", "t", "hold_ms"), motion_samples(raw, 20).select("s", "t", "mag"), F.col("t") - PRE_FRACTION * F.col("hold_ms"), F.col("t") + END_PHASE * F.col("hold_ms"), 1000.0)
    w = Window.partitionBy("ev")
    p = pairs.withColumn("phase", (F.col("st") - F.col("t")) / F.col("hold_ms"))
    p = p.withColumns({"n": F.count(F.lit(1)).over(w), "n_pre": F.count(F.when(F.col("phase") < 0, 1)).over(w), "base": F.avg(F.when(F.col("phase") < 0, F.col("mag"))).over(w)}).where("n >= 5 and n_pre >= 2")
    p = p.withColumn("v", F.col("mag") - F.col("base"))
    order = Window.partitionBy("ev").orderBy("phase")
    p = p.withColumns({"p1": F.lead("phase").over(order), "v1": F.lead("v").over(order)})
    p = p.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(PHASES - 1)), lambda i: (F.element_at(F.lit(bins), i + 1) >= F.col("phase")) & (F.element_at(F.lit(bins), i + 1) < F.coalesce(F.col("p1"), F.col("phase") + 1e-12)))))
    b = F.element_at(F.lit(bins), F.col("i") + 1)
    at = F.when(b == F.col("phase"), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (b - F.col("phase")) / (F.col("p1") - F.col("phase")))
    got = p.groupBy("ev").agg(F.max(F.when(F.col("i") == mid, at)).alias("mid_phase_energy"), F.max(at).alias("peak_phase_energy"))
    # interactions with enough samples count even where no phase could be read
    able = pairs.withColumn("pre", F.col("st") < F.col("t")).groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pre"), 1)).alias("np")).where("n >= 5 and np >= 2").select("ev")
    return ev.select("ev", "sessionId", "participantId", "t_s", "gesture").join(able, "ev").join(got, "ev", "left").drop("ev")


def _events(raw: DataFrame, kind: str) -> DataFrame:
    e = raw.where((F.col("kind") == kind) & F.col("tRelMs").isNotNull())
    return e.select(F.struct("sessionId", "eventIndex").alias("ev"), F.col("sessionId").alias("s"), "participantId", F.col("tRelMs").cast("double").alias("t"))


def _back(ev: DataFrame, got: DataFrame) -> DataFrame:
    return ev.join(got, "ev").select(F.col("s").alias("sessionId"), "participantId", (F.col("t") / 1000.0).alias("t_s"), *[c for c in got.columns if c != "ev"])


def band_power(values: Column, low_bins: tuple[int, int] = (1, 6), high_bins: tuple[int, int] = (26, 30), n: int = 64) -> tuple[Column, Column]:
    """Shares of spectral power in two ranges of Fourier bins of an array's first n values; null if it is shorter or still."""
    x = F.slice(values, 1, n)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

    def power(k: Column) -> Column:
        def part(f) -> Column:
            angle = lambda i: F.lit(2 * math.pi / n) * k * i.cast("double")
            return F.aggregate(F.transform(x, lambda v, i: (v - mean) * f(angle(i))), F.lit(0.0), lambda a, v: a + v)

        return part(F.cos) * part(F.cos) + part(F.sin) * part(F.sin)

    spectrum = F.transform(F.sequence(F.lit(1), F.lit(n // 2)), lambda k: power(k.cast("double")))
    total = F.aggregate(spectrum, F.lit(0.0), lambda a, v: a + v)
    band = lambda lo, hi: F.aggregate(F.slice(spectrum, lo, hi - lo + 1), F.lit(0.0), lambda a, v: a + v)
    ok = (F.size(values) >= n) & (total > 0)
    return F.when(ok, band(*low_bins) / total), F.when(ok, band(*high_bins) / total)
