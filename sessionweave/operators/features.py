"""The windowed behavioural features: typing, tap, gesture, coupling and motion families, 574 columns.

Each event relation is assigned to windows by arithmetic and aggregated once with conditional aggregates; the frames are
joined to the skeleton on (sessionId, window_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gesture_class, grid_cell, ratio, truthy
from ..functions.stats import finite, nine_stats, number, share, stat_columns
from ..shipping import ship
from . import epochs, sequence
from .windows import LENGTH_S, STRIDE_S, assign_windows, overlapping, window_grid

# fixed values: event kinds and classes of the data model
KEY_CLASSES = ("LETTER", "SPACE", "BACKSPACE", "DIGIT", "PUNCT_OR_SYMBOL", "ENTER", "OTHER")
PAIR_CLASSES = ("LETTER", "SPACE", "BACKSPACE")
GESTURES = ("scroll_fling", "scroll_drag", "drag_swipe", "long_press", "tap")
SCROLLS = ("scroll", "window_scroll")
MODALITY_KINDS = {"typing": ("keydown", "keyup"), "tapping": ("touchstart", "touchend"), "scrolling": ("scroll", "window_scroll", "carousel_scroll")}
INTERACTIONS = ("keydown", "keyup", "input", "touchstart", "touchmove", "touchend", "touchcancel", "scroll", "window_scroll", "carousel_scroll", "pointerdown", "pointerup", "pointercancel", "click")
ACCEL = ("peak", "impulse_auc", "latency_ms", "decay_ratio", "z_share", "snr")
ORIENT = ("beta_peak_dev", "beta_peak_latency_ms", "gamma_peak_dev", "gamma_peak_latency_ms")
ENERGY = ("mid_phase_energy", "peak_phase_energy")
SAMPLE_HZ, LEAST_IDLE, IDLE_GUARD_MS, ROLL_S, BASE_S, WARM_S = 20.0, 60, 1000.0, 5.0, 30.0, 5.0
KEY = ["sessionId", "window_index"]


def feature_names() -> list[str]:
    out = ["typing_keydown_count", "typing_backspace_share", "typing_autorepeat_share", *(f"typing_share_{k.lower()}" for k in KEY_CLASSES)]
    typing = ["typing_dwell_ms", *(f"typing_dwell_{k.lower()}_ms" for k in KEY_CLASSES), "typing_transition_ms", *(f"typing_transition_{a.lower()}_{b.lower()}_ms" for a in PAIR_CLASSES for b in PAIR_CLASSES), "typing_backspace_run_length"]
    out += [c for p in typing for c in stat_columns(p)]
    out += ["tap_count", "tap_cells_touched", "tap_coverage", "tap_ctrl_target_x_dev", "tap_ctrl_target_y_dev"]
    out += [c for p in ("tap_hold_ms", "tap_x", "tap_y", "tap_radiusX", "tap_radiusY", "tap_force") for c in stat_columns(p)]
    out += ["gesture_n_interactions", *(f"gesture_share_{g}" for g in GESTURES)]
    out += [c for p in ("gesture_hold_ms", *(f"gesture_hold_{g}_ms" for g in GESTURES), "gesture_drag_displacement_px", "gesture_drag_path_len_px", "gesture_scroll_fling_coast_frac", "gesture_stroke_x0", "gesture_stroke_y0") for c in stat_columns(p)]
    out += [c for e in ("tap", "key") for m in ACCEL for c in stat_columns(f"coupling_{e}_accel_{m}")]
    out += [c for e in ("tap", "key") for m in ORIENT for c in stat_columns(f"coupling_{e}_orient_{m}")]
    out += [c for m in ENERGY for c in stat_columns(f"coupling_gesture_{m}")]
    out += ["motion_idle_frac", "motion_idle_run_max_len_s", "motion_idle_sway_power", "motion_idle_tremor_power"]
    return out + [c for m in ("idle_accel_mag", "active_accel_mag", "cross_axis_corr") for c in stat_columns(f"motion_{m}")]


# --- event relations ---------------------------------------------------------------------------------------------------


def keydowns(raw: DataFrame) -> DataFrame:
    return raw.where("kind = 'keydown'").select("sessionId", "participantId", "eventIndex", "tRelMs", (F.col("tRelMs") / 1000.0).alias("t_s"), F.col("payload_keyClass").alias("keyClass"), truthy(F.col("payload_repeat")).alias("is_repeat"))


def key_transitions(raw: DataFrame, longest_ms: float = 3000.0) -> DataFrame:
    t = sequence.transitions(keydowns(raw), "keyClass", longest_ms, "sessionId", "tRelMs", "eventIndex")
    return t.select("sessionId", "participantId", "t_s", "transition", F.col("dt").alias("dt_ms"))


def backspace_runs(raw: DataFrame) -> DataFrame:
    return sequence.runs(keydowns(raw), "keyClass", "BACKSPACE", "sessionId", "t_s", "eventIndex").drop("t_end")


def key_dwells(raw: DataFrame) -> DataFrame:
    """Dwells of keys, paired within their session."""
    k = raw.where(F.col("kind").isin("keydown", "keyup"))
    p = sequence.pair_greedy(k, F.col("kind") == "keydown", F.col("kind") == "keyup", None, "sessionId", "tRelMs", "eventIndex")
    return p.select("sessionId", "participantId", (F.col("tRelMs") / 1000.0).alias("t_s"), (F.col("up_t") - F.col("tRelMs")).alias("dwell_ms"), F.col("payload_keyClass").alias("keyClass"))


def touches(raw: DataFrame) -> DataFrame:
    """Completed touches; a cancelled one takes its end and is left out."""
    k = raw.where(F.col("kind").isin("touchstart", "touchend", "touchcancel")).select("sessionId", "participantId", "eventIndex", "kind", F.col("tRelMs").cast("double").alias("tRelMs"))
    p = sequence.pair_greedy(k, F.col("kind") == "touchstart", F.col("kind").isin("touchend", "touchcancel"), F.col("kind") == "touchcancel", "sessionId", "tRelMs", "eventIndex")
    return p.select("sessionId", "participantId", "eventIndex", "tRelMs", "up_t", (F.col("tRelMs") / 1000.0).alias("t_s"), (F.col("up_t") - F.col("tRelMs")).alias("hold_ms"))


def interactions(raw: DataFrame, coast_ms: float = 2000.0) -> DataFrame:
    """Touches with path, displacement, scrolling during and after, and their class."""
    d = touches(raw).withColumn("ev", F.struct("sessionId", "eventIndex")).withColumns({"s": F.col("sessionId"), "t": F.col("tRelMs")})
    span = 4000.0
    moves = raw.where("kind = 'touchmove' and tRelMs is not null").select(F.col("sessionId").alias("s"), F.col("tRelMs").cast("double").alias("t"), F.col("eventIndex").alias("mi"), number(F.col("payload_x")).alias("x"), number(F.col("payload_y")).alias("y"))
    m = epochs.epoch_join(d.select("ev", "s", "t", "up_t"), moves, F.col("t"), F.col("up_t"), span, closed=True)
    order = Window.partitionBy("ev").orderBy("st", "mi")
    m = m.withColumn("step", F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2)))
    at = F.struct("st", "mi")
    m = m.groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.min_by(F.struct("x", "y"), at).alias("a"), F.max_by(F.struct("x", "y"), at).alias("b"))
    far = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    m = m.select("ev", F.when(F.col("n") >= 2, F.col("path")).otherwise(0.0).alias("path_len_px"), F.when(F.col("n") >= 2, far).otherwise(0.0).alias("displacement_px"))
    scroll = raw.where(F.col("kind").isin(*SCROLLS) & F.col("tRelMs").isNotNull()).select(F.col("sessionId").alias("s"), F.col("tRelMs").cast("double").alias("t"), number(F.col("payload_scrollTop")).alias("y"))
    c = epochs.epoch_join(d.select("ev", "s", "t", "up_t"), scroll, F.col("t"), F.col("up_t") + coast_ms, span, closed=True)
    reach = lambda cond: F.when(F.count(F.when(cond, F.col("y"))) > 1, F.max(F.when(cond, F.col("y"))) - F.min(F.when(cond, F.col("y")))).otherwise(0.0)
    c = c.groupBy("ev").agg(reach(F.col("st") <= F.col("up_t")).alias("scroll_during_px"), reach(F.col("st") > F.col("up_t")).alias("scroll_coast_px"))
    out = d.join(m, "ev", "left").join(c, "ev", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)).alias(n)
    moved = F.when(F.col("path_len_px").isNull(), 0.0).otherwise(F.col("displacement_px"))
    out = out.select("sessionId", "participantId", "eventIndex", "t_s", "hold_ms", zero("path_len_px"), moved.alias("displacement_px"), zero("scroll_during_px"), zero("scroll_coast_px"))
    return out.withColumn("gesture", gesture_class(F.col("scroll_during_px"), F.col("scroll_coast_px"), F.col("displacement_px"), F.col("hold_ms")))


def strokes(raw: DataFrame, gap_ms: float = 300.0, least: int = 3) -> DataFrame:
    """Islands of touchmoves: first and last normalised position of those with three points or more."""
    m = raw.where("kind = 'touchmove'").select("sessionId", "participantId", "eventIndex", "tRelMs", number(F.col("payload_xNorm")).alias("x"), number(F.col("payload_yNorm")).alias("y"))
    m = sequence.islands(m, sequence.gap_over(gap_ms, "sessionId", "tRelMs", "eventIndex"), "sessionId", "tRelMs", "eventIndex")
    at = F.struct("tRelMs", "eventIndex")
    g = m.groupBy("sessionId", "participantId", "island").agg((F.min("tRelMs") / 1000.0).alias("t_s"), *(f(F.struct("x", "y"), at).alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b"))), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).select("sessionId", "participantId", "t_s", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "n")


# --- skeleton ----------------------------------------------------------------------------------------------------------


def timeline(raw: DataFrame) -> DataFrame:
    """Task instances with start, end and pass number; a repeated task_end fans its task out."""
    start = raw.where("kind = 'task_start'").select("sessionId", "participantId", "deviceFamily", "taskIndex", "taskId", F.col("payload_taskType").alias("taskType"), "activeArea", F.col("tRelMs").alias("task_start_ms"))
    end = raw.where("kind = 'task_end'").select("sessionId", "taskIndex", F.col("tRelMs").alias("task_end_ms"))
    t = start.join(end, ["sessionId", "taskIndex"], "left").withColumns({"task_start_s": F.col("task_start_ms") / 1000.0, "task_end_s": F.col("task_end_ms") / 1000.0})
    t = t.withColumn("task_duration_s", F.col("task_end_s") - F.col("task_start_s"))
    return t.withColumn("task_pass", F.row_number().over(Window.partitionBy("sessionId", "taskType").orderBy("taskIndex")))


def affordances(raw: DataFrame, tasks: DataFrame, least: float = 0.05) -> DataFrame:
    """Per task type and modality: share of instances with an event in [start, end), and whether that is five percent or more."""
    inst = tasks.withColumn("ti", F.monotonically_increasing_id())
    both = inst.select("ti", F.col("sessionId").alias("s"), "taskType", F.col("task_start_ms").cast("double").alias("t"), F.col("task_end_ms").cast("double").alias("e"), F.lit("task").alias("kind"))
    ev = raw.where(F.col("kind").isin(*{k for ks in MODALITY_KINDS.values() for k in ks})).select(F.col("sessionId").alias("s"), F.col("tRelMs").cast("double").alias("t"), "kind")
    u = both.unionByName(ev, allowMissingColumns=True)
    for m, kinds in MODALITY_KINDS.items():
        u = sequence.next_time(u, F.col("kind").isin(*kinds), inclusive=True, name=f"n_{m}")
    hit = {m: F.coalesce(F.col(f"n_{m}") < F.col("e"), F.lit(False)) for m in MODALITY_KINDS}
    return u.where("kind = 'task'").groupBy("taskType").agg(*(share(h).alias(f"{m}_frac") for m, h in hit.items()), F.count(F.lit(1)).alias("n_instances")).select("taskType", *((F.col(f"{m}_frac") >= least).alias(m) for m in MODALITY_KINDS), *(f"{m}_frac" for m in MODALITY_KINDS), "n_instances")


def skeleton(raw: DataFrame, length: float = LENGTH_S, stride: float = STRIDE_S, carry: list[str] | None = None) -> DataFrame:
    """Windows with what their task afforded, what was observed and where overlapping tasks disagree."""
    ev = raw.where("tRelMs is not null").withColumn("t_s", F.col("tRelMs") / 1000.0)
    carry = carry if carry is not None else [c for c in ("participantId", "deviceFamily", "sessionIndex", "deviceModel") if c in raw.columns]
    grid = window_grid(ev, "sessionId", "t_s", length, stride, carry).withColumnsRenamed({"window_start": "window_start_s", "window_end": "window_end_s"})
    tasks = timeline(raw)
    aff = affordances(raw, tasks)
    span = tasks.join(aff.select("taskType", *MODALITY_KINDS), "taskType", "left").withColumns({"start": F.col("task_start_s"), "end": F.col("task_end_s")})
    ctx = sequence.as_of(grid.withColumn("ctx_t", F.col("window_start_s")), span.select("sessionId", "start", "end", "taskIndex", "taskType", "task_pass", "activeArea"), ["taskIndex", "taskType", "task_pass", "activeArea"], ["taskIndex", "taskType", "task_pass"], "sessionId", "ctx_t")
    ctx = ctx.withColumn("task_boundary_straddle", F.col("window_end_s") > F.col("end")).drop("ctx_t", "start", "end")
    ctx = ctx.join(aff.select("taskType", *(F.col(m).alias(f"{m}_afforded") for m in MODALITY_KINDS)), "taskType", "left")
    hits = assign_windows(ev.select("sessionId", "t_s", "kind"), "sessionId", "t_s", length, stride).groupBy(*KEY).agg(*(F.bool_or(F.col("kind").isin(*k)).alias(f"{m}_observed") for m, k in MODALITY_KINDS.items()))
    met = overlapping(span.select("sessionId", "start", "end", *MODALITY_KINDS), grid.select("sessionId", "window_index", F.col("window_start_s").alias("window_start"), F.col("window_end_s").alias("window_end")), "sessionId", stride=stride)
    clash = met.groupBy(*KEY).agg(*(F.coalesce(F.max(F.col(m).cast("int")) != F.min(F.col(m).cast("int")), F.lit(False)).alias(f"{m}_straddle_conflict") for m in MODALITY_KINDS))
    out = ctx.join(hits, KEY, "left").join(clash, KEY, "left")
    return out.withColumns({f"{m}_observed": F.coalesce(F.col(f"{m}_observed"), F.lit(False)) for m in MODALITY_KINDS})


def eligible(modality: str) -> Column:
    """Afforded is true and no conflict is known; unknown affordance is out, unknown conflict is none."""
    return F.coalesce(F.col(f"{modality}_afforded"), F.lit(False)) & ~F.coalesce(F.col(f"{modality}_straddle_conflict"), F.lit(False))


# --- families ----------------------------------------------------------------------------------------------------------


class _Windows:
    def __init__(self, raw: DataFrame, skel: DataFrame, length: float, stride: float):
        self.length, self.stride, self.skel = length, stride, skel
        self.starts = raw.where("tRelMs is not null").groupBy("sessionId").agg((F.min("tRelMs") / 1000.0).alias("t0"), (F.max("tRelMs") / 1000.0).alias("t1"))

    def of(self, relation: DataFrame, modality: str | None) -> DataFrame:
        w = assign_windows(relation.drop("window_index"), "sessionId", "t_s", self.length, self.stride, self.starts).withColumn("rel", F.col("t_s") - F.col("window_start"))
        return w if modality is None else w.join(self.skel.where(eligible(modality)).select(*KEY), KEY, "left_semi")


def typing_features(w: _Windows, raw: DataFrame) -> list[DataFrame]:
    rel = F.col("rel")
    keys = w.of(keydowns(raw), "typing").groupBy(*KEY).agg(F.count(F.lit(1)).alias("typing_keydown_count"), share(F.col("keyClass") == "BACKSPACE").alias("typing_backspace_share"), share(F.col("is_repeat")).alias("typing_autorepeat_share"), *(share(F.col("keyClass") == k).alias(f"typing_share_{k.lower()}") for k in KEY_CLASSES))
    d = F.col("dwell_ms")
    dwell = w.of(key_dwells(raw), "typing").groupBy(*KEY).agg(*nine_stats(d, rel, "typing_dwell_ms"), *(c for k in KEY_CLASSES for c in nine_stats(d, rel, f"typing_dwell_{k.lower()}_ms", F.col("keyClass") == k)))
    t = F.col("dt_ms")
    trans = w.of(key_transitions(raw), "typing").groupBy(*KEY).agg(*nine_stats(t, rel, "typing_transition_ms"), *(c for a in PAIR_CLASSES for b in PAIR_CLASSES for c in nine_stats(t, rel, f"typing_transition_{a.lower()}_{b.lower()}_ms", F.col("transition") == f"{a}->{b}")))
    runs = w.of(backspace_runs(raw), "typing").groupBy(*KEY).agg(*nine_stats(F.col("run_length"), rel, "typing_backspace_run_length"))
    return [keys, dwell, trans, runs]


def tap_features(w: _Windows, raw: DataFrame) -> list[DataFrame]:
    taps = raw.where("kind = 'touchstart'").select("sessionId", "participantId", (F.col("tRelMs") / 1000.0).alias("t_s"), *(number(F.col(f"payload_{p}")).alias(p) for p in ("xNorm", "yNorm", "radiusX", "radiusY", "force")), (F.col("payload_componentId") == "continue_button").alias("ctrl"))
    base = taps.where("ctrl").groupBy("participantId").agg(F.percentile("xNorm", F.lit(0.5)).alias("bx"), F.percentile("yNorm", F.lit(0.5)).alias("by"))
    e = w.of(taps, "tapping").join(base, "participantId", "left")
    rel, both = F.col("rel"), F.count("xNorm") == F.count("yNorm")
    # cells are counted only where as many x as y are known
    cells = F.when((F.count("xNorm") > 0) & both, F.count_distinct(F.when(F.col("xNorm").isNotNull() & F.col("yNorm").isNotNull(), F.struct(grid_cell(F.col("xNorm")), grid_cell(F.col("yNorm"))))))
    off = lambda a, b: F.avg(F.when(F.col("ctrl"), F.col(a))) - F.first(b, ignorenulls=True)
    a = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("tap_count"), cells.alias("tap_cells_touched"), (cells / 64.0).alias("tap_coverage"), off("xNorm", "bx").alias("tap_ctrl_target_x_dev"), off("yNorm", "by").alias("tap_ctrl_target_y_dev"), *(c for p, n in (("x", "xNorm"), ("y", "yNorm"), ("radiusX", "radiusX"), ("radiusY", "radiusY"), ("force", "force")) for c in nine_stats(F.col(n), rel, f"tap_{p}")))
    h = w.of(touches(raw).select("sessionId", "t_s", "hold_ms"), "tapping").groupBy(*KEY).agg(*nine_stats(F.col("hold_ms"), rel, "tap_hold_ms"))
    return [a, h]


def gesture_features(w: _Windows, raw: DataFrame, inter: DataFrame) -> list[DataFrame]:
    rel, hold, g = F.col("rel"), F.col("hold_ms"), F.col("gesture")
    frac = ratio(F.col("scroll_coast_px"), F.col("scroll_during_px") + F.col("scroll_coast_px"))
    a = w.of(inter, "tapping").groupBy(*KEY).agg(F.count(F.lit(1)).alias("gesture_n_interactions"), *(share(g == k).alias(f"gesture_share_{k}") for k in GESTURES), *nine_stats(hold, rel, "gesture_hold_ms"), *(c for k in GESTURES for c in nine_stats(hold, rel, f"gesture_hold_{k}_ms", g == k)), *nine_stats(F.col("displacement_px"), rel, "gesture_drag_displacement_px", g == "drag_swipe"), *nine_stats(F.col("path_len_px"), rel, "gesture_drag_path_len_px", g == "drag_swipe"), *nine_stats(frac, rel, "gesture_scroll_fling_coast_frac", g == "scroll_fling"))
    s = w.of(strokes(raw), "tapping").groupBy(*KEY).agg(*nine_stats(F.col("x0"), rel, "gesture_stroke_x0"), *nine_stats(F.col("y0"), rel, "gesture_stroke_y0"))
    return [a, s]


def coupling_features(w: _Windows, raw: DataFrame, inter: DataFrame) -> list[DataFrame]:
    def block(relation: DataFrame, modality: str, prefix: str, metrics: tuple[str, ...]) -> DataFrame:
        return w.of(relation, modality).groupBy(*KEY).agg(*(c for m in metrics for c in nine_stats(F.col(m), F.col("rel"), f"{prefix}_{m}")))

    out = []
    for name, kind, modality in (("tap", "touchstart", "tapping"), ("key", "keydown", "typing")):
        out += [block(epochs.accel_epochs(raw, kind), modality, f"coupling_{name}_accel", ACCEL), block(epochs.orient_epochs(raw, kind), modality, f"coupling_{name}_orient", ORIENT)]
    return [*out, block(epochs.phase_epochs(raw, inter), "tapping", "coupling_gesture", ENERGY)]


def _cross_axis(pdf):
    import numpy as np
    import pandas as pd

    o = pdf.sort_values("tRelMs", kind="stable")
    t, b, g = o["tRelMs"].to_numpy() / 1000.0, o["beta"], o["gamma"]
    n = len(t)
    if n < 20:
        return pd.DataFrame({"sessionId": [], "t_s": [], "corr": []})
    win = max(5, int(round(ROLL_S * (n / max(t[-1] - t[0], 1e-6)))))
    db, dg = b.diff().iloc[1:].reset_index(drop=True), g.diff().iloc[1:].reset_index(drop=True)
    c = db.rolling(win, min_periods=max(3, win // 2)).corr(dg).to_numpy()
    return pd.DataFrame({"sessionId": o["sessionId"].iloc[1:].to_numpy(), "t_s": t[1:], "corr": np.where(np.isfinite(c), c, np.nan)})


def cross_axis_correlation(raw: DataFrame) -> DataFrame:
    """Rolling correlation of tilt changes; the frame follows each session's own sampling rate, so a session is one group."""
    ship(raw.sparkSession)
    o = raw.where("kind = 'deviceorientation'").select("sessionId", F.col("tRelMs").cast("double").alias("tRelMs"), number(F.col("payload_beta")).alias("beta"), number(F.col("payload_gamma")).alias("gamma")).where("tRelMs is not null and beta is not null and gamma is not null")
    return o.groupBy("sessionId").applyInPandas(_cross_axis, "sessionId string, t_s double, corr double")


def motion_features(w: _Windows, raw: DataFrame) -> list[DataFrame]:
    m = epochs.motion_samples(raw, 20).select("s", "t", "mag", F.lit("motion").alias("kind"))
    touch = raw.where(F.col("kind").isin(*INTERACTIONS)).select(F.col("sessionId").alias("s"), F.col("tRelMs").cast("double").alias("t"), F.lit(None).cast("double").alias("mag"), F.lit("touch").alias("kind"))
    e = sequence.idle(m.unionByName(touch), F.col("kind") == "touch", IDLE_GUARD_MS).where("kind = 'motion'").select(F.col("s").alias("sessionId"), (F.col("t") / 1000.0).alias("t_s"), "mag", "is_idle")
    e = w.of(e.withColumn("id", F.monotonically_increasing_id()), None)
    rel, idle = F.col("rel"), F.col("is_idle")
    zero = lambda c: c
    stats = [*nine_stats(F.col("mag"), rel, "motion_idle_accel_mag", idle), *nine_stats(F.col("mag"), rel, "motion_active_accel_mag", ~idle)]
    a = e.groupBy(*KEY).agg(share(idle).alias("motion_idle_frac"), *map(zero, stats))
    a = a.withColumns({f"motion_{k}_accel_mag_n": F.coalesce(f"motion_{k}_accel_mag_n", F.lit(0)) for k in ("idle", "active")})
    run = sequence.longest_run(e, "is_idle", KEY, "t_s").select(*KEY, (F.col("longest_run") / SAMPLE_HZ).alias("motion_idle_run_max_len_s"))
    first = e.where("is_idle").withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("t_s", "id")))
    first = first.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 64, F.struct("r", "mag")))), lambda x: x["mag"]).alias("x"))
    sway, tremor = epochs.band_power(F.col("x"))
    power = first.where(F.col("n") >= LEAST_IDLE).select(*KEY, sway.alias("motion_idle_sway_power"), tremor.alias("motion_idle_tremor_power"))
    able = m.select(F.col("s").alias("sessionId")).distinct()
    c = w.of(cross_axis_correlation(raw).join(able, "sessionId", "left_semi"), None).groupBy(*KEY).agg(*nine_stats(F.col("corr"), rel, "motion_cross_axis_corr"))
    return [a, run, power, c.join(a.select(*KEY), KEY, "left_semi")]


def build_windows(raw: DataFrame, length: float = LENGTH_S, stride: float = STRIDE_S) -> DataFrame:
    """Skeleton and all 574 features of canonical raw events."""
    raw = raw.repartition("sessionId")
    skel = skeleton(raw, length, stride)
    w = _Windows(raw, skel, length, stride)
    inter = interactions(raw)
    out = skel
    for frame in [*typing_features(w, raw), *tap_features(w, raw), *gesture_features(w, raw, inter), *coupling_features(w, raw, inter), *motion_features(w, raw)]:
        out = out.join(frame, KEY, "left")
    # counts are 0, not null, in eligible windows without events
    for c, modality in (("typing_keydown_count", "typing"), ("tap_count", "tapping"), ("gesture_n_interactions", "tapping")):
        out = out.withColumn(c, F.when(eligible(modality), F.coalesce(F.col(c), F.lit(0))))
    return out.select(*skel.columns, *feature_names())


# --- corrections -------------------------------------------------------------------------------------------------------


def _baseline(pdf):
    import numpy as np

    o = pdf.sort_values("tRelMs", kind="stable").copy()
    t = o["tRelMs"].to_numpy() / 1000.0
    dt = float(np.median(np.diff(t))) if len(t) >= 3 else 0.0
    hz = 1.0 / dt if dt > 0 else SAMPLE_HZ
    rows, warm = max(20, int(round(BASE_S * hz))), max(10, int(round(WARM_S * hz)))
    for c in ("beta", "gamma"):
        o[f"{c}_baseline"] = o[c].rolling(rows, min_periods=warm).median()
        o[f"{c}_residual"] = o[c] - o[f"{c}_baseline"]
    o["coverage"] = np.clip((t - t[0]) / BASE_S, 0.0, 1.0)
    return o


def orientation_corrections(raw: DataFrame) -> DataFrame:
    """Orientation samples with circular encodings, causal rolling-median baselines, residuals and baseline coverage."""
    ship(raw.sparkSession)
    from ..functions.stats import circular_encode

    o = raw.where("kind = 'deviceorientation'").select("sessionId", "eventIndex", F.col("tRelMs").cast("double").alias("tRelMs"), *(number(F.col(f"payload_{a}")).alias(a) for a in ("alpha", "beta", "gamma")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema) + ", beta_baseline double, beta_residual double, gamma_baseline double, gamma_residual double, coverage double"
    got = o.groupBy("sessionId").applyInPandas(_baseline, schema)
    got = got.withColumns({f"{c}": finite(F.col(c)) for c in ("alpha", "beta", "gamma", "beta_baseline", "beta_residual", "gamma_baseline", "gamma_residual")})
    for a in ("alpha", "beta"):
        s, c = circular_encode(F.col(a))
        got = got.withColumns({f"{a}_sin": s, f"{a}_cos": c})
    return got
