"""Exploratory measures of sessions: text and name rules, motion, gestures, typing, space on the screen, decisions, curves.

Frames use short names unless told otherwise: s session, pid participant, t time, id tie-break, v value, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, truthy
from ..functions.stats import number, share
from . import epochs, sequence
from .scoring import exact_median

# fixed values: kinds and limits of the data model
REPLACEMENTS = ("insertReplacementText", "insertFromPaste")
ZONES = ((0.0, 0.33, "top"), (0.33, 0.66, "middle"), (0.66, 1.01, "bottom"))
WRAP_DEG, SINGULAR_DEG = 170.0, 80.0
IDLE_RUN, ACTIVE_RUN, FFT = 60, 40, 64


# --- names and rows ------------------------------------------------------------------------------------------------------


def of_family(raw: DataFrame, family: str = "mobile", column: str = "deviceFamily", time: str = "tRelMs") -> DataFrame:
    return raw.where((F.lower(column) == family) & F.col(time).isNotNull())


def base_name(task: Column) -> Column:
    """A task's name without the number of its pass."""
    return F.regexp_replace(task, r"_0\d$", "")


def is_pass(task: Column, number_: int) -> Column:
    return task.endswith(f"_0{number_}")


def key_name(component: Column, prefix: str = "code_key_") -> Column:
    """The key of a keypad component, null for other components."""
    return F.when(component.startswith(prefix), F.replace(component, F.lit(prefix), F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in text; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def break_on_gaps(df: DataFrame, values: list[str], most: float = 0.5, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """s, t and values, with a row of nulls in the middle of every gap over most."""
    after = F.lead(t).over(Window.partitionBy(s).orderBy(t, tie))
    d = df.select(s, t, *values, after.alias("__next"))
    hole = d.where(F.col("__next") - F.col(t) > most).select(s, ((F.col(t) + F.col("__next")) / 2).alias(t), *(F.lit(None).cast(d.schema[v].dataType).alias(v) for v in values))
    return d.drop("__next").unionByName(hole)


def caret(selection: Column, length: Column) -> tuple[Column, Column]:
    """Place of the caret as a fraction of the text, and whether that is before its end; null for an empty text."""
    at = F.when(number(length) > 0, number(selection) / number(length))
    return at, at < 0.99


def active_families(wide: DataFrame, families: dict[str, list[str]]) -> Column:
    """How many families have a value in the row."""
    return sum((F.coalesce(*(F.col(f"`{c}`").cast("double") for c in cols)).isNotNull().cast("int") for cols in families.values() if cols), F.lit(0))


def eligibility_counts(windows: DataFrame, eligible: dict[str, Column], populated: list[str], by: str = "participantId") -> DataFrame:
    """Per participant: windows, eligible ones by modality, and windows where a column has a value."""
    return windows.groupBy(by).agg(F.count(F.lit(1)).alias("n_windows"), *(F.count(F.when(c, 1)).alias(f"{m}_eligible") for m, c in eligible.items()), *(F.count(f"`{c}`").alias(f"{c}_populated") for c in populated))


def task_sequences(tasks: DataFrame, s: str = "s", order: str = "task_index", name: str = "task_type") -> DataFrame:
    """The distinct orders of tasks over sessions, and how many sessions have each; one row means that tasks compare by place."""
    seq = tasks.groupBy(s).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("x")))), lambda e: e["x"]).alias("q"))
    return seq.groupBy(F.array_join("q", ">").alias("sequence"), F.size("q").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("sessions"))


# --- controls and joins ---------------------------------------------------------------------------------------------------


def signed_shift(events: DataFrame, uniform: Column, positive: Column, least: float = 2000.0, most: float = 10000.0, t: str = "t") -> DataFrame:
    """Events moved by least to most either way; uniform is in [0, 1) and positive a sign, both fixed by the event."""
    by = least + uniform * (most - least)
    return events.withColumn(t, F.col(t) + F.when(positive, by).otherwise(-by))


def matched_control(spans: DataFrame, bounds: DataFrame, uniform: Column, before: float = 0.3, after: float = 1.5, s: str = "s") -> DataFrame:
    """Spans of the same duration at another place of their session, with room for their phases; none where it has no room.

    spans(s, start, end), bounds(s, t0, t1) of the session's samples."""
    d = F.col("end") - F.col("start")
    low, high = F.col("t0") + before * d, F.col("t1") - after * d
    moved = spans.join(bounds, s).where(high > low).withColumn("__at", low + uniform * (high - low))
    return moved.withColumns({"end": F.col("__at") + d, "start": F.col("__at")}).drop("__at", "t0", "t1")


def decision_latency(decisions: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """Decisions with the time from their task's start, 0 at least; null without a start."""
    return decisions.join(starts.select(*key, F.col("t").alias("__t0")), key, "left").withColumn("latency", F.greatest(F.col("t") - F.col("__t0"), F.lit(0.0))).drop("__t0")


def paired_gap(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Every pair of a first and a second event of a task, and the time between; pairs the wrong way round go."""
    p = first.select(*key, F.col("t").alias("a")).join(second.select(*key, F.col("t").alias("b")), key)
    return p.withColumn("gap", F.col("b") - F.col("a")).where("gap >= 0")


def entry_latency(starts: DataFrame, interactions: DataFrame, s: str = "s", t: str = "t") -> DataFrame:
    """Task starts with the time to the first interaction at or after them."""
    both = starts.withColumn("__start", F.lit(True)).unionByName(interactions.select(s, t).withColumn("__start", F.lit(False)), allowMissingColumns=True)
    got = sequence.next_time(both, ~F.col("__start"), s, t, inclusive=True, name="__next")
    return got.where("__start").withColumn("latency", F.col("__next") - F.col(t)).drop("__start", "__next")


def sharing(rows: DataFrame, owner: str, model: str) -> DataFrame:
    """Each owner's first model (by name), how many owners have it, and whether only one does."""
    own = rows.where(F.col(model).isNotNull()).groupBy(owner).agg(F.min(model).alias(model), F.count(F.lit(1)).alias("n"))
    n = own.groupBy(model).agg(F.count(F.lit(1)).alias("sharing"))
    return own.join(n, model).withColumn("singleton", F.col("sharing") == 1)


def offset_from_key(taps: DataFrame, key: str, x: str, by: str, least: int = 3) -> DataFrame:
    """Per group the median and deviation of taps' offsets from the median place of their key over all groups."""
    centre = exact_median(taps, [key], x, "__c")
    off = taps.join(centre, key).withColumn("__d", F.col(x) - F.col("__c"))
    return exact_median(off, [by], "__d", "offset").join(off.groupBy(by).agg(F.count("__d").alias("n"), F.stddev_samp("__d").alias("sd")), by).where(F.col("n") >= least)


def target_stats(taps: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Per group: aim (medians) and scatter on one target, and the aim's offset from the median of all groups' aims."""
    g = taps.groupBy(by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("x_sd"), F.stddev_samp(y).alias("y_sd"))
    g = g.join(exact_median(taps, [by], x, "x_med"), by, "left").join(exact_median(taps, [by], y, "y_med"), by, "left")
    return g.crossJoin(exact_median(g, [], "x_med", "__m")).withColumn("x_offset", F.col("x_med") - F.col("__m")).drop("__m")  # one row


def precision(target: DataFrame, keypad: DataFrame, by: str) -> DataFrame:
    """Scatter on the target and on the keypad, of groups that have both."""
    return target.select(by, F.col("x_sd").alias("target_sd")).join(keypad.select(by, F.col("sd").alias("keypad_sd")), by).where("target_sd is not null and keypad_sd is not null")


# --- motion -----------------------------------------------------------------------------------------------------------------


def _flag_runs(samples: DataFrame, flag: Column, least: int, s: str, t: str, tie: str) -> DataFrame:
    """Samples of maximal runs of least samples or more where flag holds, numbered by run."""
    e = samples.withColumn("__f", F.coalesce(flag, F.lit(False)))
    e = sequence.islands(e, sequence.changes("__f", s, t, tie), s, t, tie, "run").where("__f")
    n = F.count(F.lit(1)).over(Window.partitionBy(s, "run"))
    return e.withColumn("__n", n).where(F.col("__n") >= least).drop("__f", "__n")


def steadiness(samples: DataFrame, idle: Column, least: int = IDLE_RUN, v: str = "v", s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Per session: idle runs, the median of their population deviations, and the mean spectrum's shares in the sway and tremor bands
    over runs of FFT samples or more."""
    r = _flag_runs(samples, idle, least, s, t, tie).withColumn("__r", F.row_number().over(Window.partitionBy(s, "run").orderBy(t, tie)))
    per = r.groupBy(s, "run").agg(F.stddev_pop(v).alias("sd"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") <= FFT, F.struct("__r", F.col(v).cast("double").alias("x"))))), lambda e: e["x"]).alias("x"))
    sway, tremor = epochs.band_power(F.col("x"))
    per = per.select(s, "sd", F.when(F.col("n") >= FFT, sway).alias("sway"), F.when(F.col("n") >= FFT, tremor).alias("tremor"))
    return per.groupBy(s).agg(F.count(F.lit(1)).alias("runs"), F.avg("sway").alias("sway"), F.avg("tremor").alias("tremor")).join(exact_median(per, [s], "sd", "median_sd"), s)


def normalised_jerk(samples: DataFrame, active: Column, least: int = ACTIVE_RUN, v: str = "v", s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Per session the median over active runs of the rms of change per time over the rms of the value."""
    r = _flag_runs(samples, active, least, s, t, tie)
    w = Window.partitionBy(s, "run").orderBy(t, tie)
    dt = F.col(t) - F.lag(t).over(w)
    r = r.withColumn("__j", F.when(dt > 0, (F.col(v) - F.lag(v).over(w)) / dt))
    per = r.groupBy(s, "run").agg(F.sqrt(F.avg(F.col("__j") * F.col("__j"))).alias("j"), F.sqrt(F.avg(F.col(v) * F.col(v))).alias("m"))
    per = per.where("m > 0 and j is not null").withColumn("ratio", F.col("j") / F.col("m"))
    return exact_median(per, [s], "ratio", "jerk").join(per.groupBy(s).agg(F.count(F.lit(1)).alias("runs")), s)


def orienting_response(starts: DataFrame, samples: DataFrame, span: float = 1.0, least: int = 5, v: str = "v", s: str = "s") -> DataFrame:
    """Per session the median over task starts of the rms after over the rms before, span each.  starts(s, ev, t), samples(s, t, v)."""
    p = epochs.epoch_join(starts, samples, F.col("t") - span, F.col("t") + span, 2 * span, s)
    pre, post = F.when(F.col("st") < F.col("t"), F.col(v) * F.col(v)), F.when(F.col("st") >= F.col("t"), F.col(v) * F.col(v))
    per = p.groupBy(s, "ev").agg(F.count(pre).alias("n0"), F.count(post).alias("n1"), F.sqrt(F.avg(pre)).alias("a"), F.sqrt(F.avg(post)).alias("b"))
    per = per.where((F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("a") > 0)).withColumn("ratio", F.col("b") / F.col("a"))
    return exact_median(per, [s], "ratio", "response").join(per.groupBy(s).agg(F.count(F.lit(1)).alias("starts")), s)


def orientation_risk(samples: DataFrame, s: str = "s", beta: str = "beta", gamma: str = "gamma", wrap: float = WRAP_DEG, singular: float = SINGULAR_DEG) -> DataFrame:
    """Sessions whose beta comes near half a turn (wrap_risk) or whose gamma comes near a right angle (singularity_risk)."""
    g = samples.groupBy(s).agg(*(f(c).alias(f"{c}_{n}") for c in (beta, gamma) for n, f in (("min", F.min), ("max", F.max))))
    w = (F.col(f"{beta}_min") < -wrap) | (F.col(f"{beta}_max") > wrap)
    r = (F.col(f"{gamma}_min") < -singular) | (F.col(f"{gamma}_max") > singular)
    return g.withColumns({"wrap_risk": w, "singularity_risk": r}).where("wrap_risk or singularity_risk")


# --- gestures and epochs ------------------------------------------------------------------------------------------------------


def straightness(interactions: DataFrame, least_moves: int = 3) -> DataFrame:
    """Displacement over path length of gestures with enough moves that moved at all."""
    ok = (F.col("path_len_px") > 0) & (F.col("displacement_px") > 0) & (F.col("n_moves") >= least_moves)
    return interactions.where(ok).withColumn("straightness", F.col("displacement_px") / F.col("path_len_px"))


def scroll_morphology(interactions: DataFrame) -> DataFrame:
    """Scrolling gestures with their total distance and the distance per millisecond of contact, one at least."""
    g = interactions.where(F.col("gesture").isin("scroll_fling", "scroll_drag")).withColumn("scroll_total_px", F.col("scroll_during_px") + F.col("scroll_coast_px"))
    return g.withColumn("scroll_efficiency", F.col("scroll_total_px") / F.greatest(F.col("hold_ms"), F.lit(1.0)))


def axis_shares(bins: DataFrame, axes: list[str], rel: str = "rel") -> DataFrame:
    """One row: each axis' share of the mean absolute deviation from the time of the event on."""
    one = bins.where(F.col(rel) >= 0).agg(*(F.avg(F.abs(F.col(a))).alias(a) for a in axes))
    total = sum((F.col(a) for a in axes), F.lit(0.0))
    return one.select(*(ratio(F.col(a), total).alias(f"{a}_share") for a in axes))


def phase_bins(spans: DataFrame, samples: DataFrame, columns: list[str], bins: int = 30, most_phase: float = 1.5, before: float = 0.3, longest: float = 5000.0, width: float = 1000.0, s: str = "s") -> DataFrame:
    """ev, bin and the mean of each column's deviation from its mean before the span, by phase (0 start, 1 end).

    spans(ev, s, start, end); needs a duration up to longest, two samples before and three in all."""
    d = F.col("end") - F.col("start")
    e = spans.where((d > 0) & (d <= longest)).withColumns({"t": F.col("start"), "__d": d})
    p = epochs.epoch_join(e.select("ev", s, "t", "__d"), samples, F.col("t") - before * F.col("__d"), F.col("t") + most_phase * F.col("__d"), width, s, closed=True)
    w = Window.partitionBy("ev")
    pre = F.col("st") < F.col("t")
    p = p.withColumns({"__n": F.count(F.lit(1)).over(w), "__p": F.count(F.when(pre, 1)).over(w), **{f"__b_{c}": F.avg(F.when(pre, F.col(c))).over(w) for c in columns}})
    p = p.where("__n >= 3 and __p >= 2").withColumn("phase", (F.col("st") - F.col("t")) / F.col("__d"))
    p = p.withColumn("bin", F.floor(F.col("phase") * bins / most_phase).cast("int")).where(f"bin >= 0 and bin < {bins}")
    return p.groupBy("ev", "bin").agg(*(F.avg(F.col(c) - F.col(f"__b_{c}")).alias(c) for c in columns))


def bin_support(cells: DataFrame, by: list[str], value: str = "v", least: int = 10) -> DataFrame:
    """Per group and bin how many values there are, and whether they are too few."""
    return cells.groupBy(*by, "bin").agg(F.count(value).alias("n")).withColumn("thin", F.col("n") < least)


def existence_curve(cells: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """Per bin the mean, its standard error and the support, and peak_bin, the bin with the largest mean (the first of equal ones)."""
    by = by or []
    g = cells.groupBy(*by, "bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"))
    top = g.where("mean is not null").groupBy(*by).agg(F.max_by("bin", F.struct("mean", -F.col("bin"))).alias("peak_bin"))
    return g.join(top, by) if by else g.crossJoin(top)  # one row


def curve_shape(curve: DataFrame, by: list[str] | None = None, mean: str = "mean") -> DataFrame:
    """Peak by size, its bin, the last bin's value, and whether that is under half the peak (null for no peak)."""
    by = by or []
    g = curve.where(F.col(mean).isNotNull()).groupBy(*by).agg(F.max_by(F.struct("bin", F.col(mean).alias("m")), F.struct(F.abs(F.col(mean)), -F.col("bin"))).alias("top"), F.max_by(mean, "bin").alias("end"))
    decays = F.when(F.abs(F.col("top.m")) > 1e-9, F.abs(F.col("end")) < 0.5 * F.abs(F.col("top.m")))
    return g.select(*by, F.col("top.m").alias("peak"), F.col("top.bin").alias("peak_bin"), "end", decays.alias("decays"))


def release_test(cells: DataFrame, phase: str = "phase", value: str = "v", factor: float = 1.15) -> DataFrame:
    """One row: means in the middle of a gesture, around its release and after, and whether release stands out from both."""
    near = lambda lo, hi: F.avg(F.when((F.col(phase) >= lo) & (F.col(phase) <= hi), F.col(value)))
    g = cells.agg(near(0.3, 0.7).alias("mid"), near(0.9, 1.1).alias("release"), near(1.3, 1.5).alias("coast"))
    return g.withColumn("stands_out", (F.col("release") > F.col("mid") * factor) & (F.col("release") > F.col("coast") * factor))


def phase_energy(cells: DataFrame, phase: str = "phase", value: str = "v") -> DataFrame:
    """Per event the mean over the phases of the gesture itself."""
    return cells.groupBy("ev").agg(F.avg(F.when((F.col(phase) >= 0) & (F.col(phase) <= 1), F.col(value))).alias("energy"))


def class_dominance(rows: DataFrame, cls: str, pid: str, value: str, at: float = 0.4) -> DataFrame:
    """Per class: rows, participants, the largest participant's share and whether it could carry the class, and the spread of
    participants' means."""
    per = rows.groupBy(cls, pid).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    g = per.groupBy(cls).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("participants"), (F.max("n") / F.sum("n")).alias("top_share"), F.min("mean").alias("least_mean"), F.max("mean").alias("most_mean"))
    return g.withColumn("dominated", F.col("top_share") > at)


# --- typing -------------------------------------------------------------------------------------------------------------------


def typing_episodes(keys: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Per task instance: keys, share of backspaces, length of the finished text and keys per character of it.

    keys(by..., keyClass, val_len)."""
    g = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"), share(F.col("keyClass") == "BACKSPACE").alias("bs_rate"), F.max("val_len").alias("final_len")).where(F.col("n_keys") >= least)
    return g.withColumn("keys_per_char", ratio(F.col("n_keys").cast("double"), F.col("final_len")))


def autorepeat(keys: DataFrame, by: str) -> DataFrame:
    """Percent of keys that a held key repeated, over all keys and over backspaces.  keys(by, keyClass, repeat)."""
    r, b = truthy(F.col("repeat")), F.col("keyClass") == "BACKSPACE"
    return keys.groupBy(by).agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(b, 1)).alias("n_backspace"), (100 * share(r)).alias("repeat_pct"), (100 * F.avg(F.when(b, F.when(r, 1.0).otherwise(0.0)))).alias("bs_repeat_pct"))


def repositioning(keys: DataFrame, by: str) -> DataFrame:
    """Percent of keys typed with the caret before the end of the text.  keys(by, sel, len)."""
    _, moved = caret(F.col("sel"), F.col("len"))
    return keys.withColumn("__m", moved).where("__m is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), (100 * share(F.col("__m"))).alias("reposition_pct"))


def predictive_text(episodes: DataFrame, inputs: DataFrame, by: str) -> DataFrame:
    """Two signs of predicted text: episodes with fewer keys than characters, and inputs that replace text."""
    e = episodes.groupBy(by).agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("keys_per_char") < 1, 1)).alias("under_one"))
    r = inputs.where(F.col("inputType").isin(*REPLACEMENTS)).groupBy(by).agg(F.count(F.lit(1)).alias("replacements"))
    return e.join(r, by, "left").withColumns({"replacements": F.coalesce("replacements", F.lit(0)), "under_one_pct": 100.0 * F.col("under_one") / F.col("episodes")})


# --- the screen -------------------------------------------------------------------------------------------------------------


def reach(taps: DataFrame, x: str, y: str, by: str, cells: int = 8) -> DataFrame:
    """Per group: taps, interquartile ranges of both axes, grid cells touched and their share of all."""
    from ..functions.scalars import grid_cell

    q = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    n = F.count_distinct(F.struct(grid_cell(F.col(x), cells), grid_cell(F.col(y), cells)))
    return taps.groupBy(by).agg(F.count(F.lit(1)).alias("n"), q(x).alias("x_iqr"), q(y).alias("y_iqr"), n.alias("cells"), (n / float(cells * cells)).alias("coverage"))


def vertical_zones(taps: DataFrame, y: str, by: str) -> DataFrame:
    return taps.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(share((F.col(y) >= lo) & (F.col(y) < hi)).alias(name) for lo, hi, name in ZONES))


def viewport(resizes: DataFrame, by: list[str]) -> DataFrame:
    """Per session: median size, least, most and range of the height, and the aspect; a size is the viewport's or else the window's."""
    w, h = (F.coalesce(number(F.col(f"viewport{x}")), number(F.col(f"inner{x}"))) for x in ("Width", "Height"))
    r = resizes.withColumns({"__w": w, "__h": h}).where("__w is not null and __h is not null")
    g = r.groupBy(*by).agg(F.percentile("__w", F.lit(0.5)).alias("w_med"), F.percentile("__h", F.lit(0.5)).alias("h_med"), F.min("__h").alias("h_min"), F.max("__h").alias("h_max"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"h_range": F.col("h_max") - F.col("h_min"), "aspect": F.round(ratio(F.col("h_med"), F.col("w_med")), 3)})


# --- decisions ----------------------------------------------------------------------------------------------------------------


def decision_inventory(decisions: DataFrame, s: str = "s", pid: str = "pid") -> DataFrame:
    """Per kind: events, sessions, participants and percent of errors among those known to be right or wrong."""
    return decisions.groupBy("kind").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(s).alias("n_sessions"), F.count_distinct(pid).alias("n_participants"), F.round((1 - F.avg(F.when(F.col("correct").isNotNull(), F.col("correct").cast("double")))) * 100, 1).alias("error_pct"))


def decision_rate(decisions: DataFrame, tasks: DataFrame, family: dict[str, str], key: list[str]) -> DataFrame:
    """Per kind: instances of its task family and the percent of them in which it occurs.  tasks(key..., task_type)."""
    spark = decisions.sparkSession
    names = F.broadcast(spark.createDataFrame(list(family.items()), "kind string, task_type string"))
    n = tasks.groupBy("task_type").agg(F.count(F.lit(1)).alias("instances"))
    fired = decisions.join(names, "kind").select("kind", "task_type", *key).distinct().join(tasks, [*key, "task_type"]).groupBy("kind").agg(F.count(F.lit(1)).alias("fired"))
    return names.join(n, "task_type", "left").join(fired, "kind", "left").select("kind", "task_type", F.coalesce("instances", F.lit(0)).alias("instances"), F.round(100.0 * F.coalesce("fired", F.lit(0)) / F.when(F.col("instances") > 0, F.col("instances")), 1).alias("fired_pct"))


def decision_exposure(decisions: DataFrame, events: DataFrame, s: str = "s", pid: str = "pid") -> DataFrame:
    """Decisions of each kind per session of the participant."""
    n = events.groupBy(pid).agg(F.count_distinct(s).alias("sessions"))
    return decisions.groupBy(pid, "kind").agg(F.count(F.lit(1)).alias("n")).join(n, pid).withColumn("per_session", F.col("n") / F.col("sessions"))


# --- curves -------------------------------------------------------------------------------------------------------------------


def median_curves(curves: DataFrame, step: float = 0.5, s: str = "s", pid: str = "pid", t: str = "t", v: str = "v") -> DataFrame:
    """pid, g (grid place) and the median over sessions of curves interpolated at g * step, within each curve's ends only."""
    w = Window.partitionBy(s).orderBy(t)
    c = curves.withColumns({"__t1": F.lead(t).over(w), "__v1": F.lead(v).over(w)})
    low = F.ceil(F.col(t) / step)
    high = F.when(F.col("__t1").isNull(), F.floor(F.col(t) / step)).otherwise(F.ceil(F.col("__t1") / step) - 1)
    c = c.where(high >= low).withColumn("g", F.explode(F.sequence(low, high)))
    at = F.col("g") * step
    value = F.when(at == F.col(t), F.col(v)).otherwise(F.col(v) + (F.col("__v1") - F.col(v)) * (at - F.col(t)) / (F.col("__t1") - F.col(t)))
    cells = c.select(pid, s, "g", value.alias("__x"))
    return exact_median(cells, [pid, "g"], "__x", "median").join(cells.groupBy(pid, "g").agg(F.count("__x").alias("n")), [pid, "g"])


# --- context and speed ----------------------------------------------------------------------------------------------------------


def context_changes(sessions: DataFrame, fields: list[str], numbers: list[str], pid: str = "pid", roles: tuple[str, str] = ("enrol", "probe")) -> DataFrame:
    """Per participant with both roles: whether each field differs between them (null if either is null) and the change of each number.

    sessions(pid, role, fields..., numbers...), one row a role."""
    a, b = (sessions.where(F.col("role") == r).select(pid, *(F.col(c).alias(f"{c}_{r}") for c in [*fields, *numbers])) for r in roles)
    both = a.join(b, pid)
    return both.select(pid, *((F.col(f"{c}_{roles[0]}") != F.col(f"{c}_{roles[1]}")).alias(f"{c}_changed") for c in fields), *((F.col(f"{c}_{roles[1]}") - F.col(f"{c}_{roles[0]}")).alias(f"{c}_delta") for c in numbers))


def speed_accuracy(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median latency and number of right and of wrong decisions.  decisions(correct, latency)."""
    d = decisions.where("correct is not null and latency is not null")
    key = [*(by or []), "correct"]
    return exact_median(d, key, "latency", "median").join(d.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)


def quanta(rows: DataFrame, model: str, value: str, first: int = 6) -> DataFrame:
    """Per model how many distinct values a field takes, and the least of them."""
    d = rows.where(F.col(value).isNotNull()).select(model, value).distinct()
    r = d.withColumn("__r", F.row_number().over(Window.partitionBy(model).orderBy(value)))
    return r.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") <= first, F.struct("__r", F.col(value).alias("x"))))), lambda e: e["x"]).alias("least"))
