"""Screening of features: everything works on the long form (row, feature, value), so a wide table is one job, not one per column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feature_parts
from ..functions.stats import correlation, finite, share
from ..shipping import ship
from .scoring import value_ranks

LONG = ("feature", "value")

# fixed values: families left out by decision, names that are counts, the flag that governs a family, notes on features by the
# beginning of their name (the first that fits), columns that are no features
HARD_EXCLUDED = ("tap_radiusX", "tap_radiusY", "tap_force", "tap_cells_touched", "tap_coverage")
COUNT_LIKE = ("tap_count", "tap_cells_touched", "typing_keydown_count", "gesture_n_interactions")
GOVERNING_FLAG = {"typing": "typing_afforded", "tap": "tapping_afforded"}
KNOWN_ISSUES = {
    "tap_radiusX_": "follows the device model",
    "tap_radiusY_": "zero on newer phones: the field is not supported",
    "tap_force_": "repeats tap_radiusX on phones",
    "tap_coverage": "tap_cells_touched over a constant",
    "tap_cells_touched": "a count, and tap_coverage times a constant",
    "typing_transition_space_space_": "rare by the text that is typed",
    "typing_transition_backspace_space_": "rare by the text that is typed",
    "typing_dwell_digit_": "rare by the text that is typed",
    "typing_dwell_punct_or_symbol_": "rare by the text that is typed",
    "typing_dwell_enter_": "rare in a window",
}
IDENTITY = ("sessionId", "participantId", "deviceFamily", "window_index", "window_start_s", "window_end_s", "taskIndex", "taskType", "activeArea", "task_pass", "task_start_s", "task_end_s")
FLAGS = tuple(f"{m}_{x}" for x in ("afforded", "observed") for m in ("typing", "tapping", "scrolling")) + ("task_boundary_straddle",) + tuple(f"{m}_straddle_conflict" for m in ("typing", "tapping", "scrolling"))
QUESTIONS = ("ctxTimeOfDay", "ctxFatigue", "ctxFocusLevel", "ctxEnvironmentNoise", "ctxMovement", "ctxPosture", "ctxHandUse", "ctxInputDevice", "ctxCaffeine", "ctxAlcohol", "ctxPrivacy")
CONTEXT = ("deviceModel", "devicePlatform", "appVersion", "consentVersion", "schemaVersion", "identitySource", "usableForSignalExtraction", "completedNormally", "sessionIndex", "sessionDurationMs", *QUESTIONS)
PACE_STEMS = ("dwell", "ptp", "rtp", "reaction", "interval", "speed", "velocity", "duration", "pace", "gap", "latency", "hold", "press")
PACE_STATS = ("_mean", "_median", "_p95", "_max")
IDENTITY_NAMES = ("participantid", "sessionid", "deviceid", "identitysource")


def is_count_like(name: Column) -> Column:
    return name.isin(*COUNT_LIKE) | name.rlike("(_n|_count)$")


def is_pace(name: Column) -> Column:
    """Whether a feature measures how fast, not how: a stem anywhere and a statistic of level at the end."""
    return F.lower(name).rlike(f"({'|'.join(PACE_STEMS)})") & F.lower(name).rlike(f"({'|'.join(PACE_STATS)})$")


def known_issue(name: Column, issues: dict[str, str] = KNOWN_ISSUES) -> Column:
    """Note of the first prefix that fits; null if none does."""
    return F.coalesce(*(F.when(name.startswith(p), F.lit(note)) for p, note in issues.items()))


def check_leaks(features: list[str]) -> None:
    """Raises if a feature list holds an identity column."""
    leaked = [f for f in features if f.lower() in IDENTITY_NAMES]
    if leaked:
        raise ValueError(f"identity columns among the features: {leaked}")


def covered(wide: DataFrame, least: float = 0.5, but: tuple[str, ...] = (*IDENTITY, "role")) -> list[str]:
    """Numeric columns, none of but, that hold a value in least of the rows or more; one pass."""
    numeric = [f.name for f in wide.schema if f.name not in but and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.name not in but and f.dataType.typeName().startswith("decimal")]
    got = wide.agg(*(share(finite(F.col(f"`{c}`")).isNotNull()).alias(c) for c in numeric)).first() if numeric else {}
    return [c for c in numeric if got[c] is not None and got[c] >= least]


def long_form(wide: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return wide.unpivot(ids, features, *LONG).withColumn("value", finite(F.col("value")))


def availability(long: DataFrame, group: str) -> DataFrame:
    """Percent of values present, overall and in the worst group; empty and nearly empty (under one percent) features."""
    per = long.groupBy("feature", group).agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("rows"))
    out = per.groupBy("feature").agg((F.sum("n") * 100.0 / F.sum("rows")).alias("pct"), F.min(F.col("n") * 100.0 / F.col("rows")).alias("worst_group_pct"), F.sum("n").alias("n"))
    return out.withColumns({"is_empty": F.col("n") == 0, "is_near_empty": (F.col("n") > 0) & (F.col("pct") < 1.0)})


def exposure(long: DataFrame, group: str, least_groups: int = 5, flag_at: float = 0.5) -> DataFrame:
    """Correlation of groups' means with their number of rows; null under least_groups or where either is constant."""
    per = long.groupBy("feature", group).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("rows")).where("mean is not null")
    varied = (F.count(F.lit(1)) >= least_groups) & (F.min("mean") < F.max("mean")) & (F.min("rows") < F.max("rows"))
    out = per.groupBy("feature").agg(F.when(varied, correlation(F.col("mean"), F.col("rows"))).alias("r"))
    return out.withColumn("flag", F.coalesce(F.abs("r") >= flag_at, F.lit(False)))


def group_lock(long: DataFrame, group: str, least_modal: int = 20, least_rows: int = 5, strong: float = 3.0, tight: float = 0.4) -> DataFrame:
    """Whether a feature tells groups rather than behaviour: spread between groups' means over spread within them.

    locked is null where it can't be judged: under two groups of least_rows values or under least_modal values off the mode."""
    v = long.where("value is not null")
    counted = v.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    modal = counted.groupBy("feature").agg((F.sum("n") - F.max("n")).alias("off_mode"))
    per = v.groupBy("feature", group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where(F.col("n") >= least_rows)
    g = per.groupBy("feature").agg(F.count(F.lit(1)).alias("groups"), F.stddev_samp("mean").alias("between"), F.percentile("sd", F.lit(0.5)).alias("within"))
    whole = v.groupBy("feature").agg(F.stddev_samp("value").alias("overall"))
    out = modal.join(g, "feature", "left").join(whole, "feature", "left")
    able = (F.coalesce("groups", F.lit(0)) >= 2) & (F.col("off_mode") >= least_modal)
    assoc = F.when(F.col("within") > 0, F.col("between") / F.col("within"))
    locked = F.when(F.col("within") <= 0, F.col("between") > 0).otherwise((assoc >= strong) & (F.col("within") / F.col("overall") < tight))
    return out.select("feature", "off_mode", F.coalesce("groups", F.lit(0)).alias("groups"), F.when(able, assoc).alias("association"), F.when(able, locked).alias("locked"))


def pairwise_correlation(wide: DataFrame, features: list[str], least: int = 30) -> DataFrame:
    """a, b, overlap and r of all pairs of features over rows where both are present.

    Each partition adds up five products of its value and mask matrices, of a size that only the number of features sets; two
    rounds of sums over partitions follow.  Values are taken off a mean of their own first, for exactness."""
    import numpy as np
    import pyarrow as pa

    ship(wide.sparkSession)
    means = wide.agg(*(F.avg(finite(F.col(f"`{c}`"))).alias(c) for c in features)).first()
    centre = np.array([means[c] or 0.0 for c in features])
    names = ("n", "x", "y", "xx", "yy", "xy")
    schema = "i int, part int, " + ", ".join(f"{c} array<double>" for c in names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        part = 0
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            mask = np.isfinite(x)
            x = np.where(mask, x - centre, 0.0)
            m = mask.astype(float)
            part = int(b.column("__part")[0].as_py()) if b.num_rows else part
            now = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = now if total is None else total + now
        if total is not None:
            k = len(features)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(np.full(k, part % 64), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], ["i", "part", *names])

    def added(t: pa.Table) -> pa.Table:
        cols = [np.stack([np.array(v) for v in t.column(c).to_pylist()]).sum(axis=0) for c in names]
        return pa.table([pa.array([t.column("i")[0].as_py()], pa.int32()), pa.array([t.column("part")[0].as_py()], pa.int32()), *(pa.array([c], pa.list_(pa.float64())) for c in cols)], names=["i", "part", *names])

    got = wide.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in features), F.spark_partition_id().alias("__part")).mapInArrow(sums, schema)
    got = got.groupBy("i", "part").applyInArrow(added, schema).groupBy("i").applyInArrow(added, schema)
    cells = got.select("i", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(features) - 1)).alias("j"), *names)).alias("c")).select("i", "c.*").where("i < j and n > 0")
    n, cov = F.col("n"), F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    # a variance that is rounding error is none
    varied = (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    r = F.when((n >= least) & varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.when(varied, vx * vy)))))
    label = F.array(*(F.lit(c) for c in features))
    named = cells.select(F.element_at(label, F.col("i") + 1).alias("p"), F.element_at(label, F.col("j") + 1).alias("q"), n.cast("long").alias("overlap"), r.alias("r"))
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "overlap", "r")


def redundancy(pairs: DataFrame) -> DataFrame:
    """Each feature's most correlated partner (by size, then name) with the correlation rounded to three places."""
    both = pairs.where("r is not null").select(F.col("a").alias("feature"), F.col("b").alias("partner"), "r").unionByName(pairs.where("r is not null").select(F.col("b").alias("feature"), F.col("a").alias("partner"), "r"))
    w = Window.partitionBy("feature").orderBy(F.round(F.abs("r"), 9).desc(), "partner")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("feature", "partner", F.round(F.abs("r"), 3).alias("corr"))


def duplicates(best: DataFrame, support: DataFrame) -> DataFrame:
    """Of mutual best partners with a rounded correlation of 1.0 the one to drop: less support, then later name."""
    a, b = best.where("corr = 1.0").alias("a"), best.where("corr = 1.0").alias("b")
    m = a.join(b, (F.col("a.partner") == F.col("b.feature")) & (F.col("b.partner") == F.col("a.feature"))).where("a.feature < b.feature").select(F.col("a.feature").alias("f"), F.col("b.feature").alias("g"))
    s = support.select("feature", "n")
    m = m.join(s.withColumnsRenamed({"feature": "f", "n": "nf"}), "f").join(s.withColumnsRenamed({"feature": "g", "n": "ng"}), "g")
    return m.select(F.when(F.col("ng") > F.col("nf"), F.col("f")).otherwise(F.col("g")).alias("dropped"), F.when(F.col("ng") > F.col("nf"), F.col("g")).otherwise(F.col("f")).alias("kept"))


def decisions(diagnostics: DataFrame, hard: tuple[str, ...] = HARD_EXCLUDED) -> DataFrame:
    """decision and decision_reason: the first reason that applies, in order of priority."""
    name = F.col("feature")
    excluded = F.lit(False)
    for p in hard:
        excluded = excluded | name.startswith(p)
    why = F.when(excluded, "hard_excluded_family").when(F.col("is_empty"), "fully_empty").when(F.col("is_near_empty"), "near_empty").when(is_count_like(name), "count_like").when(F.coalesce(F.col("exposure_flag"), F.lit(False)), "high_exposure_corr").otherwise("kept")
    return diagnostics.withColumn("decision_reason", why).withColumn("decision", F.when(F.col("decision_reason") == "kept", "keep").otherwise("drop"))


def _decided(decided: DataFrame, losers: DataFrame) -> DataFrame:
    """decided with the features of losers(feature, why) dropped for that reason."""
    out = decided.join(losers, "feature", "left")
    hit = F.col("why").isNotNull()
    return out.withColumns({"decision": F.when(hit, "drop").otherwise(F.col("decision")), "decision_reason": F.coalesce("why", "decision_reason")}).drop("why")


def drop_duplicates(decided: DataFrame) -> DataFrame:
    """Drops one of each two kept features that are each other's best partner with a correlation of 1.0.

    decided: feature, partner and corr (over all features), n (support), decision, decision_reason."""
    kept = decided.where("decision = 'keep'")
    d = duplicates(kept.select("feature", "partner", "corr"), kept)
    return _decided(decided, d.select(F.col("dropped").alias("feature"), F.concat(F.lit("duplicate_of:"), "kept").alias("why")))


def drop_duplicates_of_dropped(decided: DataFrame) -> DataFrame:
    """Drops kept features whose mutual best partner at 1.0 was dropped for a reason of its own, not as a duplicate."""
    other = decided.where("decision = 'drop' and not startswith(decision_reason, 'duplicate_of')").select(F.col("feature").alias("p"), F.col("partner").alias("back"), F.col("decision_reason").alias("reason"))
    hit = decided.where("decision = 'keep' and corr = 1.0").join(other, (F.col("partner") == F.col("p")) & (F.col("back") == F.col("feature")))
    return _decided(decided, hit.select("feature", F.concat(F.lit("duplicate_of_dropped:"), "p", F.lit(":"), "reason").alias("why")))


def mark_for_review(decided: DataFrame) -> DataFrame:
    """needs_manual_review on kept features that look locked to the device; they stay."""
    flag = F.coalesce(F.col("locked"), F.lit(False)) & (F.col("decision") == "keep")
    return decided.withColumns({"needs_manual_review": flag, "decision_reason": F.when(flag, "device_locked_needs_manual_review").otherwise(F.col("decision_reason"))})


def decide(diagnostics: DataFrame, hard: tuple[str, ...] = HARD_EXCLUDED) -> DataFrame:
    """All passes over diagnostics in order."""
    return mark_for_review(drop_duplicates_of_dropped(drop_duplicates(decisions(diagnostics, hard))))


def context_confound(long: DataFrame, groups: list[str], at: float = 3.0) -> DataFrame:
    """Strongest association of each feature with any of the groups' columns; of equal ones the first column."""
    each = None
    for i, g in enumerate(groups):
        one = group_lock(long.where(F.col(g).isNotNull()), g).select("feature", F.lit(i).alias("i"), F.lit(g).alias("grouping"), "association")
        each = one if each is None else each.unionByName(one)
    w = Window.partitionBy("feature").orderBy(F.desc("association"), "i")
    top = each.where("association is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select("feature", "grouping", "association", (F.col("association") >= at).alias("high"))


def diagnose(wide: DataFrame, features: list[str], ids: list[str], group: str = "participantId", device: str = "deviceModel", questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """One row per feature: its parts, availability, exposure, device lock, context, redundancy, notes and needs_review."""
    asked = [c for c in questions if c in wide.columns]
    carried = [c for c in dict.fromkeys([*ids, group, device, *asked]) if c in wide.columns]
    long = long_form(wide, carried, features)
    out = availability(long, group)
    out = out.join(exposure(long, group).select("feature", F.col("r").alias("exposure_r"), F.col("flag").alias("exposure_flag")), "feature", "left")
    if device in wide.columns:
        lock = group_lock(long.where(F.col(device).isNotNull()), device)
        out = out.join(lock.select("feature", F.col("association").alias("device_association"), "locked", F.col("locked").isNotNull().alias("lock_assessable")), "feature", "left")
    else:
        out = out.withColumns({"device_association": F.lit(None).cast("double"), "locked": F.lit(None).cast("boolean"), "lock_assessable": F.lit(False)})
    if asked:
        ctx = context_confound(long, asked).select("feature", F.col("association").alias("context_association"), F.col("grouping").alias("context_column"), F.col("high").alias("context_high"))
        out = out.join(ctx, "feature", "left")
    else:
        out = out.withColumns({"context_association": F.lit(None).cast("double"), "context_column": F.lit(None).cast("string"), "context_high": F.lit(False)})
    out = out.join(redundancy(pairwise_correlation(wide, features)), "feature", "left")
    family, metric, stat = feature_parts(F.col("feature"))
    flag = F.coalesce(*(F.when(family == k, F.lit(v)) for k, v in GOVERNING_FLAG.items()))
    out = out.withColumns({"family": family, "metric": metric, "statistic": F.coalesce(stat, F.lit("none")), "governing_flag": flag, "is_count_like": is_count_like(F.col("feature")), "known_issue": known_issue(F.col("feature"))})
    return needs_review(out)


def needs_review(diagnostics: DataFrame) -> DataFrame:
    """One flag for any of the warning signs."""
    no = F.lit(False)
    signs = [F.coalesce(F.col(c), no) for c in ("is_empty", "is_near_empty", "is_count_like", "exposure_flag", "locked", "context_high")]
    any_ = F.col("known_issue").isNotNull()
    for c in signs:
        any_ = any_ | c
    return diagnostics.withColumn("needs_review", any_)


def candidate(windows: DataFrame, decided: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """The windows with identity, flag, context and kept feature columns, and what doesn't add up: columns that are in no list, and
    expected ones that are missing."""
    rows = decided.select("feature", "decision").collect()  # one a feature
    kept = {r["feature"] for r in rows if r["decision"] == "keep"}
    known = (*IDENTITY, *FLAGS, *CONTEXT)
    report = {"unaccounted": sorted(set(windows.columns) - {r["feature"] for r in rows} - set(known)), "missing": sorted(set(known) - set(windows.columns))}
    order = [c for c in known if c in windows.columns] + [c for c in windows.columns if c in kept]
    return windows.select(*order), report


# fixed values: each modality's columns and what makes a window eligible
MODALITIES = {"typing": (("typing_", "coupling_key_"), "typing"), "tap": (("tap_", "coupling_tap_"), "tapping"), "gesture": (("gesture_", "coupling_gesture_"), "tapping"), "motion": (("motion_",), None)}


def modality_table(table: DataFrame, modality: str) -> DataFrame:
    """Eligible windows with identity columns and the modality's own features; raises if there is no feature or gate."""
    prefixes, gate = MODALITIES[modality]
    flags = ("typing_afforded", "typing_observed", "typing_straddle_conflict")
    own = [c for c in table.columns if c.startswith(prefixes) and c not in flags]
    if not own:
        raise ValueError(f"no feature columns for {modality}")
    needed = (f"{gate}_afforded", f"{gate}_straddle_conflict") if gate else ("motion_idle_frac",)
    lacking = [c for c in needed if c not in table.columns]
    if lacking:
        raise ValueError(f"{modality} lacks {lacking}")
    ok = F.col("motion_idle_frac").isNotNull() if gate is None else F.coalesce(F.col(needed[0]), F.lit(False)) & ~F.coalesce(F.col(needed[1]), F.lit(False))
    return table.where(ok).select(*[c for c in IDENTITY if c in table.columns], *own)


def equality_share(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Per group the share of rows with both values in which they are equal."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col(a) == F.col(b)).alias("equal"))


def principal_components(wide: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """wide with pc (the first k components of median-imputed, standardised features) and the shares of variance they explain.

    The moments of all pairs are what pairwise_correlation adds up, over imputed values, so only a matrix of features by features
    reaches the driver."""
    import numpy as np

    one = wide.agg(*(F.percentile(finite(F.col(f"`{c}`")), F.lit(0.5)).alias(c) for c in features)).first()
    use = [c for c in features if one[c] is not None]
    filled = wide.withColumns({f"__{c}": F.coalesce(finite(F.col(f"`{c}`")), F.lit(one[c])) for c in use})
    stats = filled.agg(*(x for c in use for x in (F.avg(f"__{c}").alias(f"m_{c}"), F.stddev_pop(f"__{c}").alias(f"s_{c}")))).first()
    z = {c: (F.col(f"__{c}") - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in use}
    corr = np.diag([1.0 if stats[f"s_{c}"] else 0.0 for c in use])
    at = {c: i for i, c in enumerate(use)}
    for r in pairwise_correlation(filled.select(*(F.col(f"__{c}").alias(c) for c in use)), use, 1).where("r is not null").collect():
        corr[at[r["a"]], at[r["b"]]] = corr[at[r["b"]], at[r["a"]]] = r["r"]
    values, vectors = np.linalg.eigh(corr)
    top = np.argsort(values)[::-1][:k]
    axes = [v * np.sign(v[np.abs(v).argmax()]) for v in vectors[:, top].T]
    pcs = [sum((z[c] * float(w) for c, w in zip(use, v, strict=True)), F.lit(0.0)) for v in axes]
    return filled.withColumn("pc", F.array(*pcs)).drop(*(f"__{c}" for c in use)), [float(values[i] / values.sum()) for i in top]


def dominance(values: DataFrame, group: str, value: str, most_share: float = 0.5, agreement: float = 0.8) -> DataFrame:
    """Largest group's share of the values, and how many groups' means agree in sign (0 is not positive)."""
    per = values.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    up, all_ = F.count(F.when(F.col("mean") > 0, 1)), F.count(F.lit(1))
    out = per.agg((F.max("n") / F.sum("n")).alias("max_share"), (F.greatest(up, all_ - up) / F.when(all_ > 0, all_)).alias("consensus"), all_.alias("groups"))
    good = (F.col("max_share") < most_share) & (F.col("consensus") >= agreement)
    return out.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "trustworthy").otherwise("needs_scrutiny"))


def reliability(values: DataFrame, group: str, value: str, least: int = 5, dominance: float = 0.4, agreement: float = 0.8) -> DataFrame:
    """Verdict on whether a direction of value is shared by groups: underpowered, contested, dominated_and_contested, trustworthy."""
    per = values.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    voice = F.when(F.col("n") >= least, F.sign("mean"))
    up, down = F.count(F.when(voice > 0, 1)), F.count(F.when(voice < 0, 1))
    out = per.agg(F.count(F.lit(1)).alias("groups"), F.count(voice).alias("voting"), (F.max("n") / F.sum("n")).alias("top_share"), (F.greatest(up, down) / F.when(F.count(voice) > 0, F.count(voice))).alias("consensus"))
    verdict = F.when(F.col("voting") < 3, "underpowered").when((F.col("top_share") > dominance) & (F.col("consensus") < 1.0), "dominated_and_contested").when(F.col("consensus") < agreement, "contested").otherwise("trustworthy")
    return out.withColumn("verdict", verdict)


def average_ranks(df: DataFrame, column: str, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks with ties averaged, from counts per value."""
    by = partition or []
    r = value_ranks(df, by, column).select(*by, column, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(r, [*by, column], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    r = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, by, "rx"), y, by, "ry")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho"))
