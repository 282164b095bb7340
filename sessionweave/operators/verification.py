"""Verification of identities: trust windows against enrolled references, controls, fusion over modalities and stress tests.

Rows are windows of one modality: pid, s (session), role (train, enrol, probe), a start and end, and x, the vector that
``preprocess`` or an embedder made.  Everything that is reported per k, identity, seed or modality is one grouped plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring, screening

LEAST_TRAIN, LEAST_IDENTITIES, SEEDS, LEAST_WEIGHT = 30, 3, 8, 1e-3
KS = (1, 2, 3, 5, 8, 10, 15, 20)


def with_roles(df: DataFrame, splits: DataFrame, s: str = "s") -> DataFrame:
    """Rows of the sessions that have a role, with it."""
    return df.join(splits.select(s, "role"), s)


def preprocess(df: DataFrame, features: list[str], ids: list[str], role: str = "role") -> tuple[DataFrame, str]:
    """df's ids with x, features imputed by the median and standardised over the train rows, in the order of features; and what it was
    fitted on: train_only, or all_windows_fallback under LEAST_TRAIN train rows.  A feature without a fit value becomes 0."""
    screening.check_leaks(features)
    thin = df.where(F.col(role) == "train").limit(LEAST_TRAIN).count() < LEAST_TRAIN
    long = screening.long_form(df, list(dict.fromkeys([*ids, role])), features)
    z = scoring.standardise(long, F.lit(True) if thin else F.col(role) == "train")
    place = F.create_map(*(x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))))
    vec = F.transform(F.array_sort(F.collect_list(F.struct(place[F.col("feature")].alias("i"), "z"))), lambda v: v["z"])
    return z.groupBy(*ids).agg(vec.alias("x")), "all_windows_fallback" if thin else "train_only"


def references(df: DataFrame, role: str = "enrol") -> DataFrame:
    """cand and ref, the mean vector of each identity's enrolment rows."""
    return scoring.mean_vectors(df.where(F.col("role") == role), ["pid"], "x").select(F.col("pid").alias("cand"), F.col("mean").alias("ref"))


def _mean(vectors: Column) -> Column:
    total = F.aggregate(F.slice(vectors, 2, 1 << 30), F.element_at(vectors, 1), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    return F.transform(total, lambda c: c / F.size(vectors))


def trust_vectors(df: DataFrame, ks: tuple[int, ...] = KS, stride: int = 1, role: str = "probe", start: str = "start", end: str = "end") -> DataFrame:
    """k, pid, s, trust_id, span and x, the mean vector of k consecutive rows of a session, every stride rows."""
    rows = df.where(F.col("role") == role).withColumn("x", F.transform("x", lambda c: c.cast("double")))
    w = Window.partitionBy("s").orderBy(start)
    out = None
    for k in ks:
        f = w.rowsBetween(0, k - 1)
        one = rows.withColumns({"rn": F.row_number().over(w), "xs": F.collect_list("x").over(f), "span": F.last(end).over(f) - F.col(start)})
        one = one.where((F.size("xs") == k) & ((F.col("rn") - 1) % stride == 0))
        one = one.select(F.lit(k).alias("k"), "pid", "s", F.concat_ws("|", "s", "rn", F.lit(k)).alias("trust_id"), "span", _mean(F.col("xs")).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


def score(trusts: DataFrame, refs: DataFrame) -> DataFrame:
    """Every trust window against every reference: cand, genuine, score (the negative distance) and z, normalised over the candidates."""
    met = scoring.against(trusts, refs)
    keep = [c for c in trusts.columns if c != "x"]
    out = met.select(*keep, "cand", F.col("pid").eqNullSafe(F.col("cand")).alias("genuine"), (-scoring.distance(F.col("x"), F.col("ref"))).alias("score"))
    return scoring.cohort_z(out)


def metrics(scored: DataFrame, by: list[str], score: str = "score", suffix: str = "") -> DataFrame:
    """by with auc, eer and far; all null with one class."""
    a = scoring.auc(scored, by, score=score)
    p = scoring.eer_far(scoring.roc_points(scored, by, score=score), by)
    both = F.col("auc").isNotNull()
    return a.join(p, by, "left").select(*by, F.col("auc").alias(f"auc{suffix}"), F.when(both, F.col("eer")).alias(f"eer{suffix}"), F.when(both, F.col("far")).alias(f"far{suffix}"))


def evaluate(scored: DataFrame, by: tuple[str, ...] = ("k",), fixed: DataFrame | None = None) -> DataFrame:
    """One row per k (and what else by names): counts, median span over trust windows, metrics raw and normalised, the least and
    greatest AUC without one identity; skipped says why a row has no metrics.  fixed(pid) restricts to those identities."""
    by = list(by)
    s = scored if fixed is None else scored.join(fixed.select("pid").distinct(), "pid", "left_semi")
    spans = scoring.exact_median(s.groupBy(*by, "trust_id").agg(F.first("span").alias("span")), by, "span", "median_span_s")
    n = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n_comparisons"), F.count_distinct("trust_id").alias("n_trust_windows"), F.count_distinct("pid").alias("n_probe_identities"), F.count_distinct("cand").alias("n_reference_identities"))
    loo = scoring.leave_one_out_auc(s, "pid", by).groupBy(*by).agg(F.min("auc").alias("auc_loo_min"), F.max("auc").alias("auc_loo_max"))
    out = n.join(spans, by).join(metrics(s, by), by, "left").join(metrics(s, by, "z", "_norm"), by, "left").join(loo, by, "left")
    few = F.col("n_probe_identities") < LEAST_IDENTITIES
    gone = ("auc", "eer", "far", "auc_norm", "eer_norm", "far_norm", "auc_loo_min", "auc_loo_max")
    return out.withColumns({c: F.when(~few, F.col(c)) for c in gone} | {"skipped": F.when(few, F.lit(f"fewer than {LEAST_IDENTITIES} probe identities"))})


def per_identity(scored: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """AUC of each probe identity's own comparisons."""
    return scoring.auc(scored, [*by, "pid"]).select(*by, "pid", "auc", (F.col("n1") + F.col("n0")).cast("long").alias("n_comparisons")).where("auc is not null")


def fixed_identities(df: DataFrame, most_k: int) -> DataFrame:
    """pid of identities with a probe session of most_k rows or more: those that can be scored at every k."""
    n = df.where("role = 'probe'").groupBy("pid", "s").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= most_k).select("pid").distinct()


def fixed_over(tables: dict[str, DataFrame], most_k: int) -> DataFrame:
    """pid of identities with most_k probe rows or more, and an enrolment, in every modality."""
    out = None
    for df in tables.values():
        n = df.where("role = 'probe'").groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most_k).select("pid")
        one = n.join(df.where("role = 'enrol'").select("pid").distinct(), "pid", "left_semi")
        out = one if out is None else out.intersect(one)
    return out


def largest_k(results: DataFrame, usual: int) -> DataFrame:
    """The usual k where it could be evaluated, else the largest k that could; no row with fewer than two identities at all k."""
    ok = results.where("auc is not null and n_probe_identities >= 2")
    return ok.agg(F.coalesce(F.max(F.when(F.col("k") == usual, F.col("k"))), F.max("k")).alias("k")).where("k is not null")


def leave_one_out_shift(scored: DataFrame, by: list[str], score: str = "z", at: float = 0.03) -> DataFrame:
    """AUC without each identity, its shift from the whole, and whether that is more than at."""
    whole = scoring.auc(scored, by, score=score).select(*by, F.col("auc").alias("whole"))
    one = scoring.leave_one_out_auc(scored, "pid", by, score=score)
    both = one.join(whole, by) if by else one.crossJoin(whole)  # one row
    shift = F.col("auc") - F.col("whole")
    return both.where("auc is not null").select(*by, "left_out", "auc", shift.alias("shift"), (F.abs(shift) > at).alias("flag"))


# --- label controls ----------------------------------------------------------------------------------------------------


def moved_probes(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with probe sessions claimed by the identity of another: other(s, other) maps probe sessions to probe sessions.

    Enrolment and training stay, so each identity keeps one of either."""
    own = df.where("role = 'probe'").select("s", "pid").distinct()
    to = other.join(own.select(F.col("s").alias("other"), F.col("pid").alias("claimed")), "other").select("s", "claimed")
    return df.join(to, "s", "left").withColumn("pid", F.when(F.col("role") == "probe", F.coalesce("claimed", "pid")).otherwise(F.col("pid"))).drop("claimed")


def shuffled_probes(df: DataFrame, seed: int) -> DataFrame:
    return moved_probes(df, scoring.permuted(df.where("role = 'probe'").select("s"), "s", seed))


def moved_sessions(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with fake, the identity of another session, for all roles; one map for all modalities keeps them consistent."""
    own = df.select("s", "pid").groupBy("s").agg(F.min("pid").alias("pid"))
    return df.join(other.join(own.select(F.col("s").alias("other"), F.col("pid").alias("fake")), "other").select("s", "fake"), "s")


def clean_identities(moved: DataFrame) -> DataFrame:
    """fake identities with enrolment and probe rows that share no real person: with one the control would hold a true match."""
    own = moved.where("role in ('enrol', 'probe')").select("fake", "pid", "role").distinct()
    roles = own.groupBy("fake", "pid").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("role") == "enrol", 1).otherwise(0)).alias("e"), F.max(F.when(F.col("role") == "probe", 1).otherwise(0)).alias("p"))
    return roles.groupBy("fake").agg(F.max("e").alias("e"), F.max("p").alias("p"), F.max("n").alias("shared")).where("e = 1 and p = 1 and shared = 1").select("fake")


def gap(real: DataFrame, control: DataFrame, by: str = "k") -> DataFrame:
    """Per k the real AUC, the mean over the control's seeds, and their difference."""
    c = control.groupBy(by).agg(F.avg("auc").alias("control"), F.count("auc").alias("seeds"))
    return real.select(by, F.col("auc").alias("real")).join(c, by).withColumn("gap", F.col("real") - F.col("control"))


def stability(results: DataFrame, by: str = "k") -> DataFrame:
    """Mean and sample deviation of the AUC over seeds."""
    return results.groupBy(by).agg(F.count("auc").alias("seeds"), F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"))


def weight_basis(gaps: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """modality and weight: the mean gap, less where the control had data for fewer seeds, LEAST_WEIGHT at least.

    gaps(modality, gap, seeds)."""
    g = gaps.groupBy("modality").agg(F.avg("gap").alias("gap"), F.max("seeds").alias("n"))
    return g.select("modality", F.greatest(F.col("gap") * F.col("n") / float(seeds), F.lit(LEAST_WEIGHT)).alias("weight"))


def importance(scored_rows: DataFrame, probes: DataFrame, refs: DataFrame, other: DataFrame) -> DataFrame:
    """Per component of x the drop of the AUC when probe rows take it from another row: other(row, other).

    A distance changes in one component only, so all components are scored from one join.  scored_rows(row, pid, cand, genuine,
    score); probes(row, x)."""
    mine = probes.join(other, "row").join(probes.select(F.col("row").alias("other"), F.col("x").alias("y")), "other").select("row", "x", "y")
    met = scored_rows.join(mine, "row").join(refs, "cand")
    each = met.select("genuine", "score", F.posexplode(F.arrays_zip("x", "y", "ref")).alias("j", "c"))
    step = F.col("c.y").cast("double") - F.col("c.ref"), F.col("c.x").cast("double") - F.col("c.ref")
    moved = each.select("j", "genuine", (-F.sqrt(F.greatest(F.col("score") * F.col("score") + step[0] * step[0] - step[1] * step[1], F.lit(0.0)))).alias("score"))
    base = scoring.auc(scored_rows, []).select(F.col("auc").alias("base"))
    return scoring.auc(moved, ["j"]).crossJoin(base).select("j", (F.col("base") - F.col("auc")).alias("drop"))  # base is one row


def moved_components(df: DataFrame, components: list[int], other: DataFrame) -> DataFrame:
    """df with the given components of x taken from another row, all from the same one: other(row, other)."""
    y = df.select(F.col("row").alias("other"), F.col("x").alias("y"))
    hit = F.array(*(F.lit(c) for c in components))
    return df.join(other, "row").join(y, "other").withColumn("x", F.transform("x", lambda v, i: F.when(F.array_contains(hit, i), F.get("y", i)).otherwise(v))).drop("y", "other")


# --- several modalities ------------------------------------------------------------------------------------------------


def positions(tables: dict[str, DataFrame]) -> DataFrame:
    """Every (s, window_index) that any modality has, once, with its start and end."""
    out = None
    for df in tables.values():
        one = df.select("s", "window_index", "start", "end")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("s", "window_index").agg(F.min("start").alias("start"), F.min("end").alias("end"))


def shared_trust(tables: dict[str, DataFrame], ks: tuple[int, ...] = KS) -> DataFrame:
    """Trust windows that slide over the positions of any modality's probe rows, for all modalities at once.

    modality, k, pid, s, trust_id, span, n_windows and x, the mean of the modality's rows within the k positions."""
    probes = {m: df.where("role = 'probe'") for m, df in tables.items()}
    w = Window.partitionBy("s").orderBy("window_index")
    p = positions(probes).withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("s"))})
    rows = None
    for m, df in probes.items():
        one = df.select(F.lit(m).alias("modality"), "pid", "s", "window_index", F.transform("x", lambda c: c.cast("double")).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(p.select("s", "window_index", "rn", "n"), ["s", "window_index"])
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("n >= k")
    # a row lies in the trust windows that begin at most k - 1 positions before it
    rows = rows.withColumn("first", F.explode(F.sequence(F.greatest(F.lit(1), F.col("rn") - F.col("k") + 1), F.least(F.col("rn"), F.col("n") - F.col("k") + 1))))
    held = rows.groupBy("modality", "k", "pid", "s", "first").agg(F.collect_list("x").alias("xs"))
    ends = p.select(F.col("s").alias("s2"), F.col("rn").alias("r2"), F.col("end").alias("e2"))
    starts = p.select("s", F.col("rn").alias("first"), "start")
    out = held.join(starts, ["s", "first"]).join(ends, (F.col("s") == F.col("s2")) & (F.col("r2") == F.col("first") + F.col("k") - 1))
    return out.select("modality", "k", "pid", "s", F.concat_ws("|", "s", "first", "k").alias("trust_id"), (F.col("e2") - F.col("start")).alias("span"), F.size("xs").cast("long").alias("n_windows"), _mean(F.col("xs")).alias("x"))


def score_modalities(trusts: DataFrame, refs: DataFrame, ddof: int = 1) -> DataFrame:
    """Distances and z (over the candidates of a trust window and modality) of trusts(modality, ...) against refs(modality, cand, ref)."""
    met = trusts.join(refs, "modality")
    keep = [c for c in trusts.columns if c != "x"]
    out = met.select(*keep, "cand", (F.col("pid") == F.col("cand")).alias("genuine"), scoring.distance(F.col("x"), F.col("ref")).alias("dist"))
    w = Window.partitionBy("modality", "trust_id")
    sd = (F.stddev_samp if ddof else F.stddev_pop)("dist").over(w)
    return out.withColumn("z", (F.col("dist") - F.avg("dist").over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def fuse(scored: DataFrame, scheme: str = "equal", weights: DataFrame | None = None) -> DataFrame:
    """One row per trust window and candidate: fused, the weighted mean of z over the modalities that are there.

    Schemes: equal, fixed (weights(modality, weight)), dynamic (rows behind the score)."""
    if scheme == "fixed":
        s = scored.join(weights.select("modality", F.col("weight").alias("w")), "modality")
    else:
        s = scored.withColumn("w", F.lit(1.0) if scheme == "equal" else F.col("n_windows").cast("double"))
    key = [c for c in ("k", "pid", "cand", "trust_id", "genuine", "span") if c in s.columns]
    return scoring.weighted_fusion(s, key)


def sweep(scored: DataFrame, combinations: list[tuple[str, ...]], schemes: tuple[str, ...] = ("equal", "dynamic"), weights: DataFrame | None = None) -> DataFrame:
    """Fused scores of every combination of modalities under every scheme."""
    spark = scored.sparkSession
    combos = spark.createDataFrame([("+".join(c), m) for c in combinations for m in c], "combo string, modality string")
    s = scored.join(F.broadcast(combos), "modality")
    out = None
    for scheme in schemes:
        t = s.join(weights.select("modality", F.col("weight").alias("w")), "modality") if scheme == "fixed" else s.withColumn("w", F.lit(1.0) if scheme == "equal" else F.col("n_windows").cast("double"))
        one = scoring.weighted_fusion(t, ["combo", "k", "pid", "cand", "trust_id", "genuine", "span"]).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return out


def session_scores(tables: dict[str, DataFrame], refs: DataFrame, weights: DataFrame, role: str = "probe") -> DataFrame:
    """One fused score per session and candidate: the mean vector of a session's rows of a role in each modality, z over the
    candidates, weighted mean over the modalities that a (session, candidate) has.  role = 'train' replays training rows."""
    out = None
    for m, df in tables.items():
        one = scoring.mean_vectors(df.where(F.col("role") == role), ["s", "pid"], "x").select(F.lit(m).alias("modality"), "pid", "s", F.col("s").cast("string").alias("trust_id"), F.col("mean").alias("x"))
        out = one if out is None else out.unionByName(one)
    scored = score_modalities(out, refs).join(weights.select("modality", F.col("weight").alias("w")), "modality")
    return scoring.weighted_fusion(scored, ["s", "pid", "cand", "genuine"])


def same_device(scored: DataFrame, devices: DataFrame) -> DataFrame:
    """Comparisons within groups of two or more identities with the same device: devices(pid, device)."""
    groups = devices.groupBy("device").agg(F.count_distinct("pid").alias("n")).where("n >= 2").select("device")
    d = devices.join(groups, "device", "left_semi")
    a, b = d.withColumnRenamed("device", "da"), d.select(F.col("pid").alias("cand"), F.col("device").alias("device"))
    return scored.join(a, "pid").join(b, "cand").where("da = device").drop("da")


def by_task_group(scored: DataFrame, held_out: list) -> DataFrame:
    """scored(task, ...) with task_group: heldout_tasks or seen_tasks."""
    return scored.withColumn("task_group", F.when(F.col("task").isin(*held_out), "heldout_tasks").otherwise("seen_tasks"))


def held_out_tasks(tasks: list, share: float = 0.23, seed: int = 42) -> list:
    """A fixed share of the tasks, one at least, by a mix of their place and the seed."""
    order = sorted(range(len(tasks)), key=lambda i: ((i + 1) * 2654435761 * (2 * seed + 1)) % 4294967291)
    return sorted(tasks[i] for i in order[: max(1, round(len(tasks) * share))])


def without_held_out(df: DataFrame, held_out: list) -> DataFrame:
    """Training rows of held-out tasks lose their role, so nothing is fitted on them."""
    out = (F.col("role") == "train") & F.col("task").isin(*held_out)
    return df.withColumn("role", F.when(out, "train_held_out").otherwise(F.col("role")))


def rank_table(scored: DataFrame, by: tuple[str, ...] = ("modality", "pid")) -> DataFrame:
    """Candidates of each probe identity by their median distance, with the rank of its own reference."""
    g = scoring.exact_median(scored, [*by, "cand"], "dist", "median_dist")
    w = Window.partitionBy(*by).orderBy("median_dist", "cand")
    g = g.withColumns({"rank": F.row_number().over(w), "n_candidates": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return g.withColumn("own_rank", F.max(F.when(F.col("cand") == F.col("pid"), F.col("rank"))).over(Window.partitionBy(*by)))


def reference_distances(refs: DataFrame) -> DataFrame:
    """Distance of every two references of a modality, with its rank from the nearest pair on."""
    a, b = refs.select("modality", F.col("cand").alias("a"), F.col("ref").alias("ra")), refs.select("modality", F.col("cand").alias("b"), F.col("ref").alias("rb"))
    d = a.join(b, "modality").where("a < b").select("modality", "a", "b", scoring.distance(F.col("ra"), F.col("rb")).alias("dist"))
    return screening.average_ranks(d, "dist", ["modality"])


def shifts(df: DataFrame, least: int = 3) -> DataFrame:
    """Distance of each identity's mean probe vector from its mean enrolment vector, and its rank from the largest on, ties averaged."""
    m = scoring.mean_vectors(df.where("role in ('enrol', 'probe')"), ["pid", "role"], "x").where(F.col("n") >= least)
    a, b = (m.where(F.col("role") == r).select("pid", F.col("mean").alias(r)) for r in ("enrol", "probe"))
    d = a.join(b, "pid").select("pid", scoring.distance(F.col("enrol"), F.col("probe")).alias("shift"))
    return screening.average_ranks(d.withColumn("neg", -F.col("shift")), "neg").drop("neg")


def with_outcomes(changes: DataFrame, shift: DataFrame, auc: DataFrame) -> DataFrame:
    """Context changes with each identity's shift and AUC where they are known."""
    return changes.join(shift.select("pid", "shift"), "pid", "left").join(auc.select("pid", "auc"), "pid", "left")
