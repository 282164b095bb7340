"""Queries of the exploratory operators, the ingest's session index and the remaining screens and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import share
from ..operators import epochs, quality, screening
from ..operators import explore as x
from ..sources import sessions
from .base import DAY, EV, HOUR, TASKS, events, table, tasks
from .screens import FEATURES, WIDE, wide

E = F.col


def _r(df, **places):
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def device_filter(spark, d):
    return x.of_family(events(spark, d).withColumn("family", F.initcap("kind")), "click", "family", "t").select("id", "family")


def name_rules(spark, d):
    """Names made of kinds: base of the task, second passes, keys of the keypad, pace features and a pattern."""
    e = events(spark, d).withColumns({"task": F.concat(E("kind"), F.lit("_0"), E("k") % 3), "comp": F.when(E("k") % 2 == 0, F.concat(F.lit("code_key_"), E("k"))).otherwise(E("kind")), "feat": F.concat(E("kind"), F.when(E("k") % 2 == 0, "_hold").otherwise("_rate"), F.when(E("id") % 2 == 0, "_mean").otherwise("_std"))})
    n = lambda c: F.count(F.when(c, 1))
    return e.groupBy(x.base_name(E("task")).alias("base")).agg(n(x.is_pass(E("task"), 2)).alias("second"), F.count_distinct(x.key_name(E("comp"))).alias("keys"), n(screening.is_pace(E("feat"))).alias("pace"), n(x.matches(E("task"), "e[wr]_0[1-2]")).alias("matched"))


def gap_breaks(spark, d):
    return _r(x.break_on_gaps(events(spark, d), ["v"], DAY), t=4)


def caret_moves(spark, d):
    return _r(x.repositioning(events(spark, d).select("s", (E("k") % 50).alias("sel"), (E("k") % 60).alias("len")), "s"), reposition_pct=6)


def active_kinds(spark, d):
    n = x.active_families(wide(spark, d), {"a": ["f_value", "f_k"], "b": ["f_sparse"], "c": ["f_empty"], "e": ["f_used_count"]})
    return wide(spark, d).groupBy("kind", n.cast("long").alias("active")).agg(F.count(F.lit(1)).alias("n"))


def eligibility_counts(spark, d):
    return x.eligibility_counts(wide(spark, d), {"even": E("f_k") % 2 == 0, "high": E("f_value") > 50}, ["f_sparse", "f_used_count"], "s")


def task_sequences(spark, d):
    t = tasks(spark, d).withColumn("task_index", F.row_number().over(Window.partitionBy("s").orderBy("start"))).where("task_index <= 3")
    return x.task_sequences(t.withColumn("task_type", E("task_type") % 2))


def signed_control(spark, d):
    e = events(spark, d)
    p = e.where("kind = 'purchase'").select(E("id").alias("ev"), "s", "t")
    m = x.signed_shift(p, E("ev") * 7919 % 1000 / 1000.0, E("ev") % 2 == 0, 5 * HOUR, 50 * HOUR)
    g = epochs.epoch_join(m, e.select("s", "t", "v"), E("t") - DAY, E("t") + DAY, 2 * DAY)
    return g.groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def matched_control(spark, d):
    b = events(spark, d).groupBy("s").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return _r(x.matched_control(tasks(spark, d).select("s", "start", "end", "task_type"), b, E("task_type") * 0.17 + 0.05), start=3, end=3)


def decision_latency(spark, d):
    e = events(spark, d).withColumn("task", F.floor(E("t") / DAY))
    starts = e.where("kind = 'view'").groupBy("s", "task").agg(F.min("t").alias("t"))
    return _r(x.decision_latency(e.where("kind = 'purchase'").select("s", "task", "id", "t"), starts, ["s", "task"]).select("s", "id", "latency"), latency=4)


def drag_gap(spark, d):
    e = events(spark, d).withColumn("task", E("k") % 10)
    g = x.paired_gap(e.where("kind = 'signup'"), e.where("kind = 'purchase'"), ["s", "task"])
    return g.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("gap"))


def entry_latency(spark, d):
    e = events(spark, d)
    return _r(x.entry_latency(e.where("kind = 'purchase'").select("s", "id", "t"), e.where("kind = 'click'")).select("s", "id", "latency"), latency=4)


def model_sharing(spark, d):
    return x.sharing(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


def _taps(spark, d):
    return events(spark, d).select("s", "id", (E("k") % 10).alias("key"), (E("v") / 100).alias("px"), (E("k") / 100.0).alias("py"), "kind")


def keypad_offset(spark, d):
    return _r(x.offset_from_key(_taps(spark, d), "key", "px", "s"), offset=6, sd=6)


def target_stats(spark, d):
    return _r(x.target_stats(_taps(spark, d).where("kind = 'click'"), "px", "py", "s"), x_sd=6, y_sd=6, x_med=6, y_med=6, x_offset=6)


def precision(spark, d):
    t = _taps(spark, d)
    return _r(x.precision(x.target_stats(t.where("kind = 'click'"), "px", "py", "s"), x.offset_from_key(t, "key", "px", "s"), "s"), target_sd=6, keypad_sd=6)


def steadiness(spark, d):
    return _r(x.steadiness(events(spark, d), E("kind").isin("view", "click"), 3).select("s", "runs", "median_sd"), median_sd=6)


def jerk(spark, d):
    return _r(x.normalised_jerk(events(spark, d).withColumn("t", E("t") / HOUR), E("kind") != "purchase", 4), jerk=6)


def orienting(spark, d):
    e = events(spark, d)
    return _r(x.orienting_response(e.where("kind = 'purchase'").select("s", E("id").alias("ev"), "t"), e.select("s", "t", "v"), 3 * DAY, 2), response=6)


def orientation_risk(spark, d):
    return x.orientation_risk(events(spark, d).select("s", E("v").alias("beta"), E("k").alias("gamma")), wrap=190.0, singular=98.0)


def _gestures(spark, d):
    g = F.when(E("k") % 3 == 0, "scroll_fling").when(E("k") % 3 == 1, "scroll_drag").otherwise("tap")
    return events(spark, d).select("s", "kind", E("v").alias("path_len_px"), (E("v") * (E("k") % 7) / 7.0).alias("displacement_px"), (E("k") % 6).alias("n_moves"), g.alias("gesture"), E("v").alias("scroll_during_px"), E("k").cast("double").alias("scroll_coast_px"), (E("v") / 20).alias("hold_ms"))


def straightness(spark, d):
    return x.straightness(_gestures(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("straightness"), 6).alias("mean"))


def scroll_morphology(spark, d):
    m = x.scroll_morphology(_gestures(spark, d))
    return m.groupBy("kind").agg(F.round(F.percentile("scroll_total_px", F.lit(0.5)), 6).alias("total"), F.round(F.percentile("scroll_efficiency", F.lit(0.5)), 6).alias("efficiency"))


def axis_shares(spark, d):
    e = events(spark, d)
    p = epochs.epoch_join(e.where("kind = 'purchase'").select("s", "t"), e.select("s", "t", (E("v") - 50).alias("a"), (E("k") - 50).alias("b")), E("t") - DAY, E("t") + DAY, 2 * DAY)
    return _r(x.axis_shares(p.withColumn("rel", E("st") - E("t")), ["a", "b"]), a_share=6, b_share=6)


def _cells(spark, d):
    """Phase bins of the spans from each purchase to the next."""
    e = events(spark, d)
    p = e.where("kind = 'purchase'").withColumn("end", F.lead("t").over(Window.partitionBy("s").orderBy("t", "id"))).where("end is not null")
    return x.phase_bins(p.select(E("id").alias("ev"), "s", E("t").alias("start"), "end"), e.select("s", "t", "v"), ["v"], longest=5 * DAY, width=5 * DAY)


def phase_curve(spark, d):
    return _r(_cells(spark, d), v=6)


def phase_support(spark, d):
    return x.bin_support(_cells(spark, d).withColumn("grp", E("ev") % 2), ["grp"])


def existence_peak(spark, d):
    return _r(x.existence_curve(_cells(spark, d)), mean=6, sem=6)


def curve_shape(spark, d):
    c = _cells(spark, d).withColumn("grp", E("ev") % 3)
    return _r(x.curve_shape(x.existence_curve(c, by=["grp"]), ["grp"]), peak=6, end=6)


def _phases(spark, d):
    return _cells(spark, d).withColumn("phase", (E("bin") + 0.5) * 0.05)


def release_test(spark, d):
    return _r(x.release_test(_phases(spark, d)), mid=6, release=6, coast=6)


def phase_energy(spark, d):
    return _r(x.phase_energy(_phases(spark, d)), energy=6)


def class_dominance(spark, d):
    return _r(x.class_dominance(events(spark, d).withColumn("pid", E("s") % 40), "kind", "pid", "v"), top_share=6, least_mean=6, most_mean=6)


def _keys(spark, d):
    return events(spark, d).select("s", F.floor(E("t") / DAY).alias("task"), F.when(E("kind") == "error", "BACKSPACE").otherwise("LETTER").alias("keyClass"), (E("k") % 8).alias("val_len"), F.when(E("k") % 5 == 0, "True").when(E("k") % 5 == 1, "1.0").otherwise("false").alias("repeat"), F.when(E("k") % 9 == 0, "insertReplacementText").otherwise("insertText").alias("inputType"))


def typing_episodes(spark, d):
    return _r(x.typing_episodes(_keys(spark, d), ["s", "task"]), bs_rate=6, keys_per_char=6)


def autorepeat(spark, d):
    return _r(x.autorepeat(_keys(spark, d), "s"), repeat_pct=6, bs_repeat_pct=6)


def predictive_text(spark, d):
    k = _keys(spark, d)
    return _r(x.predictive_text(x.typing_episodes(k, ["s", "task"]), k, "s"), under_one_pct=6)


def reach(spark, d):
    return _r(x.reach(_taps(spark, d), "px", "py", "s"), x_iqr=6, y_iqr=6, coverage=6)


def vertical_zones(spark, d):
    return _r(x.vertical_zones(_taps(spark, d), "py", "s"), top=6, middle=6, bottom=6)


def viewport(spark, d):
    e = events(spark, d)
    v = e.select("s", F.when(E("k") % 2 == 0, E("v").cast("string")).alias("viewportWidth"), F.when(E("k") % 3 == 0, E("k").cast("string")).alias("viewportHeight"), F.when(E("k") % 5 != 0, (E("v") + 1).cast("string")).otherwise("none").alias("innerWidth"), (E("k") + 7).cast("string").alias("innerHeight"))
    return _r(x.viewport(v, ["s"]), w_med=6, h_med=6)


def _decisions(spark, d):
    return events(spark, d).select("s", (E("s") % 40).alias("pid"), F.floor(E("t") / DAY).alias("task"), "kind", "t", F.when(E("k") % 3 != 0, E("k") % 3 == 1).alias("correct"))


def decision_inventory(spark, d):
    return x.decision_inventory(_decisions(spark, d))


def decision_rate(spark, d):
    e = _decisions(spark, d)
    t = e.select("s", "task").distinct().withColumn("task_type", F.when(E("task") % 2 == 0, "even").otherwise("odd"))
    return x.decision_rate(e, t, {"click": "even", "view": "odd", "purchase": "odd", "error": "none"}, ["s", "task"])


def decision_exposure(spark, d):
    e = _decisions(spark, d)
    return _r(x.decision_exposure(e, e), per_session=6)


def speed_accuracy(spark, d):
    e = _decisions(spark, d).withColumn("latency", E("t") - F.floor(E("t") / DAY) * DAY)
    return _r(x.speed_accuracy(e, ["kind"]), median=4)


def rate_curves(spark, d):
    n = events(spark, d).groupBy("s", F.floor(E("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _r(x.median_curves(n.select("s", (E("s") % 10).alias("pid"), (E("day") + E("s") % 3 * 0.25).alias("t"), E("n").cast("double").alias("v"))), median=6)


def context_change(spark, d):
    e = events(spark, d)
    at = F.struct("t", "id")
    ends = [e.groupBy("s").agg(f(F.struct("kind", "v", "k"), at).alias("q")).select(E("s").alias("pid"), F.lit(r).alias("role"), F.when(E("q.k") % 7 != 0, E("q.kind")).alias("kind"), E("q.v").alias("v")) for r, f in (("enrol", F.min_by), ("probe", F.max_by))]
    return _r(x.context_changes(ends[0].unionByName(ends[1]), ["kind"], ["v"]), v_delta=6)


def quanta(spark, d):
    return x.quanta(events(spark, d), "kind", "k").select("kind", "n", F.array_join(E("least").cast("array<string>"), ",").alias("first_six"))


def dominance(spark, d):
    return _r(screening.dominance(events(spark, d).withColumns({"g": E("s") % 11, "y": E("v") - 50}), "g", "y"), max_share=6, consensus=6)


def equality_share(spark, d):
    e = events(spark, d).withColumns({"a": F.floor(E("v") / 10), "b": F.when(E("k") % 6 != 0, F.floor(E("k") / 10))})
    return _r(screening.equality_share(e, "a", "b", ["kind"]), equal=6)


def principal_components(spark, d):
    """Spread of the first two components, and the shares of variance that they explain."""
    pc, shares_ = screening.principal_components(wide(spark, d), [f for f in FEATURES if f not in ("f_empty", "f_sparse")])
    return pc.agg(F.round(F.var_pop(E("pc")[0]), 4).alias("var0"), F.round(F.var_pop(E("pc")[1]), 4).alias("var1"), F.count(F.lit(1)).alias("n")).withColumns({"share0": F.round(F.lit(shares_[0]), 5), "share1": F.round(F.lit(shares_[1]), 5)})


def screening_decisions(spark, d):
    """All passes of the screen: families left out, thresholds, duplicates among what is kept, duplicates of what was dropped, review."""
    w = wide(spark, d).withColumns({"f_twin_n": E("f_noise") * 3, "f_b": E("f_value") * 4})
    names = [*FEATURES, "f_twin_n", "f_b"]
    diag = screening.diagnose(w, names, ["s", "id"], "s", "kind")
    return screening.decide(diag, ("f_k",)).select("feature", "decision", "decision_reason", "needs_manual_review")


def covered_features(spark, d):
    names = screening.covered(wide(spark, d), 0.5, ("s", "id"))
    return spark.createDataFrame([(n,) for n in names], "feature string")


def core_missing(spark, d):
    w = wide(spark, d).withColumns({"x_afforded": E("id") % 4 != 0, "x_straddle_conflict": F.when(E("id") % 5 != 0, E("id") % 5 == 1)})
    return quality.core_missing(w, {"f_sparse": "x", "f_used_count": "x", "f_value": "x"})


def session_distribution(spark, d):
    return quality.session_distribution(events(spark, d).withColumn("pid", E("s") % 13 * (E("s") % 2)), "pid", "s")


def session_index(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(E("o_orderkey").alias("sessionId"), E("o_custkey").alias("participantId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("startedAtIso"), E("o_totalprice").cast("double").alias("tRelMs"))
    return _r(sessions.session_index(raw).select("sessionId", "participantId", "sessionNo", "gapHours", "lastMs"), gapHours=6)


_CELL = EV + """, sp AS (SELECT id AS ev, s, t AS a, lead(t) OVER (PARTITION BY s ORDER BY t, id) - t AS d FROM ev WHERE kind = 'purchase'), pr AS (SELECT sp.ev, (e.t - a) / d AS ph, e.v, count(*) OVER w AS n, count(*) FILTER (e.t < a) OVER w AS p, avg(e.v) FILTER (e.t < a) OVER w AS b
 FROM sp JOIN ev e ON e.s = sp.s AND e.t >= a - 0.3::DOUBLE * d AND e.t <= a + 1.5::DOUBLE * d WHERE d > 0 AND d <= 432000 WINDOW w AS (PARTITION BY sp.ev)), ce AS (SELECT ev, CAST(floor(ph * 30 / 1.5::DOUBLE) AS INT) AS bin, avg(v - b) AS v FROM pr WHERE n >= 3 AND p >= 2 AND ph >= 0 AND floor(ph * 30 / 1.5::DOUBLE) < 30 GROUP BY ALL)"""
_CURVE = "SELECT {g} bin, count(v) AS n, avg(v) AS mean, stddev_pop(v) / sqrt(count(v)) AS sem FROM ce GROUP BY ALL"
_PH = _CELL + ", pc AS (SELECT ev, v, (bin + 0.5::DOUBLE) * 0.05::DOUBLE AS phase FROM ce)"
_TAP = EV + ", ta AS (SELECT s, id, k % 10 AS key, v / 100 AS px, k / 100.0::DOUBLE AS py, kind FROM ev)"
_TGT = ", tg AS (SELECT s, count(px) AS n, stddev_samp(px) AS x_sd, stddev_samp(py) AS y_sd, quantile_cont(px, 0.5) AS x_med, quantile_cont(py, 0.5) AS y_med FROM ta WHERE kind = 'click' GROUP BY s)"
_OFF = ", of AS (SELECT s, px - quantile_cont(px, 0.5) OVER (PARTITION BY key) AS dx FROM ta), ok AS (SELECT s, quantile_cont(dx, 0.5) AS off, count(dx) AS n, stddev_samp(dx) AS sd FROM of GROUP BY s HAVING count(dx) >= 3)"
_GES = EV + ", ge AS (SELECT s, kind, v AS p, v * (k % 7) / 7.0::DOUBLE AS d, k % 6 AS n, CASE k % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'd' ELSE 't' END AS g, v + k AS tot, v / 20 AS h FROM ev)"
_KEY = EV + ", ke AS (SELECT s, CAST(floor(t / 86400) AS BIGINT) AS task, kind = 'error' AS bs, k % 8 AS len, k % 5 = 0 AS rep, k % 9 = 0 AS repl FROM ev), ep AS (SELECT s, task, count(*) AS n_keys, avg(bs::INT) AS bs_rate, max(len) AS final_len, count(*) / nullif(max(len), 0)::DOUBLE AS kpc FROM ke GROUP BY ALL HAVING count(*) >= 3)"
_DEC = EV + ", de AS (SELECT s, s % 40 AS pid, CAST(floor(t / 86400) AS BIGINT) AS task, kind, t, CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END AS correct FROM ev)"
SQL = {
    "device_filter": EV + " SELECT id, 'Click' AS family FROM ev WHERE kind = 'click'",
    "name_rules": EV + ", n AS (SELECT kind, k, id, kind || '_0' || (k % 3) AS task FROM ev) SELECT kind AS base, count(*) FILTER (k % 3 = 2) AS second, count(DISTINCT CASE WHEN k % 2 = 0 THEN k END) AS keys, count(*) FILTER (k % 2 = 0 AND id % 2 = 0) AS pace, count(*) FILTER (regexp_matches(task, 'e[wr]_0[1-2]')) AS matched FROM n GROUP BY kind",
    "gap_breaks": EV + ", g AS (SELECT s, t, v, lead(t) OVER (PARTITION BY s ORDER BY t, id) AS n FROM ev) SELECT s, round(t, 4) AS t, v FROM g UNION ALL SELECT s, round((t + n) / 2, 4), NULL FROM g WHERE n - t > 86400",
    "caret_moves": EV + ", c AS (SELECT s, (k % 50) / (k % 60)::DOUBLE < 0.99 AS m FROM ev WHERE k % 60 > 0) SELECT s, count(*) AS n, round(100 * avg(m::INT), 6) AS reposition_pct FROM c GROUP BY s",
    "active_kinds": WIDE + ", a AS (SELECT kind, (f_value IS NOT NULL OR f_k IS NOT NULL)::INT + (f_sparse IS NOT NULL)::INT + (f_empty IS NOT NULL)::INT + (f_used_count IS NOT NULL)::INT AS active FROM wd) SELECT kind, active, count(*) AS n FROM a GROUP BY ALL",
    "eligibility_counts": WIDE + " SELECT s, count(*) AS n_windows, count(*) FILTER (f_k::BIGINT % 2 = 0) AS even_eligible, count(*) FILTER (f_value > 50) AS high_eligible, count(f_sparse) AS f_sparse_populated, count(f_used_count) AS f_used_count_populated FROM wd GROUP BY s",
    "task_sequences": TASKS + ", r AS (SELECT s, task_type % 2 AS tt, row_number() OVER (PARTITION BY s ORDER BY start) AS i FROM tk), q AS (SELECT s, string_agg(tt::VARCHAR, '>' ORDER BY i) AS sequence, count(*) AS length FROM r WHERE i <= 3 GROUP BY s) SELECT sequence, length, count(*) AS sessions FROM q GROUP BY ALL",
    "signed_control": EV + ", a AS (SELECT id AS ev, s, t + CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * (18000 + (id * 7919 % 1000) / 1000.0::DOUBLE * 162000) AS t FROM ev WHERE kind = 'purchase') SELECT a.ev, count(*) AS n, round(avg(v), 6) AS mean FROM a JOIN ev e ON a.s = e.s AND e.t >= a.t - 86400 AND e.t < a.t + 86400 GROUP BY a.ev",
    "matched_control": TASKS + """, b AS (SELECT s, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY s), m AS (SELECT tk.s, task_type, "end" - start AS d, t0 + 0.3::DOUBLE * ("end" - start) AS lo, t1 - 1.5::DOUBLE * ("end" - start) AS hi FROM tk JOIN b ON tk.s = b.s) SELECT s, task_type, round(lo + (task_type * 0.17::DOUBLE + 0.05::DOUBLE) * (hi - lo), 3) AS start, round(lo + (task_type * 0.17::DOUBLE + 0.05::DOUBLE) * (hi - lo) + d, 3) AS "end" FROM m WHERE hi > lo""",
    "decision_latency": EV + ", d AS (SELECT *, floor(t / 86400) AS task FROM ev), b AS (SELECT s, task, min(t) AS t0 FROM d WHERE kind = 'view' GROUP BY ALL) SELECT d.s, d.id, round(CASE WHEN t0 IS NULL THEN 0 ELSE greatest(t - t0, 0) END, 4) AS latency FROM d LEFT JOIN b ON d.s = b.s AND d.task = b.task WHERE kind = 'purchase'",
    "drag_gap": EV + " SELECT a.s, count(*) AS n, round(avg(b.t - a.t), 4) AS gap FROM ev a JOIN ev b ON a.s = b.s AND a.k % 10 = b.k % 10 WHERE a.kind = 'signup' AND b.kind = 'purchase' AND b.t >= a.t GROUP BY a.s",
    "entry_latency": EV + " SELECT s, id, round((SELECT min(c.t) FROM ev c WHERE c.s = ev.s AND c.kind = 'click' AND c.t >= ev.t) - t, 4) AS latency FROM ev WHERE kind = 'purchase'",
    "model_sharing": "WITH o AS (SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS sharing, count(*) OVER (PARTITION BY o_orderpriority) = 1 AS singleton FROM o",
    "keypad_offset": _TAP + _OFF + ' SELECT s, round(off, 6) AS "offset", n, round(sd, 6) AS sd FROM ok',
    "target_stats": _TAP + _TGT + " SELECT s, n, round(x_sd, 6) AS x_sd, round(y_sd, 6) AS y_sd, round(x_med, 6) AS x_med, round(y_med, 6) AS y_med, round(x_med - (SELECT quantile_cont(x_med, 0.5) FROM tg), 6) AS x_offset FROM tg",
    "precision": _TAP + _TGT + _OFF + " SELECT tg.s, round(x_sd, 6) AS target_sd, round(sd, 6) AS keypad_sd FROM tg JOIN ok ON tg.s = ok.s WHERE x_sd IS NOT NULL AND sd IS NOT NULL",
    "steadiness": EV + ", f AS (SELECT *, kind IN ('view', 'click') AS f FROM ev), g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, id) - row_number() OVER (PARTITION BY s, f ORDER BY t, id) AS g FROM f), r AS (SELECT s, stddev_pop(v) AS sd FROM g WHERE f GROUP BY s, g HAVING count(*) >= 3) SELECT s, count(*) AS runs, round(quantile_cont(sd, 0.5), 6) AS median_sd FROM r GROUP BY s",
    "jerk": EV + ", f AS (SELECT s, id, t / 3600 AS t, v, kind <> 'purchase' AS f FROM ev), g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, id) - row_number() OVER (PARTITION BY s, f ORDER BY t, id) AS g FROM f), h AS (SELECT s, g, v, t - lag(t) OVER w AS dt, v - lag(v) OVER w AS dv FROM g WHERE f WINDOW w AS (PARTITION BY s, g ORDER BY t, id)), r AS (SELECT s, sqrt(avg(CASE WHEN dt > 0 THEN (dv / dt) * (dv / dt) END)) AS j, sqrt(avg(v * v)) AS m FROM h GROUP BY s, g HAVING count(*) >= 4) SELECT s, round(quantile_cont(j / m, 0.5), 6) AS jerk, count(*) AS runs FROM r WHERE m > 0 AND j IS NOT NULL GROUP BY s",
    "orienting": EV + ", p AS (SELECT a.s, a.id, sqrt(avg(e.v * e.v) FILTER (e.t < a.t)) AS a, sqrt(avg(e.v * e.v) FILTER (e.t >= a.t)) AS b FROM ev a JOIN ev e ON a.s = e.s AND e.t >= a.t - 259200 AND e.t < a.t + 259200 WHERE a.kind = 'purchase' GROUP BY ALL HAVING count(*) FILTER (e.t < a.t) >= 2 AND count(*) FILTER (e.t >= a.t) >= 2) SELECT s, round(quantile_cont(b / a, 0.5), 6) AS response, count(*) AS starts FROM p WHERE a > 0 GROUP BY s",
    "orientation_risk": EV + ", g AS (SELECT s, min(v) AS beta_min, max(v) AS beta_max, min(k) AS gamma_min, max(k) AS gamma_max FROM ev GROUP BY s) SELECT *, beta_min < -190 OR beta_max > 190 AS wrap_risk, gamma_min < -98 OR gamma_max > 98 AS singularity_risk FROM g WHERE beta_min < -190 OR beta_max > 190 OR gamma_min < -98 OR gamma_max > 98",
    "straightness": _GES + " SELECT kind, count(*) AS n, round(avg(d / p), 6) AS mean FROM ge WHERE p > 0 AND d > 0 AND n >= 3 GROUP BY kind",
    "scroll_morphology": _GES + " SELECT kind, round(quantile_cont(tot, 0.5), 6) AS total, round(quantile_cont(tot / greatest(h, 1), 0.5), 6) AS efficiency FROM ge WHERE g <> 't' GROUP BY kind",
    "axis_shares": EV + ", p AS (SELECT avg(abs(e.v - 50)) AS a, avg(abs(e.k - 50)) AS b FROM ev c JOIN ev e ON c.s = e.s AND e.t >= c.t AND e.t < c.t + 86400 WHERE c.kind = 'purchase') SELECT round(a / (a + b), 6) AS a_share, round(b / (a + b), 6) AS b_share FROM p",
    "phase_curve": _CELL + " SELECT ev, bin, round(v, 6) AS v FROM ce",
    "phase_support": _CELL + " SELECT ev % 2 AS grp, bin, count(v) AS n, count(v) < 10 AS thin FROM ce GROUP BY ALL",
    "existence_peak": _CELL + ", cu AS (" + _CURVE.format(g="") + ") SELECT bin, n, round(mean, 6) AS mean, round(sem, 6) AS sem, (SELECT bin FROM cu ORDER BY mean DESC, bin LIMIT 1) AS peak_bin FROM cu",
    "curve_shape": _CELL + ", cu AS (" + _CURVE.format(g="ev % 3 AS grp,") + "), p AS (SELECT * FROM cu QUALIFY row_number() OVER (PARTITION BY grp ORDER BY abs(mean) DESC, bin) = 1), l AS (SELECT * FROM cu QUALIFY row_number() OVER (PARTITION BY grp ORDER BY bin DESC) = 1) SELECT p.grp, round(p.mean, 6) AS peak, p.bin AS peak_bin, round(l.mean, 6) AS \"end\", CASE WHEN abs(p.mean) > 1e-9 THEN abs(l.mean) < 0.5 * abs(p.mean) END AS decays FROM p JOIN l ON p.grp = l.grp",
    "release_test": _PH + ", r AS (SELECT avg(v) FILTER (phase >= 0.3 AND phase <= 0.7) AS mid, avg(v) FILTER (phase >= 0.9 AND phase <= 1.1) AS release, avg(v) FILTER (phase >= 1.3 AND phase <= 1.5) AS coast FROM pc) SELECT round(mid, 6) AS mid, round(release, 6) AS release, round(coast, 6) AS coast, release > mid * 1.15 AND release > coast * 1.15 AS stands_out FROM r",
    "phase_energy": _PH + " SELECT ev, round(avg(v) FILTER (phase >= 0 AND phase <= 1), 6) AS energy FROM pc GROUP BY ev",
    "class_dominance": EV + ", p AS (SELECT kind, s % 40 AS pid, count(*) AS n, avg(v) AS m FROM ev GROUP BY ALL) SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS participants, round(max(n) / sum(n), 6) AS top_share, round(min(m), 6) AS least_mean, round(max(m), 6) AS most_mean, max(n) / sum(n) > 0.4 AS dominated FROM p GROUP BY kind",
    "typing_episodes": _KEY + " SELECT s, task, n_keys, round(bs_rate, 6) AS bs_rate, final_len, round(kpc, 6) AS keys_per_char FROM ep",
    "autorepeat": _KEY + " SELECT s, count(*) AS n_keys, count(*) FILTER (bs) AS n_backspace, round(100 * avg(rep::INT), 6) AS repeat_pct, round(100 * avg(rep::INT) FILTER (bs), 6) AS bs_repeat_pct FROM ke GROUP BY s",
    "predictive_text": _KEY + ", r AS (SELECT s, count(*) AS r FROM ke WHERE repl GROUP BY s) SELECT ep.s, count(*) AS episodes, count(*) FILTER (kpc < 1) AS under_one, coalesce(any_value(r), 0) AS replacements, round(100.0::DOUBLE * count(*) FILTER (kpc < 1) / count(*), 6) AS under_one_pct FROM ep LEFT JOIN r ON ep.s = r.s GROUP BY ep.s",
    "reach": _TAP + ", c AS (SELECT *, (least(greatest(trunc(px * 8), 0), 7), least(greatest(trunc(py * 8), 0), 7)) AS c FROM ta) SELECT s, count(*) AS n, round(quantile_cont(px, 0.75) - quantile_cont(px, 0.25), 6) AS x_iqr, round(quantile_cont(py, 0.75) - quantile_cont(py, 0.25), 6) AS y_iqr, count(DISTINCT c) AS cells, round(count(DISTINCT c) / 64.0, 6) AS coverage FROM c GROUP BY s",
    "vertical_zones": _TAP + ' SELECT s, count(*) AS n, round(avg((py >= 0 AND py < 0.33::DOUBLE)::INT), 6) AS top, round(avg((py >= 0.33::DOUBLE AND py < 0.66::DOUBLE)::INT), 6) AS middle, round(avg((py >= 0.66::DOUBLE AND py < 1.01::DOUBLE)::INT), 6) AS bottom FROM ta GROUP BY s',
    "viewport": EV + ", z AS (SELECT s, CASE WHEN k % 2 = 0 THEN v WHEN k % 5 <> 0 THEN v + 1 END AS w, CASE WHEN k % 3 = 0 THEN k ELSE k + 7 END::DOUBLE AS h FROM ev), g AS (SELECT s, quantile_cont(w, 0.5) AS w_med, quantile_cont(h, 0.5) AS h_med, min(h) AS h_min, max(h) AS h_max, count(*) AS n FROM z WHERE w IS NOT NULL GROUP BY s) SELECT s, round(w_med, 6) AS w_med, round(h_med, 6) AS h_med, h_min, h_max, n, h_max - h_min AS h_range, round(h_med / nullif(w_med, 0), 3) AS aspect FROM g",
    "decision_inventory": _DEC + " SELECT kind, count(*) AS n_events, count(DISTINCT s) AS n_sessions, count(DISTINCT pid) AS n_participants, round((1 - avg(correct::INT)) * 100, 1) AS error_pct FROM de GROUP BY kind",
    "decision_rate": _DEC + ", t AS (SELECT DISTINCT s, task, CASE WHEN task % 2 = 0 THEN 'even' ELSE 'odd' END AS task_type FROM de), n AS (SELECT task_type, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT unnest(['click', 'view', 'purchase', 'error']) AS kind, unnest(['even', 'odd', 'odd', 'none']) AS task_type), f AS (SELECT kind, count(*) AS f FROM (SELECT DISTINCT m.kind, t.s, t.task FROM de JOIN m ON de.kind = m.kind JOIN t ON t.s = de.s AND t.task = de.task AND t.task_type = m.task_type) GROUP BY kind) SELECT m.kind, m.task_type, coalesce(n, 0) AS instances, round(100.0::DOUBLE * coalesce(f, 0) / n, 1) AS fired_pct FROM m LEFT JOIN n ON m.task_type = n.task_type LEFT JOIN f ON m.kind = f.kind",
    "decision_exposure": _DEC + ", n AS (SELECT pid, count(DISTINCT s) AS sessions FROM de GROUP BY pid) SELECT de.pid, kind, count(*) AS n, any_value(sessions) AS sessions, round(count(*) / any_value(sessions), 6) AS per_session FROM de JOIN n ON de.pid = n.pid GROUP BY de.pid, kind",
    "speed_accuracy": _DEC + " SELECT kind, correct, count(*) AS n, round(quantile_cont(t - task * 86400, 0.5), 4) AS median FROM de WHERE correct IS NOT NULL GROUP BY ALL",
    "rate_curves": EV + ", c AS (SELECT s, floor(t / 86400) + s % 3 * 0.25::DOUBLE AS t, count(*)::DOUBLE AS v FROM ev GROUP BY s, floor(t / 86400)), n AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY s ORDER BY t)), g AS (SELECT s % 10 AS pid, unnest(range(CAST(ceil(t / 0.5) AS BIGINT), CAST(CASE WHEN t1 IS NULL THEN floor(t / 0.5) + 1 ELSE ceil(t1 / 0.5) END AS BIGINT))) AS g, t, v, t1, v1 FROM n) SELECT pid, g, round(quantile_cont(CASE WHEN g * 0.5::DOUBLE = t THEN v ELSE v + (v1 - v) * (g * 0.5::DOUBLE - t) / (t1 - t) END, 0.5), 6) AS median, count(*) AS n FROM g GROUP BY pid, g",
    "context_change": EV + ", q AS (SELECT s, CASE WHEN k % 7 <> 0 THEN kind END AS kind, v, t, id FROM ev), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY s ORDER BY t, id) = 1), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC, id DESC) = 1) SELECT f.s AS pid, f.kind <> l.kind AS kind_changed, round(l.v - f.v, 6) AS v_delta FROM f JOIN l ON f.s = l.s",
    "quanta": EV + ", q AS (SELECT DISTINCT kind, k FROM ev WHERE k IS NOT NULL) SELECT kind, count(*) AS n, array_to_string(list_sort(list(k))[1:6], ',') AS first_six FROM q GROUP BY kind",
    "dominance": EV + ", p AS (SELECT s % 11 AS g, count(*) AS n, avg(v - 50) AS m FROM ev GROUP BY ALL), q AS (SELECT max(n) / sum(n) AS a, greatest(count(*) FILTER (m > 0), count(*) - count(*) FILTER (m > 0)) / count(*)::DOUBLE AS c, count(*) AS groups FROM p) SELECT round(a, 6) AS max_share, round(c, 6) AS consensus, groups, CASE WHEN a < 0.5 AND c >= 0.8 THEN 'trustworthy' ELSE 'needs_scrutiny' END AS verdict FROM q",
    "equality_share": EV + " SELECT kind, count(*) AS n, round(avg((floor(v / 10) = floor(k / 10.0::DOUBLE))::INT), 6) AS equal FROM ev WHERE k % 6 <> 0 GROUP BY kind",
    "covered_features": WIDE + " SELECT feature FROM lg GROUP BY feature HAVING avg((value IS NOT NULL)::INT) >= 0.5",
    "core_missing": WIDE + ", w AS (SELECT * FROM wd WHERE id % 4 <> 0 AND NOT coalesce(CASE WHEN id % 5 <> 0 THEN id % 5 = 1 END, false)), m AS (SELECT 'f_sparse' AS c, f_sparse AS x FROM w UNION ALL SELECT 'f_used_count', f_used_count FROM w UNION ALL SELECT 'f_value', f_value FROM w) SELECT 'core_missing_' || c AS \"check\", round(avg((x IS NULL)::INT), 6) AS value, CASE WHEN avg((x IS NULL)::INT) > 0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM m GROUP BY c",
    "session_distribution": EV + ", p AS (SELECT s % 13 * (s % 2) AS pid, count(DISTINCT s) AS n FROM ev GROUP BY ALL) SELECT 'sessions_' || n AS \"check\", count(*)::DOUBLE AS value, 'INFO' AS status FROM p GROUP BY n",
    "session_index": "WITH o AS (SELECT o_orderkey AS sessionId, o_custkey AS participantId, o_orderdate::TIMESTAMP AS st, o_totalprice::DOUBLE AS lastMs FROM orders) SELECT sessionId, participantId, row_number() OVER w AS sessionNo, round((epoch_us(st) - lag(epoch_us(st)) OVER w) / 3.6e9::DOUBLE, 6) AS gapHours, lastMs FROM o WINDOW w AS (PARTITION BY participantId ORDER BY st, sessionId)",
}
ROWS_ONLY = ("principal_components", "screening_decisions")


def queries() -> dict:
    return {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
