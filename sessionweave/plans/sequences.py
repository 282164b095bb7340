"""Queries over the events table: windows, joins in time, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import nine_stats, share
from ..operators import sequence as q
from ..operators import windows as w
from .base import DAY, EV, GRID, HOUR, TASKS, events, nine_sql, tasks

L, S = 2 * DAY, DAY


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def flatten_payload(spark, d):
    return events(spark, d).select("s", "id", F.round("t", 6).alias("t"), "kind", "v", "k")


def window_grid(spark, d):
    return r6(w.window_grid(events(spark, d), length=L, stride=S), "window_start", "window_end")


def window_event_counts(spark, d):
    e = w.assign_windows(events(spark, d), length=L, stride=S)
    return e.groupBy("s", "window_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.max("kind").alias("last_kind"))


def window_nine_stats(spark, d):
    e = w.assign_windows(events(spark, d), length=L, stride=S)
    out = e.groupBy("s", "window_index").agg(*nine_stats(F.col("v"), F.col("t") - F.col("window_start"), "value"))
    return r6(out.withColumn("value_slope", F.round(F.col("value_slope") * DAY, 4)), "value_mean", "value_std", "value_cv", "value_median", "value_iqr", "value_p95")


def observed_flags(spark, d):
    flags = {f"has_{k}": F.col("kind") == k for k in ("click", "purchase", "error")}
    return w.observed_flags(events(spark, d), flags, length=L, stride=S).drop("window_start", "window_end")


def asof_context(spark, d):
    out = q.as_of(events(spark, d), tasks(spark, d), ["task_type", "afforded"], clear=["task_type", "afforded"])
    return r6(out.select("s", "id", "task_type", "afforded", F.col("start").alias("task_start"), F.col("end").alias("task_end")), "task_start", "task_end")


def interval_overlap(spark, d):
    g = w.window_grid(events(spark, d), length=L, stride=S)
    return w.overlapping(tasks(spark, d), g, stride=S).groupBy("s", "window_index").agg(F.count(F.lit(1)).alias("n_tasks"), F.min("task_type").alias("least_type"))


def straddle_conflict(spark, d):
    g = w.window_grid(events(spark, d), length=L, stride=S)
    return w.straddle_conflicts(tasks(spark, d), g, ["afforded"], stride=S).select("s", "window_index", F.coalesce("n_overlapping", F.lit(0)).alias("n_overlapping"), "afforded_conflict")


def affordance_frac(spark, d):
    """Share of tasks of each type with a click in [start, end): the next click at or after the start decides."""
    starts = tasks(spark, d).withColumn("id", F.monotonically_increasing_id())
    both = events(spark, d).where("kind = 'click'").select("s", "t", F.lit("click").alias("kind")).unionByName(starts.withColumns({"t": F.col("start"), "kind": F.lit("task")}).drop("start", "id"), allowMissingColumns=True)
    n = q.next_time(both, F.col("kind") == "click", inclusive=True).where("kind = 'task'")
    hit = F.coalesce(F.col("next_t") < F.col("end"), F.lit(False))
    return n.groupBy("task_type").agg(F.round(share(hit), 6).alias("frac"), F.count(F.lit(1)).alias("n_instances"), (share(hit) >= 0.05).alias("affords"))


def pair_greedy(spark, d):
    """Clicks take the views and signups after them; a signup takes its click but gives no pair."""
    e = events(spark, d)
    p = q.pair_greedy(e, F.col("kind") == "click", F.col("kind").isin("view", "signup"), F.col("kind") == "signup")
    return p.select("s", "id", F.round(F.col("up_t") - F.col("t"), 6).alias("hold"))


def next_event_latency(spark, d):
    e = q.next_time(events(spark, d), F.col("kind") == "purchase")
    return e.where("kind = 'view'").select("s", "id", F.round(F.col("next_t") - F.col("t"), 6).alias("latency"))


def nearest_idle_mask(spark, d):
    e = q.idle(events(spark, d), F.col("kind") == "error", DAY)
    return e.where("kind <> 'error'").select("s", "id", F.round("prev_gap", 6).alias("prev_gap"), F.round("next_gap", 6).alias("next_gap"), "is_idle")


def transitions(spark, d):
    return q.transitions(events(spark, d), "kind", 12 * HOUR).select("s", "id", F.round("dt", 6).alias("dt"), "transition")


def transition_matrix(spark, d):
    e = q.transitions(events(spark, d), "kind", 12 * HOUR)
    return e.groupBy("transition").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("dt", F.lit(0.5)), 4).alias("median_dt"))


def runs_islands(spark, d):
    return q.runs(events(spark, d), "kind", "click").select("s", F.round("t", 6).alias("t"), "run_length", F.round("t_end", 6).alias("t_end"))


def bursts(spark, d):
    return r6(q.bursts(events(spark, d), 6 * HOUR), "burst_start", "duration", "start_gap")


def longest_run(spark, d):
    e = w.assign_windows(events(spark, d).withColumn("cheap", F.col("v") < 40), length=L, stride=S)
    return q.longest_run(e, "cheap", ["s", "window_index"])


def silence_stats(spark, d):
    return r6(q.silence_stats(events(spark, d), 12 * HOUR), "idle_pct", "silences_per_min", "longest_silence")


def cv_cv2(spark, d):
    return r6(q.rhythm(events(spark, d)), "cv", "cv2")


def mode_switches(spark, d):
    return q.mode_switches(events(spark, d), "kind", 6 * HOUR)


def rolling_median_fixed(spark, d):
    return q.rolling(events(spark, d), "v", 9, least=4, how="median").select("s", "id", F.round("rolled", 6).alias("rolled"))


def rolling_mean_gated(spark, d):
    return q.rolling(events(spark, d), "v", 5).select("s", "id", F.round("rolled", 6).alias("rolled"))


def rolling_corr_fixed(spark, d):
    return q.rolling_corr(events(spark, d).withColumn("kd", F.col("k").cast("double")), "v", "kd", 12, least=6).select("s", "id", F.round("rolled", 5).alias("rolled"))


def circular_mean(spark, d):
    from ..functions.stats import circular_encode
    from ..functions.stats import circular_mean as mean

    sin, cos = circular_encode(F.col("k") * 3.6)
    e = events(spark, d).select("s", sin.alias("sn"), cos.alias("cs"))
    return e.groupBy("s").agg(F.round(mean(F.col("sn"), F.col("cs")), 3).alias("mean_deg"), F.count(F.lit(1)).alias("n"))


def phase_unwrap(spark, d):
    e = events(spark, d).withColumn("deg", (F.col("k") * 7 % 360).cast("double"))
    return q.unwrap_degrees(e, "deg").select("s", "id", "unwrapped")


def rate_windows(spark, d):
    return w.windowed_rate(events(spark, d), length=L, stride=S).select("s", "window_index", F.round(F.col("rate") * DAY, 6).alias("per_day"))


def drift_quartiles(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("t1", F.max("t").over(Window.partitionBy("s")))
    e = e.withColumn("quarter", F.floor(F.col("t") * 4 / F.col("t1")).cast("int")).where("t1 > 0 and quarter < 4")
    per = e.groupBy("s", "quarter").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    wide = per.groupBy("s").agg(F.sum("n").alias("n"), F.min("n").alias("least"), *(F.max(F.when(F.col("quarter") == i, F.col("mean"))).alias(f"q{i + 1}") for i in range(4)))
    return wide.where("n >= 40 and least >= 8").select("s", *(F.round(f"q{i}", 6).alias(f"q{i}") for i in range(1, 5)), F.round(F.col("q4") - F.col("q1"), 6).alias("drift"))


def detection(spark, d):
    from pyspark.sql import Window

    e = q.rolling(events(spark, d), "v", 5).withColumn("half", F.max("t").over(Window.partitionBy("s")) / 2)
    calib = e.where(F.col("t") < F.col("half")).groupBy("s").agg((F.avg("rolled") + 0.5 * F.stddev_pop("rolled")).alias("threshold"))
    return q.detect(e.join(calib, "s"), F.col("threshold"), F.col("half"), bar=3, value="rolled").select("s", F.round("detected_at", 6).alias("detected_at"), "most_consecutive")


def inferred_end(spark, d):
    from pyspark.sql import Window

    e = events(spark, d)
    last = e.groupBy("s").agg(F.max("t").alias("t1"))
    p = e.where("kind = 'purchase'")
    wd = Window.partitionBy("s").orderBy("t", "id")
    out = p.withColumn("lead", F.lead("t").over(wd)).join(last, "s")
    return out.select("s", "id", F.round("t", 6).alias("start"), F.round(F.coalesce("lead", "t1"), 6).alias("end"), F.row_number().over(wd).alias("task_pass"))


def isolation_class(spark, d):
    e = q.intervals_between(events(spark, d))
    gap = F.coalesce("dt", F.lit(float("inf")))
    return e.groupBy(F.when(gap >= 12 * HOUR, "isolated").when(gap < 3 * HOUR, "clustered").otherwise("between").alias("isolation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


_AVG = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"
_BETWEEN = "d AS (SELECT *, t - lag(t) OVER (PARTITION BY s ORDER BY t, id) AS dt FROM ev)"

SQL = {
    "flatten_payload": EV + " SELECT s, id, round(t, 6) AS t, kind, v, k FROM ev",
    "window_grid": EV + ", " + GRID + " SELECT s, window_index, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end FROM g",
    "window_event_counts": EV + ", " + GRID + " SELECT s, window_index, count(*) AS n, round(sum(v), 4) AS total, max(kind) AS last_kind FROM g JOIN ev USING (s) WHERE t >= window_start AND t < window_end GROUP BY ALL",
    "window_nine_stats": EV + ", " + GRID + ", x AS (SELECT s, window_index, v, t - window_start AS rel FROM g JOIN ev USING (s) WHERE t >= window_start AND t < window_end) SELECT s, window_index, " + nine_sql("v", "rel", "value") + " FROM x GROUP BY s, window_index",
    "observed_flags": EV + ", " + GRID + " SELECT s, window_index, " + ", ".join(f"EXISTS (SELECT 1 FROM ev e WHERE e.s = g.s AND e.kind = '{k}' AND e.t >= window_start AND e.t < window_end) AS has_{k}" for k in ("click", "purchase", "error")) + " FROM g",
    "asof_context": TASKS + ' SELECT ev.s, id, CASE WHEN NOT coalesce(t > "end", false) THEN task_type END AS task_type, CASE WHEN NOT coalesce(t > "end", false) THEN afforded END AS afforded, round(start, 6) AS task_start, round("end", 6) AS task_end FROM ev ASOF LEFT JOIN tk ON ev.s = tk.s AND ev.t >= tk.start',
    "interval_overlap": TASKS + ", " + GRID + ' SELECT s, window_index, count(*) AS n_tasks, min(task_type) AS least_type FROM g JOIN tk USING (s) WHERE start < window_end AND "end" > window_start GROUP BY ALL',
    "straddle_conflict": TASKS + ", " + GRID + ' SELECT g.s, window_index, count(tk.s) AS n_overlapping, CASE WHEN count(tk.s) > 0 THEN coalesce(max(afforded::INT) <> min(afforded::INT), false) END AS afforded_conflict FROM g LEFT JOIN tk ON g.s = tk.s AND start < window_end AND "end" > window_start GROUP BY ALL',
    "affordance_frac": TASKS + """, h AS (SELECT task_type, EXISTS (SELECT 1 FROM ev WHERE ev.s = tk.s AND kind = 'click' AND t >= start AND t < "end") AS hit FROM tk) SELECT task_type, round(avg(hit::INT), 6) AS frac, count(*) AS n_instances, avg(hit::INT) >= 0.05 AS affords FROM h GROUP BY task_type""",
    "pair_greedy": EV + """, u AS (SELECT s, t, id, kind, row_number() OVER (PARTITION BY s ORDER BY t, id) - 1 AS o FROM ev WHERE kind IN ('view', 'signup')),
 d AS (SELECT s, t, id, row_number() OVER (PARTITION BY s ORDER BY t, id) - 1 AS i, (SELECT count(*) FROM u WHERE u.s = ev.s AND u.t < ev.t) AS f FROM ev WHERE kind = 'click'),
 m AS (SELECT *, i + max(f - i) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM d) SELECT m.s, m.id, round(u.t - m.t, 6) AS hold FROM m JOIN u ON u.s = m.s AND u.o = m.m WHERE u.kind <> 'signup'""",
    "next_event_latency": EV + " SELECT s, id, round((SELECT min(p.t) FROM ev p WHERE p.s = ev.s AND p.kind = 'purchase' AND p.t > ev.t) - t, 6) AS latency FROM ev WHERE kind = 'view'",
    "nearest_idle_mask": EV + ", n AS (SELECT s, id, t - (SELECT max(p.t) FROM ev p WHERE p.s = ev.s AND p.kind = 'error' AND p.t < ev.t) AS a, (SELECT min(p.t) FROM ev p WHERE p.s = ev.s AND p.kind = 'error' AND p.t >= ev.t) - t AS b FROM ev WHERE kind <> 'error') SELECT s, id, round(a, 6) AS prev_gap, round(b, 6) AS next_gap, coalesce(a >= 86400, true) AND coalesce(b >= 86400, true) AS is_idle FROM n",
    "transitions": EV + ", x AS (SELECT s, id, t - lag(t) OVER o AS dt, lag(kind) OVER o || '->' || kind AS transition FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id)) SELECT s, id, round(dt, 6) AS dt, transition FROM x WHERE dt <= 43200",
    "transition_matrix": EV + ", x AS (SELECT t - lag(t) OVER o AS dt, lag(kind) OVER o || '->' || kind AS transition FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id)) SELECT transition, count(*) AS n, round(quantile_cont(dt, 0.5), 4) AS median_dt FROM x WHERE dt <= 43200 GROUP BY transition",
    "runs_islands": EV + ", x AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, id) - row_number() OVER (PARTITION BY s, kind ORDER BY t, id) AS g FROM ev) SELECT s, round(min(t), 6) AS t, count(*) AS run_length, round(max(t), 6) AS t_end FROM x WHERE kind = 'click' GROUP BY s, g",
    "bursts": EV + ", " + _BETWEEN + ", x AS (SELECT *, sum((coalesce(dt, 0) > 21600)::INT) OVER (PARTITION BY s ORDER BY t, id) AS g FROM d), b AS (SELECT s, min(t) AS a, count(*) AS size, max(t) - min(t) AS duration FROM x GROUP BY s, g) SELECT s, round(a, 6) AS burst_start, size, round(duration, 6) AS duration, round(a - lag(a) OVER (PARTITION BY s ORDER BY a), 6) AS start_gap FROM b",
    "longest_run": EV + ", " + GRID + ", x AS (SELECT s, window_index, t, id, v < 40 AS f FROM g JOIN ev USING (s) WHERE t >= window_start AND t < window_end), y AS (SELECT *, row_number() OVER (PARTITION BY s, window_index ORDER BY t, id) - row_number() OVER (PARTITION BY s, window_index, f ORDER BY t, id) AS r FROM x), z AS (SELECT s, window_index, f, r, sum(f::INT) AS n FROM y GROUP BY ALL) SELECT s, window_index, max(n) AS longest_run FROM z GROUP BY ALL",
    "silence_stats": EV + ", " + _BETWEEN + " SELECT s, count(*) FILTER (dt >= 43200) AS n_silences, round(coalesce(sum(dt) FILTER (dt >= 43200), 0) * 100 / nullif(max(t) - min(t), 0), 6) AS idle_pct, round(count(*) FILTER (dt >= 43200) * 60 / nullif(max(t) - min(t), 0), 6) AS silences_per_min, round(max(dt) FILTER (dt >= 43200), 6) AS longest_silence FROM d GROUP BY s",
    "cv_cv2": EV + ", " + _BETWEEN + ", x AS (SELECT *, lag(dt) OVER (PARTITION BY s ORDER BY t, id) AS p FROM d) SELECT s, count(dt) AS n_intervals, round(CASE WHEN count(dt) > 5 AND avg(dt) > 0 THEN stddev_pop(dt) / avg(dt) END, 6) AS cv, round(CASE WHEN count(dt) >= 6 THEN avg(CASE WHEN dt + p > 0 THEN 2 * abs(dt - p) / (dt + p) END) END, 6) AS cv2 FROM x GROUP BY s",
    "mode_switches": EV + ", x AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, id) - row_number() OVER (PARTITION BY s, kind ORDER BY t, id) AS g FROM ev), r AS (SELECT s, count(*) AS n, max(t) - min(t) AS span FROM x GROUP BY s, kind, g) SELECT s, CASE WHEN sum(n) >= 5 THEN count(*) - 1 ELSE 0 END AS raw_switches, CASE WHEN sum(n) >= 5 THEN greatest(count(*) FILTER (span >= 21600) - 1, 0) ELSE 0 END AS real_switches FROM r GROUP BY s",
    "rolling_median_fixed": EV + " SELECT s, id, round(CASE WHEN count(v) OVER o >= 4 THEN quantile_cont(v, 0.5) OVER o END, 6) AS rolled FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id ROWS 8 PRECEDING)",
    "rolling_mean_gated": EV + " SELECT s, id, round(CASE WHEN count(v) OVER o >= 5 THEN avg(v) OVER o END, 6) AS rolled FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id ROWS 4 PRECEDING)",
    "rolling_corr_fixed": EV + ", x AS (SELECT s, id, t, v - lag(v) OVER o AS a, (k - lag(k) OVER o)::DOUBLE AS b FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id)) SELECT s, id, round(CASE WHEN count(a) OVER f >= 6 THEN corr(a, b) OVER f END, 5) AS rolled FROM x WINDOW f AS (PARTITION BY s ORDER BY t, id ROWS 11 PRECEDING)",
    "circular_mean": EV + " SELECT s, round((degrees(atan2(avg(sin(radians(k * 3.6::DOUBLE))), avg(cos(radians(k * 3.6::DOUBLE))))) + 360) % 360, 3) AS mean_deg, count(*) AS n FROM ev GROUP BY s",
    "phase_unwrap": EV + ", x AS (SELECT s, id, t, (k * 7 % 360)::DOUBLE AS deg, (k * 7 % 360)::DOUBLE - lag((k * 7 % 360)::DOUBLE) OVER (PARTITION BY s ORDER BY t, id) AS dd FROM ev), y AS (SELECT *, CASE WHEN abs(dd) <= 180 THEN 0 ELSE -360 * round(dd / 360) END AS c FROM x) SELECT s, id, deg + sum(coalesce(c, 0)) OVER (PARTITION BY s ORDER BY t, id) AS unwrapped FROM y",
    "rate_windows": EV + ", n AS (SELECT s, CAST(floor(max(t) / 86400) AS BIGINT) AS n FROM ev GROUP BY s), g AS (SELECT s, unnest(range(0, n + 1)) AS window_index FROM n) SELECT s, window_index, round(count(*) / 172800.0 * 86400, 6) AS per_day FROM g JOIN ev USING (s) WHERE t >= window_index * 86400.0 AND t < window_index * 86400.0 + 172800.0 GROUP BY ALL",
    "drift_quartiles": EV + ", x AS (SELECT *, max(t) OVER (PARTITION BY s) AS t1 FROM ev), y AS (SELECT s, CAST(floor(t * 4 / t1) AS INT) AS q, v FROM x WHERE t1 > 0), p AS (SELECT s, q, count(*) AS n, avg(v) AS m FROM y WHERE q < 4 GROUP BY ALL) SELECT s, " + ", ".join(f"round(max(m) FILTER (q = {i}), 6) AS q{i + 1}" for i in range(4)) + ", round(max(m) FILTER (q = 3) - max(m) FILTER (q = 0), 6) AS drift FROM p GROUP BY s HAVING sum(n) >= 40 AND min(n) >= 8",
    "detection": EV + ", x AS (SELECT s, t, max(t) OVER (PARTITION BY s) / 2 AS half, CASE WHEN count(v) OVER o >= 5 THEN avg(v) OVER o END AS r FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, id ROWS 4 PRECEDING)), c AS (SELECT s, avg(r) + 0.5 * stddev_pop(r) AS th FROM x WHERE t < half GROUP BY s), y AS (SELECT s, t, coalesce(r > th, false) AS f FROM x JOIN c USING (s) WHERE t >= half), z AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t) - row_number() OVER (PARTITION BY s, f ORDER BY t) AS g FROM y), r AS (SELECT s, count(*) AS n, min(t) AS a FROM z WHERE f GROUP BY s, g) SELECT s, round(min(a) FILTER (n >= 3), 6) AS detected_at, max(n) AS most_consecutive FROM r GROUP BY s",
    "inferred_end": EV + """ , z AS (SELECT s, max(t) AS t1 FROM ev GROUP BY s) SELECT s, id, round(t, 6) AS start, round(coalesce(lead(t) OVER o, t1), 6) AS "end", row_number() OVER o AS task_pass FROM ev JOIN z USING (s) WHERE kind = 'purchase' WINDOW o AS (PARTITION BY s ORDER BY t, id)""",
    "isolation_class": EV + ", " + _BETWEEN + " SELECT CASE WHEN coalesce(dt, 'inf'::DOUBLE) >= 43200 THEN 'isolated' WHEN dt < 10800 THEN 'clustered' ELSE 'between' END AS isolation, count(*) AS n, round(avg(v), 6) AS mean_v FROM d GROUP BY ALL",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
