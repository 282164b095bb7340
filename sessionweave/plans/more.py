"""Queries for epochs, controls, hijack traces and the exploratory operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import float_ratio
from ..functions.stats import rounded, share
from ..operators import epochs, scoring
from ..operators import sequence as q
from .base import DAY, EV, HOUR, events, table
from .screens import ZS, _z

PRE, POST = 2 * DAY, 3 * DAY


def _pairs(spark, d):
    e = events(spark, d)
    trigger = e.where("kind = 'purchase'").select(F.col("id").alias("ev"), "s", "t")
    return epochs.epoch_join(trigger, e.select("s", "t", "v"), F.col("t") - PRE, F.col("t") + POST, PRE + POST)


def epoch_metrics(spark, d):
    out = epochs.impulse_metrics(_pairs(spark, d), value="v", tail_after=DAY)
    return out.select("ev", *(rounded(F.col(c), n).alias(c) for c, n in (("peak", 7), ("impulse_auc", 1), ("latency_ms", 4), ("decay_ratio", 6), ("snr", 5))))


def epoch_bin_means(spark, d):
    """Mean, standard error and support of half-day bins around purchases."""
    p = _pairs(spark, d).withColumn("bin", F.floor((F.col("st") - F.col("t") + PRE) / (12 * HOUR)))
    n = F.count("v")
    return p.groupBy("bin").agg(n.alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v") / F.sqrt(n), 6).alias("sem"))


def epoch_usability(spark, d):
    p = _pairs(spark, d).groupBy("ev").agg(F.count(F.when(F.col("st") < F.col("t"), 1)).alias("pre"), F.count(F.when(F.col("st") >= F.col("t"), 1)).alias("post"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(share((F.col("pre") >= 2) & (F.col("post") >= 3)), 6).alias("usable"))


def shifted_control(spark, d):
    """The epochs again at a shift fixed by each trigger's id, as a control."""
    e = events(spark, d)
    shift = (F.col("id") * 2654435761 % 1000).cast("double") * 600 + 7200
    trigger = e.where("kind = 'purchase'").select(F.col("id").alias("ev"), "s", (F.col("t") + shift).alias("t"))
    p = epochs.epoch_join(trigger, e.select("s", "t", "v"), F.col("t") - DAY, F.col("t") + DAY, 2 * DAY)
    return p.groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def practice_effect(spark, d):
    """Change of the mean from a session's first to second purchase run, in percent."""
    p = events(spark, d).where("kind = 'purchase'").withColumn("pass", F.row_number().over(Window.partitionBy("s").orderBy("t", "id")))
    a, b = p.where("pass = 1").select("s", F.col("v").alias("v1")), p.where("pass = 2").select("s", F.col("v").alias("v2"))
    return a.join(b, "s").select("s", F.round(100 * (1 - float_ratio(F.col("v2"), F.col("v1"))), 6).alias("gain"))


def duplicate_rows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "day"))
    return o.withColumn("n", n).where("n > 1").select("o_custkey", "o_orderkey", "n")


def keep_first(spark, d):
    w = Window.partitionBy("s", "kind").orderBy("t", "id")
    return events(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("s", "kind", "id")


def modal_kind(spark, d):
    n = events(spark, d).groupBy("s", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("s").agg(F.max_by("kind", F.struct("n", "kind")).alias("mode"), F.max("n").alias("n"))


def dropout(spark, d):
    """Identification with scores masked by a fixed fraction of candidates' keys, at three rates."""
    z = _z(spark, d).withColumn("u", (F.col("trust_id") * 7919 + F.col("cand") * 104729) % 100)
    rates = F.explode(F.array(*(F.lit(x) for x in (0, 20, 50)))).alias("rate")
    kept = z.select("*", rates).where("u >= rate")
    r = kept.withColumn("k", F.row_number().over(Window.partitionBy("rate", "trust_id").orderBy(F.desc("z"), "cand"))).where("k = 1")
    return r.groupBy("rate").agg(F.count(F.lit(1)).alias("n"), F.round(share(F.col("genuine")), 6).alias("rank1"))


def per_identity(spark, d):
    return scoring.auc(_z(spark, d), ["pid"], score="z").select("pid", "n1", "n0", F.round("auc", 6).alias("auc"))


def combination_sweep(spark, d):
    """Fusion of every pair of kinds and of all, weighted equally and by count."""
    e = events(spark, d).groupBy("s", "kind").agg(F.avg("v").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    z = e.join(e.groupBy("kind").agg(F.avg("m").alias("mean")), "kind").withColumn("z", F.col("m") - F.col("mean"))
    kinds = ("click", "view", "purchase")
    combos = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]] + [kinds]
    table_ = z.sparkSession.createDataFrame([("+".join(c), k) for c in combos for k in c], "combo string, kind string")
    both = z.join(table_, "kind").select("*", F.explode(F.array(F.lit("equal"), F.lit("count"))).alias("scheme")).withColumn("w", F.when(F.col("scheme") == "equal", 1.0).otherwise(F.col("n")))
    return scoring.weighted_fusion(both, ["combo", "scheme", "s"]).groupBy("combo", "scheme").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("fused"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("fused"), 6).alias("sd"))


def hijack_splice(spark, d):
    """First half of each session followed by the whole of the next one: length and place of the splice."""
    e = events(spark, d).withColumns({"rn": F.row_number().over(Window.partitionBy("s").orderBy("t", "id")), "n": F.count(F.lit(1)).over(Window.partitionBy("s"))})
    heads = e.where("rn <= floor(n / 2)").select(F.col("s").alias("a"), F.lit(0).alias("part"), "rn", "v")
    tails = e.select((F.col("s") - 1).alias("a"), F.lit(1).alias("part"), "rn", "v")
    both = heads.unionByName(tails).withColumn("pos", F.row_number().over(Window.partitionBy("a").orderBy("part", "rn")))
    roll = F.avg("v").over(Window.partitionBy("a").orderBy("pos").rowsBetween(-4, 0))
    return both.withColumn("roll", roll).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("part") == 0, F.col("pos"))), F.lit(0)).alias("split"), F.round(F.max("roll"), 6).alias("most"))


def latency_by_kind(spark, d):
    e = q.next_time(events(spark, d), F.col("kind") == "click").where("kind <> 'click'").withColumn("lat", F.col("next_t") - F.col("t"))
    return e.groupBy("kind").agg(F.count("lat").alias("n"), F.round(F.percentile("lat", F.lit(0.5)), 4).alias("median")).where("n >= 20")


def task_progress(spark, d):
    e = events(spark, d).where("kind = 'purchase'")
    w = Window.partitionBy("s").orderBy("t", "id")
    return e.select("s", "id", F.row_number().over(w).alias("ordinal"), F.round(F.col("t") - F.first("t").over(w), 6).alias("elapsed"))


_PAIR = EV + ", p AS (SELECT a.id AS ev, e.t - a.t AS rel, e.v FROM ev a JOIN ev e ON a.s = e.s AND e.t >= a.t - 172800 AND e.t < a.t + 259200 WHERE a.kind = 'purchase')"
SQL = {
    "epoch_metrics": _PAIR + """, b AS (SELECT ev, avg(v) FILTER (rel < 0) AS base, stddev_pop(v) FILTER (rel < 0) + 1e-9 AS noise FROM p GROUP BY ev HAVING count(*) >= 5 AND count(*) FILTER (rel < 0) >= 2 AND count(*) FILTER (rel >= 0) >= 3),
 x AS (SELECT ev, rel, v - base AS vp, noise FROM p JOIN b USING (ev) WHERE rel >= 0), k AS (SELECT ev, arg_max(rel, vp) AS lat, max(vp) AS peak FROM x GROUP BY ev),
 y AS (SELECT x.*, lat, peak, (greatest(vp, 0) + lag(greatest(vp, 0)) OVER o) / 2 * (rel - lag(rel) OVER o) AS area FROM x JOIN k USING (ev) WINDOW o AS (PARTITION BY ev ORDER BY rel))
 SELECT ev, round(max(peak), 7) AS peak, round(sum(area), 1) AS impulse_auc, round(max(lat), 4) AS latency_ms, round(CASE WHEN max(peak) > 0 THEN avg(vp) FILTER (rel >= lat + 86400) / max(peak) END, 6) AS decay_ratio, round(max(peak) / min(noise), 5) AS snr FROM y GROUP BY ev""",
    "epoch_bin_means": _PAIR + " SELECT CAST(floor((rel + 172800) / 43200) AS BIGINT) AS bin, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(v)), 6) AS sem FROM p GROUP BY ALL",
    "epoch_usability": _PAIR + ", g AS (SELECT ev, count(*) FILTER (rel < 0) AS a, count(*) FILTER (rel >= 0) AS b FROM p GROUP BY ev) SELECT count(*) AS n, round(avg((a >= 2 AND b >= 3)::INT), 6) AS usable FROM g",
    "shifted_control": EV + ", a AS (SELECT id AS ev, s, t + (id * 2654435761 % 1000)::DOUBLE * 600 + 7200 AS t FROM ev WHERE kind = 'purchase') SELECT a.ev, count(*) AS n, round(avg(v), 6) AS mean FROM a JOIN ev e ON a.s = e.s AND e.t >= a.t - 86400 AND e.t < a.t + 86400 GROUP BY a.ev",
    "practice_effect": EV + ", p AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY t, id) AS r FROM ev WHERE kind = 'purchase') SELECT a.s, round(100 * (1 - b.v / a.v), 6) AS gain FROM p a JOIN p b ON a.s = b.s AND a.r = 1 AND b.r = 2",
    "duplicate_rows": "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders QUALIFY n > 1",
    "keep_first": EV + " SELECT s, kind, id FROM ev QUALIFY row_number() OVER (PARTITION BY s, kind ORDER BY t, id) = 1",
    "modal_kind": EV + ", n AS (SELECT s, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT s, kind AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, kind DESC) = 1",
    "dropout": ZS + ", x AS (SELECT *, (trust_id * 7919 + cand * 104729) % 100 AS u FROM zz), k AS (SELECT rate, genuine FROM x, (VALUES (0), (20), (50)) AS t(rate) WHERE u >= rate QUALIFY row_number() OVER (PARTITION BY rate, trust_id ORDER BY z DESC, cand) = 1) SELECT rate, count(*) AS n, round(avg(genuine::INT), 6) AS rank1 FROM k GROUP BY rate",
    "per_identity": ZS + ", r AS (SELECT pid, genuine AS y, rank() OVER (PARTITION BY pid ORDER BY z) + (count(*) OVER (PARTITION BY pid, z) - 1) / 2.0::DOUBLE AS r FROM zz) SELECT pid, (count(*) FILTER (y))::DOUBLE AS n1, (count(*) FILTER (NOT y))::DOUBLE AS n0, round(CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) END, 6) AS auc FROM r GROUP BY pid",
    "combination_sweep": EV + ", m AS (SELECT s, kind, avg(v) AS m, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), z AS (SELECT s, kind, n, m - avg(m) OVER (PARTITION BY kind) AS z FROM m), c AS (SELECT unnest(['click+view', 'click+view', 'click+purchase', 'click+purchase', 'view+purchase', 'view+purchase', 'click+view+purchase', 'click+view+purchase', 'click+view+purchase']) AS combo, unnest(['click', 'view', 'click', 'purchase', 'view', 'purchase', 'click', 'view', 'purchase']) AS kind), f AS (SELECT combo, scheme, s, sum(z * CASE WHEN scheme = 'equal' THEN 1 ELSE n END) / sum(CASE WHEN scheme = 'equal' THEN 1 ELSE n END) AS f FROM z JOIN c USING (kind), (VALUES ('equal'), ('count')) AS t(scheme) GROUP BY ALL) SELECT combo, scheme, count(*) AS n, round(avg(f), 6) + 0.0::DOUBLE AS mean, round(stddev_pop(f), 6) AS sd FROM f GROUP BY ALL",
    "hijack_splice": EV + ", x AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY t, id) AS rn, count(*) OVER (PARTITION BY s) AS n FROM ev), u AS (SELECT s AS a, 0 AS part, rn, v FROM x WHERE rn <= floor(n / 2) UNION ALL SELECT s - 1, 1, rn, v FROM x), y AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY part, rn) AS pos FROM u), r AS (SELECT *, avg(v) OVER (PARTITION BY a ORDER BY pos ROWS 4 PRECEDING) AS roll FROM y) SELECT a, count(*) AS n, coalesce(max(pos) FILTER (part = 0), 0) AS split, round(max(roll), 6) AS most FROM r GROUP BY a",
    "latency_by_kind": EV + ", x AS (SELECT kind, (SELECT min(c.t) FROM ev c WHERE c.s = ev.s AND c.kind = 'click' AND c.t > ev.t) - t AS lat FROM ev WHERE kind <> 'click') SELECT kind, count(lat) AS n, round(quantile_cont(lat, 0.5), 4) AS median FROM x GROUP BY kind HAVING count(lat) >= 20",
    "task_progress": EV + " SELECT s, id, row_number() OVER w AS ordinal, round(t - first_value(t) OVER w, 6) AS elapsed FROM ev WHERE kind = 'purchase' WINDOW w AS (PARTITION BY s ORDER BY t, id)",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
