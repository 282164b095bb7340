"""Further exploratory summaries over sessions, and modelling bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import share
from ..operators import scoring, screening
from ..operators import sequence as q
from .base import DAY, EV, events
from .screens import _PC, FEATURES, WIDE, ZS, _long, _z, wide


def revisions(spark, d):
    """Task days with more than one purchase."""
    e = events(spark, d).where("kind = 'purchase'").groupBy("s", F.floor(F.col("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))
    return e.where("n > 1")


def availability_metrics(spark, d):
    kinds = ("click", "view", "purchase", "signup", "error")
    return events(spark, d).groupBy("s").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds))


def within_between_cv(spark, d):
    per = events(spark, d).groupBy("kind", "s").agg(F.percentile("v", F.lit(0.5)).alias("m"), (F.stddev_samp("v") / F.avg("v")).alias("cv"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return per.groupBy("kind").agg(F.round(F.percentile("cv", F.lit(0.5)), 6).alias("within"), F.round(F.stddev_samp("m") / F.avg("m"), 6).alias("between"))


def describe_features(spark, d):
    g = _long(spark, d).groupBy("feature").agg(F.count("value").alias("n"), F.count_distinct("value").alias("distinct_values"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("variance"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)), 6).alias("missing"))
    return g


def clean_sessions(spark, d):
    g = q.intervals_between(events(spark, d)).groupBy("s").agg(F.round(F.max("dt"), 6).alias("longest_gap"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median_v"))
    return g.where((F.col("longest_gap") <= 3 * DAY) & (F.abs("median_v") <= 75))


def stability(spark, d):
    g = events(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.round(100 * share(F.col("kind") == "error"), 6).alias("error_pct"), F.round(100 * share(F.col("v") > 100), 6).alias("high_pct"))
    return g.where("n >= 20")


def distinct_context(spark, d):
    return events(spark, d).groupBy((F.col("s") % 40).alias("pid")).agg(F.count_distinct("kind").alias("kinds"), F.count_distinct("k").alias("ks"), F.count_distinct("s").alias("sessions"))


def fixed_identities(spark, d):
    """Identities with enough probe rows for the longest trust window."""
    z = _z(spark, d).where("genuine")
    return z.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


def context_confound(spark, d):
    """Strongest association of each feature with any grouping, first grouping on a tie."""
    long = _long(spark, d).withColumns({"by_kind": F.col("kind"), "by_s": (F.col("s") % 7).cast("string")})
    return screening.context_confound(long, ["by_kind", "by_s"]).select("feature", "grouping", F.round("association", 6).alias("association"))


def high_pairs(spark, d):
    p = screening.pairwise_correlation(wide(spark, d), FEATURES)
    return p.where(F.abs("r") >= 0.5).select("a", "b", F.round("r", 6).alias("r"))


def enrolment_ablation(spark, d):
    """Mean of at most n rows of each session, chosen by a fixed order of their keys, for three sizes."""
    e = events(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy((F.col("id") * 7919) % 10007, "id")))
    e = e.select("s", "v", "r", F.explode(F.array(F.lit(5), F.lit(20), F.lit(50))).alias("size")).where("r <= size")
    return e.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.count_distinct("s").alias("sessions"))


def loo_bounds(spark, d):
    """Least and greatest area when any one identity is left out."""
    a = scoring.leave_one_out_auc(_z(spark, d), "pid", [], score="z")
    return a.agg(F.round(F.min("auc"), 6).alias("least"), F.round(F.max("auc"), 6).alias("most"), F.count(F.lit(1)).alias("identities"))


_LOCK = """SELECT feature, '{g}' AS grouping, CASE WHEN groups >= 2 AND off_mode >= 20 AND w > 0 THEN round(b / w, 6) END AS association FROM (SELECT feature, count(*) AS groups, stddev_samp(m) AS b, quantile_cont(sd, 0.5) AS w
 FROM (SELECT feature, {e} AS g, avg(value) AS m, stddev_samp(value) AS sd FROM lg WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) GROUP BY feature) JOIN (SELECT feature, sum(n) - max(n) AS off_mode FROM (SELECT feature, value, count(*) AS n FROM lg WHERE value IS NOT NULL GROUP BY ALL) GROUP BY feature) USING (feature)"""
SQL = {
    "revisions": EV + " SELECT s, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n, round(sum(v), 4) AS total FROM ev WHERE kind = 'purchase' GROUP BY ALL HAVING count(*) > 1",
    "availability_metrics": EV + " SELECT s, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("click", "view", "purchase", "signup", "error")) + " FROM ev GROUP BY s",
    "within_between_cv": EV + ", p AS (SELECT kind, s, quantile_cont(v, 0.5) AS m, stddev_samp(v) / avg(v) AS cv FROM ev GROUP BY ALL HAVING count(*) >= 5) SELECT kind, round(quantile_cont(cv, 0.5), 6) AS within, round(stddev_samp(m) / avg(m), 6) AS between FROM p GROUP BY kind",
    "describe_features": WIDE + " SELECT feature, count(value) AS n, count(DISTINCT value) AS distinct_values, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, min(value) AS least, max(value) AS most, round(avg((value IS NULL)::INT), 6) AS missing FROM lg GROUP BY feature",
    "clean_sessions": EV + ", d AS (SELECT s, v, t - lag(t) OVER (PARTITION BY s ORDER BY t, id) AS dt FROM ev) SELECT s, round(max(dt), 6) AS longest_gap, round(quantile_cont(v, 0.5), 6) AS median_v FROM d GROUP BY s HAVING max(dt) <= 259200 AND abs(quantile_cont(v, 0.5)) <= 75",
    "stability": EV + " SELECT s, count(*) AS n, round(100 * avg((kind = 'error')::INT), 6) AS error_pct, round(100 * avg((v > 100)::INT), 6) AS high_pct FROM ev GROUP BY s HAVING count(*) >= 20",
    "distinct_context": EV + " SELECT s % 40 AS pid, count(DISTINCT kind) AS kinds, count(DISTINCT k) AS ks, count(DISTINCT s) AS sessions FROM ev GROUP BY ALL",
    "fixed_identities": ZS + " SELECT pid, count(*) AS n FROM zz WHERE genuine GROUP BY pid HAVING count(*) >= 20",
    "context_confound": WIDE + ", a AS (" + _LOCK.format(g="by_kind", e="kind") + " UNION ALL " + _LOCK.format(g="by_s", e="s % 7") + ") SELECT feature, grouping, association FROM a WHERE association IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature ORDER BY association DESC, grouping) = 1",
    "high_pairs": _PC + " SELECT a, b, round(r, 6) AS r FROM pc WHERE abs(r) >= 0.5",
    "enrolment_ablation": EV + ", x AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY (id * 7919) % 10007, id) AS r FROM ev) SELECT size, count(*) AS n, round(avg(v), 6) AS mean, count(DISTINCT s) AS sessions FROM x, (VALUES (5), (20), (50)) AS t(size) WHERE r <= size GROUP BY size",
    "loo_bounds": ZS + ", i AS (SELECT DISTINCT pid AS o FROM zz), x AS (SELECT i.o, z, genuine FROM zz JOIN i ON zz.pid <> i.o), r AS (SELECT *, rank() OVER (PARTITION BY o ORDER BY z) + (count(*) OVER (PARTITION BY o, z) - 1) / 2.0::DOUBLE AS r FROM x), a AS (SELECT o, (sum(r) FILTER (genuine) - count(*) FILTER (genuine) * (count(*) FILTER (genuine) + 1) / 2.0) / (count(*) FILTER (genuine) * count(*) FILTER (NOT genuine)) AS auc FROM r GROUP BY o) SELECT round(min(auc), 6) AS least, round(max(auc), 6) AS most, count(*) AS identities FROM a",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
