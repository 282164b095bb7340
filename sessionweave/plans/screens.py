"""Queries for screening, splits, scoring, quality gates and plain relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import float_log10, gesture_class, grid_cell, ratio, right_closed_bin
from ..functions.stats import share
from ..operators import quality, scoring, screening
from ..operators import windows as w
from .base import DAY, EV, GRID, events, table

FEATURES = ["f_value", "f_k", "f_double", "f_const", "f_sparse", "f_empty", "f_noise", "f_used_count"]


def wide(spark, d) -> DataFrame:
    v = F.col("v")
    return events(spark, d).select("s", "id", "kind", v.alias("f_value"), F.col("k").cast("double").alias("f_k"), (v * 2).alias("f_double"), F.lit(1.0).alias("f_const"), F.when(F.col("id") % 150 == 0, v).alias("f_sparse"), F.lit(None).cast("double").alias("f_empty"), (F.col("id") * 7919 % 1000 / 10.0).alias("f_noise"), F.when(F.col("id") % 3 != 0, v + F.col("k")).alias("f_used_count"))


WIDE = EV + """, wd AS (SELECT s, id, kind, v AS f_value, k::DOUBLE AS f_k, v * 2 AS f_double, 1.0::DOUBLE AS f_const, CASE WHEN id % 150 = 0 THEN v END AS f_sparse, NULL::DOUBLE AS f_empty,
 (id * 7919 % 1000) / 10.0::DOUBLE AS f_noise, CASE WHEN id % 3 <> 0 THEN v + k END AS f_used_count FROM ev),
 lg AS (""" + " UNION ALL ".join(f"SELECT s, id, kind, '{f}' AS feature, {f} AS value FROM wd" for f in FEATURES) + ")"


def _long(spark, d):
    return screening.long_form(wide(spark, d), ["s", "id", "kind"], FEATURES)


def availability(spark, d):
    return screening.availability(_long(spark, d), "s").withColumns({c: F.round(c, 6) for c in ("pct", "worst_group_pct")})


def exposure_corr(spark, d):
    return screening.exposure(_long(spark, d), "s").select("feature", F.round("r", 6).alias("r"), "flag")


def group_lock(spark, d):
    return screening.group_lock(_long(spark, d), "kind").withColumn("association", F.round("association", 6))


def pairwise_corr(spark, d):
    return screening.pairwise_correlation(wide(spark, d), FEATURES).withColumn("r", F.round("r", 6))


def redundancy_mutual(spark, d):
    long = _long(spark, d)
    best = screening.redundancy(screening.pairwise_correlation(wide(spark, d), FEATURES))
    return screening.duplicates(best, screening.availability(long, "s"))


def feature_decisions(spark, d):
    long = _long(spark, d)
    diag = screening.availability(long, "s").join(screening.exposure(long, "s").select("feature", F.col("flag").alias("exposure_flag")), "feature", "left")
    return screening.decisions(diag, ("f_noise",)).select("feature", "decision", "decision_reason")


def reliability_verdict(spark, d):
    e = events(spark, d).withColumn("x", F.col("v") - 40 - F.col("k") / 10)
    out = screening.reliability(e, "s", "x")
    return out.withColumns({c: F.round(c, 6) for c in ("top_share", "consensus")})


def spearman(spark, d):
    e = events(spark, d).withColumns({"a": F.floor("v"), "b": F.col("k")})
    return screening.spearman(e, "a", "b", ["kind"]).withColumn("rho", F.round("rho", 6))


def missing_by_family(spark, d):
    long = _long(spark, d)
    return long.groupBy("kind", "feature").agg(F.round(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)), 6).alias("missing"))


def _sessions(spark, d):
    return events(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n_events")).select((F.col("s") % 40).alias("pid"), F.col("s").alias("ord"), "n_events")


def identity_splits(spark, d):
    return scoring.session_roles(_sessions(spark, d))


def impute_standardise(spark, d):
    out = scoring.standardise(_long(spark, d), F.col("id") % 2 == 0)
    return out.select("id", "feature", F.round("z", 6).alias("z"))


def centroid_distance(spark, d):
    return scored(spark, d).select("trust_id", "cand", "genuine", F.round("score", 6).alias("score"))


def scored(spark, d) -> DataFrame:
    """Vectors with odd ids against the centroids of the even ones, one per label."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    refs = scoring.mean_vectors(e.where("vec_id % 2 = 0"), ["label"], "embedding").where("n >= 2").select(F.col("label").alias("cand"), "mean")
    probes = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("trust_id"), F.col("label").alias("pid"), "embedding")
    met = scoring.against(probes, refs)
    return met.select("trust_id", "pid", "cand", (F.col("pid") == F.col("cand")).alias("genuine"), (-scoring.distance(F.col("embedding"), F.col("mean"))).alias("score"))


SCORED = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
 rf AS (SELECT label AS cand, i, avg(c) AS m, count(*) AS n FROM e WHERE vec_id % 2 = 0 GROUP BY ALL HAVING count(*) >= 2),
 sc AS (SELECT e.vec_id AS trust_id, e.label AS pid, rf.cand, e.label = rf.cand AS genuine, -sqrt(sum((e.c - rf.m) * (e.c - rf.m))) AS score FROM e JOIN rf ON e.i = rf.i WHERE e.vec_id % 2 = 1 GROUP BY ALL)"""
# scores are rounded before ranks are taken, so that both engines see the same ties
ZS = SCORED + ", zz AS (SELECT *, round((score - avg(score) OVER p) / CASE WHEN stddev_pop(score) OVER p > 0 THEN stddev_pop(score) OVER p ELSE 1 END, 7) AS z FROM sc WINDOW p AS (PARTITION BY trust_id))"


def _z(spark, d):
    return scoring.cohort_z(scored(spark, d)).withColumn("z", F.round("z", 7))


def cohort_z(spark, d):
    return scoring.cohort_z(scored(spark, d)).select("trust_id", "cand", F.round("z", 4).alias("z"))


def rank1(spark, d):
    r = scoring.rank_candidates(_z(spark, d)).where("genuine")
    return r.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.round(share(F.col("rank") == 1), 6).alias("rank1"), F.round(share(F.col("rank") <= 3), 6).alias("rank3"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def auc_eer_far(spark, d):
    z = _z(spark, d).withColumn("g", F.lit(1))
    a = scoring.auc(z, ["g"], score="z")
    p = scoring.eer_far(scoring.roc_points(z, ["g"], score="z"), ["g"])
    return a.join(p, "g").select(F.round("auc", 6).alias("auc"), F.round("eer", 6).alias("eer"), F.round("far", 6).alias("far"))


def leave_one_out_auc(spark, d):
    return scoring.leave_one_out_auc(_z(spark, d), "pid", [], score="z").select("left_out", F.round("auc", 6).alias("auc"))


def confusion(spark, d):
    r = scoring.rank_candidates(_z(spark, d)).where("rank = 1")
    n = r.groupBy("pid", F.col("cand").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("pid")), 6))


def trust_windows(spark, d):
    e = events(spark, d).select("s", F.col("t").alias("window_start"), (F.col("t") + DAY).alias("window_end"), "v")
    return scoring.trust_windows(e, ["v"], 5, 3).select("s", "rn", F.round("mean_v", 6).alias("mean_v"), F.round("span", 6).alias("span"))


def weighted_fusion(spark, d):
    e = events(spark, d).groupBy("s", "kind").agg(F.avg("v").alias("m"), F.count(F.lit(1)).cast("double").alias("w"))
    z = e.join(e.groupBy("kind").agg(F.avg("m").alias("mean")), "kind").withColumn("z", F.col("m") - F.col("mean"))
    return scoring.weighted_fusion(z.where("w >= 5"), ["s"]).withColumn("fused", F.round("fused", 6))


def enrol_probe_shift(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null").withColumn("half", F.col("vec_id") % 2)
    m = scoring.mean_vectors(e, ["label", "half"], "embedding").where("n >= 3")
    a, b = m.where("half = 0").select("label", F.col("mean").alias("a")), m.where("half = 1").select("label", F.col("mean").alias("b"))
    return a.join(b, "label").select("label", F.round(scoring.distance(F.col("a"), F.col("b")), 6).alias("shift"))


def qc_report(spark, d):
    flags = {f"has_{k}": F.col("kind") == k for k in ("click", "purchase")}
    win = w.observed_flags(events(spark, d), flags, length=2 * DAY, stride=DAY)
    return quality.report(win, ["s", "window_index"], list(flags), 1000, 10, "s")


def validation_messages(spark, d):
    per = events(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t1"), share(F.col("kind") == "error").alias("errors"))
    rules = {"few_events": ("FAIL", F.col("n") < 50), "short": ("WARN", F.col("t1") < 28 * DAY), "many_errors": ("WARN", F.col("errors") > 0.25)}
    return quality.messages(per, rules).select("s", "verdict", "issues")


def class_shares(spark, d):
    kinds = ("click", "view", "purchase", "signup", "error")
    return events(spark, d).groupBy("s").agg(*(F.round(share(F.col("kind") == k), 6).alias(f"share_{k}") for k in kinds))


def crosstab_norm(spark, d):
    n = events(spark, d).groupBy((F.col("k") % 4).alias("bucket"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("bucket")), 6))


def gesture_case(spark, d):
    e = events(spark, d)
    c = gesture_class(F.when(F.col("k") % 3 == 0, F.col("v") / 10).otherwise(0.0), F.when(F.col("k") % 6 == 0, F.col("v") / 5).otherwise(0.0), F.col("k").cast("double"), F.col("v") * 10)
    return e.groupBy(c.alias("gesture")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


def grid_coverage(spark, d):
    cell = F.struct(grid_cell(F.col("v") / 100), grid_cell(F.col("k") / 100.0))
    return events(spark, d).groupBy("s").agg(F.count_distinct(cell).alias("cells"), F.round(F.count_distinct(cell) / 64.0, 6).alias("coverage"))


def log_bins(spark, d):
    edges = [10.0**x for x in (-2, -1, 0, 1, 2, 3)]
    return events(spark, d).groupBy(right_closed_bin(F.col("v"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(float_log10(F.col("v"))), 6).alias("mean_log"))


def ecdf(spark, d):
    e = events(spark, d).select("kind", "id", "v")
    r = scoring.value_ranks(e, ["kind"], "v").join(e.groupBy("kind").agg(F.count(F.lit(1)).alias("total")), "kind")
    return e.join(r, ["kind", "v"]).select("kind", "id", F.round((F.col("below_n") + F.col("n")) / F.col("total"), 6).alias("p"))


def interval_percentiles(spark, d):
    from ..operators import sequence as q

    e = q.intervals_between(events(spark, d)).where("dt is not null")
    p = F.percentile("dt", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return e.groupBy("s").agg(p.alias("p")).select("s", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "median", "p90"))))


def separation_score(spark, d):
    """Distance of kinds' medians over their mean interquartile range, for each pair of kinds."""
    g = events(spark, d).groupBy("kind").agg(F.percentile("v", F.lit(0.5)).alias("m"), (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"))
    a, b = g.select(F.col("kind").alias("a"), F.col("m").alias("ma"), F.col("iqr").alias("ia")), g.select(F.col("kind").alias("b"), F.col("m").alias("mb"), F.col("iqr").alias("ib"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(ratio(F.abs(F.col("ma") - F.col("mb")), (F.col("ia") + F.col("ib")) / 2), 6).alias("score"))


def within_between(spark, d):
    per = events(spark, d).groupBy("kind", "s").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return per.groupBy("kind").agg(F.round(F.stddev_samp("m") / F.percentile("sd", F.lit(0.5)), 6).alias("separation"), F.count(F.lit(1)).alias("groups"))


def schema_profile(spark, d):
    """Non-null count and share of every column, in one pass."""
    e = table(spark, d, "events")
    one = e.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in e.columns))
    return one.unpivot(["rows"], e.columns, "column", "non_null").withColumn("pct", F.round(F.col("non_null") * 100.0 / F.col("rows"), 2))


def orders_semi(spark, d):
    """Customers with an order over 300 000, by segment."""
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    c = table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def orders_anti(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 250000")
    c = table(spark, d, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.select("c_custkey", "c_name", "c_nationkey")


def orders_sets(spark, d):
    o = table(spark, d, "orders")
    urgent, open_ = o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")
    both = urgent.intersect(open_).withColumn("set", F.lit("both"))
    return both.unionByName(urgent.exceptAll(open_).distinct().withColumn("set", F.lit("urgent_left"))).groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))


def orders_topk(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return o.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def pricing_summary(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


def nation_revenue(spark, d):
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))  # noqa: E741
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


_SH = "round(avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END), 6)"
_AV = WIDE + ", av AS (SELECT feature, sum(n) * 100.0 / sum(r) AS pct, min(n * 100.0 / r) AS worst, sum(n) AS n FROM (SELECT feature, s, count(value) AS n, count(*) AS r FROM lg GROUP BY ALL) GROUP BY feature), ex AS (SELECT feature, CASE WHEN count(*) >= 5 AND min(m) < max(m) AND min(r) < max(r) THEN corr(m, r) END AS r FROM (SELECT feature, s, avg(value) AS m, count(*)::DOUBLE AS r FROM lg GROUP BY ALL HAVING avg(value) IS NOT NULL) GROUP BY feature)"
_PC = WIDE + ", pc AS (SELECT a.feature AS a, b.feature AS b, count(*) AS overlap, CASE WHEN count(*) >= 30 AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN greatest(-1, least(1, corr(a.value, b.value))) END AS r FROM lg a JOIN lg b ON a.id = b.id AND a.feature < b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)"
_FLAG = EV + ", " + GRID + ", f AS (SELECT s, window_index, EXISTS (SELECT 1 FROM ev e WHERE e.s = g.s AND e.kind = 'click' AND e.t >= window_start AND e.t < window_end) AS c, EXISTS (SELECT 1 FROM ev e WHERE e.s = g.s AND e.kind = 'purchase' AND e.t >= window_start AND e.t < window_end) AS p FROM g)"

SQL = {
    "availability": _AV + " SELECT feature, round(pct, 6) AS pct, round(worst, 6) AS worst_group_pct, n, n = 0 AS is_empty, n > 0 AND pct < 1 AS is_near_empty FROM av",
    "exposure_corr": _AV + ", fs AS (SELECT feature FROM ex) SELECT feature, round(r, 6) AS r, coalesce(abs(r) >= 0.5, false) AS flag FROM ex",
    "group_lock": WIDE + """, v AS (SELECT * FROM lg WHERE value IS NOT NULL), mo AS (SELECT feature, sum(n) - max(n) AS off_mode FROM (SELECT feature, value, count(*) AS n FROM v GROUP BY ALL) GROUP BY feature),
 pr AS (SELECT feature, kind, avg(value) AS m, stddev_samp(value) AS sd FROM v GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT feature, count(*) AS groups, stddev_samp(m) AS b, quantile_cont(sd, 0.5) AS w FROM pr GROUP BY feature),
 o AS (SELECT feature, stddev_samp(value) AS o FROM v GROUP BY feature)
 SELECT mo.feature, off_mode, coalesce(groups, 0) AS groups, CASE WHEN coalesce(groups, 0) >= 2 AND off_mode >= 20 AND w > 0 THEN round(b / w, 6) END AS association,
 CASE WHEN coalesce(groups, 0) >= 2 AND off_mode >= 20 THEN CASE WHEN w <= 0 THEN b > 0 ELSE b / w >= 3 AND w / o < 0.4 END END AS locked FROM mo LEFT JOIN g USING (feature) LEFT JOIN o USING (feature)""",
    "pairwise_corr": _PC + " SELECT a, b, overlap, round(r, 6) AS r FROM pc",
    "redundancy_mutual": _PC + """, bo AS (SELECT a AS feature, b AS partner, r FROM pc WHERE r IS NOT NULL UNION ALL SELECT b, a, r FROM pc WHERE r IS NOT NULL),
 be AS (SELECT feature, partner, round(abs(r), 3) AS c FROM bo QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(abs(r), 9) DESC, partner) = 1), su AS (SELECT feature, count(value) AS n FROM lg GROUP BY feature)
 SELECT CASE WHEN sb.n > sa.n THEN x.feature ELSE y.feature END AS dropped, CASE WHEN sb.n > sa.n THEN y.feature ELSE x.feature END AS kept FROM be x JOIN be y ON x.partner = y.feature AND y.partner = x.feature AND x.feature < y.feature
 JOIN su sa ON sa.feature = x.feature JOIN su sb ON sb.feature = y.feature WHERE x.c = 1 AND y.c = 1""",
    "feature_decisions": _AV + ", w AS (SELECT av.feature, CASE WHEN starts_with(av.feature, 'f_noise') THEN 'hard_excluded_family' WHEN n = 0 THEN 'fully_empty' WHEN n > 0 AND pct < 1 THEN 'near_empty' WHEN regexp_matches(av.feature, '(_n|_count)$') THEN 'count_like' WHEN coalesce(abs(r) >= 0.5, false) THEN 'high_exposure_corr' ELSE 'kept' END AS decision_reason FROM av LEFT JOIN ex ON av.feature = ex.feature) SELECT feature, CASE WHEN decision_reason = 'kept' THEN 'keep' ELSE 'drop' END AS decision, decision_reason FROM w",
    "reliability_verdict": EV + """, p AS (SELECT s, count(*) AS n, avg(v - 40 - k / 10.0::DOUBLE) AS m FROM ev GROUP BY s), q AS (SELECT count(*) AS groups, count(*) FILTER (n >= 5) AS voting, max(n) / sum(n) AS top_share,
 greatest(count(*) FILTER (n >= 5 AND m > 0), count(*) FILTER (n >= 5 AND m < 0)) / nullif(count(*) FILTER (n >= 5), 0) AS consensus FROM p)
 SELECT groups, voting, round(top_share, 6) AS top_share, round(consensus, 6) AS consensus, CASE WHEN voting < 3 THEN 'underpowered' WHEN top_share > 0.4 AND consensus < 1 THEN 'dominated_and_contested' WHEN consensus < 0.8 THEN 'contested' ELSE 'trustworthy' END AS verdict FROM q""",
    "spearman": EV + ", x AS (SELECT kind, floor(v) AS a, k AS b FROM ev), r AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY a) + (count(*) OVER (PARTITION BY kind, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY kind ORDER BY b) + (count(*) OVER (PARTITION BY kind, b) - 1) / 2.0::DOUBLE AS rb FROM x) SELECT kind, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY kind",
    "missing_by_family": WIDE + " SELECT kind, feature, round(avg((value IS NULL)::INT), 6) AS missing FROM lg GROUP BY ALL",
    "identity_splits": "WITH x AS (SELECT user_id % 40 AS pid, user_id AS ord, count(*) AS n_events FROM events GROUP BY user_id), y AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n_sessions, row_number() OVER (PARTITION BY pid ORDER BY ord) AS position, row_number() OVER (PARTITION BY pid ORDER BY ord DESC) AS r FROM x) SELECT pid, ord, n_events, n_sessions, position, CASE WHEN n_sessions = 1 THEN 'train' WHEN r = 1 THEN 'probe' WHEN r = 2 THEN 'enrol' ELSE 'train' END AS role FROM y",
    "impute_standardise": WIDE + ", md AS (SELECT feature, quantile_cont(value, 0.5) AS med FROM lg WHERE id % 2 = 0 GROUP BY feature), st AS (SELECT lg.feature, any_value(med) AS med, avg(coalesce(value, med)) AS mean, stddev_pop(coalesce(value, med)) AS sd FROM lg JOIN md USING (feature) WHERE id % 2 = 0 GROUP BY lg.feature) SELECT id, lg.feature, round(coalesce((coalesce(value, med) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0), 6) AS z FROM lg LEFT JOIN st ON lg.feature = st.feature",
    "centroid_distance": SCORED + " SELECT trust_id, cand, genuine, round(score, 6) AS score FROM sc",
    "cohort_z": SCORED + " SELECT trust_id, cand, round((score - avg(score) OVER p) / CASE WHEN stddev_pop(score) OVER p > 0 THEN stddev_pop(score) OVER p ELSE 1 END, 4) AS z FROM sc WINDOW p AS (PARTITION BY trust_id)",
    "rank1": ZS + ", r AS (SELECT *, row_number() OVER (PARTITION BY trust_id ORDER BY z DESC, cand) AS k FROM zz) SELECT pid, count(*) AS n, round(avg((k = 1)::INT), 6) AS rank1, round(avg((k <= 3)::INT), 6) AS rank3, round(avg(k), 6) AS mean_rank FROM r WHERE genuine GROUP BY pid",
    "auc_eer_far": ZS + """, r AS (SELECT genuine, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS r FROM zz), au AS (SELECT (sum(r) FILTER (genuine) - count(*) FILTER (genuine) * (count(*) FILTER (genuine) + 1) / 2.0) / (count(*) FILTER (genuine) * count(*) FILTER (NOT genuine)) AS auc FROM r),
 g AS (SELECT z, count(*) FILTER (genuine) AS p, count(*) FILTER (NOT genuine) AS q FROM zz GROUP BY z), c AS (SELECT z, sum(p) OVER (ORDER BY z DESC) AS tp, sum(q) OVER (ORDER BY z DESC) AS fp, row_number() OVER (ORDER BY z DESC) AS k FROM g),
 d AS (SELECT *, lag(tp) OVER (ORDER BY k) AS t0, lead(tp) OVER (ORDER BY k) AS t1, lag(fp) OVER (ORDER BY k) AS f0, lead(fp) OVER (ORDER BY k) AS f1 FROM c),
 ee AS (SELECT k, fp / max(fp) OVER () AS fpr, tp / max(tp) OVER () AS tpr FROM d WHERE t0 IS NULL OR t1 IS NULL OR t1 - tp <> tp - t0 OR f1 - fp <> fp - f0 UNION ALL SELECT 0, 0, 0),
 h AS (SELECT *, lead(fpr) OVER (ORDER BY k) AS f1, lead(tpr) OVER (ORDER BY k) AS t1 FROM ee)
 SELECT round((SELECT auc FROM au), 6) AS auc, round((SELECT (fpr + 1 - tpr) / 2 FROM ee ORDER BY round(abs(fpr - (1 - tpr)), 12), k LIMIT 1), 6) AS eer, round((SELECT max(fpr + coalesce((f1 - fpr) * (0.9 - tpr) / (t1 - tpr), 0)) FROM h WHERE tpr <= 0.9 AND (t1 > 0.9 OR t1 IS NULL)), 6) AS far""",
    "leave_one_out_auc": ZS + ", i AS (SELECT DISTINCT pid AS left_out FROM zz), x AS (SELECT i.left_out, z, genuine FROM zz JOIN i ON zz.pid <> i.left_out), r AS (SELECT *, rank() OVER (PARTITION BY left_out ORDER BY z) + (count(*) OVER (PARTITION BY left_out, z) - 1) / 2.0::DOUBLE AS r FROM x) SELECT left_out, round((sum(r) FILTER (genuine) - count(*) FILTER (genuine) * (count(*) FILTER (genuine) + 1) / 2.0) / (count(*) FILTER (genuine) * count(*) FILTER (NOT genuine)), 6) AS auc FROM r GROUP BY left_out",
    "confusion": ZS + ", r AS (SELECT pid, cand AS predicted FROM zz QUALIFY row_number() OVER (PARTITION BY trust_id ORDER BY z DESC, cand) = 1), n AS (SELECT pid, predicted, count(*) AS n FROM r GROUP BY ALL) SELECT pid, predicted, n, round(n / sum(n) OVER (PARTITION BY pid), 6) AS share FROM n",
    "trust_windows": EV + ", x AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY t) AS rn, avg(v) OVER f AS m, count(*) OVER f AS n, last_value(t) OVER f + 86400 - t AS span FROM ev WINDOW f AS (PARTITION BY s ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT s, rn, round(m, 6) AS mean_v, round(span, 6) AS span FROM x WHERE n = 5 AND (rn - 1) % 3 = 0",
    "weighted_fusion": EV + ", m AS (SELECT s, kind, avg(v) AS m, count(*) AS w FROM ev GROUP BY ALL), z AS (SELECT s, w, m - avg(m) OVER (PARTITION BY kind) AS z FROM m) SELECT s, round(sum(z * w) / sum(w), 6) AS fused, count(*) AS n_modalities FROM z WHERE w >= 5 GROUP BY s",
    "enrol_probe_shift": "WITH e AS (SELECT vec_id % 2 AS h, label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), m AS (SELECT label, h, i, avg(c) AS m FROM e GROUP BY ALL HAVING count(*) >= 3) SELECT label, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS shift FROM m a JOIN m b USING (label, i) WHERE a.h = 0 AND b.h = 1 GROUP BY label",
    "qc_report": _FLAG + """, n AS (SELECT count(*)::DOUBLE AS n, avg(c::INT) AS c, avg(p::INT) AS p, avg((NOT c AND NOT p)::INT) AS z, count(DISTINCT s)::DOUBLE AS g FROM f)
 SELECT 'non_empty' AS "check", n AS value, CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM n UNION ALL SELECT 'duplicate_keys', 0, 'PASS' UNION ALL
 SELECT 'presence_has_click', round(c, 6), CASE WHEN c < .05 THEN 'FAIL' WHEN c < .2 THEN 'WARN' ELSE 'PASS' END FROM n UNION ALL SELECT 'presence_has_purchase', round(p, 6), CASE WHEN p < .05 THEN 'FAIL' WHEN p < .2 THEN 'WARN' ELSE 'PASS' END FROM n UNION ALL
 SELECT 'low_activity', round(z, 6), CASE WHEN z > .8 THEN 'FAIL' WHEN z > .5 THEN 'WARN' ELSE 'PASS' END FROM n UNION ALL SELECT 'sample_size', n, CASE WHEN n < 1000 THEN 'WARN' ELSE 'PASS' END FROM n UNION ALL SELECT 'groups', g, CASE WHEN g < 10 THEN 'WARN' ELSE 'PASS' END FROM n""",
    "validation_messages": EV + ", p AS (SELECT s, count(*) AS n, max(t) AS t1, avg((kind = 'error')::INT) AS e FROM ev GROUP BY s) SELECT s, CASE WHEN n < 50 THEN 'FAIL' WHEN t1 < 2419200 OR e > 0.25 THEN 'WARN' ELSE 'PASS' END AS verdict, concat_ws('; ', CASE WHEN n < 50 THEN 'FAIL:few_events' END, CASE WHEN t1 < 2419200 THEN 'WARN:short' END, CASE WHEN e > 0.25 THEN 'WARN:many_errors' END) AS issues FROM p",
    "class_shares": EV + " SELECT s, " + ", ".join(_SH.format(f"kind = '{k}'") + f" AS share_{k}" for k in ("click", "view", "purchase", "signup", "error")) + " FROM ev GROUP BY s",
    "crosstab_norm": EV + ", n AS (SELECT k % 4 AS bucket, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY bucket), 6) AS share FROM n",
    "gesture_case": EV + ", x AS (SELECT v, k, CASE WHEN k % 3 = 0 THEN v / 10 ELSE 0 END AS d, CASE WHEN k % 6 = 0 THEN v / 5 ELSE 0 END AS c FROM ev) SELECT CASE WHEN d + c >= 5 THEN CASE WHEN c / (d + c) >= 0.25 THEN 'scroll_fling' ELSE 'scroll_drag' END WHEN k >= 20 THEN 'drag_swipe' WHEN v * 10 >= 500 THEN 'long_press' ELSE 'tap' END AS gesture, count(*) AS n, round(avg(v), 6) AS mean_v FROM x GROUP BY ALL",
    "grid_coverage": EV + ", x AS (SELECT s, least(greatest(trunc(v / 100 * 8), 0), 7) AS a, least(greatest(trunc(k / 100.0::DOUBLE * 8), 0), 7) AS b FROM ev) SELECT s, count(DISTINCT (a, b)) AS cells, round(count(DISTINCT (a, b)) / 64.0, 6) AS coverage FROM x GROUP BY s",
    "log_bins": EV + " SELECT CASE WHEN v > 0.01 AND v <= 0.1 THEN 0 WHEN v > 0.1 AND v <= 1 THEN 1 WHEN v > 1 AND v <= 10 THEN 2 WHEN v > 10 AND v <= 100 THEN 3 WHEN v > 100 AND v <= 1000 THEN 4 END AS bin, count(*) AS n, round(avg(log10(v)), 6) AS mean_log FROM ev GROUP BY ALL",
    "ecdf": EV + " SELECT kind, id, round(cume_dist() OVER (PARTITION BY kind ORDER BY v), 6) AS p FROM ev",
    "interval_percentiles": EV + ", d AS (SELECT s, t - lag(t) OVER (PARTITION BY s ORDER BY t, id) AS dt FROM ev) SELECT s, round(quantile_cont(dt, 0.1), 4) AS p10, round(quantile_cont(dt, 0.5), 4) AS median, round(quantile_cont(dt, 0.9), 4) AS p90 FROM d WHERE dt IS NOT NULL GROUP BY s",
    "separation_score": EV + ", g AS (SELECT kind, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS i FROM ev GROUP BY kind) SELECT a.kind AS a, b.kind AS b, round(abs(a.m - b.m) / nullif((a.i + b.i) / 2, 0), 6) AS score FROM g a JOIN g b ON a.kind < b.kind",
    "within_between": EV + ", p AS (SELECT kind, s, avg(v) AS m, stddev_samp(v) AS sd FROM ev GROUP BY ALL HAVING count(*) >= 10) SELECT kind, round(stddev_samp(m) / quantile_cont(sd, 0.5), 6) AS separation, count(*) AS groups FROM p GROUP BY kind",
    "schema_profile": "SELECT (SELECT count(*) FROM events) AS rows, c AS \"column\", n AS non_null, round(n * 100.0 / (SELECT count(*) FROM events), 2) AS pct FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + ")",
    "orders_semi": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY ALL",
    "orders_anti": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "orders_sets": "WITH u AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey, 'both' AS \"set\" FROM (SELECT * FROM u INTERSECT SELECT * FROM o) UNION ALL SELECT o_custkey, 'urgent_left' FROM (SELECT DISTINCT * FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM o))) SELECT \"set\", count(*) AS n, sum(o_custkey) AS key_sum FROM r GROUP BY ALL",
    "orders_topk": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY ALL",
    "nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
