"""Splits, preprocessing, trust windows, distances, normalisation, metrics, fusion and controls of verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_roles(sessions: DataFrame, pid: str = "pid", order: str = "ord") -> DataFrame:
    """Roles by position from the end: one session trains; two enrol and probe; of more the last probes, the one before enrols."""
    w = Window.partitionBy(pid)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.desc(order)))
    role = F.when(n == 1, "train").when(r == 1, "probe").when(r == 2, "enrol").otherwise("train")
    return sessions.withColumns({"n_sessions": n, "position": F.row_number().over(w.orderBy(order)), "role": role})


def check_order(sessions: DataFrame, pid: str = "pid", order: str = "ord") -> None:
    """Raises if a participant's session order repeats."""
    bad = sessions.groupBy(pid, order).count().where("count > 1").take(1)
    if bad:
        raise ValueError(f"session order repeats: {bad[0]}")


BUCKETS = 4096


def value_ranks(df: DataFrame, by: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """by, value, and for each weight (n: rows) its sum over rows with that value and, as below_<weight>, with lesser ones.

    Rows are counted per value first; values fall into BUCKETS stretches between the group's least and greatest, whose sums are
    added up in order, so no task sorts a group as a whole."""
    weights = weights or {"n": F.lit(1)}
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*(F.sum(c).alias(k) for k, c in weights.items()))
    ends = g.groupBy(*by).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    g = g.join(ends, by) if by else g.crossJoin(ends)  # one row where there are no groups
    x = (F.col(value).cast("double") - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    g = g.withColumn("__b", F.coalesce(F.floor(x * (BUCKETS - 1)), F.lit(0)).cast("int")).drop("__lo", "__hi")
    sums = g.groupBy(*by, "__b").agg(*(F.sum(k).alias(k) for k in weights))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__b", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in weights))
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return g.join(sums, [*by, "__b"]).select(*by, value, *weights, *((F.col(f"__{k}") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(f"below_{k}") for k in weights))


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "med") -> DataFrame:
    """by and the median of each group with a value, from counts per value."""
    r = value_ranks(df, by, value)
    n = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    r = r.join(n, by) if by else r.crossJoin(n)
    low, high = F.floor((F.col("__n") + 1) / 2), F.ceil((F.col("__n") + 1) / 2)
    holds = lambda k: F.max(F.when((F.col("below_n") < k) & (k <= F.col("below_n") + F.col("n")), F.col(value)))
    return r.groupBy(*by).agg(((holds(low) + holds(high)) / 2).alias(name))


def standardise(long: DataFrame, fit_on: Column) -> DataFrame:
    """value with the fit rows' median for what is missing, then less their mean over their population deviation (0: 1).

    A feature without any fit value becomes 0."""
    fit = long.where(fit_on)
    filled = fit.join(exact_median(fit, ["feature"], "value"), "feature").withColumn("value", F.coalesce("value", "med"))
    stats = filled.groupBy("feature").agg(F.first("med").alias("med"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return long.join(stats, "feature", "left").withColumn("z", F.coalesce((F.coalesce("value", "med") - F.col("mean")) / sd, F.lit(0.0))).drop("med", "mean", "sd")


def mean_vectors(rows: DataFrame, by: list[str], vector: str = "x") -> DataFrame:
    """Component means of array vectors: summed in place by position, no long form on disk."""
    p = rows.select(*by, F.posexplode(vector).alias("i", "c")).groupBy(*by, "i").agg(F.avg(F.col("c").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def against(probes: DataFrame, references: DataFrame, most: int = 100_000) -> DataFrame:
    """Each probe with each reference.  References are one row per enrolled identity; up to most of them are copied to all tasks,
    beyond that they are dealt out in parts and probes meet each part."""
    n = references.count()
    if n <= most:
        return probes.crossJoin(F.broadcast(references))
    parts = -(-n // most)
    left = probes.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = references.withColumn("__p", F.pmod(F.xxhash64(*references.columns), F.lit(parts)).cast("int"))
    return left.join(right, "__p").drop("__p")


def trust_windows(rows: DataFrame, values: list[str], k: int, stride: int, s: str = "s", order: str = "window_start", end: str = "window_end") -> DataFrame:
    """Means over k consecutive rows of a session, every stride rows, with the span they cover."""
    w = Window.partitionBy(s).orderBy(order)
    f = w.rowsBetween(0, k - 1)
    out = rows.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(f), "span": F.last(end).over(f) - F.col(order), **{f"mean_{v}": F.avg(v).over(f) for v in values}})
    return out.where((F.col("n") == k) & ((F.col("rn") - 1) % stride == 0))


def cohort_z(scored: DataFrame, by: str = "trust_id", score: str = "score", ddof: int = 0) -> DataFrame:
    w = Window.partitionBy(by)
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(score).over(w)
    return scored.withColumn("z", (F.col(score) - F.avg(score).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def _classes(y: str) -> dict[str, Column]:
    return {"p": F.when(F.col(y), 1.0).otherwise(0.0), "q": F.when(F.col(y), 0.0).otherwise(1.0)}


def auc(scored: DataFrame, by: list[str], y: str = "genuine", score: str = "score") -> DataFrame:
    """Area under the ROC curve: the share of (genuine, impostor) pairs in order, ties a half; null with one class."""
    r = value_ranks(scored, by, score, _classes(y))
    n1, n0 = F.sum("p"), F.sum("q")
    won = F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2))
    return r.groupBy(*by).agg(n1.alias("n1"), n0.alias("n0"), (won / F.when((n1 > 0) & (n0 > 0), n1 * n0)).alias("auc"))


def roc_points(scored: DataFrame, by: list[str], y: str = "genuine", score: str = "score") -> DataFrame:
    """fpr and tpr at falling thresholds, from (0, 0), without points on a line between their neighbours."""
    g = scored.groupBy(*by, score).agg(F.sum(F.when(F.col(y), 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y), 0.0).otherwise(1.0)).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"tp": F.sum("p").over(run), "fp": F.sum("q").over(run), "__k": F.row_number().over(w)})
    bend = lambda c: (F.lead(c).over(w) - F.col(c)) != (F.col(c) - F.lag(c).over(w))
    keep = F.lag("tp").over(w).isNull() | F.lead("tp").over(w).isNull() | bend("tp") | bend("fp")
    g = g.withColumn("keep", keep).where("keep")
    whole = Window.partitionBy(*by)
    pts = g.select(*by, "__k", (F.col("fp") / F.max("fp").over(whole)).alias("fpr"), (F.col("tp") / F.max("tp").over(whole)).alias("tpr"))
    zero = pts.select(*by).distinct().select(*by, F.lit(0).alias("__k"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return zero.unionByName(pts)


def eer_far(points: DataFrame, by: list[str], at_tpr: float = 0.9) -> DataFrame:
    """Equal error rate (mean of both rates where they are nearest, first such point) and fpr interpolated at a tpr."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    w = Window.partitionBy(*by).orderBy("__k")
    p = points.withColumns({"f1": F.lead("fpr").over(w), "t1": F.lead("tpr").over(w)})
    eer = F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, F.struct(F.round(gap, 12), F.col("__k")))
    here = (F.col("tpr") <= at_tpr) & ((F.col("t1") > at_tpr) | F.col("t1").isNull())
    far = F.max(F.when(here, F.col("fpr") + F.coalesce((F.col("f1") - F.col("fpr")) * (at_tpr - F.col("tpr")) / (F.col("t1") - F.col("tpr")), F.lit(0.0))))
    return p.groupBy(*by).agg(eer.alias("eer"), far.alias("far"))


def leave_one_out_auc(scored: DataFrame, pid: str, by: list[str], y: str = "genuine", score: str = "score") -> DataFrame:
    """by, left_out and the AUC without that identity's rows, for all identities from one set of running counts.

    Of the pairs in order over all rows go those of the identity's genuine rows and those of its impostor rows; pairs of both
    were taken off twice."""
    whole = value_ranks(scored, by, score, _classes(y)).withColumnsRenamed({"p": "tp", "q": "tq", "below_p": "bp", "below_q": "bq"})
    own = value_ranks(scored, [*by, pid], score, _classes(y))
    totals = whole.groupBy(*by).agg(F.sum("tp").alias("n1"), F.sum("tq").alias("n0"), F.sum(F.col("tp") * (F.col("bq") + F.col("tq") / 2)).alias("won"))
    met = own.join(whole, [*by, score])
    met = met.join(totals, by) if by else met.crossJoin(totals)
    genuine = F.sum(F.col("p") * (F.col("bq") + F.col("tq") / 2))
    impostor = F.sum(F.col("q") * (F.col("n1") - F.col("bp") - F.col("tp") + F.col("tp") / 2))
    both = F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2))
    g = met.groupBy(*by, F.col(pid).alias("left_out")).agg((F.first("won") - genuine - impostor + both).alias("won"), (F.first("n1") - F.sum("p")).alias("n1"), (F.first("n0") - F.sum("q")).alias("n0"))
    return g.withColumn("auc", F.col("won") / F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("n1") * F.col("n0"))).drop("won")


def weighted_fusion(scores: DataFrame, key: list[str], z: str = "z", weight: str = "w") -> DataFrame:
    """Weighted mean of the scores that are there; a missing modality contributes nothing."""
    have = F.when(F.col(z).isNotNull(), F.col(weight))
    return scores.groupBy(*key).agg((F.sum(F.col(z) * F.col(weight)) / F.when(F.sum(have) > 0, F.sum(have))).alias("fused"), F.count(z).alias("n_modalities"))


def rank_candidates(scored: DataFrame, by: str = "trust_id", cand: str = "cand", score: str = "z") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), cand)))


def permuted(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """key and another key of the same set: a permutation fixed by the seed, for label controls.

    Keys are identities or sessions: they are numbered in the order of a fixed arithmetic mix of their hash and the seed."""
    a = keys.select(key).distinct()
    x = value_ranks(a.withColumn("__k", F.xxhash64(key)), [], "__k").select(F.col("__k").alias("__kx"), F.col("below_n").alias("o"))
    y = value_ranks(a.withColumn("__k", F.xxhash64(F.lit(seed), key)), [], "__k").select(F.col("__k").alias("__ky"), F.col("below_n").alias("o"))
    left = a.withColumn("__kx", F.xxhash64(key)).join(x, "__kx").select(key, "o")
    return left.join(a.select(F.col(key).alias("other"), F.xxhash64(F.lit(seed), key).alias("__ky")).join(y, "__ky").select("other", "o"), "o").drop("o")
