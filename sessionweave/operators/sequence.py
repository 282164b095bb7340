"""Operators over ordered event sequences.  All are window functions over one partitioning by session, never range joins:
as-of and next-event look-ups run over the union of both sides, pairing is a running maximum, islands are running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation


def _ordered(s: str, *order: str):
    return Window.partitionBy(s).orderBy(*order)


def as_of(observations: DataFrame, intervals: DataFrame, columns: list[str], clear: list[str], s: str = "s", t: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Observations with columns of the last interval with start <= t; those in clear are null once t > end.

    start and end are carried too."""
    names = list(dict.fromkeys([*columns, start, end]))
    obs = observations.select("*", F.lit(1).alias("__o"), F.col(t).alias("__t"), F.lit(None).cast(_struct(intervals, names)).alias("__c"))
    ctx = intervals.select(F.col(s), F.lit(0).alias("__o"), F.col(start).alias("__t"), F.struct(*names).alias("__c"))
    both = obs.unionByName(ctx, allowMissingColumns=True)
    w = Window.partitionBy(s).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__c", F.last("__c", ignorenulls=True).over(w)).where("__o = 1")
    late = F.col(t) > F.col(f"__c.{end}")
    return both.select(*observations.columns, *(F.when(~F.coalesce(late, F.lit(False)), F.col(f"__c.{c}")).alias(c) if c in clear else F.col(f"__c.{c}").alias(c) for c in names))


def _struct(df: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return "struct<" + ",".join(f"{n}:{kinds[n]}" for n in names) + ">"


def next_time(events: DataFrame, target: Column, s: str = "s", t: str = "t", inclusive: bool = False, name: str = "next_t") -> DataFrame:
    """Events with the time of the first event at a later time (or, inclusive, the same) that meets target."""
    hit = F.when(target, F.col(t))
    w = Window.partitionBy(s).orderBy(t)
    frame = w.rangeBetween(0, Window.unboundedFollowing) if inclusive else w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    if inclusive:
        return events.withColumn(name, F.min(hit).over(frame))
    # strictly later: the least hit among the peers of the next distinct time
    by_time = Window.partitionBy(s).orderBy(F.col(t).desc())
    rank = F.dense_rank().over(by_time)
    own = events.withColumn("__r", rank)
    least = F.min(hit).over(Window.partitionBy(s).orderBy("__r").rangeBetween(Window.unboundedPreceding, -1))
    return own.withColumn(name, least).drop("__r")


def nearest_gaps(events: DataFrame, target: Column, s: str = "s", t: str = "t") -> DataFrame:
    """Events with prev_gap to the last target strictly before and next_gap to the first at or after; null if there is none."""
    own = events.withColumn("__hit", F.when(target, F.col(t))).withColumn("__r", F.dense_rank().over(_ordered(s, t)))
    w = Window.partitionBy(s).orderBy("__r")
    return own.withColumns({"prev_gap": F.col(t) - F.max("__hit").over(w.rangeBetween(Window.unboundedPreceding, -1)), "next_gap": F.min("__hit").over(w.rangeBetween(0, Window.unboundedFollowing)) - F.col(t)}).drop("__r", "__hit")


def idle(events: DataFrame, target: Column, guard: float, s: str = "s", t: str = "t") -> DataFrame:
    """Events with is_idle: no target within guard on either side."""
    gaps = nearest_gaps(events, target, s, t)
    return gaps.withColumn("is_idle", (F.coalesce("prev_gap", F.lit(float("inf"))) >= guard) & (F.coalesce("next_gap", F.lit(float("inf"))) >= guard))


def pair_greedy(events: DataFrame, down: Column, up: Column, cancel: Column | None = None, s: str | list[str] = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Greedy pairing of downs with ups: each down in order takes the first up that isn't taken and doesn't precede it.

    With f the ups strictly before a down and i the down's number, the up taken is number i + max(f - i) over the downs so
    far: a running maximum instead of a loop.  An up at the down's own time counts as after it.  A down whose up meets
    cancel takes it but gives no pair.  Returns the downs' rows with up_t."""
    keys = [s] if isinstance(s, str) else s
    e = events.withColumns({"__d": F.coalesce(down, F.lit(False)), "__u": F.coalesce(up, F.lit(False))}).where("__d or __u")
    order = Window.partitionBy(*keys).orderBy(t, F.col("__u").cast("int"), tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"__f": F.sum(F.col("__u").cast("int")).over(so_far), "__i": F.sum(F.col("__d").cast("int")).over(so_far) - 1})
    downs = e.where("__d").withColumn("__m", F.col("__i") + F.max(F.col("__f") - F.col("__i")).over(Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)))
    ups = e.where("__u").select(*keys, (F.col("__f") - 1).alias("__m"), F.col(t).alias("up_t"), (F.lit(False) if cancel is None else F.coalesce(cancel, F.lit(False))).alias("__x"))
    return downs.join(ups, [*keys, "__m"]).where("not __x").select(*events.columns, "up_t")


def transitions(events: DataFrame, label: str, max_gap: float, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Consecutive events at most max_gap apart: the second event's row with dt and prev->cur."""
    w = _ordered(s, t, tie)
    e = events.withColumns({"dt": F.col(t) - F.lag(t).over(w), "transition": F.concat_ws("->", F.coalesce(F.lag(label).over(w), F.lit("null")), F.coalesce(F.col(label), F.lit("null")))})
    return e.where(F.col("dt") <= max_gap)


def islands(events: DataFrame, breaks: Column, s: str = "s", t: str = "t", tie: str = "id", name: str = "island") -> DataFrame:
    """Events numbered by island; a new one begins where breaks is true (it may look back with lag over the same order)."""
    w = _ordered(s, t, tie)
    return events.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def gap_over(limit: float, s: str = "s", t: str = "t", tie: str = "id") -> Column:
    return F.coalesce(F.col(t) - F.lag(t).over(_ordered(s, t, tie)) > limit, F.lit(False))


def changes(column: str, s: str = "s", t: str = "t", tie: str = "id") -> Column:
    return ~F.col(column).eqNullSafe(F.lag(column).over(_ordered(s, t, tie)))


def runs(events: DataFrame, column: str, value, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Maximal runs of events with column = value: s, t of the first, run_length, t_end."""
    e = islands(events, changes(column, s, t, tie), s, t, tie)
    return e.where(F.col(column) == value).groupBy(s, "island").agg(F.min(t).alias(t), F.count(F.lit(1)).alias("run_length"), F.max(t).alias("t_end")).drop("island")


def bursts(events: DataFrame, gap: float, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Bursts of events no more than gap apart: size, duration and the time from the burst before, start to start."""
    e = islands(events, gap_over(gap, s, t, tie), s, t, tie)
    b = e.groupBy(s, "island").agg(F.min(t).alias("burst_start"), F.count(F.lit(1)).alias("size"), (F.max(t) - F.min(t)).alias("duration"))
    return b.withColumn("start_gap", F.col("burst_start") - F.lag("burst_start").over(Window.partitionBy(s).orderBy("burst_start"))).drop("island")


def intervals_between(events: DataFrame, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    w = _ordered(s, t, tie)
    return events.withColumn("dt", F.col(t) - F.lag(t).over(w))


def silence_stats(events: DataFrame, least: float, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Per session: silences (gaps of least or more), their share of the time in percent, per minute, and the longest."""
    e = intervals_between(events, s, t, tie)
    span = F.max(t) - F.min(t)
    quiet = F.when(F.col("dt") >= least, F.col("dt"))
    return e.groupBy(s).agg(F.count(quiet).alias("n_silences"), (F.coalesce(F.sum(quiet), F.lit(0.0)) * 100.0 / F.when(span > 0, span)).alias("idle_pct"), (F.count(quiet) * 60.0 / F.when(span > 0, span)).alias("silences_per_min"), F.max(quiet).alias("longest_silence"))


def rhythm(events: DataFrame, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """Per session: global CV of the intervals (population deviation over mean, more than five) and local CV2 (six or more)."""
    e = intervals_between(events, s, t, tie)
    before = F.lag("dt").over(_ordered(s, t, tie))
    e = e.withColumn("c", F.when(F.col("dt") + before > 0, 2.0 * F.abs(F.col("dt") - before) / (F.col("dt") + before)))
    n = F.count("dt")
    return e.groupBy(s).agg(n.alias("n_intervals"), F.when((n > 5) & (F.avg("dt") > 0), F.stddev_pop("dt") / F.avg("dt")).alias("cv"), F.when(n >= 6, F.avg("c")).alias("cv2"))


def mode_switches(events: DataFrame, column: str, dwell: float, s: str = "s", t: str = "t", tie: str = "id", least: int = 5) -> DataFrame:
    """Per session: switches between runs of column, and those between runs that span dwell or more; 0 under least events."""
    e = islands(events, changes(column, s, t, tie), s, t, tie)
    r = e.groupBy(s, "island").agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("span"))
    total = F.sum("n")
    real = F.sum(F.when(F.col("span") >= dwell, 1).otherwise(0))
    return r.groupBy(s).agg(F.when(total >= least, F.count(F.lit(1)) - 1).otherwise(0).alias("raw_switches"), F.when(total >= least, F.greatest(real - 1, F.lit(0))).otherwise(0).alias("real_switches"))


def longest_run(events: DataFrame, flag: str, s: list[str], t: str = "t", tie: str = "id") -> DataFrame:
    """Length of the longest run of true flags within each group; 0 if there is none."""
    w = Window.partitionBy(*s).orderBy(t, tie)
    e = events.withColumn("__b", F.when(~F.col(flag).eqNullSafe(F.lag(flag).over(w)), 1).otherwise(0)).withColumn("__i", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = e.groupBy(*s, "__i").agg(F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("n"))
    return r.groupBy(*s).agg(F.max("n").alias("longest_run"))


def rolling(events: DataFrame, value: str, rows: int, s: str = "s", t: str = "t", tie: str = "id", least: int | None = None, how: str = "avg") -> DataFrame:
    """Rolling mean or median of the last rows values, null under least of them."""
    w = _ordered(s, t, tie).rowsBetween(-(rows - 1), 0)
    agg = F.avg(value) if how == "avg" else F.percentile(value, F.lit(0.5))
    return events.withColumn("rolled", F.when(F.count(value).over(w) >= (least or rows), agg.over(w)))


def rolling_corr(events: DataFrame, x: str, y: str, rows: int, s: str = "s", t: str = "t", tie: str = "id", least: int = 3) -> DataFrame:
    """Rolling correlation of the differences of x and y."""
    w = _ordered(s, t, tie)
    e = events.withColumns({"__x": F.col(x) - F.lag(x).over(w), "__y": F.col(y) - F.lag(y).over(w)})
    f = w.rowsBetween(-(rows - 1), 0)
    both = F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), 1)
    return e.withColumn("rolled", F.when(F.count(both).over(f) >= least, correlation(F.col("__x"), F.col("__y"), f))).drop("__x", "__y")


def unwrap_degrees(events: DataFrame, value: str, s: str = "s", t: str = "t", tie: str = "id") -> DataFrame:
    """value without jumps of more than half a turn; a jump of exactly half a turn keeps its sign."""
    w = _ordered(s, t, tie)
    d = F.col(value) - F.lag(value).over(w)
    turned = F.pmod(d + 180.0, F.lit(360.0)) - 180.0
    turned = F.when((turned == -180.0) & (d > 0), F.lit(180.0)).otherwise(turned)
    fix = F.when(F.abs(d) < 180.0, 0.0).otherwise(turned - d)
    return events.withColumn("__c", F.coalesce(fix, F.lit(0.0))).withColumn("unwrapped", F.col(value) + F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def detect(scores: DataFrame, threshold: Column, from_t: Column, bar: int = 5, s: str = "s", t: str = "t", value: str = "score") -> DataFrame:
    """Per session the start of the first run of bar consecutive scores over threshold at or after from_t; a null ends a run."""
    e = scores.where(F.col(t) >= from_t).withColumn("__f", F.coalesce(F.col(value) > threshold, F.lit(False)))
    w = Window.partitionBy(s).orderBy(t)
    e = e.withColumn("__b", F.when(~F.col("__f").eqNullSafe(F.lag("__f").over(w)), 1).otherwise(0)).withColumn("__i", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = e.where("__f").groupBy(s, "__i").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("detected_at"))
    return r.groupBy(s).agg(F.min(F.when(F.col("n") >= bar, F.col("detected_at"))).alias("detected_at"), F.max("n").alias("most_consecutive"))
