"""Sliding windows over sessions, and joins of events and intervals with them.

An event at offset e from the session's start lies in windows floor((e - length) / stride) + 1 to floor(e / stride), so events
are assigned to windows by arithmetic and an exact residual predicate instead of a range join: at most ceil(length / stride)
copies of a row, and one shuffle by (session, window)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH_S, STRIDE_S = 15.0, 7.5


def window_grid(events: DataFrame, s: str = "s", t: str = "t", length: float = LENGTH_S, stride: float = STRIDE_S, carry: list[str] | None = None) -> DataFrame:
    """One row per window: s, window_index, window_start, window_end and the first value of each carried column.

    The first window starts at the session's first event; sessions shorter than length have none; what is left at the end of a
    session is not covered."""
    spans = events.groupBy(s).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), *(F.first(c, ignorenulls=True).alias(c) for c in carry or []))
    n = F.floor((F.col("t1") - F.col("t0") - length) / stride).cast("int") + 1
    rows = spans.where(F.col("t1") - F.col("t0") >= length).withColumn("window_index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("t0") + F.col("window_index") * F.lit(stride)
    return rows.select(s, *(carry or []), "window_index", start.alias("window_start"), (start + length).alias("window_end"))


def assign_windows(events: DataFrame, s: str = "s", t: str = "t", length: float = LENGTH_S, stride: float = STRIDE_S, starts: DataFrame | None = None) -> DataFrame:
    """Events with window_index, window_start and window_end of each window [start, end) they lie in.

    starts(s, t0, t1) gives the sessions' first and last times where events is only a part of the sessions; windows beyond
    the grid are left out."""
    if starts is None:
        w = Window.partitionBy(s)
        e = events.withColumns({"t0": F.min(t).over(w), "t1": F.max(t).over(w)})
    else:
        e = events.join(starts.select(s, "t0", "t1"), s)
    off = F.col(t) - F.col("t0")
    last = F.floor((F.col("t1") - F.col("t0") - length) / stride).cast("int")
    low = F.greatest(F.lit(0), F.floor((off - length) / stride).cast("int"))  # one low and one high: the residual decides
    high = F.least(last, F.floor(off / stride).cast("int") + 1)
    e = e.where((F.col("t1") - F.col("t0") >= length) & (low <= high)).withColumn("window_index", F.explode(F.sequence(low, high)))
    start = F.col("t0") + F.col("window_index") * F.lit(stride)
    e = e.withColumns({"window_start": start, "window_end": start + length})
    return e.where((F.col(t) >= F.col("window_start")) & (F.col(t) < F.col("window_end"))).drop("t0", "t1")


def observed_flags(events: DataFrame, flags: dict[str, Column], s: str = "s", t: str = "t", length: float = LENGTH_S, stride: float = STRIDE_S) -> DataFrame:
    """The grid with one boolean per flag: an event that meets it lies in the window."""
    grid = window_grid(events, s, t, length, stride)
    hits = assign_windows(events, s, t, length, stride).groupBy(s, "window_index").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))
    return grid.join(hits, [s, "window_index"], "left").withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in flags})


def overlapping(intervals: DataFrame, grid: DataFrame, s: str = "s", start: str = "start", end: str = "end", stride: float = STRIDE_S) -> DataFrame:
    """Pairs of grid windows and intervals of a session with interval.start < window_end and interval.end > window_start.

    Both sides go to buckets of a fixed width; a pair is kept in the bucket where the later of the two begins."""
    width = stride * 2
    low = lambda c: F.floor(F.col(c) / width)
    g = grid.withColumn("bucket", F.explode(F.sequence(low("window_start"), low("window_end"))))
    i = intervals.where(F.col(end) >= F.col(start)).withColumn("bucket", F.explode(F.sequence(low(start), low(end))))
    met = g.join(i, [s, "bucket"]).where((F.col(start) < F.col("window_end")) & (F.col(end) > F.col("window_start")))
    return met.where(F.col("bucket") == F.floor(F.greatest(F.col("window_start"), F.col(start)) / width)).drop("bucket")


def straddle_conflicts(intervals: DataFrame, grid: DataFrame, flags: list[str], s: str = "s", start: str = "start", end: str = "end", stride: float = STRIDE_S) -> DataFrame:
    """The grid with n_overlapping and, per flag, whether the overlapping intervals disagree on it.

    Null where no interval overlaps; false where all their flags are null."""
    met = overlapping(intervals, grid.select(s, "window_index", "window_start", "window_end"), s, start, end, stride)
    agg = met.groupBy(s, "window_index").agg(F.count(F.lit(1)).alias("n_overlapping"), *(F.coalesce(F.max(F.col(f).cast("int")) != F.min(F.col(f).cast("int")), F.lit(False)).alias(f"{f}_conflict") for f in flags))
    return grid.join(agg, [s, "window_index"], "left")


def windowed_rate(events: DataFrame, s: str = "s", t: str = "t", length: float = 20.0, stride: float = 5.0) -> DataFrame:
    """Events per second in windows [i * stride, i * stride + length) from time 0 to the session's last event."""
    low = F.greatest(F.lit(0), F.floor((F.col(t) - length) / stride).cast("int"))
    e = events.withColumn("window_index", F.explode(F.sequence(low, F.floor(F.col(t) / stride).cast("int"))))
    e = e.where((F.col(t) >= F.col("window_index") * stride) & (F.col(t) < F.col("window_index") * stride + length))
    return e.groupBy(s, "window_index").agg((F.count(F.lit(1)) / F.lit(length)).alias("rate"))


def copies(length: float, stride: float) -> int:
    """How many windows an event can lie in."""
    return math.ceil(length / stride)
