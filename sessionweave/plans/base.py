"""Tables of the test data as the data model of the library sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR, DAY = 3600.0, 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def elapsed_seconds(ts, first):
    """Exact seconds between two timestamps with or without a zone, whatever the session's zone."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + (ts - first)) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s session, id, t seconds since the session's first event, kind, v value, k from the JSON payload."""
    e = table(spark, sf_dir, "events")
    e = e.join(e.groupBy("user_id").agg(F.min("ts").alias("__first")), "user_id")
    first = F.col("__first")
    return e.select(F.col("user_id").alias("s"), F.col("event_id").alias("id"), elapsed_seconds(F.col("ts"), first).alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"))


#: The same view in SQL, to begin a WITH list.
EV = """WITH RECURSIVE ev AS (
  SELECT user_id AS s, event_id AS id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS t,
         event_type AS kind, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals between a session's purchases: start, end (the next purchase or half a day later, if that is sooner), task
    type by the payload, afforded (null for one type in five)."""
    w = Window.partitionBy("s").orderBy("t", "id")
    p = events(spark, sf_dir).where("kind = 'purchase'")
    end = F.least(F.lead("t").over(w), F.col("t") + 36 * HOUR)
    return p.select("s", F.col("t").alias("start"), F.coalesce(end, F.col("t") + 36 * HOUR).alias("end"), (F.col("k") % 5).alias("task_type"), F.when(F.col("k") % 5 != 4, F.col("k") % 2 == 0).alias("afforded"))


TASKS = EV + """, tk AS (
  SELECT s, t AS start, coalesce(least(lead(t) OVER (PARTITION BY s ORDER BY t, id), t + 129600.0), t + 129600.0) AS "end",
         k % 5 AS task_type, CASE WHEN k % 5 <> 4 THEN k % 2 = 0 END AS afforded FROM ev WHERE kind = 'purchase')"""

GRID = """g0 AS (SELECT s, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY s),
g AS (SELECT s, i AS window_index, t0 + i * 86400.0::DOUBLE AS window_start, t0 + i * 86400.0::DOUBLE + 172800.0::DOUBLE AS window_end
      FROM g0, LATERAL (SELECT unnest(range(0, CAST(floor((t1 - t0 - 172800.0) / 86400.0) AS BIGINT) + 1)) AS i) WHERE t1 - t0 >= 172800.0)"""


def nine_sql(v: str, t: str, prefix: str) -> str:
    """The nine statistics in DuckDB SQL."""
    return f"""count({v}) AS {prefix}_n, round(avg({v}), 6) AS {prefix}_mean, round(CASE WHEN count({v}) >= 2 THEN stddev_samp({v}) END, 6) AS {prefix}_std,
 round(CASE WHEN count({v}) >= 2 AND abs(avg({v})) > 1e-9 THEN stddev_samp({v}) / abs(avg({v})) END, 6) AS {prefix}_cv, round(quantile_cont({v}, 0.5), 6) AS {prefix}_median,
 round(CASE WHEN count({v}) >= 2 THEN quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) END, 6) AS {prefix}_iqr, round(CASE WHEN count({v}) >= 2 THEN quantile_cont({v}, 0.95) END, 6) AS {prefix}_p95,
 max({v}) AS {prefix}_max, round(CASE WHEN count({v}) >= 3 AND max({t}) > min({t}) THEN regr_slope({v}, {t}) END * 86400, 4) AS {prefix}_slope"""
