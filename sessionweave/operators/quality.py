"""Quality gates: checks give rows (check, severity, value, passed), so a report is a union and a verdict an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graded(df: DataFrame, name: str, value: Column, hard: Column | None = None, warn: Column | None = None) -> DataFrame:
    """One row: the aggregate value and whether it fails hard, warns or passes."""
    v = df.agg(value.cast("double").alias("value"))
    status = F.lit("PASS") if warn is None else F.when(warn, "WARN").otherwise("PASS")
    status = status if hard is None else F.when(hard, "FAIL").otherwise(status)
    return v.select(F.lit(name).alias("check"), F.round("value", 6).alias("value"), status.alias("status"))


def report(windows: DataFrame, key: list[str], flags: list[str], least_rows: int, least_groups: int, group: str) -> DataFrame:
    """Non-empty, duplicate keys, presence of each flag, low activity and sample size."""
    v = F.col("value")
    dup = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = [graded(windows, "non_empty", F.count(F.lit(1)), v == 0), graded(dup, "duplicate_keys", F.coalesce(F.sum("n"), F.lit(0)), v > 0)]
    out += [graded(windows, f"presence_{f}", F.avg(F.when(F.col(f), 1.0).otherwise(0.0)), v < 0.05, v < 0.2) for f in flags]
    none = ~F.greatest(*(F.col(f) for f in flags)) if len(flags) > 1 else ~F.col(flags[0])
    out += [graded(windows, "low_activity", F.avg(F.when(none, 1.0).otherwise(0.0)), v > 0.8, v > 0.5)]
    out += [graded(windows, "sample_size", F.count(F.lit(1)), None, v < least_rows), graded(windows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "groups", F.count(F.lit(1)), None, v < least_groups)]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def core_missing(windows: DataFrame, columns: dict[str, str], warn_at: float = 0.5) -> DataFrame:
    """Share of missing values of core columns among windows where their modality is afforded without conflict; a warning over
    warn_at or where the column isn't there at all.  columns: column -> modality."""
    out = None
    for c, m in columns.items():
        ok = F.coalesce(F.col(f"{m}_afforded"), F.lit(False)) & ~F.coalesce(F.col(f"{m}_straddle_conflict"), F.lit(False))
        if c in windows.columns:
            one = graded(windows.where(ok), f"core_missing_{c}", F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)), None, F.coalesce(F.col("value") > warn_at, F.lit(False)))
        else:
            one = graded(windows.limit(0), f"core_missing_{c}", F.lit(None), None, F.lit(True))
        out = one if out is None else out.unionByName(one)
    return out


def session_distribution(windows: DataFrame, group: str, session: str) -> DataFrame:
    """How many participants have each number of sessions: says which can be enrolled and probed."""
    n = windows.groupBy(group).agg(F.count_distinct(session).alias("n"))
    return n.groupBy(F.concat(F.lit("sessions_"), F.col("n").cast("string")).alias("check")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("status", F.lit("INFO"))


def run_checks(windows: DataFrame, checks: dict) -> DataFrame:
    """Union of the results of checks (name -> function of windows); one that raises is a failure of that name."""
    out = None
    for name, check in checks.items():
        try:
            one = check(windows)
            one = one.sparkSession.createDataFrame(one.collect(), "check string, value double, status string")  # a few rows
        except Exception:  # noqa: BLE001 - whatever it is, the gate must say so and go on
            one = windows.sparkSession.createDataFrame([(f"{name}_raised", None, "FAIL")], "check string, value double, status string")
        out = one if out is None else out.unionByName(one)
    return out


def messages(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Each row with verdict FAIL, WARN or PASS and the names of the rules it breaks; a rule is (severity, broken if true)."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"{sev}:{n}")) for n, (sev, c) in rules.items())), lambda x: x.isNotNull())
    out = rows.withColumn("issues", broken)
    fail = F.exists("issues", lambda x: x.startswith("FAIL:"))
    return out.withColumns({"verdict": F.when(fail, "FAIL").when(F.size("issues") > 0, "WARN").otherwise("PASS"), "issues": F.concat_ws("; ", "issues")})


def contradiction(windows: DataFrame, afforded: str, observed: str, conflict: str) -> DataFrame:
    """Windows where something was observed that is known not to be afforded, and the share that conflicts explain."""
    bad = (F.col(afforded) == F.lit(False)) & F.col(observed)
    return windows.agg(F.count(F.when(bad, 1)).alias("n_contradictions"), F.avg(F.when(bad, F.when(F.col(conflict), 1.0).otherwise(0.0))).alias("explained"))
