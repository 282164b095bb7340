"""Column builders for the fixed nine-statistic summary and for circular values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = ("n", "mean", "std", "cv", "median", "iqr", "p95", "max", "slope")


def finite(x: Column) -> Column:
    """Null where x is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(x: Column) -> Column:
    """x as a finite double, null where it is no number."""
    return finite(x.try_cast("double"))


def rounded(x: Column, places: int) -> Column:
    """x to places digits, half away from zero, told by the scaled double as in the SQL; F.round tells it by the decimal form of x.

    Zero keeps the sign of x, which F.round drops."""
    return F.when(F.abs(x) <= 1e300, F.signum(x) * (F.round(F.abs(x) * 10.0**places) / 10.0**places)).otherwise(x)


def stat_columns(prefix: str) -> list[str]:
    return [f"{prefix}_{s}" for s in SUFFIXES]


def nine_stats(value: Column, time: Column, prefix: str, where: Column | None = None) -> list[Column]:
    """Aggregates n, mean, std, cv, median, iqr, p95, max and slope of value over time.

    Only finite values count.  All are null if no row meets where; n is 0 if rows do but no value is finite.  Spread needs
    two values, slope three at more than one time."""
    row = F.lit(True) if where is None else where
    v = F.when(row, finite(value))
    t = F.when(v.isNotNull(), time.cast("double"))
    n, mean, std = F.count(v), F.avg(v), F.stddev_samp(v)
    q = lambda p: F.percentile(v, F.lit(p))
    return [
        F.when(F.count(F.when(row, 1)) > 0, n).alias(f"{prefix}_n"),
        mean.alias(f"{prefix}_mean"),
        F.when(n >= 2, std).alias(f"{prefix}_std"),
        F.when((n >= 2) & (F.abs(mean) > 1e-9), std / F.abs(mean)).alias(f"{prefix}_cv"),
        q(0.5).alias(f"{prefix}_median"),
        F.when(n >= 2, q(0.75) - q(0.25)).alias(f"{prefix}_iqr"),
        F.when(n >= 2, q(0.95)).alias(f"{prefix}_p95"),
        F.max(v).alias(f"{prefix}_max"),
        F.when((n >= 3) & (F.max(t) > F.min(t)), F.regr_slope(v, t)).alias(f"{prefix}_slope"),
    ]


def circular_encode(degrees: Column) -> tuple[Column, Column]:
    r = F.radians(degrees)
    return F.sin(r), F.cos(r)


def circular_mean(sin: Column, cos: Column) -> Column:
    """Mean angle in degrees, 0 to 360, of encoded angles (an aggregate)."""
    return F.pmod(F.degrees(F.atan2(F.avg(sin), F.avg(cos))) + 360.0, F.lit(360.0))


def share(condition: Column) -> Column:
    """Fraction of rows that meet condition; a null condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of rows where both are known, null where either doesn't vary; an aggregate, or over a window."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y), F.min(x), F.max(x), F.min(y), F.max(y)]
    c, a, b, x0, x1, y0, y1 = parts if over is None else [q.over(over) for q in parts]
    return c / F.when((x0 < x1) & (y0 < y1) & (a * b > 0), a * b)
