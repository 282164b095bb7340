"""Scalar column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import number


def seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000.0


def truthy(x: Column) -> Column:
    """True for "true" and "1" in any case; a numeric 1.0 reads "1.0" and is false; null is false."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1"), F.lit(False))


def safe_int(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("int")


def version(x: Column) -> Column:
    """Array of ints that compares as versions do; anything that doesn't parse counts as version 0."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.try_cast("int"))
    return F.when(x.isNull() | F.exists(parts, lambda p: p.isNull()), F.array(F.lit(0))).otherwise(parts)


def magnitude(*axes: Column) -> Column:
    total = F.lit(0.0)
    for a in axes:
        total = total + number(a) * number(a)
    return F.sqrt(total)


def grid_cell(x: Column, cells: int = 8) -> Column:
    return F.least(F.greatest((x * cells).cast("int"), F.lit(0)), F.lit(cells - 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def float_ratio(a: Column, b: Column) -> Column:
    """a / b of doubles by floating-point rules where b is 0: an infinity with the sign of both, NaN if a is 0 too."""
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    return F.coalesce(ratio(a, b), F.when(b == 0, a * sign * F.lit(float("inf"))))


def float_log10(x: Column) -> Column:
    """Logarithm by floating-point rules: minus infinity of 0, NaN of what is below."""
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def gesture_class(scroll_during: Column, scroll_coast: Column, displacement: Column, hold: Column) -> Column:
    """Ordered rules: 5 px of scrolling (a quarter or more of it coasting: fling), 20 px of travel, half a second, else a tap."""
    total = scroll_during + scroll_coast
    return F.when(total >= 5.0, F.when(scroll_coast / total >= 0.25, "scroll_fling").otherwise("scroll_drag")).when(displacement >= 20.0, "drag_swipe").when(hold >= 500.0, "long_press").otherwise("tap")


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin (edges[i], edges[i+1]] that holds x; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def feature_parts(name: Column) -> tuple[Column, Column, Column]:
    """Family, metric and statistic of a feature name."""
    stat = F.regexp_extract(name, r"_(n|mean|std|cv|median|iqr|p95|max|slope)$", 1)
    return F.regexp_extract(name, r"^([a-z]+)_", 1), F.regexp_replace(name, r"_(n|mean|std|cv|median|iqr|p95|max|slope)$", ""), F.when(stat != "", stat)


def hash_fraction(*keys: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for a key: random choices that every run repeats."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) / float(1 << 31)
