"""Array and vector expressions (ARR, MTH-11, SCL-07, DST)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector is divided by 1 (SCL-07)."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def kernel_distance(a: Column, b: Column) -> Column:
    """sqrt(2 - 2 cos), never below 0 (DST-04)."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b) / (norm(a) * norm(b))))


def hellinger(p: Column, q: Column) -> Column:
    """sqrt(half the squared difference of the roots) (DST-03)."""
    return F.sqrt(0.5 * total(F.zip_with(p, q, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))))


def finite_only(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def sorted_stats(a: Column) -> dict[str, Column]:
    """Smallest, middle and largest of an array and its spread (ARR-01, MTH-07)."""
    s = F.sort_array(a)
    return {"low": F.element_at(s, 1), "high": F.element_at(s, -1), "span": F.element_at(s, -1) - F.element_at(s, 1), "mean": mean(a)}


def median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")).cast("double") + F.element_at(s, (n / 2).cast("int") + 1).cast("double")) / 2)


def mad(a: Column) -> Column:
    """Median of the absolute differences from the median (AGG-08)."""
    m = median(a)
    return median(F.transform(a, lambda x: F.abs(x.cast("double") - m)))
