"""Null-safe numeric expressions (MTH, PRJ, FLT)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "missing" in source files.
SENTINELS = (-99999, -99999.0)
SENTINEL_TEXTS = ("na", "n/a", "nan", "none", "")


def finite(c: Column) -> Column:
    """The value, or null if it is NaN or infinite (FLT-06)."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sentinel_to_null(c: Column, text: bool = False) -> Column:
    """Missing-value codes become null; a legitimate 0 stays (SRC, PRJ-12)."""
    if text:
        return F.when(~F.lower(F.trim(c)).isin(*SENTINEL_TEXTS), c)
    return F.when(~c.isin(*SENTINELS) & ~F.isnan(c.cast("double")), c)


def to_number(c: Column) -> Column:
    """Number in a text, null if there is none (PRJ-11)."""
    return finite(F.trim(c).try_cast("double"))


def safe_log10(c: Column, eps: float = 0.0) -> Column:
    """log10 of positive values, null for others (MTH-01)."""
    x = c + F.lit(eps) if eps else c
    return F.when(x > 0, F.log10(x))


def safe_divide(a: Column, b: Column, eps: float = 0.0) -> Column:
    """a / (b + eps), null where the divisor is 0 (MTH-05)."""
    return F.try_divide(a.cast("double"), (b + F.lit(eps)).cast("double"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null (PRJ-13)."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def log_ratio(a: Column, b: Column, cap: float = 6.0, floor: float = 1e-9) -> Column:
    """log10(a / b), the cap where b is nearly 0 and a is not (MTH-04)."""
    return F.when(b > floor, F.log10(F.greatest(a, F.lit(floor)) / b)).when(a > floor, F.lit(cap)).otherwise(F.lit(0.0))


def geometric_mean(*cs: Column) -> Column:
    """Over the positive values of a row, null if there is none (MTH-03)."""
    logs = [F.when(c > 0, F.ln(c)) for c in cs]
    total = reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0.0)) for v in logs])
    n = reduce(lambda x, y: x + y, [F.when(v.isNotNull(), 1).otherwise(0) for v in logs])
    return F.when(n > 0, F.exp(total / n))


def entropy(fractions: Column) -> Column:
    """Shannon entropy (nats) of an array of fractions; zeros count nothing (MTH-09)."""
    return -F.aggregate(fractions, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))


def between(c: Column, low, high) -> Column:
    """Inclusive range (FLT-03)."""
    return c.between(low, high)


def row_max(*cs: Column) -> Column:
    return F.greatest(*cs)


def row_mean(*cs: Column) -> Column:
    """Mean of the non-null values of a row (PRJ-14)."""
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in cs])
    n = reduce(lambda x, y: x + y, [F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    return F.when(n > 0, total / n)


def select_case(*branches: tuple[Column, str], otherwise: str | None = None) -> Column:
    """First branch that holds (PRJ-07)."""
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def reciprocal_fallback(value: Column, inverse: Column) -> Column:
    """The value, else the reciprocal of a positive inverse quantity (PRJ-06)."""
    return F.coalesce(value, F.when(inverse > 0, 1 / inverse))


def map_labels(c: Column, table: dict[str, str], keep: bool = False) -> Column:
    """Label of a key; one without is null, or kept as it is (PRJ-10, MAP-02)."""
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]
    return F.coalesce(found, c) if keep else found


def null_outside(c: Column, low: float, high: float) -> Column:
    """Null in place of a value outside its valid range; the row stays (PRJ-12)."""
    return F.when(c.between(low, high), c)


def fill_missing(c: Column, value: Column | float = 0.0) -> Column:
    """A value in place of null, NaN and infinity (MTH-06)."""
    return F.coalesce(finite(c), value if isinstance(value, Column) else F.lit(value))


def positive_all(*cs: Column) -> Column:
    """Are all values finite and above 0? Null is not (FLT-06)."""
    return reduce(lambda x, y: x & y, [F.coalesce(finite(c) > 0, F.lit(False)) for c in cs])


def admitted(*cs: Column) -> Column:
    """Are all fields present and not 0, empty or false? (FLT-08)"""
    return reduce(lambda x, y: x & y, [F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false") == F.lit(False) for c in cs])


def select_by_name(df, pattern: str, prefix: str = ""):
    """Columns whose names match an expression, under prefixed names (PRJ-15)."""
    import re

    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns if re.search(pattern, c)))


def columns_named(spark, tables: dict, *words: str):
    """(table, column) of every column whose name holds one of the words; only schemas are read (FLT-13)."""
    rows = [(t, c) for t, df in tables.items() for c in df.columns if any(w.lower() in c.lower() for w in words)]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def require(c: Column, message: str, value: Column) -> Column:
    """The value, or an error where the condition does not hold or is null (MTH-20)."""
    return F.when(F.coalesce(c, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double"))
