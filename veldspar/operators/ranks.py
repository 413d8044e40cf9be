"""Order statistics without a global sort in one task (WIN, AGG-07).

Ranks and exact quantiles come from value counts: values are counted, cut into ranges by approximate
quantiles of the distinct ones, summed up per range (a bounded number of ranges), and numbered
within each range; of many features or groups at once, in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are cut into.
RANGES = 64


def grouped_positions(df: DataFrame, groups: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """groups, value, range, n (rows), before (rows of smaller values), and given sums with ``<name>_before`` of each.

    Nulls are left out.  One row per group and distinct value.  Values are counted before any window
    (summed up by the tasks first), each group's distinct values are cut into ranges, and a window
    sees the values of one range; so one group, or one value, may hold all rows.
    """
    sums = {"n": F.lit(1), **sums}
    keys = list(groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(*(F.sum(c).cast("long").alias(k) for k, c in sums.items()))
    # A row of RANGES cuts per group.
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(F.col("value").cast("double"), [i / RANGES for i in range(1, RANGES)], 2000).alias("_cuts"))
    x = F.col("value").cast("double")
    counts = counts.join(cuts, keys).withColumn("range", F.size(F.filter("_cuts", lambda c: c <= x))).drop("_cuts")
    totals = counts.groupBy(*keys, "range").agg(*(F.sum(k).alias(k) for k in sums))
    # At most RANGES rows of a group.
    up = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "range", *(F.coalesce(F.sum(k).over(up), F.lit(0)).alias(f"{k}_base") for k in sums))
    within = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(base, [*keys, "range"])
    cols = []
    for k in sums:
        cols += [F.col(k), (F.col(f"{k}_base") + F.coalesce(F.sum(k).over(within), F.lit(0))).cast("long").alias("before" if k == "n" else f"{k}_before")]
    return placed.select(*keys, "value", "range", *cols)


def value_positions(df: DataFrame, value: str, **sums: Column) -> DataFrame:
    """value, n (rows), before (rows of smaller values), and given sums with ``<name>_before`` of each, over the whole table."""
    return grouped_positions(df.withColumn("_all", F.lit(0)), ["_all"], value, **sums).drop("_all", "range")


def grouped_average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the average rank of each value in its group; null for null. No window sees a whole group."""
    p = grouped_positions(df, groups, value).select(*groups, F.col("value").alias(value), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(p, [*groups, value], "left")


def quantile_columns(total: Column, ps: dict[str, float], before: str = "before", n: str = "n") -> list[Column]:
    """Aggregates over positions that give the values on both sides of each quantile; ``total`` is the group's number of rows."""
    out = []
    for name, p in ps.items():
        h = F.lit(p) * (total - 1)
        for side, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            out.append(F.max(F.when((F.col(before) <= k) & (k < F.col(before) + F.col(n)), F.col("value").cast("double"))).alias(f"_{name}_{side}"))
        out.append(F.max(h - F.floor(h)).alias(f"_{name}_at"))
    return out


def quantile_of(name: str) -> Column:
    """The quantile from the columns that :func:`quantile_columns` made."""
    return F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_at")


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str, **ps: float) -> DataFrame:
    """groups and linear-interpolation quantiles by name, exact, without gathering a group (AGG-06, AGG-07)."""
    pos = grouped_positions(df, groups, value)
    totals = pos.groupBy(*groups).agg(F.sum("n").alias("_total"))
    got = pos.join(totals, list(groups)).groupBy(*groups).agg(*quantile_columns(F.col("_total"), ps))
    return got.select(*groups, *(quantile_of(k).alias(k) for k in ps))


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``df`` with the average rank of each value (ties share it); null for null (WIN-04)."""
    p = value_positions(df, value).select(F.col("value").alias(value), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(p, value, "left")


def percent_rank(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Average rank over the number of non-null values (WIN-01)."""
    n = df.where(F.col(value).isNotNull()).count()
    return average_rank(df, value, out).withColumn(out, F.col(out) / F.lit(float(n)))


def exact_quantiles(df: DataFrame, value: str, ps: Sequence[float]) -> list[float]:
    """Linear-interpolation quantiles; reads at most two values per quantile back (AGG-06, AGG-07)."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [float("nan")] * len(ps)
    places = {int(k) for p in ps for k in (p * (n - 1) // 1, -(-p * (n - 1) // 1))}
    pos = value_positions(df, value)
    hit = F.lit(False)
    for k in places:
        hit = hit | ((F.col("before") <= k) & (k < F.col("before") + F.col("n")))
    rows = pos.where(hit).collect()
    at = {k: float(r.value) for k in places for r in rows if r.before <= k < r.before + r.n}
    out = []
    for p in ps:
        h = p * (n - 1)
        lo, hi = int(h // 1), int(-(-h // 1))
        out.append(at[lo] + (at[hi] - at[lo]) * (h - lo))
    return out


def quantile_bins(df: DataFrame, value: str, q: int, out: str = "bin") -> DataFrame:
    """Quantile bins 0..q-1, right-closed, repeated edges dropped (WIN-06)."""
    edges = sorted({round(e, 9) for e in exact_quantiles(df, value, [i / q for i in range(q + 1)])})
    b = F.lit(0)
    for e in edges[1:-1]:
        b = b + F.when(F.round(F.col(value), 9) > e, 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), b))


def cut_bins(value: Column, edges: Sequence[float], right: bool = False, include_lowest: bool = False) -> Column:
    """Bins between edges, null outside (WIN-07); closed on the left, or on the right as ``cut`` has it."""
    b = F.lit(-1)
    for k, e in enumerate(edges):
        above = value > e if right and not (include_lowest and k == 0) else value >= e
        b = b + F.when(above, 1).otherwise(0)
    if right:
        low = value >= edges[0] if include_lowest else value > edges[0]
        return F.when(low & (value <= edges[-1]), b)
    return F.when((value >= edges[0]) & (value < edges[-1]), b)


def ecdf(df: DataFrame, value: str, pool: Column | None = None, side: str = "left", out: str = "ecdf") -> DataFrame:
    """Share of the pool below each value; ``mid`` counts half of the ties (WIN-08, WIN-09)."""
    ref = df.where(pool) if pool is not None else df
    total = ref.where(F.col(value).isNotNull()).count()
    one = F.when(pool, 1).otherwise(0) if pool is not None else F.lit(1)
    p = value_positions(df, value, pool=one)
    share = (F.col("pool_before") + (F.col("pool") / 2 if side == "mid" else F.lit(0))) / F.lit(float(max(total, 1)))
    return df.join(p.select(F.col("value").alias(value), share.alias(out)), value, "left")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: Sequence[str], *order: Column) -> DataFrame:
    """Best k of each group; plans a group limit before the shuffle (SRT-04)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= k)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Adjusted p-values: running minimum from the largest of p * m / rank (WIN-12).

    Equal p-values share the rank of the last of them, which gives the same result.  The minimum of
    a range's later values is carried from range to range, so no window sees all values.
    """
    m = df.where(F.col(p).isNotNull()).count()
    pos = grouped_positions(df.withColumn("_all", F.lit(0)), ["_all"], p)
    raw = pos.select("range", "value", (F.col("value") * F.lit(float(m)) / (F.col("before") + F.col("n"))).alias("raw"))
    least = raw.groupBy("range").agg(F.min("raw").alias("least"))
    later = least.select("range", F.min("least").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    own = F.min("raw").over(Window.partitionBy("range").orderBy("value").rowsBetween(0, Window.unboundedFollowing))
    adj = raw.join(F.broadcast(later), "range").select(F.col("value").alias(p), F.least(F.lit(1.0), own, F.col("later")).alias(out))
    return df.join(adj, p, "left")


def median_deviation(df: DataFrame, value: str) -> tuple[float, float]:
    """Median, and median of the absolute differences from it (AGG-08)."""
    (m,) = exact_quantiles(df, value, [0.5])
    apart = df.where(F.col(value).isNotNull()).select(F.abs(F.col(value) - F.lit(m)).alias("apart"))
    return m, exact_quantiles(apart, "apart", [0.5])[0]
