"""Joins, cleaning and audits (JOIN, FLT, AGG)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """Keys that should be unique are not."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise if a column is missing (FLT-12)."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if a key occurs twice (JOIN-04); the count stops at the first found."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise CardinalityError(f"repeated keys in {', '.join(keys)}")
    return df


def validated_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Equi-join that checks its cardinality first (JOIN-04)."""
    keys = [on] if isinstance(on, str) else list(on)
    if validate in ("many_to_one", "one_to_one"):
        require_unique(right, *keys)
    if validate in ("one_to_many", "one_to_one"):
        require_unique(left, *keys)
    return left.join(right, keys, how)


def rule_violations(df: DataFrame, key: str, rules: Sequence[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """key, rule, field_value, bounds for each broken range rule; nulls pass (FLT-07). One scan."""
    items = []
    for name, column, low, high in rules:
        c = F.col(column).cast("double")
        broken = F.lit(False)
        if low is not None:
            broken = broken | (c < low)
        if high is not None:
            broken = broken | (c > high)
        bounds = f"[{'-inf' if low is None else low}, {'inf' if high is None else high}]"
        items.append(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), c.alias("field_value"), F.lit(bounds).alias("bounds"))))
    bad = df.select(F.col(key), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("v"))
    return bad.select(key, "v.rule", "v.field_value", "v.bounds")


def rule_kept(df: DataFrame, rules: Sequence[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """Rows that break no rule; nulls pass."""
    ok = F.lit(True)
    for _, column, low, high in rules:
        c = F.col(column).cast("double")
        if low is not None:
            ok = ok & F.coalesce(c >= low, F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(c <= high, F.lit(True))
    return df.where(ok)


def best_match(df: DataFrame, group: str, by: str, *tie: str) -> DataFrame:
    """The row with the least ``by`` of each group, first by ``tie``; rows without ``by`` do not compete (JOIN-06).

    A grouped minimum of a struct: summed up before the shuffle, so a large group is no hot spot.
    """
    rest = [c for c in df.columns if c not in (group, by, *tie)]
    best = df.where(F.col(by).isNotNull()).groupBy(group).agg(F.min(F.struct(by, *tie, *rest)).alias("m"))
    return best.select(group, *(F.col(f"m.{c}").alias(c) for c in (by, *tie, *rest)))


def classified_lookup(probe: DataFrame, table: DataFrame, on: str, id_col: str) -> DataFrame:
    """Id if exactly one row matches, else null with the reason; n_matches (JOIN-07)."""
    m = table.groupBy(on).agg(F.count(F.lit(1)).alias("n_matches"), F.min(id_col).alias("one"))
    j = probe.join(m, on, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    n = F.col("n_matches")
    return j.withColumn(id_col, F.when(n == 1, F.col("one"))).withColumn("match_quality", F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("no_match")).drop("one")


def key_overlap(views: dict[str, DataFrame]) -> DataFrame:
    """Sizes and shared keys of every pair of one-column views (JOIN-11): one pass, one shuffle on the key.

    A key's set of views is one bit mask; pairs are counted over the masks, of which there are few.
    """
    names = list(views)
    tagged = None
    for i, n in enumerate(names):
        part = views[n].toDF("k").where("k is not null").select("k", F.lit(1 << i).alias("bit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    masks = tagged.groupBy("k").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    pairs = [F.struct(F.lit(a).alias("view_a"), F.lit(b).alias("view_b"), F.lit(1 << i).alias("ma"), F.lit(1 << j).alias("mb")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    x = masks.select("mask", "n", F.explode(F.array(*pairs)).alias("p"))
    has_a, has_b = F.col("mask").bitwiseAND(F.col("p.ma")) > 0, F.col("mask").bitwiseAND(F.col("p.mb")) > 0

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")

    return x.groupBy("p.view_a", "p.view_b").agg(count(has_a).alias("n_a"), count(has_b).alias("n_b"), count(has_a & has_b).alias("n_both"))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, first or last in the given order (AGG-21), by a grouped minimum of a struct."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = (F.min if keep == "first" else F.max)(F.struct(*order, *rest))
    return df.groupBy(*keys).agg(best.alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def coverage(df: DataFrame) -> DataFrame:
    """field, n, missing, coverage, n_distinct of every column in one aggregation (AGG-23)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in df.columns:
        aggs += [F.count(c).alias(f"{c}__n"), F.countDistinct(c).alias(f"{c}__d")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"{c}__n")).alias("missing"), F.round(F.col(f"{c}__n") / F.col("_n"), 9).alias("coverage"), F.col(f"{c}__d").alias("n_distinct")) for c in df.columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def nearest_within(df: DataFrame, group: Sequence[str], x: str, y: str, at: float, tolerance: float) -> DataFrame:
    """Per group the point nearest to ``at`` within the tolerance, first by x on ties (JOIN-16)."""
    near = df.where(F.abs(F.col(x) - at) <= tolerance).groupBy(*group).agg(F.min(F.struct(F.abs(F.col(x) - at).alias("d"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("m"))
    return near.select(*group, F.col("m.x").alias("x_near"), F.col("m.y").alias("y_near"), F.col("m.d").alias("distance"))


def interpolate_at(df: DataFrame, group: Sequence[str], x: str, y: str, at: float, gap: float) -> DataFrame:
    """Linear interpolation at ``at`` where it lies inside the curve and a knot is within ``gap`` (JOIN-17).

    The knots on both sides are grouped extremes, so no curve is ever collected.
    """
    below = F.max(F.when(F.col(x) <= at, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("lo")
    above = F.min(F.when(F.col(x) >= at, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("hi")
    k = df.groupBy(*group).agg(below, above).where("lo is not null and hi is not null")
    near = F.least(F.lit(at) - F.col("lo.x"), F.col("hi.x") - F.lit(at))
    value = F.when(F.col("hi.x") == F.col("lo.x"), F.col("lo.y")).otherwise(F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (F.lit(at) - F.col("lo.x")) / F.nullif(F.col("hi.x") - F.col("lo.x"), F.lit(0.0)))
    return k.where(near <= gap).select(*group, value.alias("y_at"))


def pareto_front(df: DataFrame, high: str, low: str) -> DataFrame:
    """Rows that no other row beats: as large ``high`` and as small ``low``, one of them strictly (JOIN-20).

    Sort-based instead of all pairs: per ``low`` only its largest ``high`` can stay, and it stays if
    it exceeds every ``high`` at a smaller ``low``.  Distinct ``low`` values are cut into ranges as
    for ranks, so no window sees the whole table.
    """
    best = df.where(F.col(high).isNotNull() & F.col(low).isNotNull()).groupBy(low).agg(F.max(high).alias("_h"))
    cuts = sorted(set(df.approxQuantile(low, [i / 64 for i in range(1, 64)], 0.005)))
    part = F.lit(0)
    for c in cuts:
        part = part + F.when(F.col(low).cast("double") >= c, 1).otherwise(0)
    best = best.withColumn("_part", part)
    tops = best.groupBy("_part").agg(F.max("_h").alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    w = Window.partitionBy("_part").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    front = best.join(F.broadcast(before), "_part").withColumn("_rival", F.greatest("_before", F.max("_h").over(w))).where("_rival is null or _h > _rival").select(low, F.col("_h").alias(high))
    return df.join(front, [low, high], "left_semi")


def aligned_join(meta: DataFrame, features: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """``meta`` in its order with a column for each feature table (key, values), only of keys that all hold (JOIN-05).

    Raises if a key is repeated on any side, or if a table's vectors differ in length.
    """
    require_unique(meta, key)
    out = meta
    for name, df in features.items():
        require_unique(df, key)
        value = next(c for c in df.columns if c != key)
        if df.agg(F.count_distinct(F.size(value)).alias("n")).first().n > 1:
            raise ValueError(f"vectors of {name} differ in length")
        out = out.join(df.select(key, F.col(value).alias(name)), key)
    return out.orderBy(order)


def pivot_unique(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per name; raises if an index has a name twice (AGG-18)."""
    require_unique(df, index, column)
    return df.groupBy(index).pivot(column, list(names)).agg(F.first(value))


def resolvable_head(df: DataFrame, head: int, keep: int, known: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of the first ``head`` rows, the first ``keep`` whose key is known (SRT-11)."""
    return df.orderBy(*order).limit(head).join(known.select(key).distinct(), key, "left_semi").orderBy(*order).limit(keep)


def bind_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two blocks of columns of the same rows, by key; raises unless both hold each key once (SET-02)."""
    require_unique(left, key)
    require_unique(right, key)
    return left.join(right, key, "full")
