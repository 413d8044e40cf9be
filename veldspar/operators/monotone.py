"""Nondecreasing fits and their inverse, of curves of any length (STA-16).

Neighbouring violators are pooled within ranges of x, a range to a task; as long as the last block
of a range lies above the first one of the next, the ranges are cut elsewhere and pooled again.
What is left are blocks (lo, hi, weight, fit) of strictly rising fits, equal to those of pooling
from left to right.  The driver sees two numbers per range.

A round takes in everything that one range of ``rows`` blocks can pool, so a block that must swallow
many long rising stretches needs as many rounds as these have ranges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import cut_lineage

#: Rows of a range.
ROWS = 100_000


def curve(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """x, weight, total (of weight times y), a row per distinct x; rows with a null, NaN or infinite value or without a positive weight are left out."""
    src = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyw"]
    return src.where(finite[0] & finite[1] & finite[2] & (F.col("w") > 0)).groupBy((F.col("x") + 0.0).alias("x")).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))


def _cuts(df: DataFrame, value: str, n: int, rows: int, shift: float = 0.0) -> list[float]:
    """Values that cut the rows into ranges of about ``rows``."""
    parts = max(1, -(-n // rows))
    at = [p for p in ((i + shift) / parts for i in range(parts + 1)) if 0 < p < 1]
    return sorted(set(df.approxQuantile(value, at, 0.1 / parts))) if parts > 1 else []


def _ranged(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """With ``part``, the range that the value is in."""
    inf = float("inf")
    if not cuts:
        return df.withColumn("part", F.lit(0.0))
    return Bucketizer(splits=[-inf, *cuts, inf], inputCol="_value", outputCol="part").transform(df.withColumn("_value", F.col(value))).drop("_value")


def _pool(p: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one range, pooled from left to right."""
    p = p.sort_values("lo")
    part, out = p["part"].iloc[0], []
    for lo, hi, w, s in zip(p["lo"], p["hi"], p["weight"], p["total"], strict=True):
        while out and out[-1][3] / out[-1][2] >= s / w:
            lo, _, w0, s0 = out.pop()
            w, s = w + w0, s + s0
        out.append((lo, hi, w, s))
    lo, hi, w, s = (np.array(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"lo": lo, "hi": hi, "weight": w, "total": s, "part": part})


def pooled(points: DataFrame, rows: int = ROWS, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """lo, hi, weight, fit of the blocks of a :func:`curve`; empty for an empty one."""
    blocks, turn = keep(points.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "weight", "total")), 0
    while True:
        n = blocks.count()
        # Another place for the cuts in each round.
        cuts = _cuts(blocks, "lo", n, rows, (turn * 0.6180339887498949) % 1)
        done = _ranged(blocks.drop("part", "fit"), "lo", cuts).groupBy("part").applyInPandas(_pool, "lo double, hi double, weight double, total double, part double")
        blocks = keep(done.withColumn("fit", F.col("total") / F.col("weight")))
        ends = blocks.groupBy("part").agg(F.min("fit").alias("first"), F.max("fit").alias("last")).orderBy("part").collect()
        if all(a["last"] < b["first"] for a, b in zip(ends, ends[1:], strict=False)):
            return blocks.select("lo", "hi", "weight", "fit")
        turn += 1


def _carried(rows: DataFrame, order: list, name: str, value) -> DataFrame:
    """With the last ``value`` (a struct or null) at or before each row in ``name``, within ranges and from the ranges before."""
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
    # A row per range.
    tails = rows.groupBy("part").agg(F.max_by(name, F.struct(*order)).alias("_tail"))
    before = tails.select("part", F.last("_tail", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return rows.join(before, "part").withColumn(name, F.coalesce(name, "_before")).drop("_before")


def fitted(points: DataFrame, blocks: DataFrame, rows: int = ROWS) -> DataFrame:
    """x, weight, y, fit of each distinct x of a :func:`curve`."""
    cuts = _cuts(points, "x", points.count(), rows)
    none = F.lit(None).cast("double")
    both = points.select("x", F.lit(1).alias("kind"), "weight", (F.col("total") / F.col("weight")).alias("y"), none.alias("fit")).unionByName(blocks.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), none.alias("weight"), none.alias("y"), "fit"))
    return _carried(_ranged(both, "x", cuts), ["x", "kind"], "fit", F.col("fit")).where("kind = 1").select("x", "weight", "y", "fit")


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None, rows: int = ROWS) -> DataFrame:
    """x, weight, y (mean), fit: the nondecreasing fit of y on x (STA-16), a row per distinct x."""
    points = cut_lineage(curve(df, x, y, weight))
    return fitted(points, pooled(points, rows), rows)


def inverse(blocks: DataFrame, readings: DataFrame, value: str, top: float | None = None, rows: int = ROWS) -> DataFrame:
    """The rows of ``readings`` with ``x``: where the fit reads ``value`` (STA-16).

    Between two blocks by straight lines, at a flat piece its right end; at or below the lowest fit
    the smallest x, at or above the highest one ``top`` (by default the largest x).  Null for null
    and NaN readings and for an empty curve.
    """
    asked = readings.select((F.col(value).cast("double") + 0.0).alias("v")).where("v is not null and not isnan(v)").distinct()
    none = F.lit(None).cast("struct<f:double,lo:double,hi:double>")
    knots = blocks.select(F.col("fit").alias("v"), F.lit(0).alias("kind"), F.struct(F.col("fit").alias("f"), "lo", "hi").alias("knot"))
    both = knots.unionByName(asked.select("v", F.lit(1).alias("kind"), none.alias("knot")))
    both = _ranged(both, "v", _cuts(both, "v", both.count(), rows))
    down = _carried(both, ["v", "kind"], "below", F.col("knot")).where("kind = 1").select("v", "below")
    # The same from the other side, on values of the other sign.
    back = both.select((-F.col("v")).alias("v"), (-F.col("part")).alias("part"), "kind", "knot")
    up = _carried(back, ["v", "kind"], "above", F.col("knot")).where("kind = 1").select((-F.col("v")).alias("v"), "above")
    lo, hi = F.col("below"), F.col("above")
    line = lo["hi"] + (hi["lo"] - lo["hi"]) * (F.col("v") - lo["f"]) / (hi["f"] - lo["f"])
    last = blocks.agg(F.max("hi").alias("end"), F.max("fit").alias("highest"), F.min("fit").alias("lowest"), F.min("lo").alias("start"))
    high = F.lit(top).cast("double") if top is not None else F.col("end")
    j = down.join(up, "v").crossJoin(F.broadcast(last))  # one row
    x = F.when(F.col("v") >= F.col("highest"), high).when(F.col("v") <= F.col("lowest"), F.col("start")).when(hi["f"] == F.col("v"), hi["hi"]).otherwise(line)
    return readings.withColumn("_v", F.col(value).cast("double") + 0.0).join(j.select(F.col("v").alias("_v"), x.alias("x")), "_v", "left").drop("_v")
