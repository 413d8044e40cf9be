"""Mutual information by nearest neighbours, without a table of pairs (STA-18).

Values are taken in whole steps of 10^-digits, so every difference is exact.  Equal points are
counted first, and a point held by more than k rows needs no search; the distance to the k-th
neighbour, by the greater of both differences, comes from the blocks of :mod:`neighbors`.  How many
rows lie nearer than that in one coordinate is a difference of two positions in its order, looked up
for all rows and both coordinates at once (:mod:`ranks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import oof_ridge
from .permutations import deals, dealt, judged, places
from .ranks import grouped_positions
from .vectors import FEW, cut_lineage, knn

EULER = 0.5772156649015329


def digamma(m: Column) -> Column:
    """Of a positive number: eight steps of the recurrence, then the asymptotic series (error below 1e-12)."""
    z = m.cast("double") + 8
    q = 1 / (z * z)
    series = F.log(z) - 0.5 / z - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))
    return series - sum((1 / (m.cast("double") + i) for i in range(1, 8)), 1 / m.cast("double"))


def points(df: DataFrame, key: str, x: str, y: str, digits: int) -> DataFrame:
    """id (least key), n, x, y in whole steps: a row per distinct point. Rows with a null key or a null, NaN or infinite value are left out."""
    both = df.select(F.col(key).cast("long").alias("id"), *(F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"))))
    good = both.where("id is not null" + "".join(f" and {c} is not null and not isnan({c}) and abs({c}) < 1e300" for c in "xy"))
    whole = [F.round(F.col(c) * float(10**digits)).cast("long").alias(c) for c in "xy"]
    return good.select("id", *whole).groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def radii(pts: DataFrame, k: int, few: int = FEW) -> DataFrame:
    """id, n, x, y, eps: the k-th other row's distance by the greater difference; null where there are fewer than k others."""
    single = pts.where(F.col("n") <= k)
    # Enough distinct points to hold k rows; a neighbour may stand for many.
    v = pts.select("id", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("v"))
    near = knn(v, k, "id", "v", "square", few=few).select("id", "neighbor", "distance").join(single.select("id", F.col("n").alias("own")), "id").join(pts.select(F.col("id").alias("neighbor"), F.col("n").alias("many")), "neighbor")
    # k entries of an id.
    held = near.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col("many").alias("m")))).alias("l"))
    start = F.struct((F.col("own") - 1).alias("have"), F.lit(None).cast("double").alias("eps"))
    walk = F.aggregate("l", start, lambda s, e: F.struct((s["have"] + e["m"]).alias("have"), F.when(s["eps"].isNotNull(), s["eps"]).when(s["have"] + e["m"] >= k, e["d"]).alias("eps")))
    return pts.join(held.select("id", walk["eps"].cast("long").alias("far")), "id", "left").select("id", "n", "x", "y", F.when(F.col("n") > k, F.lit(0).cast("long")).otherwise(F.col("far")).alias("eps"))


def counts_within(pts: DataFrame) -> DataFrame:
    """id, n, nx, ny: other rows nearer than ``eps`` in each coordinate, from the positions of both ends."""
    asked = pts.where("eps > 0")
    ends = [F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"), (F.col(a) + F.col("eps") * s).alias("value")) for a in "xy" for s in (1, -1)]
    asks = asked.select("id", F.explode(F.array(*ends)).alias("e")).select("id", "e.*")
    rows = pts.select("n", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in "xy"))).alias("e")).select("e.*", "n")
    both = rows.unionByName(asks.select("axis", "value", F.lit(0).cast("long").alias("n")))
    at = grouped_positions(both, ["axis"], "value", pts=F.col("n")).select("axis", "value", "pts", "pts_before")
    # Values below the upper end less those up to the lower one.
    less = F.when(F.col("side") > 0, F.col("pts_before")).otherwise(-(F.col("pts_before") + F.col("pts")))
    found = asks.join(at, ["axis", "value"]).groupBy("id").agg(*(F.sum(F.when(F.col("axis") == a, less)).alias(f"c{a}") for a in "xy"))
    return pts.join(found, "id", "left").select("id", "n", *(F.coalesce(F.col(f"c{a}") - 1, F.lit(0)).alias(f"n{a}") for a in "xy"))


def mutual_information(df: DataFrame, key: str, x: str, y: str, k: int = 3, digits: int = 9, few: int = FEW) -> DataFrame:
    """n, mi: nearest-neighbour estimate in nats, not below 0, of two columns; 0 with no more than k rows (STA-18)."""
    pts = cut_lineage(points(df, key, x, y, digits))
    near = counts_within(cut_lineage(radii(pts, k, few)))
    s = near.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * (digamma(F.col("nx") + 1) + digamma(F.col("ny") + 1))).alias("s"))
    mi = digamma(F.lit(k)) + digamma(F.greatest("n", F.lit(1))) - F.col("s") / F.col("n")
    return s.select("n", F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).otherwise(0.0).alias("mi"))


def residual_information(df: DataFrame, key: str, fold: str, y: str, xs: Sequence[str], given: Sequence[str], k: int = 5, rounds: int = 5, alpha: float = 1e-6, seed: int = 0, digits: int = 9) -> DataFrame:
    """n, raw, null_mean, p, corrected: information that ``xs`` share with ``y`` beyond what ``given`` says of both (STA-18).

    Residuals are out of fold by ridge regression; the sum over ``xs`` is compared with that of
    residuals of y dealt anew to the rows (:mod:`permutations`), and what exceeds the mean of these
    rounds is the corrected value, not below 0.  Rows with a missing value or key are left out.
    """
    out = df.dropna(subset=[key, fold, y, *xs, *given]).dropDuplicates([key])
    for c in (y, *xs):
        out = oof_ridge(out, fold, c, given, alpha, out="_p").withColumn(f"_r_{c}", F.col(c) - F.col("_p")).drop("_p")
    out = cut_lineage(places(out, key).join(out, key).select(key, "place", *(f"_r_{c}" for c in (y, *xs))))
    n = out.count()
    own = out.select(F.col("place").alias("to"), F.col(f"_r_{y}").alias("_y"))
    every = deals(df.sparkSession, rounds, n, seed)
    got = []
    for b in range(rounds + 1):
        moved = out.crossJoin(F.broadcast(every.where(F.col("round") == b))).withColumn("to", dealt(F.col("place"), n, seed)).join(own, "to")
        got.append((b, sum(mutual_information(moved, key, f"_r_{x}", "_y", k, digits).first()["mi"] for x in xs)))
    s = judged(df.sparkSession.createDataFrame(got, "round int, mi double"), "mi")
    return s.select(F.lit(n).alias("n"), F.col("observed").alias("raw"), "null_mean", "p", F.greatest(F.col("observed") - F.col("null_mean"), F.lit(0.0)).alias("corrected"))
