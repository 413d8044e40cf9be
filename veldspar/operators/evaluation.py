"""Folds, paired comparisons and retrieval of held-out families (MOD, STA-09, 17, 18, 20, 23, SCN-04)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .models import oof_ridge
from .ranks import average_rank, grouped_average_rank


#: References that a row's distances are kept to.
MOST_REFERENCES = 4096


def hashed(key: Column, salt: str, top: int) -> Column:
    """A number below ``top`` from a key and a salt, the same wherever it is computed."""
    text = F.concat_ws("/", key.cast("string"), F.lit(salt))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(top))


def hashed_each(key: Column, number: Column, top: int) -> Column:
    """The same with a numbered salt."""
    text = F.concat_ws("/", key.cast("string"), number.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(top))


def shuffled_folds(key: Column, k: int, seed: int = 0) -> Column:
    """Fold of a row by a hash of its key: shuffled, balanced up to chance, the same in every run (MOD-01)."""
    return hashed(key, f"fold{seed}", k).cast("int")


def fold_scores(df: DataFrame, fold: str, y: str, blocks: dict[str, Sequence[str]], alpha: float = 0.0) -> DataFrame:
    """fold, and the R2 in it of a linear model of each block fitted on the other folds (MOD-09): the rows of all blocks are the same."""
    xs = sorted({x for b in blocks.values() for x in b})
    out = df.dropna(subset=[y, *xs])
    for name, b in blocks.items():
        out = oof_ridge(out, fold, y, b, alpha, out=f"_{name}")
    t = F.col(y)
    return out.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *((1 - F.sum((t - F.col(f"_{b}")) * (t - F.col(f"_{b}"))) / (F.var_pop(y) * F.count(F.lit(1)))).alias(b) for b in blocks))


def select_block(df: DataFrame, fold: str, y: str, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """block, spearman, r2 of out-of-fold predictions, best first (MOD-10); ranks of all blocks in one plan."""
    xs = sorted({x for b in blocks.values() for x in b})
    out = df.dropna(subset=[y, *xs])
    for name, b in blocks.items():
        out = oof_ridge(out, fold, y, b, out=f"_{name}")
    long = out.select(F.col(y).alias("_y"), *(F.round(f"_{b}", 9).alias(b) for b in blocks)).unpivot(["_y"], list(blocks), "block", "_p")
    e = F.col("_y") - F.col("_p")
    ranked = grouped_average_rank(grouped_average_rank(long, ["block"], "_p", "_rp"), ["block"], "_y", "_ry")
    return ranked.groupBy("block").agg(F.corr("_rp", "_ry").alias("spearman"), (1 - F.sum(e * e) / (F.var_pop("_y") * F.count(F.lit(1)))).alias("r2"))


def cluster_bootstrap(df: DataFrame, group: str, a: Column, b: Column, rounds: int) -> DataFrame:
    """round, delta: difference of two mean errors with whole groups drawn anew, 0 to 2 times by hash (STA-09).

    Sums are made per group once, so a round costs one row per group.
    """
    g = df.groupBy(group).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n"))
    w = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", hashed_each(F.col(group), F.col("round"), 3))
    return w.groupBy("round").agg((F.sum(F.col("w") * (F.col("b") - F.col("a"))) / F.sum(F.col("w") * F.col("n"))).alias("delta"))


def masked_prediction(neighbors: DataFrame, rows: DataFrame, y: str, fold: str) -> DataFrame:
    """id, y, pred: mean target of the neighbours that lie in other folds (MOD-11); a row without any is left out.

    ``rows``: id, target, fold.  Neighbours of a row's own fold are what would leak.
    """
    j = neighbors.select("id", "neighbor").join(rows, "id").join(rows.select(F.col("id").alias("neighbor"), F.col(y).alias("_ny"), F.col(fold).alias("_nf")), "neighbor")
    return j.where(F.col("_nf") != F.col(fold)).groupBy("id", F.col(y).alias("y")).agg(F.avg("_ny").alias("pred"))


def reference_distances(df: DataFrame, refs: DataFrame, key: str, family: str, vector: str) -> DataFrame:
    """key, family, d: array of (reference family, distance) of each row to at most ``MOST_REFERENCES`` references, broadcast as one array."""
    if refs.count() > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references; take centroids of families")
    packed = refs.agg(F.collect_list(F.struct(F.col("family").alias("f"), F.col("centroid").alias("c"))).alias("_refs"))
    d = F.transform("_refs", lambda s: F.struct(s["f"].alias("f"), F.round(arrays.euclid(F.col(vector), s["c"]), 9).alias("d")))
    return df.crossJoin(F.broadcast(packed)).select(key, F.col(family).alias("family"), F.array_sort(d).alias("d"))


def nearest_but(d: Column, held: Column) -> Column:
    """Distance to the nearest reference of another family than the held one."""
    return F.array_min(F.transform(F.filter(d, lambda s: s["f"] != held), lambda s: s["d"]))


def mean_nearest(d: Column, held: Column | None, k: int) -> Column:
    """Mean distance to the k nearest references, without the held family."""
    kept = d if held is None else F.filter(d, lambda s: s["f"] != held)
    near = F.slice(F.array_sort(F.transform(kept, lambda s: s["d"])), 1, k)
    return F.round(F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near), 9)


def held_out_retrieval(distances: DataFrame, seeds: Sequence) -> DataFrame:
    """held, percentile of each held-out seed family among the families that are no seeds then (MOD-12).

    A family's score is its best row's; a row's is minus the distance to the nearest other seed.
    """
    held = F.explode(F.array(*(F.lit(s) for s in seeds))).alias("held")
    best = distances.select("family", "d", held).groupBy("held", "family").agg(F.max(-nearest_but(F.col("d"), F.col("held"))).alias("score"))
    pool = best.where((F.col("family") == F.col("held")) | ~F.col("family").isin(*seeds))
    ranked = grouped_average_rank(pool, ["held"], "score", "rank")
    n = pool.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(n, "held").where("family = held").select("held", (F.col("rank") / F.col("n")).alias("percentile"))


def held_out_auc(distances: DataFrame, seeds: Sequence) -> DataFrame:
    """auc of telling seed rows by their distance to seeds of other families (MOD-13)."""
    own = F.col("family").isin(*seeds)
    rows = distances.select(own.alias("good"), (-nearest_but(F.col("d"), F.when(own, F.col("family")).otherwise(F.lit(-1)))).alias("score"))
    ranked = average_rank(rows, "score", "rank")
    s = ranked.agg(F.sum(F.when(F.col("good"), F.col("rank"))).alias("r"), F.count(F.when(F.col("good"), 1)).alias("n1"), F.count(F.when(~F.col("good"), 1)).alias("n0"))
    return s.select(((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


# Coefficients of the error function's rational approximation (error below 1.5e-7).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column) -> Column:
    """p-value of a standard normal score (STA-20)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def hypergeometric_tail(hits: int, n: int, a: int, b: int) -> float:
    """Chance of at least ``hits`` common members of two random sets of ``a`` and ``b`` of ``n`` (SET-08).

    The first term by log-gammas, the others by their ratios, until they no longer add anything.
    """
    if hits <= max(0, a + b - n):
        return 1.0
    if hits > min(a, b):
        return 0.0
    def choose(x, y):
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    mean = a * b / n
    if hits < mean:
        # The lower tail is the shorter one.
        return 1.0 - _tail(hits - 1, -1, n, a, b, choose)
    return _tail(hits, 1, n, a, b, choose)


def _tail(k: int, step: int, n: int, a: int, b: int, choose) -> float:
    term = total = math.exp(choose(a, k) + choose(n - a, b - k) - choose(n, b))
    while term > 1e-18 * total:
        if step > 0:
            term *= (a - k) * (b - k) / ((k + 1) * (n - a - b + k + 1))
        else:
            term *= k * (n - a - b + k) / ((a - k + 1) * (b - k + 1))
        k += step
        total += term
    return min(total, 1.0)


def evidence_grade(n: Column, coverage: Column) -> Column:
    """Grade of evidence by its number and coverage (STA-19)."""
    return F.when((n >= 500) & (coverage >= 0.2), "strong").when((n >= 100) & (coverage >= 0.05), "moderate").otherwise("limited")
