"""Screening rules, membership and model scores (SCN, MOD)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


#: References of a pack.
PACK = 4096


def effect_label(auc: Column) -> Column:
    """Strength and direction of an effect by its AUC (STA-19)."""
    d = F.round(2 * F.abs(auc - 0.5), 9)
    side = F.when(auc > 0.5, "higher").otherwise("lower")
    return F.when(d < 0.1, "weak/mixed").otherwise(F.concat(F.when(d >= 0.3, "strong").otherwise("moderate"), F.lit("; "), side))


def rule_performance(df: DataFrame, good: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, n_pass, precision, retention, enrichment of each rule in one pass (FLT-14, SCN-07)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(good, 1)).alias("g")]
    for k, c in rules.items():
        aggs += [F.count(F.when(c, 1)).alias(f"{k}__p"), F.count(F.when(c & good, 1)).alias(f"{k}__h")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(k).alias("rule"), F.col(f"{k}__p").alias("n_pass"), F.round(F.try_divide(F.col(f"{k}__h"), F.col(f"{k}__p")), 9).alias("precision"), F.round(F.try_divide(F.col(f"{k}__h"), F.col("g")), 9).alias("retention"), F.round(F.try_divide(F.col(f"{k}__h") * F.col("n"), F.col(f"{k}__p") * F.col("g")), 6).alias("enrichment")) for k in rules]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def enrichment(df: DataFrame, bucket: str, good: Column) -> DataFrame:
    """bucket, n, n_good, rate, enrichment over the whole table's rate, share_of_good (AGG-28, AGG-29)."""
    g = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(good, 1)).alias("n_good"))
    total = g.agg(F.sum("n").alias("all_n"), F.sum("n_good").alias("all_good"))
    # One row, whatever the input.
    j = g.crossJoin(F.broadcast(total))
    rate = F.col("n_good") / F.col("n")
    return j.select(bucket, "n", "n_good", F.round(rate, 9).alias("rate"), F.round(rate * F.col("all_n") / F.col("all_good"), 6).alias("enrichment"), F.round(F.col("n_good") / F.col("all_good"), 9).alias("share_of_good"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid, n: mean vector of each group, by position (no vector lists)."""
    e = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return c.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)


def nearest_reference(df: DataFrame, refs: DataFrame, id_col: str, vector: str, ref_id: str, ref_vector: str, exclude: tuple[str, str] | None = None) -> DataFrame:
    """id, nearest reference and its distance; optionally not of the row's own group (JOIN-18, JOIN-19).

    References go in packs of at most ``PACK`` as arrays: one pack is broadcast; of several each
    meets all rows, and a row's best of every pack are compared.
    """
    n = refs.count()
    fields = [F.col(ref_id).alias("rid"), F.col(ref_vector).alias("rv"), *([F.col(exclude[1]).alias("rg")] if exclude else [])]
    packs = max(1, -(-n // PACK))
    packed = refs.select(F.pmod(F.xxhash64(ref_id), F.lit(packs)).alias("_pack"), F.struct(*fields).alias("s")).groupBy("_pack").agg(F.collect_list("s").alias("refs")).select("refs")
    j = df.crossJoin(F.broadcast(packed) if packs == 1 else packed)
    pool = F.filter("refs", lambda s: s["rg"] != F.col(exclude[0])) if exclude else F.col("refs")
    best = F.array_min(F.transform(pool, lambda s: F.struct(F.round(arrays.euclid(F.col(vector), s["rv"]), 9).alias("d"), s["rid"].alias("rid"))))
    found = j.select(id_col, best.alias("_b"))
    if packs > 1:
        found = found.groupBy(id_col).agg(F.min("_b").alias("_b"))
    return found.select(id_col, F.col("_b.rid").alias("nearest"), F.col("_b.d").alias("distance"))


def group_folds(key: Column, k: int) -> Column:
    """Fold of a whole group, by a number of the group (MOD-02)."""
    return F.pmod(key, F.lit(k)).cast("int")


def out_of_fold_mean(df: DataFrame, fold: str, y: str) -> DataFrame:
    """Rows with the mean of ``y`` outside their fold: total minus fold, no join of rows (MOD-03)."""
    by = df.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    total = by.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    means = by.crossJoin(F.broadcast(total)).select(fold, ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("oof_mean"))
    return df.join(F.broadcast(means), fold)


def linear_score(terms: dict[str, float], intercept: float) -> Column:
    """Score from stored coefficients; a missing value counts 0 (MOD-08)."""
    out = F.lit(float(intercept))
    for c, w in terms.items():
        out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return out


def knn_regression(neighbors: DataFrame, target: DataFrame, eps: float = 1e-9) -> DataFrame:
    """id, prediction: inverse-distance mean of the neighbours' targets (MOD-07). ``target``: neighbor, y."""
    w = 1 / (F.col("distance") + eps)
    return neighbors.join(target, "neighbor").groupBy("id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))


def kmeans_profile(df: DataFrame, vector: str, k: int, seed: int = 5):
    """Rows with a cluster, relabelled by the first coordinate of its centre (EMB-09)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    m = KMeans(k=k, seed=seed, featuresCol="_v").fit(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    order = np.argsort([c[0] for c in m.clusterCenters()], kind="stable")
    label = F.array(*(F.lit(int(np.flatnonzero(order == i)[0])) for i in range(len(order))))
    return m.transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))).withColumn("cluster", F.element_at(label, F.col("prediction") + 1)).drop("_v", "prediction")


def geometric_edges(low: float, high: float, n: int) -> Sequence[float]:
    return [float(x) for x in np.geomspace(low, high, n + 1)]


def first_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
