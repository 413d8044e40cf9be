"""Out-of-fold models, graph layers and spectral maps (MOD, GRF-08/09, EMB-02/03)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def oof_ridge(df: DataFrame, fold: str, y: str, xs: Sequence[str], alpha: float = 0.0, out: str = "pred") -> DataFrame:
    """Rows with the prediction of a ridge regression fitted without their fold (MOD-02..04).

    One pass sums cross products by fold; each fold's fit is the total less the fold, so k folds
    cost as much as one. Rows with a missing value are left out.
    """
    clean = df.dropna(subset=[y, *xs])
    c = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(c)
    t = F.col(y).cast("double")
    sums = clean.groupBy(fold).agg(*(F.sum(c[i] * c[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(c[i] * t).alias(f"b{i}") for i in range(k))).collect()
    A = {r[fold]: np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in sums}
    B = {r[fold]: np.array([r[f"b{i}"] for i in range(k)]) for r in sums}
    ridge = alpha * np.diag([0.0] + [1.0] * (k - 1))
    total_a, total_b = sum(A.values()), sum(B.values())
    pred = None
    for f in sorted(A):
        w = np.linalg.solve(total_a - A[f] + ridge, total_b - B[f])
        p = sum((c[i] * float(w[i]) for i in range(1, k)), F.lit(float(w[0])))
        pred = F.when(F.col(fold) == f, p) if pred is None else pred.when(F.col(fold) == f, p)
    return clean.withColumn(out, pred)


def scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """n, r2, mae, rmse of predictions in one pass (STA-14)."""
    e = F.col(y) - F.col(pred)
    return df.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def logistic(df: DataFrame, label: str, xs: Sequence[str], reg: float = 0.01) -> DataFrame:
    """Rows with the probability of label 1 by logistic regression on standardised features (MOD-04)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    steps = [VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, regParam=reg, standardization=False)]
    out = Pipeline(stages=steps).fit(df).transform(df)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_x", "_z", "rawPrediction", "probability", "prediction")


def random_forest(df: DataFrame, y: str, xs: Sequence[str], trees: int = 50, seed: int = 3):
    """Forest regression and its importances (MOD-05)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    m = Pipeline(stages=[VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip"), RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, seed=seed)]).fit(df)
    return m.transform(df).drop("_x"), dict(zip(xs, m.stages[-1].featureImportances.toArray().tolist(), strict=True))


def unit_strength(edges: DataFrame) -> DataFrame:
    """Edge weights scaled so that the mean node strength is 1 (GRF-08)."""
    both = edges.select(F.col("src").alias("id"), "w").union(edges.select("dst", "w"))
    mean = both.groupBy("id").agg(F.sum("w").alias("s")).agg(F.avg("s").alias("m"))
    return edges.crossJoin(F.broadcast(mean)).select("src", "dst", (F.col("w") / F.col("m")).alias("w"))


def supra_edges(layers: dict[str, DataFrame], strength: float) -> DataFrame:
    """Layered edges (layer, src, other layer, dst, w) with identity edges of strength / (layers - 1) (GRF-09)."""
    out, names = None, list(layers)
    for n in names:
        part = layers[n].select(F.lit(n).alias("layer"), "src", F.lit(n).alias("other"), "dst", "w")
        out = part if out is None else out.unionByName(part)
    nodes = {n: layers[n].select(F.col("src").alias("id")).union(layers[n].select("dst")).distinct() for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            same = nodes[a].join(nodes[b], "id", "left_semi")
            out = out.unionByName(same.select(F.lit(a).alias("layer"), F.col("id").alias("src"), F.lit(b).alias("other"), F.col("id").alias("dst"), F.lit(strength / max(1, len(names) - 1)).alias("w")))
    return out


def diffusion_map(w: np.ndarray, k: int = 2) -> np.ndarray:
    """Leading nontrivial coordinates of a (small) affinity matrix, signs fixed by the largest entry (EMB-02, EMB-03)."""
    d = np.maximum(w.sum(1), 1e-12)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    top = np.argsort(values)[::-1][1 : k + 1]
    x = vectors[:, top] / np.sqrt(d)[:, None] * values[top]
    pivot = np.argmax(np.abs(x), axis=0)
    return x * np.sign(x[pivot, np.arange(len(top))])


def jackknife(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, mean without it: total less group (STA-10)."""
    by = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = by.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return by.crossJoin(F.broadcast(total)).select(group, F.try_divide(F.col("ts") - F.col("s"), (F.col("tn") - F.col("n")).cast("double")).alias("mean_without"))


def readiness(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that fail; a missing value fails (SCN-08)."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())
