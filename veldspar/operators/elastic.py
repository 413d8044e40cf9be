"""Elastic nets and the choice among blocks of features and models (MOD-04, MOD-10).

Folds share one pass: cross products are summed by fold, a fold's training rows are the total less
the fold, and every block and penalty is fitted from them by coordinate descent.  What reaches the
driver is one matrix of the features for each fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import grouped_average_rank
from .vectors import cut_lineage


@dataclass
class Moments:
    """Of a fold's training rows: count, means of (y, features), and their covariances."""

    n: float
    mean: np.ndarray
    cov: np.ndarray


def training_moments(df: DataFrame, fold: str, y: str, xs: Sequence[str]) -> dict[object, Moments]:
    """By fold, of all rows outside of it.  Columns are shifted by their means first, so large offsets lose no digits."""
    cols = [F.col(c).cast("double") for c in (y, *xs)]
    k = len(cols)
    shift = [float(v or 0) for v in df.agg(*(F.avg(c) for c in cols)).first()]
    z = [c - s for c, s in zip(cols, shift, strict=True)]
    rows = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *(F.sum(z[i]).alias(f"s{i}") for i in range(k)), *(F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k))).collect()
    n = {r[fold]: r.n for r in rows}
    s = {r[fold]: np.array([r[f"s{i}"] for i in range(k)]) for r in rows}
    p = {r[fold]: np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in rows}
    out = {}
    for f in sorted(n):
        m = sum(n.values()) - n[f]
        if m:
            mean = (sum(s.values()) - s[f]) / m
            out[f] = Moments(m, mean + shift, (sum(p.values()) - p[f]) / m - np.outer(mean, mean))
    return out


def descend(c: np.ndarray, b: np.ndarray, l1: float, l2: float, tolerance: float = 1e-13, sweeps: int = 100_000) -> np.ndarray:
    """Least of w'Cw/2 - b'w + l1 |w| + l2 w'w/2, a coordinate at a time; a feature without variance stays 0."""
    w = np.zeros(len(b))
    size = max(float(np.abs(b).max(initial=0)), 1e-300)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            if c[j, j] <= 0:
                continue
            pull = b[j] - c[j] @ w + c[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0) / (c[j, j] + l2)
            most, w[j] = max(most, abs(new - w[j])), new
        if most <= tolerance * size:
            return w
    raise RuntimeError(f"no convergence in {sweeps} sweeps")


def fit(m: Moments, at: Sequence[int], alpha: float, ratio: float) -> tuple[np.ndarray, float]:
    """Weights on the plain features ``at`` and the intercept: standardised features, squares over 2n, alpha times ratio on |w|, the rest on squares."""
    i = np.array(at, int) + 1
    sd = np.sqrt(np.maximum(np.diag(m.cov)[i], 0))
    live = sd > 1e-9 * np.maximum(np.abs(m.mean[i]), 1e-300)
    scale = np.where(live, 1 / np.where(live, sd, 1), 0.0)
    w = descend(m.cov[np.ix_(i, i)] * np.outer(scale, scale), m.cov[i, 0] * scale, alpha * ratio, alpha * (1 - ratio)) * scale
    return w, float(m.mean[0] - w @ m.mean[i])


def oof_predictions(df: DataFrame, fold: str, y: str, xs: Sequence[str], blocks: dict[str, Sequence[str]], models: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with ``predictions``, an array of (block, model, pred) from fits without the row's fold.

    ``models`` are (alpha, ratio): (0, 0) least squares, ratio 0 ridge, 1 lasso.  Rows that miss the
    fold, y or any feature are left out; a fold that holds all rows has no prediction.
    """
    clean = df.dropna(subset=[fold, y, *xs])
    moments = training_moments(clean, fold, y, xs)

    def one(block: str, alpha: float, ratio: float) -> Column:
        at = [list(xs).index(x) for x in blocks[block]]
        pred = F.lit(None).cast("double")
        for f, m in moments.items():
            w, b = fit(m, at, alpha, ratio)
            value = sum((F.col(xs[a]).cast("double") * float(v) for a, v in zip(at, w, strict=True)), F.lit(b))
            pred = F.when(F.col(fold) == f, value).otherwise(pred)
        return pred

    return clean.withColumn("predictions", F.array(*(F.struct(F.lit(b).alias("block"), F.lit(m).alias("model"), one(b, *models[m]).alias("pred")) for b in blocks for m in models)))


def model_scores(df: DataFrame, fold: str, y: str, blocks: dict[str, Sequence[str]], models: dict[str, tuple[float, float]], digits: int = 6) -> DataFrame:
    """block, model, n, spearman and r2 of out-of-fold predictions (rounded to ``digits`` for ranks)."""
    xs = list(dict.fromkeys(x for b in blocks.values() for x in b))
    # Every block and model predicts the same rows, so the ranks of y are found once; what follows reads the table more than once.
    ranked = grouped_average_rank(df.dropna(subset=[fold, y, *xs]).withColumn("_all", F.lit(0)), ["_all"], y, "_ry")
    long = oof_predictions(ranked, fold, y, xs, blocks, models).select(F.col(y).cast("double").alias("_y"), "_ry", F.explode("predictions").alias("p")).select("_y", "_ry", "p.*").where("pred IS NOT NULL")
    p = grouped_average_rank(cut_lineage(long.withColumn("pred", F.round("pred", digits))), ["block", "model"], "pred", "_rp")
    e = F.col("_y") - F.col("pred")
    return p.groupBy("block", "model").agg(F.count(F.lit(1)).alias("n"), F.corr("_rp", "_ry").alias("spearman"), (1 - F.try_divide(F.sum(e * e), F.var_pop("_y") * F.count(F.lit(1)))).alias("r2"))
