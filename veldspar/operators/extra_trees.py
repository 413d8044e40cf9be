"""Extremely random trees, grown level by level (MOD-06).

Each node draws features and one cut for each of them between the least and the greatest value that
its rows have, by hashes of (seed, tree, node, feature), and keeps the one that leaves the least
variance.  Rows are never moved: a task replays the trees so far to know its rows' nodes and sends on
sums by (tree, node), which Spark adds up.  A level is two passes, one for the ranges and one for the
sums; the trees hold at most ``trees * 2^depth`` nodes, which bounds what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels at most, whatever is asked for.
DEEPEST = 12


def drawn(seed: int, *key: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) by the mixing steps of splitmix64 over the parts of a key."""
    h = np.uint64(seed)
    with np.errstate(over="ignore"):
        for k in key:
            h = (h ^ np.asarray(k, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / 2.0**53


@dataclass
class Trees:
    """By (tree, node), children of node i at 2i + 1 and 2i + 2: feature (-1 a leaf), cut, mean; importances by feature."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    importances: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row stands in each tree: rows x trees."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > self.cut[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature))[None, :], self.nodes(x)].mean(1) if len(x) else np.zeros(0)


def candidates(seed: int, trees: int, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether a feature is drawn, and its cut, by (tree, node, feature): ``share`` of the features, those that vary first."""
    p = low.shape[2]
    t, n, f = np.arange(trees)[:, None, None], nodes[None, :, None], np.arange(p)[None, None, :]
    varies = high > low
    order = np.argsort(np.where(varies, drawn(seed, t, n, f, 1), 2.0), axis=2, kind="stable")
    rank = np.argsort(order, axis=2, kind="stable")
    with np.errstate(invalid="ignore"):
        cut = low + drawn(seed, t, n, f, 2) * (high - low)
    return varies & (rank < max(1, round(share * p))), cut


def _added(df: DataFrame, run, join) -> list[np.ndarray]:
    """Arrays by task, put together within 64 groups in Spark; the groups' arrays."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = run(np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy())
                total = part if total is None else join(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def group(t: pa.Table) -> pa.Table:
        total = None
        for g in t["g"]:
            part = np.frombuffer(g.as_py())
            total = part if total is None else join(total, part)
        return pa.table({"g": pa.array([total.tobytes()], pa.binary())})

    parts = df.mapInArrow(task, "g binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(64)))
    return [np.frombuffer(r.g) for r in parts.groupBy("k").applyInArrow(group, "g binary").collect()]


def grow(df: DataFrame, y: str, xs: Sequence[str], trees: int = 32, depth: int = 6, least: int = 3, share: float = 0.55, seed: int = 7) -> Trees:
    """Trees on all rows; a row that misses y or a feature (null, NaN) is left out, a table without rows predicts 0.

    ``least`` rows stay on either side of a cut; of equal cuts the first feature's is taken.
    """
    depth, p = min(depth, DEEPEST), len(xs)
    size = 2 ** (depth + 1) - 1
    model = Trees(np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size)), np.zeros(p))
    rows = df.dropna(subset=[y, *xs]).select(F.array(*(F.col(x).cast("double") for x in xs)).alias("x"), F.col(y).cast("double").alias("y"))
    first = rows.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not first.n:
        return model
    middle = float(first.m)
    model.value[:] = middle
    gains = np.zeros((trees, p))
    for level in range(depth):
        start, width = 2**level - 1, 2**level
        nodes = np.arange(start, start + width)
        tree = np.arange(trees)[None, :]

        def ranges(x: np.ndarray, _: np.ndarray, now: Trees = model, start: int = start, width: int = width, tree: np.ndarray = tree) -> np.ndarray:
            at = now.nodes(x) - start
            low = np.full((2, trees, width, p), np.inf)
            for t in range(trees):
                here = at[:, t] >= 0
                for f in range(p):
                    np.minimum.at(low[0, t, :, f], at[here, t], x[here, f])
                    np.minimum.at(low[1, t, :, f], at[here, t], -x[here, f])
            return low.ravel()

        found = _added(rows, ranges, np.minimum)
        low, high = np.minimum.reduce(found).reshape(2, trees, width, p) * np.array([1.0, -1.0])[:, None, None, None]
        use, cut = candidates(seed, trees, nodes, low, high, share)

        def sums(x: np.ndarray, v: np.ndarray, now: Trees = model, start: int = start, width: int = width, cut: np.ndarray = cut) -> np.ndarray:
            at, z = now.nodes(x) - start, v - middle
            out = np.zeros((trees, width, p + 1, 2))
            for t in range(trees):
                here = at[:, t] >= 0
                a, zh = at[here, t], z[here]
                out[t, :, p] = np.column_stack([np.bincount(a, minlength=width), np.bincount(a, zh, width)])
                for f in range(p):
                    left = x[here, f] <= cut[t, a, f]
                    out[t, :, f] = np.column_stack([np.bincount(a[left], minlength=width), np.bincount(a[left], zh[left], width)])
            return out.ravel()

        total = np.add.reduce(_added(rows, sums, np.add)).reshape(trees, width, p + 1, 2)
        n, s = total[:, :, p, 0][..., None], total[:, :, p, 1][..., None]
        nl, sl = total[:, :, :p, 0], total[:, :, :p, 1]
        nr, sr = n - nl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(use & (nl >= least) & (nr >= least), sl**2 / nl + sr**2 / nr - s**2 / n, -np.inf)
        best = gain.argmax(2)
        top = np.take_along_axis(gain, best[..., None], 2)[..., 0]
        feature, cuts, value = model.feature.copy(), model.cut.copy(), model.value.copy()
        for t, j in zip(*np.nonzero(top > 1e-12), strict=True):
            f, i = best[t, j], start + j
            feature[t, i], cuts[t, i] = f, cut[t, j, f]
            value[t, 2 * i + 1], value[t, 2 * i + 2] = middle + sl[t, j, f] / nl[t, j, f], middle + sr[t, j, f] / nr[t, j, f]
            gains[t, f] += top[t, j]
        grown = (feature != model.feature).any()
        model = Trees(feature, cuts, value, model.importances)
        if not grown:
            break
    total = gains.sum(1, keepdims=True)
    model.importances = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(0)
    return model


def predict(df: DataFrame, xs: Sequence[str], model: Trees, out: str = "pred") -> DataFrame:
    """Rows with the mean over the trees; null where a feature is missing or NaN.  The trees are a bounded broadcast."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.predict(np.array(x.tolist(), float).reshape(len(x), -1)))

    known = F.lit(True)
    for x in xs:
        known = known & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    filled = F.array(*(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in xs))
    return df.withColumn(out, F.when(known, run(filled)))
