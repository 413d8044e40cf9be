"""Scaling, distances, neighbours and graphs over vectors (SCL, DST, GRF, EMB).

Neighbours of many rows skip the blocks that can hold none (:mod:`neighbors`).  Where all pairs are
meant, or rows are few, vectors are packed into blocks, block pairs are joined, and numpy finds each
query's k nearest within a pair; only k candidates per vector and block pair are shuffled.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import neighbors

BLOCK = 1024
#: Rows up to which all pairs cost less than an index of blocks.
FEW = 8192
#: Bytes of vectors that a ranking over all others may broadcast; beyond, they go through a shuffle.
BROADCAST_BYTES = 64 << 20


def standard_scale(df: DataFrame, *cols: str) -> DataFrame:
    """(x - mean) / population deviation, 1 for a constant column (SCL-03). One small aggregate, broadcast."""
    s = df.agg(*(F.avg(c).alias(f"{c}__m") for c in cols), *(F.stddev_pop(c).alias(f"{c}__s") for c in cols))
    j = df.crossJoin(F.broadcast(s))  # one row
    return j.select(*df.columns, *(((F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0)).alias(f"{c}_std") for c in cols))


def pack(df: DataFrame, id_col: str, vector: str, block: int = BLOCK) -> DataFrame:
    """block, ids, matrix (doubles) rows; ids are dealt to blocks by hash."""
    n = max(1, -(-df.count() // block))

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t["v"].to_pylist(), dtype=np.float64)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([x.tobytes()], pa.binary())})

    src = df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return src.groupBy("block").applyInArrow(run, "block int, ids array<long>, matrix binary")


def _distances(x: np.ndarray, y: np.ndarray, metric: str, digits: int) -> np.ndarray:
    if metric == "cosine":
        d = 1 - (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    elif metric == "square":
        d = np.maximum(np.abs(x[:, None, 0] - y[None, :, 0]), np.abs(x[:, None, 1] - y[None, :, 1]))
    else:
        size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
        d = np.maximum(size - 2 * x @ y.T, 0)
        # What nearly cancels out is rounded too coarsely.
        p, q = np.nonzero(d < 1e-4 * size)
        for at in range(0, len(p), 1 << 14):
            some = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
            d[some] = ((x[some[0]] - y[some[1]]) ** 2).sum(1)
        d = np.sqrt(d)
    return np.round(d, digits)


def _exact(x: np.ndarray, y: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Of row with row by differences, summed up in their order: equal rows are at 0, and equal ones equally far from others."""
    if metric == "square":
        return np.round(np.abs(x[:, :2] - y[:, :2]).max(axis=1), digits)
    if metric == "cosine":
        xy, xx, yy = (sum((a[:, c] * b[:, c] for c in range(x.shape[1])), np.zeros(len(x))) for a, b in ((x, y), (x, x), (y, y)))
        return np.round(1 - xy / (np.sqrt(xx) * np.sqrt(yy)), digits)
    d = np.zeros(len(x))
    for c in range(x.shape[1]):
        d += (x[:, c] - y[:, c]) ** 2
    return np.round(np.sqrt(d), digits)


def _block_pairs(packed: DataFrame) -> DataFrame:
    """Every two blocks once: an all-pairs search stated as such; a row is two matrices of bounded size."""
    right = packed.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("matrix").alias("matrix2"))
    return packed.join(right, F.col("block") <= F.col("block2")).repartition(F.xxhash64("block", "block2"))


def _pair_distances(row: dict, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.array(row["ids"]), np.array(row["ids2"])
    return i, j, _distances(np.frombuffer(row["matrix"]).reshape(len(i), -1), np.frombuffer(row["matrix2"]).reshape(len(j), -1), metric, digits)


def _near(df: DataFrame, id_col: str, vector: str, metric: str, digits: int) -> tuple[neighbors.Index | None, Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    return neighbors.build(df, id_col, vector, metric, cut_lineage), lambda x, y: _distances(x, y, metric, digits), lambda x, y: _exact(x, y, metric, digits)


def knn(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", metric: str = "euclid", digits: int = 9, few: int = FEW, counted: Accumulator | None = None) -> DataFrame:
    """id, neighbor, distance, rank: exact k nearest others, ties by id (GRF-01).

    Up to ``few`` rows, two blocks meet once and give both their rows' candidates; beyond, blocks that
    can hold no neighbour are skipped (:mod:`neighbors`).  Both give the same rows.
    """
    if df.count() > few:
        index, distances, exact = _near(df, id_col, vector, metric, digits)
        if index:
            return neighbors.knn(index, k, distances, exact, cut_lineage, counted)

    def nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((np.broadcast_to(j, d.shape), d), axis=1)[:, : min(k, len(j))]
        got = np.take_along_axis(d, order, axis=1)
        keep = np.isfinite(got)
        return pa.RecordBatch.from_arrays([pa.array(i[np.repeat(np.arange(len(i)), keep.sum(1))]), pa.array(j[order[keep]]), pa.array(got[keep])], names=["id", "neighbor", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                i, j, d = _pair_distances(r, metric, digits)
                d[i[:, None] == j[None, :]] = np.inf
                yield nearest(i, j, d)
                if r["block"] != r["block2"]:
                    yield nearest(j, i, d.T)

    found = _block_pairs(pack(df, id_col, vector)).mapInArrow(run, "id long, neighbor long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(df: DataFrame, radius: float, id_col: str = "vec_id", vector: str = "embedding", digits: int = 9, few: int = FEW, counted: Accumulator | None = None, forest: bool = False) -> DataFrame:
    """src < dst of all pairs no farther apart than the radius; beyond ``few`` rows without the blocks that are.

    ``forest``: of the pairs that one task finds only as many as connect the same rows.
    """
    if df.count() > few:
        index, _, exact = _near(df, id_col, vector, "euclid", digits)
        if index:
            return neighbors.within(index, radius, exact, counted, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                i, j, d = _pair_distances(r, "euclid", digits)
                once = i[:, None] < j[None, :] if r["block"] == r["block2"] else i[:, None] != j[None, :]
                x, y = np.nonzero((d <= radius) & once)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[x], j[y])), pa.array(np.maximum(i[x], j[y]))], names=["src", "dst"])

    return _block_pairs(pack(df, id_col, vector)).mapInArrow(run, "src long, dst long")


def closest(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 9, few: int = FEW, counted: Accumulator | None = None) -> DataFrame:
    """id < neighbor, distance: the k closest pairs, ties by ids; beyond ``few`` rows without the blocks that can hold none (SRT-06)."""
    if df.count() > few:
        index, distances, exact = _near(df, id_col, vector, "euclid", digits)
        if index:
            return neighbors.closest(index, k, distances, exact, counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                i, j, d = _pair_distances(r, "euclid", digits)
                once = i[:, None] < j[None, :] if r["block"] == r["block2"] else i[:, None] != j[None, :]
                x, y = np.nonzero(once & np.isfinite(d))
                got, i, j = d[x, y], np.minimum(i[x], j[y]), np.maximum(i[x], j[y])
                # Only what the k-th distance does not rule out is put in order.
                on = np.flatnonzero(got <= np.partition(got, k - 1)[k - 1]) if len(got) > k else np.arange(len(got))
                order = on[np.lexsort((j[on], i[on], got[on]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(i[order]), pa.array(j[order]), pa.array(got[order])], names=["id", "neighbor", "distance"])

    found = _block_pairs(pack(df, id_col, vector)).mapInArrow(run, "id long, neighbor long, distance double")
    return found.orderBy("distance", "id", "neighbor").limit(k)


def _best_of_worst(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and worse ranks of the ``k`` best of a row, whose distances in two views are ``x`` and ``y``; ties by place.

    Only the nearest of each view are ranked: what is not among both is beyond the shorter list's end,
    so lists that hold k such are enough, and others are doubled.
    """
    n = int(np.isfinite(x).sum())
    k = min(k, n)
    m = min(n, 4 * math.ceil(math.sqrt(k * n)))
    while True:
        ranks, shortest = [], n
        for d in (x, y):
            near = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1]) if m < n else np.flatnonzero(np.isfinite(d))
            rank = np.zeros(len(d), np.int64)
            rank[near[np.argsort(d[near], kind="stable")]] = np.arange(1, len(near) + 1)
            ranks.append(rank)
            shortest = min(shortest, len(near))
        both = np.flatnonzero((ranks[0] > 0) & (ranks[1] > 0))
        worst = np.maximum(ranks[0][both], ranks[1][both])
        top = np.argsort(worst, kind="stable")[:k]
        if m == n or (len(top) == k and worst[top[-1]] <= shortest):
            return both[top], worst[top]
        m = min(n, 2 * m)


def worst_rank(df: DataFrame, split: int, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """id, neighbor, worst: best k by the larger of the two views' ranks (DST-09).

    Ranks need all others of a row: up to ``BROADCAST_BYTES`` every task has all vectors, and a few
    rows of distances at a time.
    """
    packed = cut_lineage(pack(df, id_col, vector))
    n = df.count()
    size = packed.agg(F.sum(F.octet_length("matrix"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return worst_rank_by_lists(df, split, k, n, id_col, vector, digits)
    t = packed.select("ids", "matrix").toArrow()
    j = np.concatenate([r.values.to_numpy() for r in t["ids"]] or [np.empty(0, np.int64)])
    y = np.concatenate([np.frombuffer(m.as_py()).reshape(len(r), -1) for r, m in zip(t["ids"], t["matrix"], strict=True)] or [np.empty((0, 0))])
    order = np.argsort(j)
    everything = df.sparkSession.sparkContext.broadcast((j[order], y[order]))
    del t, j, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (j, y), i = everything.value, np.array(r["ids"])
                x = np.frombuffer(r["matrix"]).reshape(len(i), -1)
                rows, found = max(1, (1 << 20) // len(j)), []
                for at in range(0, len(i), rows):
                    own, some = i[at : at + rows], x[at : at + rows]
                    views = [_distances(some[:, part], y[:, part], "euclid", digits) for part in (slice(0, split), slice(split, None))]
                    for d in views:
                        d[own[:, None] == j[None, :]] = np.inf
                    for one, *ds in zip(own, *views, strict=True):
                        to, worst = _best_of_worst(*ds, k)
                        found.append((np.full(len(to), one), j[to], worst))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "neighbor", "worst"])

    return packed.repartition(max(1, -(-n // BLOCK)), "block").mapInArrow(run, "id long, neighbor long, worst long")


def worst_rank_by_lists(df: DataFrame, split: int, k: int, n: int, id_col: str, vector: str, digits: int = 9) -> DataFrame:
    """The same from neighbour lists of both views, for any number of rows: no task holds more than two blocks.

    What is in both lists of length m has its worse rank, and what is not has one beyond m; so a row
    with k rows in both is done, and the lists are doubled until all are.
    """
    views = [df.select(id_col, F.slice(vector, *part).alias("v")) for part in ((F.lit(1), F.lit(split)), (F.lit(split + 1), F.greatest(F.size(vector) - split, F.lit(1))))]
    m = min(n - 1, max(2 * k, math.ceil(2 * math.sqrt(k * n))))
    while True:
        a, b = (knn(v, m, id_col, "v", digits=digits).select("id", "neighbor", F.col("rank").alias(c)) for v, c in zip(views, ("ra", "rb"), strict=True))
        both = cut_lineage(a.join(b, ["id", "neighbor"]).select("id", "neighbor", F.greatest("ra", "rb").cast("long").alias("worst")))
        done = both.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, n - 1)).count()
        if done == n or m >= n - 1:
            w = Window.partitionBy("id").orderBy("worst", "neighbor")
            return both.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
        m = min(n - 1, 2 * m)


def knn_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """id, overlap: share of k neighbours that two views have in common (GRF-11)."""
    both = a.select("id", "neighbor").join(b.select("id", "neighbor"), ["id", "neighbor"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("id").distinct().join(both, "id", "left").select("id", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("overlap"))


def affinity(neighbors: DataFrame, k: int, eps: float = 1e-12) -> DataFrame:
    """src < dst, w = exp(-d^2 / (s_src s_dst + eps)), s the distance to the k-th neighbour; union of both directions (GRF-03)."""
    # Written, or both uses below would search for the neighbours anew.
    neighbors = cut_lineage(neighbors.select("id", "neighbor", "distance", "rank"))
    scale = neighbors.where(F.col("rank") == k).select("id", F.col("distance").alias("s"))
    edges = neighbors.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), "distance").distinct()
    j = edges.join(scale.toDF("src", "s1"), "src").join(scale.toDF("dst", "s2"), "dst")
    return j.select("src", "dst", F.exp(-F.col("distance") * F.col("distance") / (F.col("s1") * F.col("s2") + eps)).alias("w"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only where none is set and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/veldspar-checkpoints"
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder of the session."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A table written to the shared folder and reread, and its path.

    A checkpoint keeps the estimated size of its plan.  In a loop that joins a table with itself that
    estimate is raised to a power each round, until the number alone fills the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veldspar-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (least id reachable), by least labels with jumps through the label's own label (GRF-07)."""
    spark = nodes.sparkSession
    both, of_edges = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label, old = nodes.select(F.col("id"), F.col("id").alias("component")), None

    def drop(path: str) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    while True:
        near = both.join(label.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        step = label.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        # All of a label move together, to the least that any of them has next to it; else a label is passed on by one edge a round.
        least = step.groupBy(F.col("old")).agg(F.min("component").alias("least"))
        step = step.join(least, "old").select("id", F.col("least").alias("component"), "old")
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new, path = written(step.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"), "old"))
        if old:
            drop(old)
        if new.where("component <> old").isEmpty():
            drop(of_edges)
            return new.select("id", "component")
        label, old = new.select("id", "component"), path


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and cross products of vectors: partial sums by task, one d x d matrix to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=np.float64)
            if len(x):
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([np.asarray(g).tobytes()], pa.binary())], names=["n", "s", "g"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(run, "n long, s binary, g binary").collect()
    n = sum(r.n for r in rows)
    s = sum(np.frombuffer(r.s) for r in rows)
    d = len(s)
    return n, s, sum(np.frombuffer(r.g).reshape(d, d) for r in rows)


def pca(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Explained variance (descending), components by row, effective rank (EMB-01)."""
    n, s, g = gram(df, vector)
    cov = (g - np.outer(s, s) / n) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    return values, vectors, float(values.sum() ** 2 / (values**2).sum())


def classical_mds(d: np.ndarray, k: int = 2) -> np.ndarray:
    """Coordinates from a (small) distance matrix (EMB-04)."""
    n = len(d)
    c = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * c @ (d**2) @ c)
    top = np.argsort(values)[::-1][:k]
    x = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    pivot = np.argmax(np.abs(x), axis=0)
    return x * np.sign(x[pivot, np.arange(k)])


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` rotated onto ``a`` (EMB-07)."""
    u, _, v = np.linalg.svd(b.T @ a)
    return b @ (u @ v)
