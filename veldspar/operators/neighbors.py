"""Exact neighbours without all pairs (GRF-01, DST-01).

Rows are put next to rows near the same centre and cut into blocks.  Of each block the least and the
greatest distance to some pivots is known, so by the triangle inequality two blocks, or a row and a
block, are at least so far apart as their distances to a pivot differ.  A first round looks into a
block itself and the two nearest ones, which gives each row a distance that its k-th neighbour can
not exceed; the second round visits the blocks that may hold something nearer, and of these only the
rows that may.  What is sent on are a row's candidates below its own limit.

Consecutive blocks form shelves.  A block goes once to each shelf in which some block may hold
something for it, not once to each such block, and two shelves meet in one task for both directions;
so what is shuffled is the blocks times the number of shelves at most, and a task holds two shelves.

The summary of the blocks is broadcast: there are at most about ``MOST_BLOCKS`` of them whatever the
number of rows, as blocks grow beyond.  Centres and pivots are fitted on a bounded sample; they
decide what is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast, TaskContext
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

ROWS, MOST_BLOCKS = 256, 1 << 16
#: Rows of the fit, pivots, and centres at most.
SAMPLE, PIVOTS, CENTRES = 8192, 48, 1024
#: What distances of two formulas may differ by, as a share of the largest length met.
SLACK = 1e-6
#: Shelves at least (tasks to share the work), and bytes of vectors on one at most.
SHELVES, SHELF_BYTES = 12, 16 << 20
#: Candidates that a task holds before it drops those that are not among a row's nearest.
HELD = 1 << 20


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in which the triangle inequality holds: a cosine distance is half the squared distance of unit vectors."""
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] if metric == "cosine" else x


def _metric(d: np.ndarray | float, metric: str) -> np.ndarray | float:
    """The straight distance of a metric's; the longest one that the greater difference of two coordinates ("square") can have."""
    return np.sqrt(2 * np.maximum(d, 0)) if metric == "cosine" else np.sqrt(2) * d if metric == "square" else d


def far_points(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each far from all before it."""
    at = [int(np.argmax(lengths(x, x[:1])[:, 0]))]
    near = lengths(x, x[at])[:, 0]
    while len(at) < min(n, len(x)) and near.max() > 0:
        at.append(int(np.argmax(near)))
        near = np.minimum(near, lengths(x, x[at[-1:]])[:, 0])
    return x[at]


def centres(x: np.ndarray, n: int, steps: int = 4) -> np.ndarray:
    c = far_points(x, n)
    for _ in range(steps):
        of = np.argmin(lengths(x, c), axis=1)
        count = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


@dataclass
class Index:
    """Blocks (block, ids, matrix, low, high) and what all tasks know of them."""

    blocks: DataFrame
    known: Broadcast
    metric: str

    @property
    def slack(self) -> float:
        return self.known.value["slack"]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def build(df: DataFrame, id_col: str, vector: str, metric: str, keep: Callable[[DataFrame], DataFrame], rows: int = ROWS) -> Index | None:
    """``keep`` writes a table and rereads it."""
    spark = df.sparkSession
    src = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = src.count()
    if not n:
        return None
    size = max(rows, -(-n // MOST_BLOCKS))
    some = _unit(_matrix(src.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"]), metric)
    fit = spark.sparkContext.broadcast((far_points(some, PIVOTS), centres(some, min(CENTRES, max(1, n // size)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = lengths(_unit(_matrix(b.column(1)), metric), fit.value[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmin(d, axis=1), pa.int32()), pa.array(d.min(axis=1))], names=["id", "v", "cell", "away"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            ids, x = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            d = lengths(_unit(x, metric), fit.value[0])
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([d.min(axis=0).tolist()]), pa.array([d.max(axis=0).tolist()])], names=["block", "ids", "matrix", "low", "high"])

        for b in batches:
            cell, ids, x = b.column(2).to_numpy(), b.column(0).to_numpy(), _matrix(b.column(1))
            at = 0
            while at < len(ids):
                if held and held[0][0] != cell[at]:
                    yield block()
                same = int(np.searchsorted(cell, cell[at], "right"))
                to = min(same, at + size - sum(len(h[1]) for h in held))
                held.append((int(cell[at]), ids[at:to], x[at:to]))
                if sum(len(h[1]) for h in held) >= size:
                    yield block()
                at = to
        if held:
            yield block()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (64 * size)))
    placed = src.mapInArrow(place, "id long, v array<double>, cell int, away double").repartitionByRange(parts, "cell", "away", "id").sortWithinPartitions("cell", "away", "id")
    blocks = keep(placed.select("id", "v", "cell").mapInArrow(cut, "block long, ids array<long>, matrix binary, low array<double>, high array<double>"))
    # Two numbers a pivot for each of a bounded number of blocks.
    t = blocks.select("block", F.size("ids").cast("long").alias("n"), "low", "high").orderBy("block").toArrow()
    number, count = (t[c].to_numpy() for c in ("block", "n"))
    low, high = (t[c].combine_chunks().flatten().to_numpy().reshape(len(number), -1) for c in ("low", "high"))
    longest = high.max() + np.linalg.norm(fit.value[0], axis=1).max()
    shelf = max(size, min(SHELF_BYTES // (8 * some.shape[1]), -(-n // SHELVES)))
    known = {"block": number, "n": count, "low": low, "high": high, "shelf": (np.cumsum(count) - count) // shelf, "pivots": fit.value[0], "slack": SLACK * (1 + longest)}
    return Index(blocks, spark.sparkContext.broadcast(known), metric)


def least(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """What every block, or row, of the right side is at least away from the left one."""
    return np.maximum(np.maximum(lows - high, low - highs).max(axis=-1), 0)


def _targets(index: Index, table: DataFrame, choose: Callable[[dict, dict], np.ndarray]) -> DataFrame:
    """block, target: the blocks that each block must meet."""
    known = index.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                to = known.value["block"][choose(row, known.value)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(to), pa.int64()), pa.array(to, pa.int64())], names=["block", "target"])

    return table.mapInArrow(run, "block long, target long")


def _bodies(row: dict, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(row[f"ids{suffix}"])
    return ids, np.frombuffer(row[f"matrix{suffix}"]).reshape(len(ids), -1)


def _other(index: Index) -> DataFrame:
    return index.blocks.select(F.col("block").alias("target"), F.col("ids").alias("ids2"), F.col("matrix").alias("matrix2"), F.col("low").alias("low2"), F.col("high").alias("high2"))


def knn(index: Index, k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[DataFrame], DataFrame], counted: Accumulator | None = None) -> DataFrame:
    """id, neighbor, distance, rank: the k nearest others, ties by id; ``distances`` of all rows of two blocks, ``exact`` of one row with one."""
    metric, slack, known = index.metric, index.slack, index.known

    def close(row: dict, all_: dict) -> np.ndarray:
        low, high = np.array(row["low"]), np.array(row["high"])
        middle = np.abs((all_["low"] + all_["high"]) - (low + high)).sum(axis=1)
        order = np.lexsort((middle, least(low, high, all_["low"], all_["high"]), all_["block"] != row["block"]))
        enough = int(np.searchsorted(np.cumsum(all_["n"][order]), k + 1)) + 1
        # Itself, two more, and as many as k rows need.
        return order[: max(3, enough)]

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                i, x = _bodies(row)
                best = np.empty((len(i), 0))
                for other in row["others"]:
                    j, y = _bodies(other, "2")
                    d = distances(x, y)
                    d[i[:, None] == j[None, :]] = np.inf
                    if counted is not None:
                        counted.add(d.size)
                    best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
                limit = np.nan_to_num(_metric(best[:, -1], metric), nan=np.inf, posinf=np.inf) if best.shape[1] == k else np.full(len(i), np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([limit.tolist()], pa.list_(pa.float64()))], names=["block", "limit"])

    first = _targets(index, index.blocks.select("block", "low", "high"), close)
    near = first.join(_other(index), "target").groupBy("block").agg(F.collect_list(F.struct("ids2", "matrix2")).alias("others"))
    limit = keep(index.blocks.select("block", "ids", "matrix").join(near, "block").mapInArrow(limits, "block long, limit array<double>"))

    def candidates(t: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def nearest() -> None:
            """Of what is held, each row's k nearest."""
            i, j, d = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((j, d, i))
            i = i[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            keep = order[np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k]
            i, j, d = (np.concatenate(c) for c in zip(*held, strict=True))
            held[:] = [(i[keep], j[keep], d[keep])]

        many = 0
        for (i, x, top), (j, y, other), g, same in _meetings(t, known, metric, counted):
            for left, u, right, v, fits in ((i, x, j, y, g >= top[:, None]), *([] if same else [(j, y, i, x, (g >= other[None, :]).T)])):
                if not fits.any():
                    continue
                p, q = np.nonzero(fits)
                p, q = (c[left[p] != right[q]] for c in (p, q))
                got = exact(u[p], v[q])
                on = np.isfinite(got)
                held.append((left[p[on]], right[q[on]], got[on]))
                many += len(held[-1][0])
            if many > HELD:
                nearest()
                many = 0
        if many:
            nearest()
        i, j, d = held[0] if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"id": i, "neighbor": j, "distance": d})

    found = _shelved(index, limit, slack).applyInArrow(candidates, "id long, neighbor long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _shelved(index: Index, limit: DataFrame, slack: float) -> GroupedData:
    """The blocks (with their rows' limits) by every two shelves of which some blocks may hold something for one another."""
    t = limit.select("block", F.array_max("limit").alias("top")).orderBy("block").toArrow()
    known, tops = index.known, index.blocks.sparkSession.sparkContext.broadcast(t["top"].to_numpy())

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, others = [], []
            for number in b.column(0).to_pylist():
                n = int(np.searchsorted(known.value["block"], number))
                shelf, low, high = (known.value[c] for c in ("shelf", "low", "high"))
                own.append(int(shelf[n]))
                # As seen from either block, so that both go to the same pair of shelves.
                others.append(np.unique(shelf[least(low[n], high[n], low, high) <= np.maximum(tops.value[n], tops.value) + slack]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=["block", "limit", "shelf", "others"])

    to = limit.mapInArrow(touched, "block long, limit array<double>, shelf long, others array<long>")
    rows = index.blocks.join(to, "block").withColumn("other", F.explode("others")).drop("others")
    return rows.withColumns({"one": F.least("shelf", "other"), "two": F.greatest("shelf", "other")}).groupBy("one", "two")


def _meetings(t: pa.Table, known: Broadcast, metric: str, counted: Accumulator | None) -> Iterator[tuple]:
    """Of every two blocks on a pair of shelves, once: what may be near.

    (ids, vectors, limits) of both sides, distances, whether both are one block; limits and straight
    distances as minus half their squares, which one product gives.
    """
    slack, pivots = known.value["slack"], known.value["pivots"]
    sides: dict[int, list[dict]] = {}
    for n in range(len(t)):
        row = {c: t[c][n].as_py() for c in ("shelf", "block", "matrix")} | {c: t[c][n].values.to_numpy(zero_copy_only=False) for c in ("ids", "limit", "low", "high")}
        x = np.frombuffer(row["matrix"]).reshape(len(row["ids"]), -1)
        unit = _unit(x, metric)
        half, one = -(unit * unit).sum(1)[:, None] / 2, np.ones((len(x), 1))
        sides.setdefault(row["shelf"], []).append(row | {"x": x, "left": np.hstack([unit, half, one]), "right": np.hstack([unit, one, half]), "away": lengths(unit, pivots), "reach": -((row["limit"] + slack) ** 2) / 2})
    first, last = t["one"][0].as_py(), t["two"][0].as_py()
    if not {first, last} <= set(sides):
        return
    to = sides[last]
    low, high, tops = np.array([o["low"] for o in to]), np.array([o["high"] for o in to]), np.array([o["limit"].max() for o in to])
    # Where rows of blocks that meet are seldom ruled out, every eighth meeting still tries.
    met, all_, kept = 0, 0, 0
    for row in sides[first]:
        for n in np.flatnonzero(least(row["low"], row["high"], low, high) <= np.maximum(row["limit"].max(), tops) + slack):
            other = to[n]
            if first == last and other["block"] < row["block"]:
                continue
            met += 1
            if met % 8 and kept > 0.7 * all_ > 0:
                p, q = (slice(0, len(a["x"])) for a in (row, other))
                size = len(row["x"]) * len(other["x"])
            else:
                mine, theirs = (least(a["away"], a["away"], b["low"], b["high"]) <= a["limit"] + slack for a, b in ((row, other), (other, row)))
                # Of each side the rows that look for something there, and those that such rows may find.
                p, q = (_wanted(a, own, b, seeking, slack) for a, own, b, seeking in ((row, mine, other, theirs), (other, theirs, row, mine)))
                size = len(p) * len(q)
                all_, kept = all_ + len(row["x"]) * len(other["x"]), kept + size
            if not size:
                continue
            if counted is not None:
                counted.add(size)
            yield (row["ids"][p], row["x"][p], row["reach"][p]), (other["ids"][q], other["x"][q], other["reach"][q]), row["left"][p] @ other["right"][q].T, row is other


def _wanted(a: dict, own: np.ndarray, b: dict, seeking: np.ndarray, slack: float) -> np.ndarray:
    if seeking.any():
        away = b["away"][seeking]
        own = own | (least(away.min(axis=0), away.max(axis=0), a["away"], a["away"]) <= b["limit"][seeking].max() + slack)
    return np.flatnonzero(own)


def within(index: Index, radius: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], counted: Accumulator | None = None, forest: bool = False) -> DataFrame:
    """src < dst of all pairs no farther apart than the radius; ``forest``: of a task's pairs only as many as connect the same rows."""
    known, metric, slack = index.known, index.metric, index.slack
    reach = float(_metric(radius, metric))
    limit = index.blocks.select("block", F.transform("ids", lambda _: F.lit(reach)).alias("limit"))

    def run(t: pa.Table) -> pa.Table:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        many = 0
        for (i, x, top), (j, y, _), g, same in _meetings(t, known, metric, counted):
            if not (fits := g >= top[:, None]).any():
                continue
            p, q = np.nonzero(fits)
            on = exact(x[p], y[q]) <= radius
            on &= i[p] < j[q] if same else i[p] != j[q]
            held.append((np.minimum(i[p[on]], j[q[on]]), np.maximum(i[p[on]], j[q[on]])))
            many += len(held[-1][0])
            if forest and many > HELD:
                held[:] = [spanning(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                many = 0
        src, dst = (np.concatenate(c) for c in zip(*held, strict=True))
        src, dst = spanning(src, dst) if forest else (src, dst)
        return pa.table({"src": src, "dst": dst})

    return _shelved(index, limit, slack).applyInArrow(run, "src long, dst long")


def closest(index: Index, k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], counted: Accumulator | None = None) -> DataFrame:
    """id < neighbor, distance: the k closest pairs of all, ties by ids.

    The k closest pairs within blocks bound what is looked for; a task keeps its own k closest and then
    looks no farther than the last of them.
    """
    known, metric, slack = index.known, index.metric, index.slack

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                i, x = _bodies(row)
                d = distances(x, x)[i[:, None] < i[None, :]]
                d = d[np.isfinite(d)]
                yield pa.RecordBatch.from_arrays([pa.array(np.partition(d, k - 1)[:k] if len(d) > k else d)], names=["distance"])

    near = index.blocks.select("ids", "matrix").mapInArrow(own, "distance double").orderBy("distance").limit(k).collect()
    bound = near[-1]["distance"] if len(near) == k else np.inf

    def straight(d: float) -> float:
        return float(_metric(d + slack, metric))

    limit = index.blocks.select("block", F.transform("ids", lambda _: F.lit(straight(bound))).alias("limit"))

    def run(t: pa.Table) -> pa.Table:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        many, last = 0, bound + slack

        def nearest() -> None:
            nonlocal many, last
            i, j, d = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((j, i, d))[:k]
            held[:] = [(i[order], j[order], d[order])]
            many, last = 0, d[order[-1]] if len(order) == k else last

        for (i, x, _), (j, y, _), g, same in _meetings(t, known, metric, counted):
            p, q = np.nonzero(g >= -((straight(last) + slack) ** 2) / 2)
            on = i[p] < j[q] if same else i[p] != j[q]
            p, q = p[on], q[on]
            got = exact(x[p], y[q])
            on = np.isfinite(got) & (got <= last)
            p, q = p[on], q[on]
            held.append((np.minimum(i[p], j[q]), np.maximum(i[p], j[q]), got[on]))
            many += len(p)
            if many > HELD:
                nearest()
        nearest()
        i, j, d = held[0]
        return pa.table({"id": i, "neighbor": j, "distance": d})

    found = _shelved(index, limit, slack).applyInArrow(run, "id long, neighbor long, distance double")
    return found.orderBy("distance", "id", "neighbor").limit(k)


def spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row but the least of its component a pair with that least one."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Both the ends and what they are named after.
        for to in (a, b, label[a], label[b]):
            np.minimum.at(new, to, low)
        new = new[new]
        if (new == label).all():
            on = np.flatnonzero(label != np.arange(len(ids)))
            return ids[label[on]], ids[on]
        label = new
