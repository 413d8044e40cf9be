"""Exact neighbours by blocks and pivots against brute force, and how much of all pairs they look at."""

import numpy as np
import pandas as pd
import pytest

from veldspar.operators import neighbors, vectors


def brute(x, ids, k, metric="euclid"):
    d = vectors._distances(x, x, metric, 9)
    d[ids[:, None] == ids[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return {int(i): [(int(ids[j]), float(d[n, j])) for j in row if np.isfinite(d[n, j])] for n, (i, row) in enumerate(zip(ids, order))}


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)] + [(-5, None, 2)], "vec_id long, embedding array<double>, block int").repartition(5)


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.neighbor, r.distance))
    return out


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "line", "few"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "clusters": lambda: rng.normal(size=(30, 6))[rng.integers(0, 30, 1500)] * 5 + rng.normal(size=(1500, 6)) * 0.1,
        "ties": lambda: rng.integers(0, 3, (1200, 4)).astype(float),
        "copies": lambda: np.repeat(rng.normal(size=(3, 5)), [700, 1, 400], axis=0),
        "line": lambda: np.outer(np.arange(900.0), [1, 2]),
        "few": lambda: rng.normal(size=(4, 3)),
    }[kind]()
    ids = rng.permutation(len(x)) * 7
    df = frame(spark, x, ids)
    got, want = listed(vectors.knn(df, 6, few=0).collect()), brute(x, ids, 6)
    assert {i: [n for n, _ in v] for i, v in got.items()} == {i: [n for n, _ in v] for i, v in want.items()}
    for i, v in want.items():
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in v], abs=1e-6)
    d = vectors._distances(x, x, "euclid", 9)
    for radius in (0.0, 1.0):
        a, b = np.nonzero((d <= radius) & (ids[:, None] < ids[None, :]))
        assert {(r.src, r.dst) for r in vectors.within(df, radius, few=0).collect()} == set(zip(ids[a].tolist(), ids[b].tolist()))


def test_cosine_and_empty(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    ids = np.arange(900)
    df = frame(spark, x, ids)
    got, want = listed(vectors.knn(df, 5, metric="cosine", few=0).collect()), brute(x, ids, 5, "cosine")
    assert {i: [n for n, _ in v] for i, v in got.items()} == {i: [n for n, _ in v] for i, v in want.items()}
    assert vectors.knn(df.limit(0), 5, few=-1).count() == vectors.within(df.limit(0), 1.0, few=-1).count() == 0


def test_skips_most_pairs(spark):
    """50,000 clustered rows: less than a fifth of all pairs are computed, and a sample of rows has its exact neighbours."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))[rng.integers(0, 200, 50_000)] * 4 + rng.normal(size=(50_000, 8)) * 0.2
    ids = np.arange(50_000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    counted = spark.sparkContext.accumulator(0)
    got = listed(vectors.knn(df, 10, counted=counted).collect())
    assert len(got) == 50_000 and 0 < counted.value < 50_000**2 / 5
    some = rng.integers(0, 50_000, 200)
    d = vectors._distances(x[some], x, "euclid", 9)
    d[np.arange(200), some] = np.inf
    for n, i in enumerate(some):
        assert [r[0] for r in got[int(i)]] == np.lexsort((ids, d[n]))[:10].tolist()


def test_blocks_go_once_to_a_shelf(spark):
    """Vectors without structure: a block is sent once to each shelf, not once to each block on it."""
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(6000, 24)), np.arange(6000))
    index, _, exact = vectors._near(df, "vec_id", "embedding", "euclid", 9)
    blocks, shelves = (len(np.unique(index.known.value[c])) for c in ("block", "shelf"))
    assert shelves <= neighbors.SHELVES + 1 < blocks
    wide = index.blocks.selectExpr("block", "transform(ids, x -> 1e9D) AS limit")
    sent = neighbors._shelved(index, wide, index.slack).agg({"block": "count"}).toPandas()["count(block)"].sum()
    assert sent == blocks * shelves
    assert neighbors.within(index, 1e9, exact).count() == 6000 * 5999 // 2


@pytest.mark.parametrize("kind", ["clusters", "copies", "few", "one"])
def test_closest_pairs(spark, kind):
    """The closest pairs of all are those of brute force, ties by ids, both ways; no list of neighbours is made for each row."""
    rng = np.random.default_rng(9)
    x = {
        "clusters": lambda: rng.normal(size=(30, 6))[rng.integers(0, 30, 1500)] * 5 + rng.normal(size=(1500, 6)) * 0.1,
        "copies": lambda: np.repeat(rng.normal(size=(3, 5)), [400, 1, 300], axis=0),
        "few": lambda: rng.normal(size=(6, 3)),
        "one": lambda: rng.normal(size=(1, 3)),
    }[kind]()
    ids = rng.permutation(len(x)) * 3
    d = vectors._distances(x, x, "euclid", 9)
    p, q = np.nonzero(ids[:, None] < ids[None, :])
    order = np.lexsort((ids[q], ids[p], d[p, q]))[:50]
    want = [(int(ids[p[n]]), int(ids[q[n]]), float(d[p[n], q[n]])) for n in order]
    for few in (0, 10_000):
        got = [tuple(r) for r in vectors.closest(frame(spark, x, ids), 50, few=few).collect()]
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-9)


def test_closest_pairs_skip_most_pairs(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 12_000)] * 4 + rng.normal(size=(12_000, 8)) * 0.2
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    counted = spark.sparkContext.accumulator(0)
    assert vectors.closest(df, 100, counted=counted).count() == 100
    assert 0 < counted.value < 12_000**2 / 20


def test_copies_of_long_vectors(spark):
    """Copies are at 0 and in the order of their ids, though products of long vectors are rounded."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 64)) * 1000, 30, axis=0)
    ids = rng.permutation(len(x))
    df = frame(spark, x, ids)
    for few in (0, 10_000):
        got = listed(vectors.knn(df, 10, few=few).collect())
        for n, i in enumerate(ids):
            same = np.sort(ids[n // 30 * 30 : n // 30 * 30 + 30])
            assert got[int(i)] == [(int(j), 0.0) for j in same[same != i][:10]]
        pairs = [(r.src, r.dst) for r in vectors.within(df, 0.0, few=few).collect()]
        assert len(pairs) == len(set(pairs)) == 40 * 30 * 29 // 2
    some = vectors.within(df, 0.0, few=0, forest=True)
    assert some.count() < 40 * 30 * 29 // 2
    nodes = df.where("vec_id >= 0").selectExpr("vec_id AS id")
    least = {int(i): int(ids[n // 30 * 30 : n // 30 * 30 + 30].min()) for n, i in enumerate(ids)}
    assert {r.id: r.component for r in vectors.components(some, nodes).collect()} == least


def test_components_of_a_long_chain(spark):
    """The size that the planner expects of the labels does not grow with the rounds."""
    order = np.random.default_rng(2).permutation(400)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "src long, dst long")
    got = vectors.components(edges, spark.range(400))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63
    assert {(r.component) for r in got.collect()} == {0}


def test_best_of_worst():
    """Lists of the nearest of both views against whole rankings, also where the views rank against each other."""
    rng = np.random.default_rng(7)
    for kind in ("independent", "ties", "opposed", "few"):
        n = 4 if kind == "few" else 3000
        x = rng.integers(0, 40, n).astype(float) if kind == "ties" else rng.normal(size=n)
        y = -x if kind == "opposed" else rng.integers(0, 40, n).astype(float) if kind == "ties" else rng.normal(size=n)
        x[1] = y[1] = np.inf
        worst = np.maximum(*(np.argsort(np.argsort(d, kind="stable"), kind="stable") + 1 for d in (x, y)))
        want = np.argsort(worst, kind="stable")
        want = want[want != 1][:6]
        to, got = vectors._best_of_worst(x, y, 6)
        assert to.tolist() == want.tolist() and got.tolist() == worst[want].tolist()


def test_affinity_searches_once(spark):
    """Edges and scales come from one search for the neighbours."""
    rng = np.random.default_rng(12)
    df = frame(spark, rng.normal(size=(3000, 4)), np.arange(3000))
    once, all_ = (spark.sparkContext.accumulator(0) for _ in range(2))
    assert vectors.knn(df, 5, few=0, counted=once).count() == 15_000
    edges = vectors.affinity(vectors.knn(df, 5, few=0, counted=all_), 5)
    assert edges.count() == edges.selectExpr("src", "dst").distinct().count() > 7_500
    # What a meeting leaves out depends on the order of the blocks, so the numbers may differ a little.
    assert all_.value < 1.2 * once.value
