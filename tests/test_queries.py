"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from veldspar.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Queries that SQL can not say: against numpy on the same table.


def vectors(duck):
    d = duck.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").df()
    return d, np.array(d.embedding.tolist(), float)


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLES) == {"pca_variance", "mds_coords", "kmeans_profile", "permutation_z", "bootstrap_ci", "sampled_pair_spearman", "forest_scores", "logistic_scores", "stress_map", "map_preservation", "diffusion_coords", "silhouette_scan", "extra_tree_scores"}


def test_pca_variance(spark, duck):
    got = QUERIES["pca_variance"](spark, SF).toPandas()
    _, x = vectors(duck)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(got.sort_values("component").share, want / want.sum(), atol=1e-9)
    assert got.effective_rank.iloc[0] == pytest.approx(want.sum() ** 2 / (want**2).sum())


def test_maps_of_all_vectors(spark, duck):
    """Places by landmarks hold what a dense classical map of the same landmarks says, and stress only falls."""
    from veldspar.operators import landmarks

    d, x = vectors(duck)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, marks = landmarks.choose(e, "vec_id", "embedding")
    at = d.set_index("vec_id").index.get_indexer(ids)
    assert np.allclose(x[at], marks)
    c = np.eye(len(ids)) - 1 / len(ids)
    d2 = ((marks[:, None] - marks[None]) ** 2).sum(-1)
    values, v = np.linalg.eigh(-0.5 * c @ d2 @ c)
    pull = (v[:, ::-1][:, :2] / np.sqrt(values[::-1][:2])).T
    want = -0.5 * (((x[:, None] - marks[None]) ** 2).sum(-1) - d2.mean(0)) @ pull.T
    got = QUERIES["mds_coords"](spark, SF).toPandas().sort_values("vec_id")[["x", "y"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=2e-6)
    s = QUERIES["stress_map"](spark, SF).toPandas()
    assert sorted(s.vec_id) == sorted(d.vec_id)
    # A turn keeps distances: the classical places, turned, are as far apart as before.
    other = s.sort_values("vec_id")[["other_x", "other_y"]].to_numpy()
    i = np.arange(len(got) - 1)
    assert np.allclose(np.linalg.norm(other[i] - other[i + 1], axis=1), np.linalg.norm(got[i] - got[i + 1], axis=1), atol=1e-5)


def test_map_preservation(spark, duck):
    from veldspar.operators import landmarks

    d, x = vectors(duck)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    marks = landmarks.lower_stress(e, "vec_id", "embedding", landmarks.classical(e, "vec_id", "embedding"), 12)
    y = np.array(landmarks.place(e, "vec_id", "embedding", marks).toPandas().sort_values("id").place.tolist())
    near = []
    for m in (x, y):
        dist = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), 9) + np.diag([np.inf] * len(m))
        near.append(np.argsort(dist, axis=1, kind="stable")[:, :10])
    kept = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(*near, strict=True)])
    pairs = landmarks.landmark_pairs(e, "vec_id", "embedding", marks).toPandas()
    got = QUERIES["map_preservation"](spark, SF).toPandas().iloc[0]
    assert got.n == len(pairs) and got.spearman == pytest.approx(pairs.d.rank().corr(pairs.e.rank()), abs=2e-6)
    assert got.neighbors_kept == pytest.approx(kept, abs=1e-3)


def test_diffusion_coords(spark, duck):
    d, x = vectors(duck)
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9) + np.diag([np.inf] * len(x))
    near = np.argsort(dist, axis=1, kind="stable")[:, :10]
    scale = dist[np.arange(len(x)), near[:, -1]]
    w = np.zeros_like(dist)
    for i, js in enumerate(near):
        w[i, js] = w[js, i] = np.exp(-dist[i, js] ** 2 / (scale[i] * scale[js] + 1e-12))
    deg = w.sum(1)
    values, v = np.linalg.eigh(w / np.sqrt(np.outer(deg, deg)))
    want = v[:, ::-1][:, 1:4] / np.sqrt(deg)[:, None] * values[::-1][1:4]
    got = QUERIES["diffusion_coords"](spark, SF).toPandas().sort_values("vec_id")[["c1", "c2", "c3"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)


def test_silhouette_scan(spark, duck):
    got = QUERIES["silhouette_scan"](spark, SF).toPandas().sort_values("cluster")
    d, _ = vectors(duck)
    assert got.n.sum() == len(d) and list(got.cluster) == list(range(1, got.k.iloc[0] + 1)) and -1 <= got.silhouette.iloc[0] <= 1 and got.silhouette.nunique() == 1


def test_kmeans_profile(spark, duck):
    got = QUERIES["kmeans_profile"](spark, SF).toPandas()
    d, _ = vectors(duck)
    n = next(c for c in got.columns if c.startswith("n"))
    assert got[n].sum() == len(d) and got[n].min() > 0 and got.iloc[:, 0].is_unique


def test_permutation_z(spark):
    got = QUERIES["permutation_z"](spark, SF).toPandas().iloc[0]
    assert got.z == pytest.approx((got.observed - got.null_mean) / got.null_sd) and got.null_sd > 0 and abs(got.null_mean) < 5 * got.null_sd


def test_extra_tree_scores(spark, duck):
    got = QUERIES["extra_tree_scores"](spark, SF).toPandas().iloc[0]
    p = duck.execute("SELECT p_partkey % 1000 AS k, p_retailprice AS y, (('0x' || substr(md5(p_partkey::VARCHAR || '/' || 'fold0'), 1, 7))::BIGINT % 5)::INT = 0 AS held FROM part").df()
    # The price follows the key, so the trees must do better than a line on it, and name it.
    line = np.polyfit(p.k[~p.held], p.y[~p.held], 1)
    left = ((p.y - np.polyval(line, p.k))[p.held] ** 2).sum() / ((p.y[p.held] - p.y[p.held].mean()) ** 2).sum()
    assert got.n == p.held.sum() and got.importance_key > 0.5 and got.r2 > 0.5 * (1 - left)


def test_bootstrap_ci(spark):
    got = QUERIES["bootstrap_ci"](spark, SF).toPandas().iloc[0]
    assert got.low < got.high and got.replicates >= 100


def test_sampled_pairs_agree_with_all(spark, duck):
    _, x = vectors(duck)
    i = np.triu_indices(len(x), 1)
    a, b = (pd.Series(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1))[i]) for h in (x[:, :32], x[:, 32:]))
    got = QUERIES["sampled_pair_spearman"](spark, SF).toPandas().rho[0]
    assert abs(got - a.rank().corr(b.rank())) < 0.03


def test_forest_and_logistic(spark, duck):
    f = QUERIES["forest_scores"](spark, SF).toPandas().iloc[0]
    assert f.n == duck.execute("SELECT count(*) FROM part").fetchone()[0] and f.r2 > 0 and f.rmse >= f.mae > 0
    p = QUERIES["logistic_scores"](spark, SF).toPandas().set_index("label")
    share = duck.execute("SELECT avg((l_returnflag = 'R')::INT) FROM lineitem").fetchone()[0]
    # With an intercept the mean probability is the share, and the flagged rows have no smaller one.
    assert (p.n * p.mean_p).sum() / p.n.sum() == pytest.approx(share, abs=1e-3) and p.mean_p[1.0] >= p.mean_p[0.0] - 1e-6
