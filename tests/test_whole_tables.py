"""Statistics over pairs that name no cohort take every vector of the table."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from veldspar.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    d = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return d.vec_id.to_numpy(), np.array(d.embedding.tolist(), float)


def distances(x):
    return pd.Series(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)[np.triu_indices(len(x), 1)])


def test_consensus_distance(spark, table):
    ids, x = table
    got = QUERIES["consensus_distance"](spark, SF).toPandas().sort_values(["src", "dst"])
    assert len(got) == len(ids) * (len(ids) - 1) // 2 and set(got.src) | set(got.dst) == set(ids)
    rank = distances(x[:, :32]).rank()
    assert np.allclose(got.rank_a, (rank - rank.min()) / (rank.max() - rank.min()), atol=1e-7)
    assert "WHERE" not in ORACLES["consensus_distance"]


def test_view_distances(spark, table):
    _, x = table
    d = {v: distances(x[:, s]) for v, s in (("a", slice(0, 16)), ("b", slice(16, 32)), ("d", slice(32, 64)))}
    got = QUERIES["view_distances"](spark, SF).toPandas()
    assert len(got) == 3
    for row in got.itertuples():
        assert row.rho == pytest.approx(d[row.view_a].rank().corr(d[row.view_b].rank()), abs=1e-6)
    assert "WHERE" not in ORACLES["view_distances"]


def test_calibration_curve(spark, table):
    ids, x = table
    u1, u2 = (np.array([(int(hashlib.md5(f"{i}/{s}".encode()).hexdigest()[:7], 16) % 1000003 + 1) / 1000005.0 for i in ids]) for s in ("u1", "u2"))
    x, z = (x[:, 0] - x[:, 0].mean()) / (x[:, 0].std() + 1e-8), np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
    got = QUERIES["calibration_curve"](spark, SF).toPandas().set_index("q").spearman
    for q in (0.2, 0.5, 0.8):
        assert got[q] == pytest.approx(distances(x[:, None]).rank().corr(distances((x + z * np.sqrt((1 - q) / q))[:, None]).rank()), abs=1e-5)
    assert "label" not in ORACLES["calibration_curve"]
