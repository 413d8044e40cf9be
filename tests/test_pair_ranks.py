"""Ranks of all pairs by blocks, against ranks of the whole pair table."""

import numpy as np
import pandas as pd
import pytest

from veldspar.operators import pair_ranks, views
from veldspar.plans import evaluation
from veldspar.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
VIEWS = {"a": "a", "b": "b"}


def cohort(spark, n=90, copies=0):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[:copies] = x[0]
    rows = [(7 * i, r[:2].tolist(), r[2:].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>")


@pytest.mark.parametrize("copies", [0, 40, 90])
def test_ranks_of_pairs(spark, copies, monkeypatch):
    monkeypatch.setattr(pair_ranks, "BLOCK", 16)
    monkeypatch.setattr(pair_ranks, "SAMPLE", 20)
    df = cohort(spark, copies=copies)
    want = views.pair_distances(df, "id", VIEWS).toPandas().sort_values(["src", "dst"]).reset_index(drop=True)
    p = pair_ranks.build(df, "id", VIEWS)
    got = pair_ranks.rows(p).toPandas().sort_values(["src", "dst"]).reset_index(drop=True)
    assert p.n == len(want) == len(got) == 90 * 89 // 2
    assert (got[["src", "dst"]] == want[["src", "dst"]]).all(axis=None)
    for v in "ab":
        rank = want[v].rank()
        assert np.allclose(got[f"d_{v}"], want[v], atol=1e-12) and (got[f"r_{v}"] / 2 == rank).all()
        assert p.ends[v] == (2 * rank.min(), 2 * rank.max())
    rho = pair_ranks.correlations(p)["a", "b"]
    assert rho is None if copies == 90 else rho == pytest.approx(want.a.rank().corr(want.b.rank()), abs=1e-12)


@pytest.mark.parametrize("odd", [None, [1.0, None], [1.0, float("nan")], [1.0]])
def test_odd_vectors_take_the_pair_table(spark, odd):
    assert pair_ranks.plain(cohort(spark), VIEWS) and not pair_ranks.plain(cohort(spark).limit(0), VIEWS)
    rows = [tuple(r) for r in cohort(spark).collect()]
    rows[4] = (rows[4][0], odd, rows[4][2])
    assert not pair_ranks.plain(spark.createDataFrame(rows, "id long, a array<double>, b array<double>"), VIEWS)


def test_no_pair_table(spark, monkeypatch):
    """The queries over pairs of a cohort join no rows with rows."""

    def stop(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(views, "pair_distances", stop)
    monkeypatch.setattr(evaluation.stats, "spearman_panel", stop)
    assert QUERIES["view_distances"](spark, SF).count() == 3 and QUERIES["calibration_curve"](spark, SF).count() == 3
    assert isinstance(QUERIES["consensus_distance"](spark, SF).toPandas(), pd.DataFrame)


def test_no_pair_table_of_the_correlation(spark, monkeypatch):
    def stop(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(views, "pair_distances", stop)
    assert QUERIES["pair_spearman"](spark, SF).first()["n"] > 0


@pytest.mark.parametrize("copies", [0, 40])
def test_weighted_correlations(spark, copies, monkeypatch):
    monkeypatch.setattr(pair_ranks, "BLOCK", 16)
    monkeypatch.setattr(pair_ranks, "SAMPLE", 20)
    df = cohort(spark, copies=copies)
    got = dict(pair_ranks.weighted_correlations(pair_ranks.build(df, "id", VIEWS), lambda i, rnd: (i // 7 * rnd + i // 21) % 3, 3))
    p = views.pair_distances(df, "id", VIEWS).toPandas()
    for rnd in (1, 2, 3):
        w = ((p.src // 7 * rnd + p.src // 21) % 3) * ((p.dst // 7 * rnd + p.dst // 21) % 3)
        c = np.cov(p.a.rank(), p.b.rank(), fweights=w)
        assert got[rnd] == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), abs=1e-10)
    assert pair_ranks.weighted_correlations(pair_ranks.build(df, "id", VIEWS), lambda i, rnd: 0, 2) == [(1, None), (2, None)]


def test_no_pair_table_of_the_bootstrap(spark, monkeypatch):
    def stop(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(views, "pair_distances", stop)
    assert QUERIES["node_bootstrap"](spark, SF).count() == 5
