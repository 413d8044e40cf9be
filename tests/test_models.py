"""Invariants of compositions, alignment, maps and evaluation, on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldspar.functions import cols, spectra
from veldspar.operators import composition, evaluation, loop, maps, ranks, relational, screen, vectors, views
from veldspar.sources import tables


def values(df, *columns):
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_alignment(spark):
    """Meta order is kept, only shared keys stay, repeated keys and other lengths raise."""
    feat = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "k string, x array<double>")
    meta = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3), ("d", 4)], "k string, pos int")
    got = relational.aligned_join(meta, {"x": feat}, "k", "pos").collect()
    assert [(r.k, r.x[0]) for r in got] == [("c", 3.0), ("a", 1.0), ("b", 2.0)]
    with pytest.raises(relational.CardinalityError):
        relational.aligned_join(meta.union(meta.limit(1)), {"x": feat}, "k", "pos")
    with pytest.raises(ValueError, match="length"):
        relational.aligned_join(meta, {"x": feat.union(spark.createDataFrame([("e", [1.0, 2.0])], feat.schema))}, "k", "pos")


def test_neighbors_do_not_follow_row_order(spark):
    """All distances tied: the same neighbours whatever the order of the rows; a cohort's neighbours need the same cohort."""
    eye = [(i, [float(i == j) for j in range(8)]) for i in range(8)]
    one, two = (vectors.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), 3).select("id", "neighbor").collect() for rows, n in ((eye, 1), (eye[::-1], 5)))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    a = [(i, [x]) for i, x in enumerate((0.0, 10.0, 20.0, 0.1, 9.9))]
    common = spark.createDataFrame(a[:3], "vec_id long, embedding array<double>")
    whole = spark.createDataFrame(a, "vec_id long, embedding array<double>")
    near = {r.id: r.neighbor for r in vectors.knn(whole.join(common.select("vec_id"), "vec_id", "left_semi"), 1).collect()}
    assert near == {r.id: r.neighbor for r in vectors.knn(common, 1).collect()} and near[0] == 1


def test_composition(spark):
    """Al2O3: 0.4 and 0.6 at 13 and 8, the same for any multiple, system Al-O."""
    df = spark.createDataFrame([(1, {"Al": 2.0, "O": 3.0}), (2, {"Al": 8.0, "O": 12.0})], "k int, amounts map<string,double>")
    rows = df.select("k", composition.fraction_vector(F.col("amounts")).alias("v")).orderBy("k").collect()
    assert len(rows[0].v) == 118 and rows[0].v[12] == pytest.approx(0.4) and rows[0].v[7] == pytest.approx(0.6) and sum(rows[0].v) == pytest.approx(1)
    assert np.allclose(rows[0].v, rows[1].v)
    s = {r.k: r for r in composition.property_stats(composition.atoms(df, "k", "amounts"), composition.element_table(spark), "k", ("z", "row", "group")).collect()}
    assert s[1].z_mean == pytest.approx(0.4 * 13 + 0.6 * 8) and s[1].z_std == pytest.approx(math.sqrt(0.4 * 0.6) * 5) and s[1].z_missing == 0 and s[1].group_range == 3
    assert [composition.place(z) for z in (1, 2, 3, 10, 13, 26, 57, 71, 72, 118)] == [(1, 1), (1, 18), (2, 1), (2, 18), (3, 13), (4, 8), (6, 3), (6, 3), (6, 4), (7, 18)]
    assert len(composition.SYMBOLS) == 118 == sum(composition.PERIODS)


def test_lattice_to_fractional(spark):
    """A hexagonal cell: metal at (2/3, 1/3), and back again."""
    lattice = np.array([[3.3, 0, 0], [-1.65, 1.65 * math.sqrt(3), 0], [0, 0, 20.0]])
    want = np.array([2 / 3, 1 / 3, 0.5])
    site = want @ lattice
    lit = [[F.lit(float(x)) for x in v] for v in lattice]
    got = values(spark.range(1), *spectra.fractional(lit, [F.lit(float(x)) for x in site]))
    assert np.allclose(got, want, atol=1e-9) and np.allclose(np.array(got) @ lattice, site)
    gap, _ = spectra.vacuum_gap(F.array(*(F.lit(x) for x in (0.9, 0.05, 0.1))))
    assert values(spark.range(1), gap)[0] == pytest.approx(0.8)


def test_curves(spark):
    df = spark.createDataFrame([([50.0, 300.0, 600.0, 1700.0], [0.5, 0.8, 7.0, 1.0], 1), ([1.0], [1.0, 2.0], 2)], "x array<double>, y array<double>, k int")
    rows = df.orderBy("k").select(spectra.clean_curve(F.col("x"), F.col("y"), (100.0, 1500.0), (0.0, 5.0)).alias("c")).collect()
    assert [tuple(p) for p in rows[0].c] == [(300.0, 0.8)] and rows[1].c is None
    curve = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 10.0), (3.0, 30.0))))
    assert list(values(spark.range(1), *(spectra.interpolate_clamped(curve, F.lit(v)) for v in (0.0, 1.0, 2.0, 3.0, 9.0)))) == [10.0, 10.0, 20.0, 30.0, 30.0]


def test_high_group_rule(spark):
    """A feature that rises with the target and one that falls: AUC above 0.9 and below 0.1."""
    from veldspar.operators import stats

    df = spark.createDataFrame([(float(i), float(100 - i), i >= 90) for i in range(100)], "pf double, kappa double, good boolean")
    got = {r.feature: r for r in stats.two_group_profile(df, ("pf", "kappa"), "good").collect()}
    assert got["pf"].auc > 0.9 and got["kappa"].auc < 0.1 and got["pf"].median_good == pytest.approx(94.5) and got["pf"].median_all == pytest.approx(49.5)
    labels = got["pf"].auc, got["kappa"].auc, 0.52
    assert [values(spark.range(1), screen.effect_label(F.lit(a)))[0] for a in labels] == ["strong; higher", "strong; lower", "weak/mixed"]


def test_grouped_ranks_and_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), None if v < 1 else float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 30, 400), strict=True)] + [(9, 5.0)] * 900
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g int, v double").repartition(4)
    p = pd.DataFrame(rows, columns=["g", "v"])
    want = p.groupby("g").v.rank(method="average")
    got = [r.k for r in ranks.grouped_average_rank(df, ["g"], "v", "k").orderBy("id").collect()]
    assert all((a is None and b != b) or a == b for a, b in zip(got, want, strict=True))
    q = {r.g: r for r in ranks.grouped_quantiles(df, ["g"], "v", lo=0.1, mid=0.5, hi=0.93).collect()}
    for g, x in p.dropna().groupby("g").v:
        assert np.allclose([q[g].lo, q[g].mid, q[g].hi], np.quantile(x, [0.1, 0.5, 0.93]))


def test_overlap_null_is_the_mean_of_permutations(spark):
    rng = np.random.default_rng(1)
    n, k = 12, 3
    a, b = (np.array([rng.choice(n, k, replace=False) for _ in range(n)]) for _ in range(2))
    frames = [spark.createDataFrame([(i, int(j)) for i in range(n) for j in m[i]], "id long, neighbor long") for m in (a, b)]
    got = views.overlap_null(*frames, k, n).first()
    mean = np.mean([np.mean([len(set(a[i]) & set(b[p[i]])) / k for i in range(n)]) for p in (rng.permutation(n) for _ in range(4000))])
    assert got.overlap == pytest.approx(np.mean([len(set(a[i]) & set(b[i])) / k for i in range(n)])) and got.null_mean == pytest.approx(mean, abs=0.01)


def test_tails(spark):
    from itertools import combinations

    n, a, b = 9, 4, 5
    hits = [len(set(range(a)) & set(c)) for c in combinations(range(n), b)]
    for k in range(0, 6):
        assert evaluation.hypergeometric_tail(k, n, a, b) == pytest.approx(np.mean([h >= k for h in hits]))
    p = [values(spark.range(1), evaluation.two_sided_p(F.lit(z)))[0] for z in (0.0, 1.959964, -2.575829)]
    assert np.allclose(p, [1, 0.05, 0.01], atol=1e-5)


def test_maps_keep_what_fits_a_plane():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(15, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = maps.smacof(d)
    assert maps.stress(d, y) < 1e-6 and maps.rank_preservation(d, y) == pytest.approx(1) and maps.neighbor_preservation(d, y, 4) == 1
    noisy = d + 0.2 * np.abs(rng.normal(size=d.shape))
    noisy = (noisy + noisy.T) / 2 * (1 - np.eye(15))
    assert maps.stress(noisy, maps.smacof(noisy)) <= maps.stress(noisy, vectors.classical_mds(noisy)) + 1e-12


def test_loop(spark):
    assert loop.family_of([("a", "b"), ("b", "c")]) == {"a": ["a", "b"], "b": ["b", "c"], "c": ["b", "c"]}
    df = spark.createDataFrame([(1, ["a", "x"]), (2, ["b"])], "k int, s array<string>")
    got = sorted((r.k, r.site, tuple(r.species)) for r in loop.substitutions(df, "k", "s", [("a", "b"), ("b", "c")]).collect())
    assert got == [(1, 0, ("b", "x")), (2, 0, ("c",))]
    assert [r["elements"] for r in loop.combinations(spark, "abc", 2, 5).orderBy("place").collect()] == [["a"], ["b"], ["c"], ["a", "b"], ["a", "c"]]
    ledger = spark.createDataFrame([("x", 1.0, 0, False)], "f string, merit double, round int, winner boolean")
    new = spark.createDataFrame([("x", 9.0), ("y", 5.0), ("z", 5.0), ("w", 1.0)], "f string, merit double")
    got = {r.f: (r.merit, r.round, r.winner) for r in loop.update_ledger(ledger, new, "f", 1, 3).collect()}
    assert got == {"x": (1.0, 0, False), "y": (5.0, 3, True), "z": (5.0, 3, False), "w": (1.0, 3, False)}


def test_small_columns(spark):
    one = spark.range(1)
    got = values(one, cols.reciprocal_fallback(F.lit(None).cast("double"), F.lit(4.0)), cols.reciprocal_fallback(F.lit(None).cast("double"), F.lit(0.0)), cols.fill_missing(F.lit(float("nan")), 7.0), cols.map_labels(F.lit("q"), {"a": "b"}), cols.map_labels(F.lit("q"), {"a": "b"}, keep=True))
    assert tuple(got) == (0.25, None, 7.0, None, "q")
    with pytest.raises(Exception, match="positive"):
        one.select(cols.require(F.lit(-1.0) > 0, "must be positive", F.lit(-1.0))).collect()


def test_markdown_table_says_what_it_left_out(spark):
    many = spark.range(60)
    assert "first 50 rows" in tables.markdown_table(many) and "first" not in tables.markdown_table(many.limit(50))


def test_readiness_names_what_fails(spark):
    """A missing value fails a check."""
    from veldspar.operators import models

    got = values(spark.range(1), models.readiness(("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(False))))[0]
    assert got == ["b", "c"]


def test_benjamini_hochberg_carries_over_ranges(spark):
    """More distinct p-values than ranges, against the plain rule."""
    rng = np.random.default_rng(5)
    p = np.round(rng.random(900) ** 3, 4)
    got = {r.id: r.q for r in ranks.benjamini_hochberg(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, p double"), "p").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose([got[i] for i in order], np.minimum(q, 1))
