"""Permutation nulls, nondecreasing fits, information and paged sources, each against a plain version."""

import math
import os
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldspar.operators import information, monotone, permutations, vectors
from veldspar.operators import views as op_views
from veldspar.plans import views
from veldspar.sources import pages


def test_every_round_is_a_permutation(spark):
    for n in (1, 2, 3, 64, 1001):
        t = spark.range(n).select(F.col("id").alias("p")).crossJoin(permutations.deals(spark, 6, n, seed=n)).select("round", "p", permutations.dealt(F.col("p"), n, seed=n).alias("to")).toPandas()
        for number, g in t.groupby("round"):
            assert sorted(g["to"]) == list(range(n))
            assert number or (g["to"] == g["p"]).all()
        if n == 1001:
            # Fixed points are as rare, and places as unrelated, as those of random permutations.
            moved = t[t["round"] > 0]
            assert (moved["to"] == moved["p"]).sum() < 25
            assert abs(moved.groupby("round").apply(lambda g: g["to"].corr(g["p"]), include_groups=False)).max() < 0.12


def test_no_window_over_a_round(spark, capsys):
    a = spark.range(50).select("id", ((F.col("id") + 1) % 50).alias("neighbor"))
    permutations.overlap_rounds(a, a, a.select("id"), 1, 3).explain("simple")
    plan = capsys.readouterr().out
    assert "Window" not in "".join(line for line in plan.splitlines() if "round#" in line and "Window" in line)


def test_overlap_rounds_meet_the_closed_form(spark):
    rng = np.random.default_rng(2)
    n, k = 200, 4
    near = [[(i, int(j)) for i in range(n) for j in rng.choice([x for x in range(n) if x != i], k, replace=False, p=None)] for _ in "ab"]
    a, b = (spark.createDataFrame(x, "id long, neighbor long") for x in near)
    got = permutations.overlap_rounds(a, b, spark.range(n), k, 60).toPandas().set_index("round")["overlap"]
    assert got[0] == len(set(near[0]) & set(near[1])) / (n * k)
    ins = [np.bincount([j for _, j in x], minlength=n) for x in near]
    mean = ins[0] @ ins[1] / (k * n * n)
    rounds = got[got.index > 0]
    assert abs(rounds.mean() - mean) < 4 * rounds.std() / math.sqrt(60)
    one = permutations.judged(got.reset_index().pipe(spark.createDataFrame), "overlap").first()
    assert one.p == (rounds >= got[0]).mean() and one.z == pytest.approx((got[0] - rounds.mean()) / (rounds.std(ddof=0) + 1e-12))
    none = spark.createDataFrame([], "id long")
    assert permutations.overlap_rounds(a, b, none, k, 3).count() == 0


def test_smoothness_rounds(spark):
    """Against the same permutations applied in plain loops; a missing value takes its edges out."""
    rng = np.random.default_rng(4)
    y = {i * 3: (None if i == 5 else float(rng.normal())) for i in range(40)}
    ids = sorted(y)
    edges = [(ids[i], ids[j], float(rng.random())) for i in range(40) for j in rng.choice(40, 3) if i != j]
    got = permutations.smoothness_rounds(spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame(list(y.items()), "id long, y double"), 4).toPandas().set_index("round")["smoothness"]
    to = spark.range(40).crossJoin(permutations.deals(spark, 4, 40)).select("round", "id", permutations.dealt(F.col("id"), 40).alias("to")).toPandas().set_index(["round", "id"])["to"]
    place = {k: i for i, k in enumerate(ids)}
    for number in range(5):
        v = {k: y[ids[to[number, place[k]]]] for k in ids}
        e = [(w, (v[s] - v[d]) ** 2) for s, d, w in edges if v[s] is not None and v[d] is not None]
        assert got[number] == pytest.approx(sum(w * d for w, d in e) / sum(w for w, _ in e))


def test_places_are_worked_out_once(spark, monkeypatch):
    """No condition on a place that a round deals makes its hashes be worked out again."""
    # Plans as they are before they are written.
    monkeypatch.setattr(permutations, "cut_lineage", lambda df: df)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "src long, dst long, w double")
    got = permutations.smoothness_rounds(edges, spark.range(9).selectExpr("id", "cast(id as double) AS y"), 3)
    # Once for each end of an edge, as nothing is written here.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    a = spark.range(50).select("id", ((F.col("id") + 1) % 50).alias("neighbor"))
    got = permutations.overlap_rounds(a, a, a.select("id"), 1, 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_overlap_test_searches_each_view_once(spark, monkeypatch):
    """Rounds, overlap and expectation read one written search of each view."""
    rng = np.random.default_rng(13)
    rows = [(i, [float(v) for v in rng.normal(size=64)], 1) for i in range(1500)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    knn, seen = vectors.knn, []

    def counted(*args, **kw):
        seen.append(spark.sparkContext.accumulator(0))
        return knn(*args, **kw, few=0, counted=seen[-1])

    monkeypatch.setattr(vectors, "knn", counted)
    a, b, rounds = views.dealt_overlaps(lambda _: e)
    got = len(seen), sum(s.value for s in seen)
    rounds.collect(), op_views.overlap_null(a, b, views.K, 1500).collect()
    assert got == (2, sum(s.value for s in seen)) and a.count() == b.count() == 1500 * views.K


def test_mantel_sees_a_shared_layout(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    rows = [(i, x[i].tolist(), (x[i] + 0.1 * rng.normal(size=3)).tolist(), rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 3, [0.0] * 3, [0.0] * 3), (500, None, None, None)], "id long, a array<double>, b array<double>, c array<double>")
    same = permutations.judged(permutations.mantel_rounds(df, "id", "a", "b", 1500, 12), "rho").first()
    other = permutations.judged(permutations.mantel_rounds(df, "id", "a", "c", 1500, 12), "rho").first()
    assert same.observed > 0.95 and same.z > 8 and same.p == 0 and abs(other.z) < 4


def pool(x, y, w):
    """Pooling from left to right."""
    level = []
    for v, m in zip(y[np.argsort(x)], w[np.argsort(x)], strict=True):
        level.append([v * m, m, 1])
        while len(level) > 1 and level[-2][0] / level[-2][1] >= level[-1][0] / level[-1][1]:
            s, m2, n = level.pop()
            level[-1] = [level[-1][0] + s, level[-1][1] + m2, level[-1][2] + n]
    return np.repeat([s / m for s, m, _ in level], [n for *_, n in level])


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "cliff"])
def test_isotonic_over_ranges(spark, shape):
    """Blocks that reach over many ranges equal those of one pass."""
    rng = np.random.default_rng(6)
    x, n = np.arange(3000.0), 3000
    y = {"noise": x / 300 + rng.normal(size=n) * 4, "falling": -x, "rising": x, "cliff": np.where(x < 2900, x, -1500.0)}[shape]
    w = rng.integers(1, 4, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w})).repartition(5, "y")
    got = monotone.isotonic(df, "x", "y", "w", rows=400).toPandas().sort_values("x")
    assert np.allclose(got["fit"], pool(x, y, w), rtol=1e-9, atol=1e-9) and np.allclose(got["y"], y)


def test_isotonic_of_many_values(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("x"), (F.col("id") / n + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("y"))
    got = monotone.pooled(monotone.curve(df, "x", "y"), rows=150_000).toPandas().sort_values("lo")
    y = df.orderBy("x").toPandas()["y"].to_numpy()
    want = pool(np.arange(n), y, np.ones(n))
    assert np.allclose(np.repeat(got["fit"], got["weight"].astype(int)), want, rtol=1e-9)


def test_isotonic_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 4.0, "a"), (2.0, 1.0, None), (None, 9.0, "b"), (3.0, None, "c"), (4.0, float("nan"), "d"), (float("inf"), 0.0, "e"), (5.0, 7.0, "f")], "x double, y double, fit string")
    got = [(r.x, r.weight, r.y, round(r.fit, 9)) for r in monotone.isotonic(df, "x", "y").orderBy("x").collect()]
    assert got == [(1.0, 2.0, 3.0, round(7 / 3, 9)), (2.0, 1.0, 1.0, round(7 / 3, 9)), (5.0, 1.0, 7.0, 7.0)]
    assert monotone.isotonic(df.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("rows", [7, 100_000])
def test_inverse(spark, rows):
    """As a table of the fit is read backwards."""
    x = np.arange(60.0)
    fit = np.repeat(np.cumsum(np.random.default_rng(8).random(20)) - 3, 3)
    blocks = spark.createDataFrame(pd.DataFrame({"lo": x[::3], "hi": x[2::3], "fit": fit[::3]}))
    v = [*np.linspace(fit[0] - 1, fit[-1] + 1, 90), *fit[3:12:3], 0.0, -0.0]
    df = spark.createDataFrame([*((i, float(q)) for i, q in enumerate(v)), (1000, None), (1001, float("nan"))], "id long, v double")
    got = {r.id: r.x for r in monotone.inverse(blocks, df, "v", rows=rows).collect()}
    for i, q in enumerate(v):
        want = x[-1] if q >= fit[-1] else x[0] if q <= fit[0] else np.interp(q, fit, x)
        assert got[i] == pytest.approx(want), (i, q)
    assert got[1000] is None and got[1001] is None and len(got) == len(v) + 2
    assert monotone.inverse(blocks.limit(0), df, "v").where("x is not null").count() == 0
    assert monotone.inverse(blocks, df, "v", top=1e3).where(F.col("v") > 100).where("x <> 1000").count() == 0


def plain_information(x, y, k):
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, len(x) + 2))])
    psi = lambda m: harmonic[m - 1] - information.EULER
    total = 0.0
    for i in range(len(x)):
        dx, dy = np.abs(np.delete(x, i) - x[i]), np.abs(np.delete(y, i) - y[i])
        eps = np.sort(np.maximum(dx, dy))[k - 1]
        total += psi((dx < eps).sum() + 1) + psi((dy < eps).sum() + 1)
    return max(0.0, psi(k) + psi(len(x)) - total / len(x))


@pytest.mark.parametrize("few", [8192, 0])
def test_information(spark, few):
    """Against all pairs: ties in both coordinates, points held by many rows, by both ways of finding neighbours."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=500).round(1), np.zeros(60), rng.normal(size=240)])
    y = np.concatenate([x[:500] + rng.normal(size=500).round(1), np.zeros(60), rng.normal(size=240)])
    whole = [np.round(c * 1e9).astype(np.int64) for c in (x, y)]
    df = spark.createDataFrame([*((i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))), (9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 1.0, float("inf")), (None, 1.0, 1.0)], "id long, x double, y double")
    got = information.mutual_information(df, "id", "x", "y", 3, few=few).first()
    assert got.n == 800 and got.mi == pytest.approx(plain_information(*whole, 3), abs=1e-9)


def test_information_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0)], "id long, x double, y double")
    assert information.mutual_information(df, "id", "x", "y").first()["mi"] == 0.0
    assert information.mutual_information(df.limit(0), "id", "x", "y").first().asDict() == {"n": 0, "mi": 0.0}


def test_digamma(spark):
    got = spark.range(1, 400).select("id", information.digamma(F.col("id")).alias("p")).collect()
    assert max(abs(r.p - (sum(1 / i for i in range(1, r.id)) - information.EULER)) for r in got) < 1e-11


def test_residual_information(spark):
    """What the given column explains of both is no information; what is shared beyond it is."""
    rng = np.random.default_rng(10)
    g, s, u = (rng.normal(size=600) for _ in range(3))
    rows = [(i, i % 5, float(2 * g[i] + s[i]), float(g[i] + s[i]), float(g[i] + u[i]), float(g[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, shared double, other double, g double")
    yes, no = (information.residual_information(df, "id", "fold", "y", [c], ["g"], rounds=2).first() for c in ("shared", "other"))
    assert yes.corrected > 1 and yes.p == 0 and no.corrected < 0.1


def counted_page(base, page, size):
    """A service of ``n`` records whose second page fails the first time it is asked for."""
    n, folder = base.split("@")
    if page == 2 and folder:
        mark = pathlib.Path(folder) / "failed"
        if not mark.exists():
            mark.touch()
            raise OSError("try again")
    return [{"id": k, "name": f"r{k}"} for k in range((page - 1) * size, min(page * size, int(n)))]


@pytest.fixture
def service(spark):
    spark.sparkContext.addPyFile(os.path.abspath(__file__))
    return f"{pathlib.Path(__file__).stem}:counted_page"


@pytest.mark.parametrize("per_task", [1, 3, 50])
def test_pages_end_with_a_short_one(spark, service, per_task):
    for n in (0, 3, 4, 9, 41):
        got = pages.read_pages(spark, service, "id long, name string, absent int", base=f"{n}@", page_size=4, pages_per_task=per_task, wait=0).collect()
        assert sorted((r.id, r.name, r.absent, r.page) for r in got) == [(k, f"r{k}", None, k // 4 + 1) for k in range(n)]


def test_a_failing_page_is_asked_again(spark, service, tmp_path):
    got = pages.read_pages(spark, service, "id long", base=f"10@{tmp_path}", page_size=4, pages_per_task=1, wait=0.01)
    assert sorted(r.id for r in got.collect()) == list(range(10)) and (tmp_path / "failed").exists()
    assert pages.attempt(lambda: [], 0, 0) == []
    calls = []
    with pytest.raises(OSError):
        pages.attempt(lambda: calls.append(1) or (_ for _ in ()).throw(OSError("down")), 2, 0)
    assert len(calls) == 3


def test_more_pages_than_stated(spark, service):
    with pytest.raises(Exception, match="max_pages"):
        pages.read_pages(spark, service, "id long", base="41@", page_size=4, max_pages=10, wait=0).collect()
    assert pages.read_pages(spark, service, "id long", base="40@", page_size=4, max_pages=10, wait=0).count() == 40


def test_pages_of_files(spark, tmp_path):
    spark.range(23).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    got = pages.read_pages(spark, "veldspar.sources.pages:parquet_page", "id long", base=f"file://{tmp_path}/t", page_size=5).collect()
    assert sorted((r.id, r.page) for r in got) == [(k, k // 5 + 1) for k in range(23)]
