"""Invariants of the library outside the queries."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldspar.functions import arrays, cols, text
from veldspar.operators import ranks, relational, screen, stats, vectors
from veldspar.sources import tables


def one(df, c):
    return df.select(c.alias("v")).first().v


def test_ranks_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = [float(v) if v > 2 else None for v in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v double").repartition(5)
    got = [r.rank for r in ranks.average_rank(df, "v").orderBy("id").collect()]
    want = pd.Series(x, dtype=float).rank(method="average")
    assert all((g is None and w != w) or g == w for g, w in zip(got, want, strict=True))
    ps = [0, 0.1, 0.33, 0.5, 0.9, 1]
    assert np.allclose(ranks.exact_quantiles(df, "v", ps), np.quantile([v for v in x if v is not None], ps))


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9, 0.03]
    got = {r.p: r.q for r in ranks.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p double"), "p").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    for k, i in enumerate(order):
        assert got[p[i]] == pytest.approx(min(1, q[k]))


def test_pareto_matches_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (120, 2)))]
    got = {r.id for r in relational.pareto_front(spark.createDataFrame(pts, "id long, hi double, lo double"), "hi", "lo").collect()}
    want = {i for i, a, b in pts if not any(x >= a and y <= b and (x > a or y < b) for _, x, y in pts)}
    assert got == want


def test_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    with pytest.raises(relational.CardinalityError):
        relational.validated_join(a, a.union(a), "k")
    assert relational.validated_join(a, a.withColumnRenamed("v", "w"), "k").count() == 2
    with pytest.raises(ValueError, match="missing"):
        relational.require_columns(a, "z")


def test_rules_let_nulls_pass(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id long, x double")
    rules = [("r", "x", None, 10.0)]
    assert {r.id for r in relational.rule_kept(df, rules).collect()} == {1, 2}
    assert [(r.id, r.rule, r.field_value) for r in relational.rule_violations(df, "id", rules).collect()] == [(3, "r", 50.0)]


def test_key_overlap(spark):
    v = {n: spark.createDataFrame([(k,) for k in ks], "k long") for n, ks in (("a", [1, 2, 3, 3]), ("b", [2, 3, 4]), ("c", [9]))}
    got = {(r.view_a, r.view_b): (r.n_a, r.n_b, r.n_both) for r in relational.key_overlap(v).collect()}
    assert got == {("a", "b"): (3, 3, 2), ("a", "c"): (3, 1, 0), ("b", "c"): (3, 1, 0)}


def test_cols(spark):
    df = spark.createDataFrame([(0.0, -99999.0, "na", "Grain 100 to 500 nm; 0.5 to 1.5 micrometer", "95% of >=12.5")], "z double, s double, t string, l string, n string")
    assert one(df, cols.safe_log10(F.col("z"))) is None and one(df, cols.safe_divide(F.lit(1.0), F.col("z"))) is None
    assert one(df, cols.sentinel_to_null(F.col("s"))) is None and one(df, cols.sentinel_to_null(F.col("z"))) == 0.0
    assert one(df, cols.sentinel_to_null(F.col("t"), text=True)) is None and one(df, cols.to_number(F.col("t"))) is None
    assert one(df, text.length_um(F.col("l"))) == pytest.approx((0.3 + 1.0) / 2)
    lengths = {"100-500 nm": 0.3, "5 ~ 7 microns": 6.0, "3 to 4": None, "95 % of 12.5 um": 12.5, "2*10^-6 m": 2.0, "0.2 mm, 100 um": 150.0, "1 nm": None, "7 µm or 9 μm": 8.0, "": None}
    for words, want in lengths.items():
        assert one(df, text.length_um(F.lit(words))) == (want if want is None else pytest.approx(want)), words
    assert one(df, text.numbers_median(F.col("n"), 10, 100)) == pytest.approx((95 + 12.5) / 2)
    assert one(df, text.canonical(F.lit(" Film "), {"film": "thin film"})) == "thin film" and one(df, text.canonical(F.lit("-"), {})) is None
    assert one(df, cols.log_ratio(F.lit(1.0), F.lit(0.0))) == 6.0 and one(df, cols.geometric_mean(F.lit(4.0), F.lit(9.0), F.lit(-1.0))) == pytest.approx(6.0)


def test_distances(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "p array<double>, q array<double>")
    assert one(df, arrays.hellinger(F.col("p"), F.col("q"))) == pytest.approx(0.5**0.5)
    assert one(df, arrays.kernel_distance(F.col("p"), F.col("p"))) == pytest.approx(0, abs=1e-7)
    assert one(df, arrays.mad(F.array(*(F.lit(float(v)) for v in (1, 2, 4, 9))))) == pytest.approx(1.5)


def test_knn_is_row_order_invariant(spark):
    rows = [(i, [1.0 * (i == j) for j in range(8)]) for i in range(8)]
    a = vectors.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).select("id", "neighbor").collect()
    b = vectors.knn(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(4), 3).select("id", "neighbor").collect()
    assert set(a) == set(b) and len(a) == 24


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r.neighbor) for r in vectors.knn(df, 4).collect()}
    assert got == {(i, int(j)) for i in range(90) for j in np.argsort(d[i])[:4]}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "id long")
    assert {r.id: r.component for r in vectors.components(e, n).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}


def test_embeddings():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = vectors.classical_mds(d)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d)
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    assert np.allclose(vectors.procrustes(x, x @ turn), x)


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) * [5, 1, 1, 0.1]
    values, _, effective = vectors.pca(spark.createDataFrame([([float(v) for v in r],) for r in x], "e array<double>"), "e")
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]) and 1 < effective < 4


def test_stats(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(v), float(2 * v + 1), bool(v > 0)) for i, v in enumerate(x)], "id long, x double, y double, good boolean")
    m = stats.ols(df, "y", ["x"])
    assert (m["intercept"], m["x"], m["r2"]) == pytest.approx((1, 2, 1))
    auc, n1, n0 = stats.auc_rows(df, "x", F.col("good"))
    assert auc == 1.0 and n1 + n0 == 400 and stats.ks_statistic(df, "x", F.col("good")) == 1.0
    b = [r.mean for r in stats.bootstrap_mean(df, "x", "id", 60).collect()]
    assert abs(np.mean(b) - x.mean()) < 0.05 and 0.02 < np.std(b) < 0.1
    z = stats.permutation_z(df, "x", F.col("good"), "id", 50).first()
    assert z.z > 8 and abs(z.null_mean) < 0.1


def test_reference_exclusion(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [1.0])], "id long, g string, v array<double>")
    refs = spark.createDataFrame([("r1", "a", [0.1]), ("r2", "b", [0.9])], "rid string, rg string, rv array<double>")
    free = screen.nearest_reference(df, refs, "id", "v", "rid", "rv").orderBy("id").collect()
    barred = screen.nearest_reference(df, refs, "id", "v", "rid", "rv", exclude=("g", "rg")).orderBy("id").collect()
    assert [r.nearest for r in free] == ["r1", "r2"] and [r.nearest for r in barred] == ["r2", "r1"]


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, 2.5, "a"), (2, float("nan"), "na"), (-99999, 0.0, "b")], "id long, x double, t string")
    clean = tables.null_sentinels(df).collect()
    assert [tuple(r) for r in clean] == [(1, 2.5, "a"), (2, None, None), (None, 0.0, "b")]
    tables.write_json_records(df, f"{base}/j")
    assert tables.scan_json(spark, f"{base}/j", "id long, x double, t string").where("x is null").count() == 1
    (tmp_path / "c.csv").write_text("id,x\n1,2.5\nbroken,x,y\n")
    got = tables.scan_csv(spark, f"{base}/c.csv", "id int, x double").collect()
    assert got[0].id == 1 and got[1]._corrupt == "broken,x,y"
    (tmp_path / "k.json").write_text('{"a": {"v": 1}, "b": {"v": 2}}')
    assert {r.key: r.value.v for r in tables.scan_keyed_json(spark, f"{base}/k.json", "struct<v:int>").collect()} == {"a": 1, "b": 2}
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.read_or_build(spark, f"{base}/cache", build).count() == 3
    assert len(calls) == 1
    tables.write_typed_empty(spark, "a int, b string", f"{base}/empty")
    assert spark.read.parquet(f"{base}/empty").columns == ["a", "b"]
    assert tables.snapshot_integrity(spark, f"{base}/c.csv").first().bytes == (tmp_path / "c.csv").stat().st_size
    assert tables.id_audit(df, "id").first().repeated == 0
    assert "| 1 |" in tables.markdown_table(df)
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    tables.freeze_graph(e, f"{base}/g", k=2)
    assert {r.id: r.degree for r in spark.read.parquet(f"{base}/g/nodes").collect()} == {1: 1, 2: 2, 3: 1}


def test_config_and_structure():
    cfg = tables.parse_config("a: 1\nlist: [1, 2.5, x]  # c\nblock:\n  b: true\n  c: text\nd: null\n")
    assert cfg == {"a": 1, "list": [1, 2.5, "x"], "block": {"b": True, "c": "text"}, "d": None}
    s = tables.parse_structure(tables.format_structure("WSe2", [[3, 0, 0], [0, 3, 0], [0, 0, 9]], ["W", "Se", "Se"], [[1 / 3, 2 / 3, 0.5], [0, 0, 0.1], [0, 0, 0.9]]))
    assert s["species"] == ["W", "Se", "Se"] and s["coords"][2][2] == pytest.approx(0.9) and len(list(itertools.chain(*s["lattice"]))) == 9


def test_worst_rank_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(40)], "vec_id long, embedding array<double>")
    want = set(vectors.worst_rank(df, 3, 4).collect())
    monkeypatch.setattr(vectors, "BLOCK", 15)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert set(vectors.worst_rank(df, 3, 4).collect()) == want and len(want) == 160


def test_stream(spark, tmp_path):
    from veldspar.streaming import curves

    sf = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(sf).schema.simpleString()[7:-1].replace(":", " ")
    spark.read.parquet(sf).repartition(3).write.parquet(f"{tmp_path}/in")
    q = curves.append_to(curves.windowed_profile(curves.read_events(spark, f"{tmp_path}/in", schema, 3)), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    e = spark.read.parquet(sf).where("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.window.start, r.event_type): r.n for r in e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_models(spark):
    from veldspar.operators import models

    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(size=150) * 0.1
    rows = [(i, i % 5, float(a), float(b), float(c), int(c > 0.5)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, y double, hot int")
    got = {r.id: r.pred for r in models.oof_ridge(df, "fold", "y", ["a", "b"], 0.7).collect()}
    for f in range(5):
        on = np.arange(150) % 5 != f
        A = np.c_[np.ones(on.sum()), x[on]]
        w = np.linalg.solve(A.T @ A + np.diag([0, 0.7, 0.7]), A.T @ y[on])
        for i in np.flatnonzero(~on):
            assert got[int(i)] == pytest.approx(w[0] + x[i] @ w[1:])
    assert models.scores(models.oof_ridge(df, "fold", "y", ["a", "b"]), "y", "pred").first().r2 > 0.99
    assert models.logistic(df, "hot", ["a", "b"]).where((F.col("p") > 0.5) == (F.col("hot") == 1)).count() > 130
    edges = {"u": spark.createDataFrame([(1, 2, 2.0), (2, 3, 4.0)], "src long, dst long, w double"), "v": spark.createDataFrame([(2, 3, 1.0)], "src long, dst long, w double")}
    assert models.unit_strength(edges["u"]).agg(F.sum("w")).first()[0] == pytest.approx(6 / 4)
    s = models.supra_edges(edges, 0.3).where("layer <> other").collect()
    assert {(r.src, r.w) for r in s} == {(2, 0.3), (3, 0.3)}
    ring = np.roll(np.eye(6), 1, 0) + np.roll(np.eye(6), -1, 0)
    assert models.diffusion_map(ring).shape == (6, 2)
    assert one(df.limit(1), models.readiness(("ok", F.lit(True)), ("bad", F.lit(False)), ("unknown", F.lit(None).cast("boolean")))) == ["bad", "unknown"]


def test_worst_rank_by_lists(spark, monkeypatch):
    """The same rows from neighbour lists as from whole rankings, with lists that must grow."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(60, 6)).tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 16)
    want = sorted(map(tuple, vectors.worst_rank(df, 3, 4).collect()))
    assert sorted((r.id, r.neighbor, r.worst) for r in vectors.worst_rank_by_lists(df, 3, 4, 60, "vec_id", "embedding").collect()) == want


def test_nearest_reference_in_packs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(rng.normal(size=(40, 3)).tolist())], "id long, g int, v array<double>")
    refs = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(rng.normal(size=(25, 3)).tolist())], "rid long, rg int, rv array<double>")
    one = sorted(map(tuple, screen.nearest_reference(rows, refs, "id", "v", "rid", "rv", ("g", "rg")).collect()))
    monkeypatch.setattr(screen, "PACK", 6)
    assert sorted(map(tuple, screen.nearest_reference(rows, refs, "id", "v", "rid", "rv", ("g", "rg")).collect())) == one
