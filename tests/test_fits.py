"""Elastic nets against their conditions of optimality, random trees against plain loops."""

import numpy as np
import pytest

from veldspar.operators import elastic, extra_trees


def table(n=300, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 10, 0.1, 3][:p] + [5, 1e6, 0, -2][:p]
    y = 2 * (x[:, 0] - 5) + 0.3 * (x[:, 1] - 1e6) + rng.normal(size=n) * 0.5 + 1000
    return x, y


def frame(spark, x, y):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, i % 3, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, fold int, " + ", ".join(f"{c} double" for c in cols) + ", y double").repartition(4), cols


@pytest.mark.parametrize("alpha,ratio", [(0.0, 0.0), (0.5, 0.0), (0.3, 0.5), (1.0, 1.0), (50.0, 1.0)])
def test_elastic_net_is_optimal(spark, alpha, ratio):
    x, y = table()
    x = np.column_stack([x, np.full(len(x), 7.0)])
    df, cols = frame(spark, x, y)
    got = elastic.oof_predictions(df, "fold", "y", cols, {"all": cols}, {"m": (alpha, ratio)}).toPandas().sort_values("id")
    moments = elastic.training_moments(df, "fold", "y", cols)
    for f in range(3):
        rows = np.arange(len(x)) % 3 != f
        w, b = elastic.fit(moments[f], range(5), alpha, ratio)
        mean, sd = x[rows].mean(0), x[rows].std(0)
        sd[4] = 1
        z, left = (x[rows] - mean) / sd, y[rows] - x[rows] @ w - b
        v = w * sd
        slope = z.T @ left / rows.sum() - alpha * (1 - ratio) * v
        assert w[4] == 0 and abs(left.mean()) < 1e-6
        assert np.abs(slope[v != 0] - alpha * ratio * np.sign(v[v != 0])).max(initial=0) < 1e-7
        assert (np.abs(slope[v == 0]) <= alpha * ratio + 1e-7).all()
        pred = np.array([p[0]["pred"] for p in got.predictions])[~rows]
        assert np.allclose(pred, x[~rows] @ w + b, atol=1e-6)
    if alpha == 50:
        assert (w == 0).all()


def test_models_rank_by_block(spark):
    x, y = table(seed=2)
    df, cols = frame(spark, x, y)
    s = elastic.model_scores(df, "fold", "y", {"good": cols[:2], "bad": cols[2:]}, {"line": (0.0, 0.0), "net": (0.1, 0.5)}).toPandas().set_index(["block", "model"])
    assert s.n.eq(300).all() and s.r2["good", "line"] > 0.9 > s.r2["bad", "line"] and s.spearman["good", "line"] > s.spearman["good", "net"] - 0.05
    none = elastic.model_scores(df.limit(0), "fold", "y", {"good": cols[:2]}, {"line": (0.0, 0.0)})
    assert none.count() == 0


def plain_tree(x, y, tree, seed, depth, least, share):
    """One tree node by node: (feature, cut, mean) by node."""
    out, gains = {}, np.zeros(x.shape[1])

    def grow(rows, node, level):
        out[node] = (-1, 0.0, y[rows].mean())
        if level == depth:
            return
        low, high = x[rows].min(0), x[rows].max(0)
        order = sorted(range(x.shape[1]), key=lambda f: float(extra_trees.drawn(seed, tree, node, f, 1)) if high[f] > low[f] else 2.0)
        best = (1e-12, None)
        for f in sorted(order[: max(1, round(share * x.shape[1]))]):
            if high[f] <= low[f]:
                continue
            cut = low[f] + float(extra_trees.drawn(seed, tree, node, f, 2)) * (high[f] - low[f])
            left = rows[x[rows, f] <= cut]
            right = rows[x[rows, f] > cut]
            if min(len(left), len(right)) < least:
                continue
            spread = lambda r: ((y[r] - y[r].mean()) ** 2).sum()
            gain = spread(rows) - spread(left) - spread(right)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut, left, right))
        if best[1]:
            f, cut, left, right = best[1]
            gains[f] += best[0]
            out[node] = (f, cut, y[rows].mean())
            grow(left, 2 * node + 1, level + 1)
            grow(right, 2 * node + 2, level + 1)

    grow(np.arange(len(x)), 0, 0)
    return out, gains / gains.sum()


def test_random_trees_equal_plain_loops(spark):
    x, y = table(200, 4, 4)
    x[:, 3] = np.round(x[:, 3])
    df, cols = frame(spark, x, y)
    model = extra_trees.grow(df, "y", cols, trees=3, depth=4, seed=11)
    shares = []
    for t in range(3):
        want, share = plain_tree(x, y, t, 11, 4, 3, 0.55)
        shares.append(share)
        for node, (f, cut, value) in want.items():
            assert model.feature[t, node] == f and model.value[t, node] == pytest.approx(value)
            assert f < 0 or model.cut[t, node] == pytest.approx(cut)
    assert np.allclose(model.importances, np.mean(shares, axis=0)) and model.importances.argmax() == 1
    got = extra_trees.predict(df, cols, model).toPandas().sort_values("id").pred
    assert np.allclose(got, model.predict(x))


def test_random_trees_of_missing_constant_and_empty_rows(spark):
    schema = "id long, a double, b double, y double"
    same = spark.createDataFrame([(i, 1.0, 2.0, float(i)) for i in range(9)] + [(9, None, 1.0, 5.0), (10, float("nan"), 1.0, 5.0)], schema)
    model = extra_trees.grow(same, "y", ["a", "b"], trees=2)
    got = extra_trees.predict(same, ["a", "b"], model).toPandas().sort_values("id").pred
    assert np.allclose(got[:9], 4) and got[9:].isna().all() and (model.importances == 0).all()
    none = extra_trees.grow(same.limit(0), "y", ["a", "b"], trees=2)
    assert (none.feature == -1).all() and extra_trees.predict(same.limit(0), ["a", "b"], none).count() == 0


def test_random_trees_near_a_forest(spark):
    from veldspar.operators import models

    x, y = table(600, 4, 8)
    df, cols = frame(spark, x, y)
    # Random cuts need more levels than best ones: grown out until a side has under three rows.
    train, held = df.where("fold > 0"), df.where("fold = 0")
    ours = models.scores(extra_trees.predict(held, cols, extra_trees.grow(train, "y", cols, trees=24, depth=10)), "y", "pred").first().r2
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    v = VectorAssembler(inputCols=cols, outputCol="v")
    forest = RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=24, maxDepth=6, seed=1).fit(v.transform(train))
    other = models.scores(forest.transform(v.transform(held)), "y", "prediction").first().r2
    assert ours > other - 0.1 and ours > 0.6
