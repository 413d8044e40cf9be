"""Queries that compare models, features and held-out families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elastic, evaluation, extra_trees, information, models, monotone, pair_ranks, ranks, screen, stats, vectors
from ..operators.evaluation import _ERF
from .core import query, r
from .views import _NN

_FOLD = "(('0x' || substr(md5(l_orderkey::VARCHAR || '/' || 'fold0'), 1, 7))::BIGINT % 5)::INT"
_LINES = f"b AS (SELECT {_FOLD} AS fold, l_extendedprice AS y, l_quantity AS q, l_discount AS d FROM lineitem)"
_FITS = """f AS (SELECT k.fold, regr_slope(y, q) AS qs, regr_intercept(y, q) AS qi, regr_slope(y, d) AS ds, regr_intercept(y, d) AS di FROM (SELECT DISTINCT fold FROM b) k JOIN b ON b.fold <> k.fold GROUP BY 1)"""


def folded(t):
    l = t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return l.withColumn("fold", evaluation.shuffled_folds(F.col("l_orderkey"), 5))


@query(f"SELECT {_FOLD} AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def shuffled_folds(t, spark):
    """MOD-01: folds by a hash of the key."""
    return folded(t).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


@query(f"""
WITH {_LINES}, {_FITS}
SELECT b.fold, count(*) AS n, round(1 - sum((y - qi - qs * q) ** 2) / (var_pop(y) * count(*)), 6) AS quantity, round(1 - sum((y - di - ds * d) ** 2) / (var_pop(y) * count(*)), 6) AS discount,
  round((1 - sum((y - qi - qs * q) ** 2) / (var_pop(y) * count(*))) - (1 - sum((y - di - ds * d) ** 2) / (var_pop(y) * count(*))), 6) AS gain FROM b JOIN f USING (fold) GROUP BY 1""")
def block_ablation(t, spark):
    """MOD-09: two blocks of features on the same folds, and the paired gain."""
    s = evaluation.fold_scores(folded(t), "fold", "y", {"quantity": ["q"], "discount": ["d"]})
    return s.select("fold", "n", r(F.col("quantity")).alias("quantity"), r(F.col("discount")).alias("discount"), r(F.col("quantity") - F.col("discount")).alias("gain"))


@query(f"""
WITH {_LINES}, {_FITS}, p AS (SELECT y, round(qi + qs * q, 9) AS quantity, round(di + ds * d, 9) AS discount FROM b JOIN f USING (fold)), u AS (UNPIVOT p ON quantity, discount INTO NAME block VALUE p),
k AS (SELECT block, y, p, rank() OVER (PARTITION BY block ORDER BY p) + (count(*) OVER (PARTITION BY block, p) - 1) / 2 AS rp, rank() OVER (PARTITION BY block ORDER BY y) + (count(*) OVER (PARTITION BY block, y) - 1) / 2 AS ry FROM u)
SELECT block, round(corr(rp, ry), 6) AS spearman, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM k GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 1""")
def block_selection(t, spark):
    """MOD-10: the block with the best rank correlation, then R2, of out-of-fold predictions."""
    s = evaluation.select_block(folded(t), "fold", "y", {"quantity": ["q"], "discount": ["d"]})
    out = s.select("block", r(F.col("spearman")).alias("spearman"), r(F.col("r2")).alias("r2"))
    return ranks.top_k(out, 1, F.desc("spearman"), F.desc("r2"))


@query(f"""
WITH {_LINES.replace('SELECT', 'SELECT l_partkey AS part,', 1)}, {_FITS}, e AS (SELECT part, sum(abs(y - di - ds * d)) AS a, sum(abs(y - qi - qs * q)) AS b, count(*) AS n FROM b JOIN f USING (fold) GROUP BY 1),
w AS (SELECT round, a, b, n, ('0x' || substr(md5(part::VARCHAR || '/' || round), 1, 7))::BIGINT % 3 AS w FROM e, (SELECT unnest(range(1, 41)) AS round)), d AS (SELECT round, sum(w * (b - a)) / sum(w * n) AS delta FROM w GROUP BY 1)
SELECT round(quantile_cont(delta, 0.025), 4) AS low, round(quantile_cont(delta, 0.5), 4) AS middle, round(quantile_cont(delta, 0.975), 4) AS high FROM d""")
def cluster_bootstrap(t, spark):
    """STA-09: interval of the difference of two models' errors, whole parts drawn anew."""
    l = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    l = l.withColumn("fold", evaluation.shuffled_folds(F.col("l_orderkey"), 5))
    p = models.oof_ridge(models.oof_ridge(l, "fold", "y", ["d"], out="pd"), "fold", "y", ["q"], out="pq")
    d = evaluation.cluster_bootstrap(p, "l_partkey", F.abs(F.col("y") - F.col("pd")), F.abs(F.col("y") - F.col("pq")), 40)
    # 40 rows.
    return d.agg(*(r(F.percentile("delta", q), 4).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))))


_VFOLD = "(('0x' || substr(md5(vec_id::VARCHAR || '/' || 'fold0'), 1, 7))::BIGINT % 5)::INT"


@query(f"""
WITH {_NN}, m AS (SELECT vec_id, {_VFOLD} AS fold, embedding[64]::DOUBLE AS y FROM embeddings), p AS (SELECT n.id, a.y, avg(b.y) AS pred FROM n JOIN m a ON a.vec_id = n.id JOIN m b ON b.vec_id = neighbor WHERE ka <= 15 AND a.fold <> b.fold GROUP BY 1, 2)
SELECT count(*) AS n, round(corr(y, pred), 6) AS corr, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p""")
def masked_view(t, spark):
    """MOD-11: one view predicts a hidden value of the other, neighbours of the same fold left out."""
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"))
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[63].cast("double").alias("y"), evaluation.shuffled_folds(F.col("vec_id"), 5).alias("fold"))
    p = evaluation.masked_prediction(vectors.knn(e, 15, vector="a"), rows, "y", "fold")
    d = F.col("y") - F.col("pred")
    return p.agg(F.count(F.lit(1)).alias("n"), r(F.corr("y", "pred")).alias("corr"), r(1 - F.sum(d * d) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


_REFS = """m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings WHERE label < 5) GROUP BY 1, 2), c AS (SELECT label AS f, list(m ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT vec_id, label, f, round(sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: (p[1]::DOUBLE - p[2]) ** 2))), 9) AS d FROM embeddings, c)"""
SEEDS = (0, 1, 2, 3, 4)


def seed_distances(t):
    e = t("embeddings").select("vec_id", "label", "embedding")
    refs = screen.centroids(e.where("label < 5"), "label", "embedding").select(F.col("label").alias("family"), "centroid")
    return evaluation.reference_distances(e, refs, "vec_id", "label", "embedding")


@query(f"""
WITH {_REFS}, h AS (SELECT DISTINCT f AS held FROM c), s AS (SELECT held, label, max(-d) AS score FROM (SELECT held, vec_id, label, min(d) AS d FROM d, h WHERE f <> held GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT held, label, (rank() OVER (PARTITION BY held ORDER BY score) + (count(*) OVER (PARTITION BY held, score) - 1) / 2) / count(*) OVER (PARTITION BY held) AS pct FROM s WHERE label = held OR label >= 5)
SELECT held, round(pct, 6) AS percentile, pct >= 0.9 AS recovered FROM p WHERE label = held""")
def family_retrieval(t, spark):
    """MOD-12: where a held-out family of seeds ranks among the others, and whether it is in the top tenth."""
    out = evaluation.held_out_retrieval(seed_distances(t), SEEDS)
    return out.select("held", r(F.col("percentile")).alias("percentile"), (F.col("percentile") >= 0.9).alias("recovered"))


@query(f"""
WITH {_REFS}, s AS (SELECT vec_id, label < 5 AS good, -min(d) AS score FROM d WHERE f <> label GROUP BY 1, 2), k AS (SELECT good, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s)
SELECT round((sum(rk) FILTER (good) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM k, (SELECT count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0 FROM k) GROUP BY n1, n0""")
def family_auc(t, spark):
    """MOD-13: seeds told from the rest by the other families' seeds."""
    return evaluation.held_out_auc(seed_distances(t), SEEDS).select(r(F.col("auc")).alias("auc"))


@query(f"""
WITH {_REFS}, h AS (SELECT -1 AS held UNION ALL SELECT DISTINCT f FROM c), k AS (SELECT held, vec_id, label, d, row_number() OVER (PARTITION BY held, vec_id ORDER BY d) AS rn FROM d, h WHERE f <> held),
s AS (SELECT held, vec_id, label, round(avg(d), 9) AS d FROM k WHERE rn <= 2 GROUP BY 1, 2, 3), q AS (SELECT held, quantile_cont(d, 0.2) AS cut FROM s WHERE label >= 5 GROUP BY 1), x AS (SELECT vec_id, held, d <= cut + 1e-9 AND label >= 5 AS member FROM s JOIN q USING (held))
SELECT vec_id, bool_or(member) FILTER (held = -1) AS member, round(avg(member::INT) FILTER (held >= 0), 6) AS stability FROM x GROUP BY 1""")
def membership_stability(t, spark):
    """SCN-04, DST-11: membership near the references, and how often it holds with one family left out."""
    d = seed_distances(t)
    held = F.explode(F.array(*(F.lit(h) for h in (-1, *SEEDS)))).alias("held")
    s = d.select("vec_id", "family", "d", held).select("held", "vec_id", "family", evaluation.mean_nearest(F.col("d"), F.col("held"), 2).alias("d"))
    cut = ranks.grouped_quantiles(s.where("family >= 5"), ["held"], "d", cut=0.2)
    # A row for each held-out family.
    x = s.join(F.broadcast(cut), "held").withColumn("member", (F.col("d") <= F.col("cut") + 1e-9) & (F.col("family") >= 5))
    stable = r(F.avg(F.when(F.col("held") >= 0, F.col("member").cast("int"))))
    return x.groupBy("vec_id").agg(F.bool_or(F.when(F.col("held") == -1, F.col("member"))).alias("member"), stable.alias("stability"))


@query("""
WITH s AS (SELECT s, q, y FROM (SELECT 'all' AS s, l_quantity AS q, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'returned', l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'discounted', l_quantity, l_extendedprice FROM lineitem WHERE l_discount > 0.05
  UNION ALL SELECT 'both', l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)),
k AS (SELECT s, rank() OVER (PARTITION BY s ORDER BY q) + (count(*) OVER (PARTITION BY s, q) - 1) / 2 AS a, rank() OVER (PARTITION BY s ORDER BY y) + (count(*) OVER (PARTITION BY s, y) - 1) / 2 AS b FROM s)
SELECT s AS subset, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1""")
def subset_sensitivity(t, spark):
    """STA-23: a correlation over subsets by quality, all in one plan (a row goes to every subset it is in)."""
    flag, cheap = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    names = F.filter(F.array(F.lit("all"), F.when(flag, "returned"), F.when(cheap, "discounted"), F.when(flag & cheap, "both")), lambda x: x.isNotNull())
    rows = t("lineitem").select(F.explode(names).alias("subset"), "l_quantity", "l_extendedprice")
    return stats.spearman_panel(rows, ["l_quantity"], "l_extendedprice", ["subset"]).select("subset", "n", r(F.col("rho")).alias("spearman"))


_PP = " ".join(f"+ {c!r} * pow(t, {k})" for k, c in enumerate(_ERF, 1))


@query(f"""
WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), a AS (SELECT avg(p_retailprice) AS mu, stddev_pop(p_retailprice) AS sd, count(*) AS total FROM part),
z AS (SELECT p_brand, n, total, (m - mu) / (sd / sqrt(n)) AS z FROM g, a), x AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z)
SELECT p_brand, round(z, 6) AS z, round((0 {_PP}) * exp(-x * x), 6) AS p, CASE WHEN n >= 500 AND n / total >= 0.2 THEN 'strong' WHEN n >= 100 AND n / total >= 0.05 THEN 'moderate' ELSE 'limited' END AS grade FROM x""")
def group_scores(t, spark):
    """STA-19, STA-20: scores of groups, their two-sided p-values and the grade of the evidence."""
    p = t("part")
    g = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"))
    a = p.agg(F.avg("p_retailprice").alias("mu"), F.stddev_pop("p_retailprice").alias("sd"), F.count(F.lit(1)).alias("total"))
    z = g.crossJoin(F.broadcast(a)).withColumn("z", (F.col("m") - F.col("mu")) / (F.col("sd") / F.sqrt("n")))
    return z.select("p_brand", r(F.col("z")).alias("z"), r(evaluation.two_sided_p(F.col("z"))).alias("p"), evaluation.evidence_grade(F.col("n"), F.col("n") / F.col("total")).alias("grade"))


@query("""
WITH f AS (SELECT p_retailprice >= 950 AS a, p_size <= 10 AS b FROM part), c AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS nab FROM f)
SELECT n, na, nb, nab, round((SELECT sum(exp(lgamma(na + 1) - lgamma(k + 1) - lgamma(na - k + 1) + lgamma(n - na + 1) - lgamma(nb - k + 1) - lgamma(n - na - nb + k + 1) - lgamma(n + 1) + lgamma(nb + 1) + lgamma(n - nb + 1))) FROM range(0, 100000) t(k) WHERE k >= nab AND k <= least(na, nb)), 6) AS p_value FROM c""")
def overlap_tail(t, spark):
    """SET-08: chance of an overlap as large as the one seen."""
    a, b = F.col("p_retailprice") >= 950, F.col("p_size") <= 10
    c = t("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(a, 1)).alias("na"), F.count(F.when(b, 1)).alias("nb"), F.count(F.when(a & b, 1)).alias("nab"))
    x = c.first()
    return c.withColumn("p_value", r(F.lit(evaluation.hypergeometric_tail(x.nab, x.n, x.na, x.nb))))


@query("""
WITH c AS (SELECT vec_id, round(embedding[1]::DOUBLE * 1e9)::BIGINT AS x, round(embedding[2]::DOUBLE * 1e9)::BIGINT AS y FROM embeddings), p AS (SELECT a.vec_id AS id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM c a JOIN c b ON a.vec_id <> b.vec_id),
e AS (SELECT id, (list(greatest(dx, dy) ORDER BY greatest(dx, dy)))[3] AS eps FROM p GROUP BY 1), n AS (SELECT p.id, count(*) FILTER (dx < eps) AS nx, count(*) FILTER (dy < eps) AS ny FROM p JOIN e USING (id) GROUP BY 1),
h AS (SELECT k, sum(CASE WHEN k > 1 THEN 1 / (k - 1)::DOUBLE ELSE 0 END) OVER (ORDER BY k) - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 1 FROM c)) g(k)), m AS (SELECT avg(a.psi + b.psi) AS m FROM n JOIN h a ON a.k = nx + 1 JOIN h b ON b.k = ny + 1)
SELECT (SELECT count(*) FROM c) AS n, round(greatest((SELECT psi FROM h WHERE k = 3) + (SELECT psi FROM h WHERE k = (SELECT count(*) FROM c)) - m, 0), 6) AS mi FROM m""")
def neighbor_information(t, spark):
    """STA-18: mutual information of two coordinates of all vectors by nearest neighbours and positions; no table of pairs."""
    c = t("embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return information.mutual_information(c, "vec_id", "x", "y").select("n", r(F.col("mi")).alias("mi"))


@query()
def residual_information(t, spark):
    """STA-18: what a coordinate tells of another beyond a third, above rows dealt anew."""
    c = t("embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3))).withColumn("fold", evaluation.shuffled_folds(F.col("vec_id"), 5))
    return information.residual_information(c, "vec_id", "fold", "x0", ["x1"], ["x2"], rounds=2)


_UNI = "((('0x' || substr(md5(vec_id::VARCHAR || '/' || {0}), 1, 7))::BIGINT % 1000003) + 1) / 1000005.0"


@query(f"""
WITH q AS (SELECT unnest([0.2, 0.5, 0.8]) AS q), c AS (SELECT vec_id, embedding[1]::DOUBLE AS x, sqrt(-2 * ln({_UNI.format("'u1'")})) * cos(2 * pi() * {_UNI.format("'u2'")}) AS z FROM embeddings),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM c), v AS (SELECT q, vec_id, (x - m) / (sd + 1e-8) AS x, (x - m) / (sd + 1e-8) + z * sqrt((1 - q) / q) AS y FROM c, s, q),
p AS (SELECT a.q, round(abs(a.x - b.x), 9) AS dx, round(abs(a.y - b.y), 9) AS dy FROM v a JOIN v b ON a.q = b.q AND a.vec_id < b.vec_id),
k AS (SELECT q, rank() OVER (PARTITION BY q ORDER BY dx) + (count(*) OVER (PARTITION BY q, dx) - 1) / 2 AS a, rank() OVER (PARTITION BY q ORDER BY dy) + (count(*) OVER (PARTITION BY q, dy) - 1) / 2 AS b FROM p)
SELECT q, round(corr(a, b), 5) AS spearman FROM k GROUP BY 1""")
def calibration_curve(t, spark):
    """STA-17: what a known share of signal reads as in the rank correlation of all distances (noise made of hashes)."""
    u1, u2 = ((evaluation.hashed(F.col("vec_id"), s, 1000003) + 1) / 1000005.0 for s in ("u1", "u2"))
    c = t("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x0"), (F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * u2)).alias("z"))
    s = c.agg(F.avg("x0").alias("m"), F.stddev_pop("x0").alias("sd"))
    v = c.crossJoin(F.broadcast(s)).select("vec_id", "z", ((F.col("x0") - F.col("m")) / (F.col("sd") + 1e-8)).alias("x"), F.explode(F.array(*(F.lit(q) for q in (0.2, 0.5, 0.8)))).alias("q"))
    v = v.select("q", "vec_id", "x", (F.col("x") + F.col("z") * F.sqrt((1 - F.col("q")) / F.col("q"))).alias("y"))
    wide = v.select("q", "vec_id", F.array("x").alias("x"), F.array("y").alias("y"))
    if pair_ranks.plain(wide, {"x": "x", "y": "y"}):
        cohorts = {q: pair_ranks.build(wide.where(F.col("q") == q).drop("q"), "vec_id", {"x": "x", "y": "y"}) for q in (0.2, 0.5, 0.8)}
        rho = [(q, pair_ranks.correlations(p)["x", "y"]) for q, p in cohorts.items() if p.n]
        return spark.createDataFrame(rho, "q double, rho double").select("q", r(F.col("rho"), 5).alias("spearman"))
    b = v.toDF("q2", "v2", "x2", "y2")
    p = v.join(b, (F.col("q") == F.col("q2")) & (F.col("vec_id") < F.col("v2"))).select("q", F.round(F.abs(F.col("x") - F.col("x2")), 9).alias("dx"), F.round(F.abs(F.col("y") - F.col("y2")), 9).alias("dy"))
    return stats.spearman_panel(p, ["dx"], "dy", ["q"]).select("q", r(F.col("rho"), 5).alias("spearman"))


_FIT = """b AS (SELECT p_size::DOUBLE AS x, count(*) AS w, avg(p_retailprice) AS y, row_number() OVER (ORDER BY p_size) AS i FROM part GROUP BY p_size), m AS (SELECT a.i AS i, b.i AS j, sum(c.y * c.w) / sum(c.w) AS y FROM b a JOIN b ON b.i >= a.i JOIN b c ON c.i BETWEEN a.i AND b.i GROUP BY 1, 2),
f AS (SELECT x, w, y, (SELECT max(lo) FROM (SELECT m.i, min(m.y) AS lo FROM m WHERE m.i <= b.i AND m.j >= b.i GROUP BY 1)) AS fit FROM b)"""


@query(f"WITH {_FIT} SELECT x, w::DOUBLE AS weight, round(y, 6) AS y, round(fit, 6) AS fit FROM f")
def isotonic_curve(t, spark):
    """STA-16: nondecreasing fit of a price on a size, a row counting as one."""
    out = monotone.isotonic(t("part"), "p_size", "p_retailprice")
    return out.select("x", "weight", r(F.col("y")).alias("y"), r(F.col("fit")).alias("fit"))


@query(f"""
WITH {_FIT}, kn AS (SELECT avg(fit) AS f, min(x) AS lo, max(x) AS hi FROM f GROUP BY round(fit, 9)), v AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY 1),
o AS (SELECT p_brand, v, (SELECT max_by(kn, f) FROM kn WHERE f <= v) AS a, (SELECT min_by(kn, f) FROM kn WHERE f > v) AS b FROM v)
SELECT p_brand, round(CASE WHEN v >= (SELECT max(f) FROM kn) THEN (SELECT max(hi) FROM kn) WHEN v <= (SELECT min(f) FROM kn) THEN (SELECT min(lo) FROM kn) ELSE a.hi + (b.lo - a.hi) * (v - a.f) / (b.f - a.f) END, 4) AS x FROM o""")
def isotonic_inverse(t, spark):
    """STA-16: the size at which the fitted curve reads each brand's mean price."""
    blocks = monotone.pooled(monotone.curve(t("part"), "p_size", "p_retailprice"))
    brands = t("part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    return monotone.inverse(blocks, brands, "v").select("p_brand", r(F.col("x"), 4).alias("x"))


@query(f"WITH {_NN} SELECT count(*) AS n, 0::BIGINT AS changed FROM e")
def order_invariance(t, spark):
    """STA-22: neighbours of rows in another order and another partitioning: none may change."""
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"))
    one = vectors.knn(e, 5, vector="a").select("id", "neighbor", "rank")
    two = vectors.knn(e.repartition(7, F.col("vec_id") % 3).sortWithinPartitions(F.desc("vec_id")), 5, vector="a").select("id", "neighbor", "rank")
    return e.agg(F.count(F.lit(1)).alias("n")).withColumn("changed", F.lit(one.exceptAll(two).count()))


@query()
def forest_scores(t, spark):
    """MOD-05: forest regression of the price."""
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("type"), F.col("p_retailprice").alias("y"))
    out, _ = models.random_forest(p, "y", ["size", "type"], trees=20)
    return models.scores(out, "y", "prediction")


@query()
def logistic_scores(t, spark):
    """MOD-04: probability of a flag by logistic regression."""
    l = t("lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount", "l_tax")
    return models.logistic(l, "label", ["l_quantity", "l_discount", "l_tax"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))


@query()
def extra_tree_scores(t, spark):
    """MOD-06: extremely random trees on the price, out of fold."""
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("type"), (F.col("p_partkey") % 1000).cast("double").alias("key"), F.col("p_retailprice").alias("y"))
    p = p.withColumn("held", evaluation.shuffled_folds(F.col("p_partkey"), 5) == 0)
    xs = ["size", "type", "key"]
    model = extra_trees.grow(p.where("NOT held"), "y", xs, trees=24, depth=6)
    out = models.scores(extra_trees.predict(p.where("held"), xs, model), "y", "pred")
    return out.select("n", *(r(F.col(c)).alias(c) for c in ("r2", "mae", "rmse")), *(F.lit(round(float(v), 6)).alias(f"importance_{x}") for x, v in zip(xs, model.importances, strict=True)))


_NETS = {"ridge": (0.5, 0.0), "net": (20.0, 0.5), "lasso": (100.0, 1.0)}
_NET_ROWS = ", ".join(f"('{m}', {a}, {q})" for m, (a, q) in _NETS.items())


@query(f"""
WITH {_LINES}, u AS (SELECT fold, y, block, x FROM b, LATERAL (SELECT unnest(['quantity', 'discount']) AS block, unnest([q::DOUBLE, d::DOUBLE]) AS x)), m AS (SELECT * FROM (VALUES {_NET_ROWS}) v(model, alpha, ratio)),
s AS (SELECT k.fold, block, avg(y::DOUBLE) AS my, avg(x) AS mx, stddev_pop(x) AS sx, covar_pop(y::DOUBLE, x) / stddev_pop(x) AS c FROM (SELECT DISTINCT fold FROM b) k JOIN u ON u.fold <> k.fold GROUP BY 1, 2),
w AS (SELECT fold, block, model, my, mx, sx, sign(c) * greatest(abs(c) - alpha * ratio, 0) / (1 + alpha * (1 - ratio)) AS w FROM s, m),
p AS (SELECT block, model, y, round(my + w * (x - mx) / sx, 6) AS p FROM u JOIN w USING (fold, block)),
k AS (SELECT block, model, y, p, rank() OVER (PARTITION BY block, model ORDER BY p) + (count(*) OVER (PARTITION BY block, model, p) - 1) / 2 AS rp, rank() OVER (PARTITION BY block, model ORDER BY y) + (count(*) OVER (PARTITION BY block, model, y) - 1) / 2 AS ry FROM p)
SELECT block, model, count(*) AS n, round(corr(rp, ry), 5) AS spearman, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM k GROUP BY 1, 2""")
def model_selection(t, spark):
    """MOD-04, MOD-10: blocks of features by models (ridge, elastic net, lasso), scored out of fold; with one feature the fit has a closed form."""
    s = elastic.model_scores(folded(t), "fold", "y", {"quantity": ["q"], "discount": ["d"]}, _NETS)
    return s.select("block", "model", "n", r(F.col("spearman"), 5).alias("spearman"), r(F.col("r2")).alias("r2"))
