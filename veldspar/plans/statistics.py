"""Queries of ranks, quantiles, correlations, screening and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks, screen, stats
from .core import query, r

_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
FEATURES = ("l_quantity", "l_discount", "l_tax")


def _profile_sql() -> str:
    one = """SELECT '{f}' AS feature, round(median({f}) FILTER (good), 6) AS median_good, round(median({f}), 6) AS median_all,
  round((sum(rk) FILTER (good) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM (SELECT {f}, good, {rk} AS rk FROM g WHERE {f} IS NOT NULL), (SELECT count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0 FROM g) GROUP BY n1, n0"""
    body = " UNION ALL ".join(one.format(f=f, rk=_AVG.format(f)) for f in FEATURES)
    return f"""WITH q AS (SELECT round(quantile_cont(l_extendedprice, 0.9), 9) AS c FROM lineitem), g AS (SELECT l_quantity, l_discount, l_tax, round(l_extendedprice, 9) >= c AS good FROM lineitem, q), p AS ({body})
SELECT *, CASE WHEN round(2 * abs(auc - 0.5), 9) < 0.1 THEN 'weak/mixed' ELSE CASE WHEN round(2 * abs(auc - 0.5), 9) >= 0.3 THEN 'strong' ELSE 'moderate' END || '; ' || CASE WHEN auc > 0.5 THEN 'higher' ELSE 'lower' END END AS effect FROM p"""


@query(_profile_sql())
def high_group_profile(t, spark):
    """AGG-07, STA-11, STA-19: the top decile of price against all, feature by feature."""
    df = t("lineitem").select("l_extendedprice", *FEATURES)
    (cut,) = ranks.exact_quantiles(df, "l_extendedprice", [0.9])
    good = F.round("l_extendedprice", 9) >= round(cut, 9)
    flagged = df.withColumn("good", good)
    out = stats.two_group_profile(flagged, FEATURES, "good").select("feature", r(F.col("median_good")).alias("median_good"), r(F.col("median_all")).alias("median_all"), r(F.col("auc")).alias("auc"))
    return out.withColumn("effect", screen.effect_label(F.col("auc")))


@query(f"SELECT p_partkey, round(({_AVG.format('p_retailprice')}) / count(*) OVER (), 9) AS pct, round(1 - ({_AVG.format('p_retailprice')}) / count(*) OVER () + 1.0 / count(*) OVER (), 9) AS pct_low FROM part")
def pct_rank_average(t, spark):
    """WIN-01, WIN-02: percentile rank with shared ties, and its inverse."""
    p = ranks.percent_rank(t("part").select("p_partkey", "p_retailprice"), "p_retailprice")
    n = t("part").count()
    return p.select("p_partkey", F.round("pct", 9).alias("pct"), F.round(1 - F.col("pct") + 1.0 / n, 9).alias("pct_low"))


@query(f"SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN rk END AS rank FROM supplier LEFT JOIN (SELECT s_suppkey, {_AVG.format('s_acctbal')} AS rk FROM supplier WHERE s_acctbal > 0) USING (s_suppkey)")
def masked_rank(t, spark):
    """WIN-03: ranks inside a cohort only."""
    s = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("b"))
    return ranks.average_rank(s, "b").select("s_suppkey", "rank")


@query("""
WITH e AS (SELECT DISTINCT round(unnest(quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])), 9) AS e FROM lineitem),
inner_e AS (SELECT e FROM e WHERE e > (SELECT min(e) FROM e) AND e < (SELECT max(e) FROM e)), b AS (SELECT l_extendedprice, (SELECT count(*) FROM inner_e WHERE l_quantity > e) AS bin FROM lineitem)
SELECT bin::INT AS bin, count(*) AS n, round(avg(l_extendedprice), 6) AS mean_price FROM b GROUP BY 1""")
def qcut_bins(t, spark):
    """WIN-06: quantile bins with repeated edges dropped."""
    b = ranks.quantile_bins(t("lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", 10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice")).alias("mean_price"))


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 500000 THEN floor(o_totalprice / 50000)::INT END AS bin FROM orders) GROUP BY 1")
def cut_bins(t, spark):
    """WIN-07: stated edges, closed on the left, null outside."""
    return t("orders").select(ranks.cut_bins(F.col("o_totalprice"), [50_000.0 * i for i in range(11)]).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH pool AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, round((SELECT count(*) FROM pool WHERE v < c_acctbal) / (SELECT count(*) FROM pool), 9) AS ecdf FROM customer""")
def ecdf_left(t, spark):
    """WIN-08: share of a pool below each value, pool and rows counted in one pass."""
    c = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return ranks.ecdf(c, "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("c_custkey", F.round("ecdf", 9).alias("ecdf"))


@query("SELECT c_custkey, round(((SELECT count(*) FROM customer d WHERE d.c_nationkey < c.c_nationkey) + (SELECT count(*) FROM customer d WHERE d.c_nationkey = c.c_nationkey) / 2.0) / (SELECT count(*) FROM customer), 9) AS ecdf FROM customer c")
def ecdf_mid(t, spark):
    """WIN-09: ties count half."""
    return ranks.ecdf(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", side="mid").select("c_custkey", F.round("ecdf", 9).alias("ecdf"))


@query("""
WITH p AS (SELECT p_partkey, round(p_size / 60.0 * p_size / 60.0, 9) AS p FROM part), k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk, count(*) OVER () AS m FROM p)
SELECT p_partkey, p, round(least(1, min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM k""")
def bh_adjust(t, spark):
    """WIN-12, STA-20."""
    p = t("part").select("p_partkey", F.round(F.col("p_size") / 60.0 * F.col("p_size") / 60.0, 9).alias("p"))
    return ranks.benjamini_hochberg(p, "p").select("p_partkey", "p", F.round("q", 9).alias("q"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def corr_pearson(t, spark):
    """STA-01, AGG-25: all pairs in one pass."""
    return t("lineitem").agg(r(F.corr("l_quantity", "l_extendedprice")).alias("quantity_price"), r(F.corr("l_quantity", "l_discount")).alias("quantity_discount"), r(F.corr("l_discount", "l_tax")).alias("discount_tax"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS feature, round(corr(a, b), 6) AS spearman, count(*) AS n FROM (SELECT {_AVG.format(x)} AS a, {_AVG.format('l_extendedprice')} AS b FROM lineitem)" for x in FEATURES))
def corr_spearman_panel(t, spark):
    """STA-02, LOP-01: rank correlation of each feature with the target."""
    return stats.spearman_panel(t("lineitem"), FEATURES, "l_extendedprice").select("feature", r(F.col("rho")).alias("spearman"), "n")


@query(f"""
WITH k AS (SELECT {_AVG.format('l_quantity')} AS x, {_AVG.format('l_extendedprice')} AS y, {_AVG.format('l_tax')} AS z FROM lineitem), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM k)
SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def partial_spearman(t, spark):
    """STA-03."""
    v = stats.partial_spearman(t("lineitem"), "l_quantity", "l_extendedprice", "l_tax")
    return spark.createDataFrame([(float(v),)], "partial double").select(r(F.col("partial")).alias("partial"))


@query(f"""
WITH k AS (SELECT l_returnflag, l_linestatus = 'F' AS good, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk FROM lineitem),
s AS (SELECT l_returnflag, count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0, sum(rk) FILTER (good) AS s FROM k GROUP BY 1 HAVING n1 >= 3 AND n0 >= 3)
SELECT round(sum(s - n1 * (n1 + 1) / 2.0) / sum(n1 * n0), 6) AS auc, count(*) AS strata FROM s""")
def stratified_auc(t, spark):
    """AGG-26: pairs compared within strata only, from value counts per stratum."""
    from pyspark.sql import Window

    c = t("lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("g"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = c.withColumn("rk", before + (F.col("n") + 1) / 2).groupBy("l_returnflag").agg(F.sum("g").alias("n1"), F.sum(F.col("n") - F.col("g")).alias("n0"), F.sum(F.col("g") * F.col("rk")).alias("s")).where("n1 >= 3 and n0 >= 3")
    return s.agg(r(F.sum(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / F.sum(F.col("n1") * F.col("n0"))).alias("auc"), F.count(F.lit(1)).alias("strata"))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem), e AS (SELECT round(a, 6) AS a, round((b - a) / 12, 6) AS w FROM q), x AS (SELECT floor((l_extendedprice - a) / w)::INT AS bin, a, w, l_quantity FROM lineitem, e)
SELECT bin, count(*) AS n, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.75), 6) AS q75 FROM x WHERE bin BETWEEN 0 AND 11 GROUP BY 1 HAVING count(*) >= 10""")
def binned_summary(t, spark):
    """AGG-27: equal-width bins between p1 and p99, at least ten rows."""
    df = t("lineitem").select("l_extendedprice", "l_quantity")
    a, b = ranks.exact_quantiles(df, "l_extendedprice", [0.01, 0.99])
    low, width = round(a, 6), round((b - a) / 12, 6)
    bins = df.withColumn("bin", F.floor((F.col("l_extendedprice") - low) / width).cast("int")).where("bin between 0 and 11")
    q = ranks.grouped_quantiles(bins, ["bin"], "l_quantity", median=0.5, q25=0.25, q75=0.75)
    n = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return n.join(q, "bin").select("bin", "n", *(r(F.col(c)).alias(c) for c in ("median", "q25", "q75")))


@query("""
WITH e AS (SELECT DISTINCT round(unnest(quantile_cont(l_discount, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])), 9) AS e FROM lineitem), inner_e AS (SELECT e FROM e WHERE e > (SELECT min(e) FROM e) AND e < (SELECT max(e) FROM e)),
b AS (SELECT l_quantity > 40 AS good, (SELECT count(*) FROM inner_e WHERE round(l_discount, 9) > e)::INT AS bin FROM lineitem), t AS (SELECT count(*) AS n, count(*) FILTER (good) AS g FROM b)
SELECT bin, count(*) AS n, count(*) FILTER (good) AS n_good, round(count(*) FILTER (good) / count(*), 9) AS rate, round(count(*) FILTER (good) / count(*) * any_value(t.n) / any_value(t.g), 6) AS enrichment, round(count(*) FILTER (good) / any_value(t.g), 9) AS share_of_good FROM b, t GROUP BY bin""")
def decile_enrichment(t, spark):
    """AGG-28."""
    b = ranks.quantile_bins(t("lineitem").select("l_discount", "l_quantity"), "l_discount", 10)
    return screen.enrichment(b, "bin", F.col("l_quantity") > 40)


@query("""
WITH b AS (SELECT o_orderpriority AS bucket, o_totalprice > 300000 AS good FROM orders), t AS (SELECT count(*) AS n, count(*) FILTER (good) AS g FROM b)
SELECT bucket, count(*) AS n, count(*) FILTER (good) AS n_good, round(count(*) FILTER (good) / count(*), 9) AS rate, round(count(*) FILTER (good) / count(*) * any_value(t.n) / any_value(t.g), 6) AS enrichment, round(count(*) FILTER (good) / any_value(t.g), 9) AS share_of_good FROM b, t GROUP BY bucket""")
def categorical_enrichment(t, spark):
    """AGG-29."""
    return screen.enrichment(t("orders").select(F.nullif(F.trim("o_orderpriority"), F.lit("")).alias("bucket"), "o_totalprice"), "bucket", F.col("o_totalprice") > 300000)


def _rules() -> dict:
    return {"small": F.col("l_quantity") <= 10, "cheap_rate": F.col("l_discount") >= 0.05, "both": (F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05)}


_RULE = "SELECT '{0}' AS rule, count(*) FILTER ({1}) AS n_pass, round(count(*) FILTER (({1}) AND good) / count(*) FILTER ({1}), 9) AS precision, round(count(*) FILTER (({1}) AND good) / count(*) FILTER (good), 9) AS retention, round(count(*) FILTER (({1}) AND good) * count(*) / (count(*) FILTER ({1}) * count(*) FILTER (good)), 6) AS enrichment FROM g"


@query("WITH g AS (SELECT *, l_returnflag = 'R' AS good FROM lineitem) " + " UNION ALL ".join(_RULE.format(*x) for x in (("small", "l_quantity <= 10"), ("cheap_rate", "l_discount >= 0.05"), ("both", "l_quantity <= 10 AND l_discount >= 0.05"))))
def rule_performance(t, spark):
    """FLT-14, SCN-07: precision, retention and enrichment of rules in one pass."""
    return screen.rule_performance(t("lineitem"), F.col("l_returnflag") == "R", _rules())


@query(f"""
WITH k AS (SELECT p_partkey, ({_AVG.format('p_retailprice')}) / count(*) OVER () AS a, 1 - ({_AVG.format('p_size')}) / count(*) OVER () + 1.0 / count(*) OVER () AS b FROM part)
SELECT p_partkey, round(sqrt(a * b), 6) AS dual, a >= 0.8 AND b >= 0.8 AS strict, a >= 0.6 AND b >= 0.6 AS broad FROM k""")
def dual_score_flags(t, spark):
    """SCN-01, SCN-03: two percentiles, neither making up for the other."""
    n = t("part").count()
    p = ranks.percent_rank(ranks.percent_rank(t("part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "a"), "p_size", "b0")
    p = p.withColumn("b", 1 - F.col("b0") + 1.0 / n)
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", r(F.sqrt(a * b)).alias("dual"), ((a >= 0.8) & (b >= 0.8)).alias("strict"), ((a >= 0.6) & (b >= 0.6)).alias("broad"))


@query("""
WITH f AS (SELECT l_suppkey % 5 AS fold, l_extendedprice AS y FROM lineitem), t AS (SELECT fold, sum(y) AS s, count(*) AS n FROM f GROUP BY 1), a AS (SELECT sum(s) AS s, sum(n) AS n FROM t)
SELECT fold::INT AS fold, round(sqrt(avg((y - (a.s - t.s) / (a.n - t.n)) ** 2)), 4) AS rmse, count(*) AS n FROM f JOIN t USING (fold), a GROUP BY fold""")
def oof_group_kfold_mean(t, spark):
    """MOD-02, MOD-03, STA-14: whole groups held out, scored against the mean of the rest."""
    f = t("lineitem").select(screen.group_folds(F.col("l_suppkey"), 5).alias("fold"), "l_extendedprice")
    o = screen.out_of_fold_mean(f, "fold", "l_extendedprice")
    e = F.col("l_extendedprice") - F.col("oof_mean")
    return o.groupBy("fold").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_fit(t, spark):
    """STA-15: least squares by one pass of sums."""
    m = stats.ols(t("lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(float(m["intercept"]), float(m["l_quantity"]), float(m["r2"]))], "intercept double, slope double, r2 double").select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"))


@query("""
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds FROM lineitem)
SELECT l_returnflag, round(avg((l_quantity - m) / s), 6) AS quantity, round(avg((l_discount - dm) / ds), 6) AS discount FROM lineitem, s GROUP BY 1""")
def standard_scale(t, spark):
    """SCL-03."""
    from ..operators import vectors

    s = vectors.standard_scale(t("lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount")
    return s.groupBy("l_returnflag").agg(r(F.avg("l_quantity_std")).alias("quantity"), r(F.avg("l_discount_std")).alias("discount"))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem)
SELECT l_returnflag, round(avg(greatest(-6, least(6, (l_extendedprice - m) / w))), 6) AS scaled, round(max((l_extendedprice - m) / w), 6) AS top FROM lineitem, q GROUP BY 1""")
def robust_scale(t, spark):
    """SCL-01, SCL-02: median and quartile range, clipped."""
    df = t("lineitem").select("l_returnflag", "l_extendedprice")
    a, m, b = ranks.exact_quantiles(df, "l_extendedprice", [0.25, 0.5, 0.75])
    z = (F.col("l_extendedprice") - m) / (b - a)
    return df.groupBy("l_returnflag").agg(r(F.avg(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z)))).alias("scaled"), r(F.max(z)).alias("top"))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem)
SELECT l_returnflag, round(avg(greatest(a, least(b, l_extendedprice))), 4) AS mean, round(min(greatest(a, l_extendedprice)), 4) AS low, round(max(least(b, l_extendedprice)), 4) AS high FROM lineitem, q GROUP BY 1""")
def winsor(t, spark):
    """SCL-05."""
    df = t("lineitem").select("l_returnflag", "l_extendedprice")
    a, b = ranks.exact_quantiles(df, "l_extendedprice", [0.01, 0.99])
    x = F.greatest(F.lit(a), F.least(F.lit(b), F.col("l_extendedprice")))
    return df.groupBy("l_returnflag").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.min(x), 4).alias("low"), F.round(F.max(x), 4).alias("high"))


@query("""
WITH v AS (SELECT value, event_type = 'click' AS good FROM events WHERE value IS NOT NULL), x AS (SELECT DISTINCT value AS x FROM v), c AS (SELECT count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0 FROM v),
k AS (SELECT value AS x, sum(good::INT) AS g, count(*) AS n FROM v GROUP BY 1), f AS (SELECT sum(g) OVER (ORDER BY x) / n1 AS f1, (sum(n) OVER (ORDER BY x) - sum(g) OVER (ORDER BY x)) / n0 AS f0 FROM k, c)
SELECT round(max(abs(f1 - f0)), 6) AS d FROM f""")
def ks_two_sample(t, spark):
    """STA-12."""
    d = stats.ks_statistic(t("events").select("value", "event_type"), "value", F.col("event_type") == "click")
    return spark.createDataFrame([(float(d),)], "d double").select(r(F.col("d")).alias("d"))


@query("SELECT p_partkey, round(0.7 * p_retailprice / 1000 - 0.3 * p_size + 0.5, 6) AS merit FROM part")
def linear_merit(t, spark):
    """MOD-08: score from stored coefficients."""
    p = t("part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("price"), "p_size")
    return p.select("p_partkey", r(screen.linear_score({"price": 0.7, "p_size": -0.3}, 0.5)).alias("merit"))


@query()
def bootstrap_ci(t, spark):
    """STA-07: interval of a mean over weighted replicates, all in one pass."""
    b = stats.bootstrap_mean(t("orders"), "o_totalprice", "o_orderkey", 100)
    return b.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


@query()
def permutation_z(t, spark):
    """Mean difference against labels drawn by hash (the null of neighbour overlaps is in ``overlap_null``)."""
    return stats.permutation_z(t("orders"), "o_totalprice", F.col("o_orderpriority") == "1-URGENT", "o_orderkey", 100)


@query("""
WITH f AS (SELECT (l_suppkey % 5)::INT AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT DISTINCT fold FROM f),
m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN k ON f.fold <> k.fold GROUP BY 1)
SELECT fold, count(*) AS n, round(avg(abs(y - a - b * x)), 3) AS mae, round(sqrt(avg((y - a - b * x) ** 2)), 3) AS rmse FROM f JOIN m USING (fold) GROUP BY 1""")
def oof_ridge_scores(t, spark):
    """MOD-02..04, STA-14: out-of-fold regression, all folds from one pass of sums."""
    from ..operators import models

    f = t("lineitem").select(screen.group_folds(F.col("l_suppkey"), 5).alias("fold"), "l_quantity", "l_extendedprice")
    p = models.oof_ridge(f, "fold", "l_extendedprice", ["l_quantity"])
    e = F.col("l_extendedprice") - F.col("pred")
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


@query("WITH t AS (SELECT sum(l_quantity) AS s, count(*) AS n FROM lineitem) SELECT l_returnflag, round((any_value(t.s) - sum(l_quantity)) / (any_value(t.n) - count(*)), 6) AS mean_without FROM lineitem, t GROUP BY 1")
def jackknife_groups(t, spark):
    """STA-10: the mean without each group."""
    from ..operators import models

    return models.jackknife(t("lineitem"), "l_quantity", "l_returnflag").select("l_returnflag", r(F.col("mean_without")).alias("mean_without"))
