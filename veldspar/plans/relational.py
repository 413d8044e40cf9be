"""Queries over keyed tables: joins, cleaning, grouping, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cols
from ..operators import ranks, relational
from .core import query, r

RULES = (("discount_low", "l_discount", 0.02, None), ("quantity_high", "l_quantity", None, 45.0), ("tax_band", "l_tax", 0.0, 0.07))


@query("""
SELECT field, n, missing, coverage, n_distinct FROM (
  SELECT 'c_custkey' AS field, count(*) AS n, count(*) - count(c_custkey) AS missing, round(count(c_custkey) / count(*), 9) AS coverage, count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL
  SELECT 'c_name', count(*), count(*) - count(c_name), round(count(c_name) / count(*), 9), count(DISTINCT c_name) FROM customer UNION ALL
  SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), round(count(c_nationkey) / count(*), 9), count(DISTINCT c_nationkey) FROM customer UNION ALL
  SELECT 'c_acctbal', count(*), count(*) - count(c_acctbal), round(count(c_acctbal) / count(*), 9), count(DISTINCT c_acctbal) FROM customer UNION ALL
  SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), round(count(c_mktsegment) / count(*), 9), count(DISTINCT c_mktsegment) FROM customer)""")
def schema_coverage_audit(t, spark):
    """AGG-23: coverage profile of every field in one aggregation."""
    return relational.coverage(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("""
SELECT count(l_tax) AS n, count(*) FILTER (l_tax = 0) AS zeros, count(*) FILTER (l_tax > 0) AS positive, count(*) FILTER (l_tax < 0) AS negative,
  min(l_tax) AS low, max(l_tax) AS high, round(quantile_cont(l_tax, 0.01), 6) AS p1, round(quantile_cont(l_tax, 0.5), 6) AS median, round(quantile_cont(l_tax, 0.99), 6) AS p99 FROM lineitem""")
def numeric_audit(t, spark):
    """AGG-24: counts by sign, extremes and exact quantiles of a measure."""
    x = F.col("l_tax")
    df = t("lineitem").select("l_tax")
    p1, median, p99 = ranks.exact_quantiles(df, "l_tax", [0.01, 0.5, 0.99])
    def count(c):
        return F.count(F.when(c, 1))
    return df.agg(F.count(x).alias("n"), count(x == 0).alias("zeros"), count(x > 0).alias("positive"), count(x < 0).alias("negative"), F.min(x).alias("low"), F.max(x).alias("high"), r(F.lit(p1)).alias("p1"), r(F.lit(median)).alias("median"), r(F.lit(p99)).alias("p99"))


@query("""
SELECT l_orderkey, 'discount_low' AS rule, l_discount AS field_value, '[0.02, inf]' AS bounds FROM lineitem WHERE l_discount < 0.02 UNION ALL
SELECT l_orderkey, 'quantity_high', l_quantity, '[-inf, 45.0]' FROM lineitem WHERE l_quantity > 45 UNION ALL
SELECT l_orderkey, 'tax_band', l_tax, '[0.0, 0.07]' FROM lineitem WHERE l_tax < 0 OR l_tax > 0.07""")
def rule_clean_rejects(t, spark):
    """FLT-07: log of broken range rules, each rule on its own."""
    return relational.rule_violations(t("lineitem"), "l_orderkey", RULES)


@query("""
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem
WHERE l_discount >= 0.02 AND l_quantity <= 45 AND l_tax BETWEEN 0 AND 0.07 GROUP BY 1""")
def rule_clean_kept(t, spark):
    """FLT-07: what is left when every rule holds (pushed to the scan)."""
    return relational.rule_kept(t("lineitem"), RULES).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity")).alias("quantity"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def validated_left_join(t, spark):
    """JOIN-02, JOIN-04: left join whose right keys are checked to be unique."""
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return relational.validated_join(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), c, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


@query("""
SELECT p_brand, p_retailprice, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part) WHERE rn = 1""")
def best_match_argmin(t, spark):
    """JOIN-06: per group the row of least cost, first id on ties."""
    return relational.best_match(t("part").select("p_brand", "p_retailprice", "p_partkey", "p_name"), "p_brand", "p_retailprice", "p_partkey")


@query("""
WITH m AS (SELECT floor(p_retailprice) AS p_retailprice, count(*) AS k, min(p_partkey) AS one FROM part GROUP BY 1), probe AS (SELECT DISTINCT floor(l_extendedprice / l_quantity) AS p_retailprice FROM lineitem)
SELECT p_retailprice, coalesce(k, 0) AS n_matches, CASE WHEN k = 1 THEN one END AS p_partkey, CASE WHEN k = 1 THEN 'unique' WHEN k > 1 THEN 'ambiguous' ELSE 'no_match' END AS match_quality
FROM probe LEFT JOIN m USING (p_retailprice)""")
def ambiguous_lookup(t, spark):
    """JOIN-07: an id only where exactly one row matches, else the reason."""
    probe = t("lineitem").select(F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("p_retailprice")).distinct()
    return relational.classified_lookup(probe, t("part").select(F.floor("p_retailprice").cast("double").alias("p_retailprice"), "p_partkey"), "p_retailprice", "p_partkey").select("p_retailprice", "n_matches", "p_partkey", "match_quality")


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL), c AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL),
v AS (SELECT 'customer' AS n, 1 AS i, k FROM a UNION ALL SELECT 'orders', 2, k FROM b UNION ALL SELECT 'events', 3, k FROM c), s AS (SELECT n, i, count(*) AS c FROM v GROUP BY 1, 2)
SELECT x.n AS view_a, y.n AS view_b, x.c AS n_a, y.c AS n_b, (SELECT count(*) FROM v p JOIN v q ON p.k = q.k WHERE p.n = x.n AND q.n = y.n) AS n_both FROM s x JOIN s y ON x.i < y.i""")
def view_key_overlap(t, spark):
    """JOIN-10, JOIN-11: shared keys of every pair of views from one bit mask per key."""
    views = {"customer": t("customer").select("c_custkey"), "orders": t("orders").select("o_custkey"), "events": t("events").select("user_id")}
    return relational.key_overlap(views)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(t, spark):
    """JOIN-12."""
    return t("customer").join(t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t, spark):
    """JOIN-13."""
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
WITH a AS (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40), b AS (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_size, p_partkey LIMIT 60)
SELECT DISTINCT least(a.p_partkey, b.p_partkey) AS a_key, greatest(a.p_partkey, b.p_partkey) AS b_key FROM a JOIN b ON a.p_partkey <> b.p_partkey
AND abs(a.p_retailprice - b.p_retailprice) / least(a.p_retailprice, b.p_retailprice) < 0.25 AND abs(a.p_size - b.p_size) < 20""")
def band_join_mismatch(t, spark):
    """JOIN-15: pairs of two top lists within relative and absolute bands, unordered, no self."""
    p = t("part").select("p_partkey", "p_retailprice", "p_size")
    a = ranks.top_k(p, 40, F.desc("p_retailprice"), F.asc("p_partkey"))
    b = ranks.top_k(p, 60, F.asc("p_size"), F.asc("p_partkey")).toDF("k", "c", "s")
    near = (F.col("p_partkey") != F.col("k")) & (F.abs(F.col("p_retailprice") - F.col("c")) / F.least("p_retailprice", "c") < 0.25) & (F.abs(F.col("p_size") - F.col("s")) < 20)
    # Forty rows against sixty: both sides are bounded by their limits.
    return a.join(F.broadcast(b), near).select(F.least("p_partkey", "k").alias("a_key"), F.greatest("p_partkey", "k").alias("b_key")).distinct()


def curves(t):
    """Curves of the events table: seconds of the day against the value, per user and type."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t("events").where("value is not null").select("user_id", "event_type", (seconds.cast("double")).alias("x"), F.col("value").alias("y"))


@query("""
WITH c AS (SELECT user_id, event_type, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL)
SELECT user_id, event_type, x AS x_near, y AS y_near, d AS distance FROM (SELECT *, abs(x - 43200) AS d, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(x - 43200), x, y) AS rn FROM c WHERE abs(x - 43200) <= 7200) WHERE rn = 1""")
def nearest_within_tolerance(t, spark):
    """JOIN-16: per curve the point nearest to noon within two hours."""
    return relational.nearest_within(curves(t), ["user_id", "event_type"], "x", "y", 43200.0, 7200.0)


@query("""
WITH c AS (SELECT user_id, event_type, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL),
lo AS (SELECT user_id, event_type, x, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY x DESC, y DESC) AS rn FROM c WHERE x <= 43200) WHERE rn = 1),
hi AS (SELECT user_id, event_type, x, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY x, y) AS rn FROM c WHERE x >= 43200) WHERE rn = 1)
SELECT user_id, event_type, round(CASE WHEN hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (43200 - lo.x) / (hi.x - lo.x) END, 6) AS y_at
FROM lo JOIN hi USING (user_id, event_type) WHERE least(43200 - lo.x, hi.x - 43200) <= 10800""")
def interpolate_at(t, spark):
    """JOIN-17: value at noon by linear interpolation, where a knot is within three hours."""
    out = relational.interpolate_at(curves(t), ["user_id", "event_type"], "x", "y", 43200.0, 10800.0)
    return out.withColumn("y_at", r(F.col("y_at")))


@query("""
WITH p AS (SELECT p_partkey, p_retailprice, p_size FROM part)
SELECT p_partkey, p_retailprice, p_size FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))""")
def pareto_front(t, spark):
    """JOIN-20, SCN-02: high price, small size; by sorting, not by pairs."""
    return relational.pareto_front(t("part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS total, round(avg(l_extendedprice), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high,
  round(stddev_samp(l_quantity), 6) AS sd_sample, round(stddev_pop(l_quantity), 6) AS sd_population, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS p90,
  count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_discount > 0.05) AS discounted, round(avg((l_discount > 0.05)::INT), 6) AS discount_rate, bool_or(l_tax > 0.07) AS any_high_tax
FROM lineitem GROUP BY 1, 2""")
def group_named_agg(t, spark):
    """AGG-01..07, 09, 15, 17 in one pass."""
    high = F.col("l_discount") > 0.05
    keys = ["l_returnflag", "l_linestatus"]
    # Exact quantiles of few large groups come from placed values, not from a group's value map in one task.
    q = ranks.grouped_quantiles(t("lineitem").select(*keys, "l_quantity"), keys, "l_quantity", median=0.5, p90=0.9)
    g = t("lineitem").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity")).alias("total"), r(F.avg("l_extendedprice")).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"),
        r(F.stddev_samp("l_quantity")).alias("sd_sample"), r(F.stddev_pop("l_quantity")).alias("sd_population"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.when(high, 1)).alias("discounted"), r(F.avg(high.cast("int"))).alias("discount_rate"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"),
    )
    return g.join(q.select(*keys, r(F.col("median")).alias("median"), r(F.col("p90")).alias("p90")), keys)


@query("""
SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def pivot_mean(t, spark):
    """AGG-19: pivot with stated values (one pass)."""
    p = t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return p.select("l_returnflag", r(F.col("F")).alias("F"), r(F.col("O")).alias("O"))


@query("""
SELECT floor(l_quantity / 10)::INT AS bin, round(median(l_extendedprice) FILTER (l_returnflag = 'A'), 6) AS "A", round(median(l_extendedprice) FILTER (l_returnflag = 'N'), 6) AS "N", round(median(l_extendedprice) FILTER (l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY 1""")
def pivot_median_bins(t, spark):
    """AGG-19: medians by bin and flag."""
    rows = t("lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("bin"), "l_returnflag", "l_extendedprice")
    m = ranks.grouped_quantiles(rows, ["bin", "l_returnflag"], "l_extendedprice", median=0.5)
    p = m.groupBy("bin").pivot("l_returnflag", ["A", "N", "R"]).agg(F.first("median"))
    return p.select("bin", *(r(F.col(c)).alias(c) for c in "ANR"))


@query("""
SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer""")
def unpivot_long(t, spark):
    """AGG-20."""
    return t("customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")).unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "variable", "value")


_DEDUP = "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts{0}, event_id{0}) AS rn FROM events) WHERE rn = 1"


@query(_DEDUP.format(""))
def dedup_keep_first(t, spark):
    """AGG-21."""
    return relational.dedup(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], "first")


@query(_DEDUP.format(" DESC"))
def dedup_keep_last(t, spark):
    """AGG-21."""
    return relational.dedup(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], "last")


@query("SELECT round(1 - count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 9) AS duplicate_fraction FROM lineitem")
def duplicate_fraction(t, spark):
    """AGG-22: share of rows whose key occurred before."""
    g = t("lineitem").groupBy("l_orderkey", "l_linenumber").count()
    return g.agg(F.round(1 - F.count(F.lit(1)) / F.sum("count"), 9).alias("duplicate_fraction"))


@query("""
SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS mean,
  round(sqrt(greatest(0, sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_quantity * l_discount) / sum(l_quantity)) ** 2)), 6) AS sd FROM lineitem GROUP BY 1""")
def weighted_group_stats(t, spark):
    """AGG-16: weighted mean and deviation from three sums."""
    w, x = cols.finite(F.col("l_quantity")), cols.finite(F.col("l_discount"))
    s = t("lineitem").groupBy("l_returnflag").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    m = F.col("wx") / F.col("w")
    return s.select("l_returnflag", F.round(m, 9).alias("mean"), r(F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - m * m))).alias("sd"))


@query("""
SELECT p_brand, p_partkey, round(p_retailprice - median(p_retailprice) OVER (PARTITION BY p_brand), 6) AS above_median, count(*) OVER (PARTITION BY p_brand) AS brand_size FROM part""")
def group_broadcast(t, spark):
    """JOIN-21: a group's aggregate on each of its rows (grouped first, so a hot group is not sorted whole)."""
    g = t("part").groupBy("p_brand").agg(F.median("p_retailprice").alias("m"), F.count(F.lit(1)).alias("brand_size"))
    return t("part").join(g, "p_brand").select("p_brand", "p_partkey", r(F.col("p_retailprice") - F.col("m")).alias("above_median"), "brand_size")


@query("""
SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1""")
def argmax_per_group(t, spark):
    """AGG-13, WIN-14: the peak of each group, first id on ties."""
    m = t("events").where("value is not null").groupBy("event_type").agg(F.max(F.struct("value", (-F.col("event_id")).alias("k"))).alias("m"))
    return m.select("event_type", (-F.col("m.k")).alias("event_id"), F.col("m.value").alias("value"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t, spark):
    """AGG-10."""
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY 1")
def collect_distinct(t, spark):
    """AGG-11."""
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(t, spark):
    """SRT-02."""
    return ranks.top_k(t("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def topk_per_group(t, spark):
    """SRT-04."""
    return ranks.top_k_per_group(t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), 5, ["o_orderpriority"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT c_custkey AS k, c_acctbal AS balance, c_name AS name, NULL::INT AS region FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name, NULL FROM supplier UNION ALL SELECT r_regionkey, NULL, r_name, r_regionkey FROM region")
def union_by_name(t, spark):
    """SET-01: union by name, missing columns null."""
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = t("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    g = t("region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return c.unionByName(s).unionByName(g, allowMissingColumns=True)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(t, spark):
    """SET-03."""
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(t, spark):
    """SET-04."""
    return t("customer").select(F.col("c_custkey").alias("k")).exceptAll(t("orders").select("o_custkey").distinct()).distinct()


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
SELECT round((SELECT count(*) FROM a SEMI JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 9) AS jaccard""")
def jaccard_keys(t, spark):
    """SET-07: from one mask per key."""
    o = t("orders").groupBy("o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("a"), F.max((F.col("o_orderpriority") == "5-LOW").cast("int")).alias("b"))
    return o.agg(F.round(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), 9).alias("jaccard"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'C1' WHEN c_acctbal >= 2500 THEN 'C2' WHEN c_acctbal >= 0 THEN 'C3' ELSE 'C4' END AS class, least(greatest(c_acctbal, 0), 5000) AS clipped,
  round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS log_balance, round(CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END, 6) AS ratio FROM customer""")
def derived_columns(t, spark):
    """PRJ-03, PRJ-07, PRJ-08, PRJ-13: derived columns, branches and clipping in one projection."""
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", cols.select_case((b >= 7500, "C1"), (b >= 2500, "C2"), (b >= 0, "C3"), otherwise="C4").alias("class"), cols.clip(b, 0.0, 5000.0).alias("clipped"), r(cols.safe_log10(b)).alias("log_balance"), r(cols.safe_divide(b, F.col("c_nationkey"))).alias("ratio"))


@query("""
SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%stand%' AND p_size IN (1, 5, 9, 14, 23) AND p_retailprice BETWEEN 910 AND 980""")
def literal_contains_filter(t, spark):
    """FLT-03, FLT-04, FLT-09: range, membership and substring predicates."""
    return t("part").where(F.lower("p_type").contains("stand") & F.col("p_size").isin(1, 5, 9, 14, 23) & F.col("p_retailprice").between(910, 980)).select("p_partkey", "p_type")


@query("""
WITH q AS (SELECT round(quantile_cont(p_retailprice, 0.8), 9) AS hi, round(quantile_cont(p_retailprice, 0.2), 9) AS lo FROM part)
SELECT p_partkey, CASE WHEN round(p_retailprice, 9) >= hi THEN 'top' ELSE 'bottom' END AS tail FROM part, q WHERE round(p_retailprice, 9) >= hi OR round(p_retailprice, 9) <= lo""")
def quantile_tail_filter(t, spark):
    """FLT-10: both tails, inclusive, by exact quantiles."""
    lo, hi = ranks.exact_quantiles(t("part").select("p_retailprice"), "p_retailprice", [0.2, 0.8])
    x = F.round("p_retailprice", 9)
    return t("part").where((x >= round(hi, 9)) | (x <= round(lo, 9))).select("p_partkey", F.when(x >= round(hi, 9), "top").otherwise("bottom").alias("tail"))


@query("""
SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step, sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS nth FROM events""")
def ordered_steps(t, spark):
    """WIN: differences and running counts along a curve."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", r(F.col("value") - F.lag("value").over(w)).alias("step"), F.row_number().over(w).cast("long").alias("nth"))


@query("""
SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""")
def round_state(t, spark):
    """LOP: state of each loop after its last round."""
    c = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).cast("long").alias("chars"))
    return c
