"""Queries of row-wise expressions: columns, filters, texts, arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, cols, text
from ..operators import ranks, relational
from .core import query, r


@query("SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 > 0 THEN p_retailprice END, CASE WHEN p_size > 0 THEN 1 / p_size::DOUBLE END), 9) AS sigma FROM part")
def reciprocal_fallback(t, spark):
    """PRJ-06, PRJ-05: a missing value from the reciprocal of its inverse."""
    value = F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice"))
    return t("part").select("p_partkey", r(cols.reciprocal_fallback(value, F.col("p_size").cast("double")), 9).alias("sigma"))


@query("""
SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1, 2""")
def label_mapping(t, spark):
    """PRJ-10, MAP-02: labels by map, without a match null or the value itself."""
    label = cols.map_labels(F.col("o_orderstatus"), {"F": "finished", "O": "open"})
    priority = cols.map_labels(F.col("o_orderpriority"), {"1-URGENT": "now"}, keep=True)
    return t("orders").groupBy(label.alias("label"), priority.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE) AS number, TRY_CAST(c_mktsegment AS DOUBLE) AS none FROM customer")
def numeric_coercion(t, spark):
    """PRJ-11: numbers in texts, null where there is none."""
    return t("customer").select("c_custkey", cols.to_number(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number"), cols.to_number(F.col("c_mktsegment")).alias("none"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS valid, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 9) AS log_value,
  round(CASE WHEN c_acctbal + 1000 > 0 THEN log10(c_acctbal + 1000) END, 9) AS log_offset FROM customer""")
def null_outside_range(t, spark):
    """PRJ-12, MTH-01: invalid values become null, the rows stay; logarithms of positive values only."""
    x = F.col("c_acctbal")
    return t("customer").select("c_custkey", cols.null_outside(x, 0, 9000).alias("valid"), r(cols.safe_log10(x), 9).alias("log_value"), r(cols.safe_log10(x, 1000.0), 9).alias("log_offset"))


@query("""
WITH p AS (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_size % 5 > 0 THEN p_size::DOUBLE END AS b, 500.0 AS c FROM part)
SELECT p_partkey, greatest(a, b, c) AS high, round((a + coalesce(b, 0) + c) / (2 + (b IS NOT NULL)::INT), 6) AS mean, round(exp((ln(a) + coalesce(ln(b), 0) + ln(c)) / (2 + (b IS NOT NULL)::INT)), 6) AS geometric FROM p""")
def row_extremes(t, spark):
    """PRJ-14, MTH-03: largest, mean and geometric mean across columns, nulls left out."""
    a, b, c = F.col("p_retailprice"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("double")), F.lit(500.0)
    return t("part").select("p_partkey", cols.row_max(a, b, c).alias("high"), r(cols.row_mean(a, b, c)).alias("mean"), r(cols.geometric_mean(a, b, c)).alias("geometric"))


@query("SELECT c_custkey AS x_c_custkey, c_nationkey AS x_c_nationkey FROM customer")
def columns_by_name(t, spark):
    """PRJ-15: columns by an expression over their names, prefixed; only those are scanned."""
    return cols.select_by_name(t("customer"), "key$", "x_")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.05 AND l_returnflag <> 'N' GROUP BY 1")
def query_string_filter(t, spark):
    """FLT-02: a filter given as text."""
    return t("lineitem").where("l_quantity > 10 and l_discount > 0.05 and l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity")).alias("quantity"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) AND value > 0 AND user_id > 0 GROUP BY 1")
def finite_positive(t, spark):
    """FLT-06: rows whose values are finite and above 0."""
    return t("events").where(cols.positive_all(F.col("value"), F.col("user_id"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE coalesce((props->>'k')::BIGINT, 0) <> 0 AND coalesce(value, 0) <> 0 GROUP BY 1")
def nested_admission(t, spark):
    """FLT-08: records whose nested fields are present and not 0."""
    e = t("events").select("event_type", "value", F.from_json("props", "k long").alias("props"))
    return e.where(cols.admitted(F.col("props.k"), F.col("value"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('lineitem', 'orders', 'events') AND (column_name LIKE '%price%' OR column_name LIKE '%key%' OR column_name LIKE '%date%')""")
def columns_by_keyword(t, spark):
    """FLT-13: fields by a word in their names, from schemas alone."""
    return cols.columns_named(spark, {n: t(n) for n in ("lineitem", "orders", "events")}, "price", "key", "date")


@query("SELECT round(m, 6) AS median, round((SELECT median(abs(p_retailprice - m)) FROM part), 6) AS mad FROM (SELECT median(p_retailprice) AS m FROM part)")
def column_mad(t, spark):
    """AGG-08: median absolute deviation of a column, exact, by ranges."""
    m, d = ranks.median_deviation(t("part"), "p_retailprice")
    return spark.createDataFrame([(m, d)], "median double, mad double").select(r(F.col("median")).alias("median"), r(F.col("mad")).alias("mad"))


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, any_value(o_custkey) AS some_key FROM orders GROUP BY 1")
def first_by_position(t, spark):
    """AGG-12: first value in a given order, and any value."""
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.any_value("o_custkey").alias("some_key"))


@query("""
SELECT c_nationkey, max(n) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING", max(n) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY" FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def pivot_unique(t, spark):
    """AGG-18: a pivot of unique entries; repeated ones are an error."""
    n = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return relational.pivot_unique(n, "c_nationkey", "c_mktsegment", "n", ["BUILDING", "MACHINERY"])


@query("""
WITH v AS (SELECT c, x FROM (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS d, l_tax * 100 AS e FROM lineitem) UNPIVOT (x FOR c IN (a, b, d, e))), s AS (SELECT c, var_samp(x) AS s FROM v GROUP BY 1), t AS (SELECT c, s / sum(s) OVER () AS share FROM s)
SELECT c AS component, round(share, 9) AS share, round(sum(share) OVER (ORDER BY share DESC, c), 9) AS cumulative FROM t""")
def cumulative_variance(t, spark):
    """WIN-11: shares of the variance in descending order and their running sum (one row per measure)."""
    x = t("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("e"))
    one = x.agg(*(F.var_samp(c).alias(c) for c in x.columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("s")) for c in x.columns))).alias("r")).select("r.*")
    share = F.col("s") / F.sum("s").over(Window.partitionBy())
    up = Window.orderBy(F.desc("share"), "component").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("component", share.alias("share")).select("component", r(F.col("share"), 9).alias("share"), r(F.sum("share").over(up), 9).alias("cumulative"))


@query("""
WITH w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS lam), s AS (SELECT lam, p_partkey, row_number() OVER (PARTITION BY lam ORDER BY round((1 - lam) * p_retailprice / 2000 + lam * p_size / 50, 9) DESC, p_partkey) AS rn FROM part, w),
top AS (SELECT * FROM s WHERE rn <= 50)
SELECT a.lam, a.lam - 0.25 AS before, count(b.p_partkey) / 50 AS stability FROM top a LEFT JOIN top b ON a.p_partkey = b.p_partkey AND b.lam = a.lam - 0.25 WHERE a.lam > 0 GROUP BY 1, 2""")
def lambda_stability(t, spark):
    """WIN-15: how much of a best list stays from one weight to the next."""
    steps = F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("lam")
    p = t("part").select("p_partkey", "p_retailprice", "p_size", steps)
    score = F.round((1 - F.col("lam")) * F.col("p_retailprice") / 2000 + F.col("lam") * F.col("p_size") / 50, 9)
    top = ranks.top_k_per_group(p.withColumn("score", score), 50, ["lam"], F.desc("score"), F.asc("p_partkey")).select("lam", "p_partkey")
    before = top.select((F.col("lam") + 0.25).alias("lam"), "p_partkey", F.lit(1).alias("stays"))
    both = top.where("lam > 0").join(before, ["lam", "p_partkey"], "left")
    return both.groupBy("lam").agg((F.count("stays") / 50).alias("stability")).select("lam", (F.col("lam") - 0.25).alias("before"), "stability")


@query("""
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, md5(p_partkey::VARCHAR), p_partkey) AS place FROM part""")
def hashed_argsort(t, spark):
    """SRT-09, SRT-10: order by value and hashed id, the same whatever the order of the rows."""
    w = Window.partitionBy("p_brand").orderBy("p_size", F.md5(F.col("p_partkey").cast("string").cast("binary")), "p_partkey")
    return t("part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH h AS (SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) SELECT p_partkey, p_retailprice FROM h WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) ORDER BY p_retailprice DESC, p_partkey LIMIT 30""")
def resolvable_head(t, spark):
    """SRT-11: of the first 60 rows the first 30 that another table knows."""
    known = t("lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return relational.resolvable_head(t("part").select("p_partkey", "p_retailprice"), 60, 30, known, "p_partkey", F.desc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT p_partkey, a.p_size, b.p_retailprice FROM (SELECT p_partkey, p_size FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 1200) b USING (p_partkey)")
def bind_columns(t, spark):
    """SET-02: blocks of columns side by side, by key."""
    return relational.bind_columns(t("part").where("p_size > 10").select("p_partkey", "p_size"), t("part").where("p_retailprice > 1200").select("p_partkey", "p_retailprice"), "p_partkey").select("p_partkey", "p_size", "p_retailprice")


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL UNION SELECT user_id FROM events WHERE user_id IS NOT NULL")
def union_keys(t, spark):
    """SET-05: union of the keys of two tables."""
    return t("orders").select(F.col("o_custkey").alias("k")).union(t("events").select("user_id")).where("k is not null").distinct()


@query("""
WITH s AS (SELECT p_partkey, list_transform(string_split(p_type || ' ' || p_name, ' '), lambda x: upper(x[1:1])) AS v FROM part),
c AS (SELECT p_partkey, e, count(*) AS n FROM (SELECT p_partkey, unnest(v) AS e FROM s) GROUP BY 1, 2)
SELECT s.p_partkey, array_to_string(list_sort(any_value(v)), '-') AS joined, string_agg(e || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY e) AS formula FROM s JOIN c USING (p_partkey) GROUP BY 1""")
def species_formula(t, spark):
    """STR-03, STR-13: lists of names joined in order, and as a formula with counts."""
    v = F.transform(F.split(F.concat_ws(" ", "p_type", "p_name"), " "), lambda x: F.upper(F.substring(x, 1, 1)))
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", F.array_join(F.array_sort("v"), "-").alias("joined"), text.counted_formula(F.col("v")).alias("formula"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size * 20 <= 500 THEN p_size * 20.0 END WHEN p_size % 4 = 1 THEN CASE WHEN (p_size + 5) * 1e-3 >= 0.003 THEN (p_size + 5) * 1e-3 END
  WHEN p_size % 4 = 2 THEN p_size::DOUBLE ELSE CASE WHEN p_size / 10 + 0.25 <= 500 THEN p_size / 10 + 0.25 END END, 9) AS grain_um FROM part""")
def grain_size(t, spark):
    """STR-08: lengths in texts, ranges by their mean, a comment before the category."""
    n = F.col("p_size")
    category = F.when(n % 4 == 0, F.concat((n * 20).cast("string"), F.lit(" micrometers"))).when(n % 4 == 1, F.concat(n.cast("string"), F.lit(" to "), (n + 10).cast("string"), F.lit(" nanometers"))).otherwise(F.lit("3 mm"))
    comment = F.when(n % 4 == 2, F.concat(n.cast("string"), F.lit("*10^-6 m"))).when(n % 4 == 3, F.concat((n / 10).cast("string"), F.lit(" - "), (n / 10 + 0.5).cast("string"), F.lit(" μm grains"))).otherwise(F.lit("  "))
    return t("part").select("p_partkey", r(text.length_um(category, comment), 9).alias("grain_um"))


@query("""
SELECT CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'fast' WHEN '2-high' THEN 'fast' WHEN '4-not specified' THEN NULL ELSE trim(o_orderpriority) END AS form, count(*) AS n FROM orders GROUP BY 1""")
def canonical_form(t, spark):
    """STR-09: synonyms to one name, marks for unknown to null, others as they are."""
    form = text.canonical(F.col("o_orderpriority"), {"1-urgent": "fast", "2-high": "fast"}, ("4-not specified", "-", "unknown"))
    return t("orders").groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, regexp_replace(s_name, '(\\d+)', '$_{\\1}$', 'g') AS label FROM supplier")
def subscript_label(t, spark):
    """STR-14: digits as subscripts."""
    return t("supplier").select("s_suppkey", text.subscript(F.col("s_name")).alias("label"))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN 'complex' WHEN p_size % 3 = 1 THEN 'real' ELSE 'none' END AS kind, count(*) AS n FROM part GROUP BY 1")
def number_kinds(t, spark):
    """STR-15: real and complex numbers and other texts."""
    n = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), n, F.lit("+2.5j)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("-"), n, F.lit(".5e-3"))).otherwise(F.concat(n, F.lit("x")))
    return t("part").groupBy(text.number_kind(value).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(DISTINCT (p_size, p_type)) AS n_distinct FROM part GROUP BY 1")
def repr_distinct(t, spark):
    """STR-16: distinct counts over mixed values by their text."""
    return t("part").groupBy("p_brand").agg(F.count_distinct(text.repr_key(F.col("p_size"), F.col("p_type"))).alias("n_distinct"))


@query("SELECT p_partkey, printf('submit %d --skill %s --size %d', p_partkey, lower(p_type), p_size) AS line FROM part")
def submission_lines(t, spark):
    """STR-18: lines from a template."""
    return t("part").select("p_partkey", F.format_string("submit %d --skill %s --size %d", "p_partkey", F.lower("p_type"), "p_size").alias("line"))


@query("""
WITH m AS (SELECT median(CASE WHEN value > 100 THEN value END) AS md FROM events)
SELECT event_id, coalesce(CASE WHEN value > 100 THEN value END, 0) AS zero_filled, coalesce(CASE WHEN value > 100 THEN value END, md) AS median_filled, (value IS NULL OR value <= 100)::INT AS missing, round(value / (user_id + 1e-12), 6) AS ratio FROM events, m""")
def impute(t, spark):
    """SCL-06, MTH-05, MTH-06: missing values by 0 or by the exact median, with an indicator; a guarded quotient."""
    e = t("events").withColumn("v", F.when(F.col("value") > 100, F.col("value")))
    (md,) = ranks.exact_quantiles(e, "v", [0.5])
    return e.select("event_id", cols.fill_missing(F.col("v")).alias("zero_filled"), cols.fill_missing(F.col("v"), md).alias("median_filled"), F.col("v").isNull().cast("int").alias("missing"), r(cols.safe_divide(F.col("value"), F.col("user_id"), 1e-12)).alias("ratio"))


@query("""
WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd, max(p_retailprice) AS top, quantile_cont(p_retailprice, 0.95) FILTER (p_retailprice > 0) AS p95, sqrt(sum((p_retailprice - (SELECT avg(p_retailprice) FROM part)) ** 2)) AS fro, sqrt(avg(p_retailprice ** 2)) AS rms FROM part)
SELECT p_partkey, round((p_retailprice - m) / (sd + 1e-8), 6) AS z, round(p_retailprice / top, 9) AS of_max, round(least(greatest(p_retailprice / p95, 0), 1), 9) AS of_p95, round((p_retailprice - m) / fro, 9) AS inertia, round(p_retailprice / rms, 9) AS of_rms FROM part, s""")
def scalings(t, spark):
    """SCL-04, SCL-08, MTH-15, MTH-16: by deviation, maximum, 95th percentile, inertia and root mean square; one row of constants is broadcast."""
    x = F.col("p_retailprice")
    p = t("part").select("p_partkey", x)
    (p95,) = ranks.exact_quantiles(p.where(x > 0), "p_retailprice", [0.95])
    s = p.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.max(x).alias("top"), F.sqrt(F.var_pop(x) * F.count(x)).alias("fro"), F.sqrt(F.avg(x * x)).alias("rms"))
    j = p.crossJoin(F.broadcast(s))
    return j.select("p_partkey", r((x - F.col("m")) / (F.col("sd") + 1e-8)).alias("z"), r(x / F.col("top"), 9).alias("of_max"), r(cols.clip(x / F.lit(p95), 0.0, 1.0), 9).alias("of_p95"), r((x - F.col("m")) / F.col("fro"), 9).alias("inertia"), r(x / F.col("rms"), 9).alias("of_rms"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, len(list_concat(e[1:8], e[57:64], [vec_id::DOUBLE])) AS width, round(list_sum(list_concat(e[1:8], e[57:64])), 6) AS total,
  round(list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda a: e[8 * a + 1])) / 8, 6) AS pooled_mean, round(sqrt(list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda a: (e[8 * a + 1] - list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda b: e[8 * b + 1])) / 8) ** 2)) / 8), 6) AS pooled_std FROM v""")
def concat_and_pool(t, spark):
    """ARR-07, ARR-12: blocks put side by side; mean and deviation of per-atom rows by position (eight atoms of eight values)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = t("embeddings").select("vec_id", e.alias("e"))
    block = F.concat(F.slice("e", 1, 8), F.slice("e", 57, 8))
    atoms = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda a: F.element_at("e", a * 8 + 1))
    m = arrays.mean(atoms)
    std = F.sqrt(arrays.mean(F.transform(atoms, lambda x: (x - m) * (x - m))))
    return v.select("vec_id", F.size(F.concat(block, F.array(F.col("vec_id").cast("double")))).cast("long").alias("width"), r(arrays.total(block)).alias("total"), r(m).alias("pooled_mean"), r(std).alias("pooled_std"))


@query("""
WITH p AS (SELECT p_brand, p_size + 1 AS w, p_retailprice AS x FROM part), m AS (SELECT p_brand, sum(w * x) / sum(w) AS mean FROM p GROUP BY 1)
SELECT p_brand, round(mean, 6) AS mean, round(sqrt(sum(w * (x - mean) ** 2) / sum(w)), 4) AS std FROM p JOIN m USING (p_brand) GROUP BY 1, mean""")
def weighted_spread(t, spark):
    """MTH-10: weighted mean and deviation in one pass of sums."""
    w, x = F.col("p_size") + 1, F.col("p_retailprice")
    sums = t("part").groupBy("p_brand").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return sums.select("p_brand", r(mean).alias("mean"), r(F.sqrt(F.col("wxx") / F.col("w") - mean * mean), 4).alias("std"))


@query("SELECT p_partkey, round(p_retailprice, 6) AS checked, abs(p_retailprice) * 1e6 AS micro, p_size / 1e6 AS cubic_cm FROM part")
def checked_units(t, spark):
    """MTH-20, PRJ-17: values that must be positive, else an error; unit conversions."""
    x = F.col("p_retailprice")
    return t("part").select("p_partkey", r(cols.require(x > 0, "price must be positive", x)).alias("checked"), (F.abs(x) * 1e6).alias("micro"), (F.col("p_size") / 1e6).alias("cubic_cm"))


@query("""
WITH f AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS pos FROM embeddings WHERE vec_id % 3 > 0)
SELECT vec_id, pos, round(v[1], 6) AS first, len(v) AS width FROM m JOIN f USING (vec_id)""")
def aligned_join(t, spark):
    """JOIN-05: features to the order of a meta table; repeated keys and vectors of different lengths are errors."""
    e = t("embeddings")
    # The meta table's own order: its ids from the last to the first.
    meta = ranks.value_positions(e.where("vec_id % 3 > 0"), "vec_id")
    n = e.where("vec_id % 3 > 0").count()
    meta = meta.select(F.col("value").alias("vec_id"), (F.lit(n) - F.col("before")).cast("long").alias("pos"))
    v = e.select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    return relational.aligned_join(meta, {"v": v}, "vec_id", "pos").select("vec_id", "pos", r(F.col("v")[0]).alias("first"), F.size("v").cast("long").alias("width"))
