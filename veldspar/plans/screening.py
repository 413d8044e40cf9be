"""Queries of screening, sets, features, references and the propose-score-record loop."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.cols import log_ratio
from ..operators import evaluation, ranks, screen, stats, vectors
from .core import query, r

_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN p_size > 10 AND p_size <= 20 THEN 1 WHEN p_size > 20 AND p_size <= 35 THEN 2 WHEN p_size >= 1 AND p_size <= 10 THEN 0 END AS bin FROM part) GROUP BY 1")
def cut_right_closed(t, spark):
    """WIN-07: right-closed bins, the lowest edge included, null outside."""
    return t("part").select(ranks.cut_bins(F.col("p_size"), [1, 10, 20, 35], right=True, include_lowest=True).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT user_id, event_type, hour(ts) AS x, median(value) AS y FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, event_type, x, round(y, 6) AS y, round(y - lag(y, 1) OVER w, 6) AS step FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY x)""")
def equal_x_collapse(t, spark):
    """WIN-13, WIN-14: repeated x become their median, then adjacent differences."""
    c = t("events").where("value is not null").groupBy("user_id", "event_type", F.hour("ts").cast("long").alias("x")).agg(F.median("value").alias("y"))
    w = Window.partitionBy("user_id", "event_type").orderBy("x")
    return c.select("user_id", "event_type", "x", r(F.col("y")).alias("y"), r(F.col("y") - F.lag("y").over(w)).alias("step"))


@query("""
WITH h AS (SELECT DISTINCT user_id, hour(ts) AS x FROM events), g AS (SELECT user_id, x, coalesce(lead(x) OVER w, min(x) OVER (PARTITION BY user_id) + 24) - x AS gap FROM h WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, max(gap) AS largest_gap FROM g GROUP BY 1""")
def periodic_gap(t, spark):
    """WIN-13, MTH-12: largest gap on a circle."""
    h = t("events").select("user_id", F.hour("ts").cast("long").alias("x")).distinct()
    w = Window.partitionBy("user_id").orderBy("x")
    first = F.min("x").over(Window.partitionBy("user_id"))
    return h.select("user_id", (F.coalesce(F.lead("x").over(w), first + 24) - F.col("x")).alias("gap")).groupBy("user_id").agg(F.max("gap").alias("largest_gap"))


@query("""
WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderstatus || o_orderpriority)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, len(list_intersect(a, ['1-URGENT', '2-HIGH', '5-LOW'])) AS shared, round(len(list_intersect(a, ['1-URGENT', '2-HIGH', '5-LOW'])) / len(list_distinct(list_concat(a, ['1-URGENT', '2-HIGH', '5-LOW']))), 6) AS jaccard,
  CASE WHEN list_contains(a, '1-URGENT') AND list_contains(a, '5-LOW') THEN 'both' WHEN list_contains(a, '1-URGENT') THEN 'a_only' WHEN list_contains(a, '5-LOW') THEN 'b_only' ELSE 'other' END AS category FROM s""")
def set_overlap_rows(t, spark):
    """SET-06, SET-07, SET-09: per-row sets against a reference set."""
    ref = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "5-LOW")))
    s = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    u, low = F.array_contains("a", "1-URGENT"), F.array_contains("a", "5-LOW")
    shared = F.size(F.array_intersect("a", ref))
    return s.select("o_custkey", shared.cast("long").alias("shared"), r(shared / F.size(F.array_union("a", ref))).alias("jaccard"), F.when(u & low, "both").when(u, "a_only").when(low, "b_only").otherwise("other").alias("category"))


@query("""
WITH f AS (SELECT p_partkey, p_retailprice >= 950 AS a, p_size <= 10 AS b FROM part), c AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS nab FROM f)
SELECT n, na, nb, nab, round(na * nb / n, 6) AS expected, round(nab * n / nullif(na * nb, 0), 6) AS enrichment FROM c""")
def overlap_vs_expectation(t, spark):
    """SET-08: two-set overlap against independence, in one pass."""
    a, b = F.col("p_retailprice") >= 950, F.col("p_size") <= 10
    c = t("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(a, 1)).alias("na"), F.count(F.when(b, 1)).alias("nb"), F.count(F.when(a & b, 1)).alias("nab"))
    return c.select("n", "na", "nb", "nab", r(F.col("na") * F.col("nb") / F.col("n")).alias("expected"), r(F.try_divide(F.col("nab") * F.col("n"), F.col("na") * F.col("nb"))).alias("enrichment"))


@query("""
SELECT id, neighbor, round(distance, 6) AS distance FROM (SELECT a.vec_id AS id, b.vec_id AS neighbor, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) ORDER BY distance, id, neighbor LIMIT 100""")
def smallest_pairs(t, spark):
    """SRT-06: the hundred closest pairs (the top-k report itself), each task's hundred closest compared."""
    k = vectors.closest(t("embeddings").select("vec_id", "embedding"), 100)
    return k.select("id", "neighbor", F.round("distance", 6).alias("distance"))


@query("SELECT p_partkey, md5(p_partkey::VARCHAR) AS h FROM part ORDER BY h LIMIT 50")
def hash_sample(t, spark):
    """SRT-07, SRT-08: a sample by hash order, the same for any row order."""
    return t("part").select("p_partkey", F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("h")).orderBy("h").limit(50)


@query("""
WITH v AS (SELECT vec_id, label, list_sort(list_transform(embedding[1:3], lambda x: abs(x::DOUBLE))) AS s FROM embeddings)
SELECT vec_id, round(log10(sqrt(s[2] * s[3]) + 1e-6), 6) AS log_dominant, round(log10(greatest(s[2], 1e-9) / s[1]), 6) AS d, round(log10(greatest(s[3], 1e-9) / s[2]), 6) AS a FROM v WHERE s[1] > 1e-9""")
def spectrum_features(t, spark):
    """MTH-04: dominant size and spread of the first three components (the whole spectra are in ``capped_spectrum``)."""
    s = F.sort_array(F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double"))))
    v = t("embeddings").select("vec_id", s.alias("s")).where(F.col("s")[0] > 1e-9)
    x, y, z = (F.col("s")[k] for k in range(3))
    return v.select("vec_id", r(F.log10(F.sqrt(y * z) + 1e-6)).alias("log_dominant"), r(log_ratio(y, x)).alias("d"), r(log_ratio(z, y)).alias("a"))


@query("""
WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), z AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY 1),
d AS (SELECT vec_id, round(list_distance(embedding::DOUBLE[], m), 9) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], m), 9), z.label) AS rn FROM embeddings, z), k AS (SELECT vec_id, round(avg(d), 9) AS dk FROM d WHERE rn <= 3 GROUP BY 1)
SELECT vec_id, round(dk, 6) AS distance, round(1 - (SELECT count(*) FROM k o WHERE o.dk < k.dk) / (SELECT count(*) FROM k), 6) AS similarity FROM k""")
def centroid_membership(t, spark):
    """SCN-04, DST-11: mean distance to the three nearest reference centroids, and its percentile."""
    e = t("embeddings")
    refs = screen.centroids(e, "label", "embedding").select(F.col("label").alias("family"), "centroid")
    d = evaluation.reference_distances(e.select("vec_id", "label", "embedding"), refs, "vec_id", "label", "embedding")
    k = d.select("vec_id", evaluation.mean_nearest(F.col("d"), None, 3).alias("dk"))
    return ranks.ecdf(k, "dk").select("vec_id", r(F.col("dk")).alias("distance"), r(1 - F.col("ecdf")).alias("similarity"))


@query(f"""
WITH k AS (SELECT p_partkey, p_brand, p_size, ({_AVG.format('p_retailprice')}) / count(*) OVER () AS a FROM part)
SELECT p_partkey, a >= 0.9 AS price_ok, p_size <= 15 AS size_ok, p_brand LIKE 'Brand#1%' AS maker_ok, (a >= 0.9)::INT + (p_size <= 15)::INT + (p_brand LIKE 'Brand#1%')::INT AS n_ok, a >= 0.9 AND p_size <= 15 AND p_brand LIKE 'Brand#1%' AS consensus FROM k""")
def consensus_flags(t, spark):
    """SCN-05, SCN-08: every condition has to hold; a missing one fails."""
    p = ranks.percent_rank(t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_retailprice", "a")
    a, s, m = (F.coalesce(c, F.lit(False)) for c in (F.col("a") >= 0.9, F.col("p_size") <= 15, F.col("p_brand").startswith("Brand#1")))
    return p.select("p_partkey", a.alias("price_ok"), s.alias("size_ok"), m.alias("maker_ok"), (a.cast("int") + s.cast("int") + m.cast("int")).alias("n_ok"), (a & s & m).alias("consensus"))


@query("""
WITH m AS (SELECT l_returnflag, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, min(l_quantity) AS q_low, max(l_quantity) AS q_high, min(l_discount) AS d_low, max(l_discount) AS d_high FROM lineitem JOIN m USING (l_returnflag) WHERE l_extendedprice >= 0.95 * top GROUP BY 1""")
def optimum_window(t, spark):
    """SCN-06, SCN-09: ranges of the rows within 5 % of a group's best."""
    li = t("lineitem")
    m = li.groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("top"))
    near = li.join(F.broadcast(m), "l_returnflag").where(F.col("l_extendedprice") >= 0.95 * F.col("top"))
    return near.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("q_low"), F.max("l_quantity").alias("q_high"), F.min("l_discount").alias("d_low"), F.max("l_discount").alias("d_high"))


@query(f"""
WITH g AS (SELECT l_returnflag = 'R' AS good, l_extendedprice AS s FROM lineitem), k AS (SELECT good, {_AVG.format('s')} AS rk, count(*) OVER () AS n FROM g), q AS (SELECT count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0, any_value(n) AS n, sum(rk) FILTER (good) AS s, count(*) FILTER (rk > 0.8 * n) AS top, count(*) FILTER (good AND rk > 0.8 * n) AS hits FROM k)
SELECT round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc, round(hits / top, 6) AS precision_top, round(hits / n1, 6) AS recall_top, round(hits * n / (top * n1), 6) AS lift FROM q""")
def retrieval_scores(t, spark):
    """STA-11, STA-13: AUC, precision, recall and lift of the top fifth."""
    df = t("lineitem").select((F.col("l_returnflag") == "R").alias("good"), "l_extendedprice")
    p = ranks.value_positions(df, "l_extendedprice", good=F.col("good").cast("int"))
    n = p.agg(F.sum("n").alias("n"), F.sum("good").alias("n1"), F.sum(F.col("good") * (F.col("before") + (F.col("n") + 1) / 2)).alias("s")).first()
    top = p.where(F.col("before") + (F.col("n") + 1) / 2 > 0.8 * n.n).agg(F.sum("n").alias("top"), F.sum("good").alias("hits"))
    auc = (n.s - n.n1 * (n.n1 + 1) / 2) / (n.n1 * (n.n - n.n1))
    return top.select(r(F.lit(float(auc))).alias("auc"), r(F.col("hits") / F.col("top")).alias("precision_top"), r(F.col("hits") / F.lit(n.n1)).alias("recall_top"), r(F.col("hits") * n.n / (F.col("top") * n.n1)).alias("lift"))


@query("""
WITH g AS (SELECT l_quantity, l_discount, l_returnflag = 'R' AS good FROM lineitem), c AS (SELECT unnest([10.0, 20.0, 30.0, 40.0]) AS cut)
SELECT cut::DOUBLE AS cut, count(*) FILTER (l_quantity <= cut) AS n_pass, round(avg(good::INT) FILTER (l_quantity <= cut), 6) AS rate FROM g, c GROUP BY 1""")
def threshold_grid(t, spark):
    """STA-21: how a rule depends on its threshold, all thresholds in one pass."""
    good = (F.col("l_returnflag") == "R").cast("int")
    cuts = (10.0, 20.0, 30.0, 40.0)
    one = t("lineitem").agg(*(F.struct(F.lit(c).alias("cut"), F.count(F.when(F.col("l_quantity") <= c, 1)).alias("n_pass"), r(F.avg(F.when(F.col("l_quantity") <= c, good))).alias("rate")).alias(f"c{int(c)}") for c in cuts))
    return one.select(F.explode(F.array(*(f"c{int(c)}" for c in cuts))).alias("r")).select("r.*")


@query("""
WITH u AS (SELECT l_returnflag, f.feature, f.v, l_extendedprice AS y FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) f(feature, v)),
k AS (SELECT l_returnflag, feature, rank() OVER (PARTITION BY l_returnflag, feature ORDER BY v) + (count(*) OVER (PARTITION BY l_returnflag, feature, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag, feature ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, feature, y) - 1) / 2.0 AS b FROM u),
s AS (SELECT l_returnflag, feature, round(corr(a, b), 6) AS spearman, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT l_returnflag, feature, spearman, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(spearman) DESC, feature) AS rn FROM s) WHERE rn <= 2""")
def top_features_per_group(t, spark):
    """LOP-01, LOP-02: rank correlations by group and feature, the strongest two of each group."""
    s = stats.spearman_panel(t("lineitem"), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice", ["l_returnflag"])
    s = s.where("n >= 50").select("l_returnflag", "feature", r(F.col("rho")).alias("spearman"), "n")
    return ranks.top_k_per_group(s, 2, ["l_returnflag"], F.abs("spearman").desc(), F.asc("feature")).drop("rn")


@query("""
WITH seeds AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), cand AS (SELECT DISTINCT s.p_brand AS brand, s.p_size + d.d AS size, s.p_retailprice AS price FROM seeds s, (VALUES (-2), (-1), (1), (2)) d(d)),
fresh AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = c.brand AND p.p_size = c.size) AND size > 0)
SELECT brand, size, round(0.7 * max(price) / 1000 - 0.3 * size / 10.0, 6) AS merit FROM fresh GROUP BY brand, size ORDER BY merit DESC, brand, size LIMIT 10""")
def candidate_round(t, spark):
    """LOP-05: seeds, substitutions, those already seen removed, scored, the best kept."""
    part = t("part")
    seeds = ranks.top_k(part.select("p_partkey", "p_brand", "p_size", "p_retailprice"), 20, F.desc("p_retailprice"), F.asc("p_partkey"))
    moved = seeds.select(F.col("p_brand").alias("brand"), F.explode(F.transform(F.array(*(F.lit(d) for d in (-2, -1, 1, 2))), lambda d: F.col("p_size") + d)).alias("size"), F.col("p_retailprice").alias("price")).where("size > 0")
    seen = part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    fresh = moved.join(seen, ["brand", "size"], "left_anti").groupBy("brand", "size").agg(F.max("price").alias("price"))
    scored = fresh.select("brand", "size", r(0.7 * F.col("price") / 1000 - 0.3 * F.col("size") / 10.0).alias("merit"))
    return ranks.top_k(scored, 10, F.desc("merit"), F.asc("brand"), F.asc("size"))


@query("""
WITH p AS (SELECT a.vec_id AS id, a.label AS own, b.vec_id AS other, b.label AS lab, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT id, own, round(min(d) FILTER (lab = own), 9) AS inside, round(min(d) FILTER (lab <> own), 9) AS outside FROM p GROUP BY 1, 2)
SELECT own AS label, round(avg((inside < outside)::INT), 6) AS recall, count(*) AS n FROM n GROUP BY 1""")
def held_out_retrieval(t, spark):
    """MOD-14: is the nearest other vector of the same family?"""
    e = t("embeddings").select("vec_id", "embedding", "label")
    near = vectors.knn(e, 1).select(F.col("id").alias("vec_id"), "neighbor")
    j = e.select("vec_id", "label").join(near, "vec_id").join(e.select(F.col("vec_id").alias("neighbor"), F.col("label").alias("other")), "neighbor")
    return j.groupBy("label").agg(r(F.avg((F.col("label") == F.col("other")).cast("int"))).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM orders RIGHT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def reindex_join(t, spark):
    """JOIN-08, JOIN-09: a stated key list keeps its keys, missing values null."""
    keys = t("customer").where("c_acctbal < 0").select("c_custkey")
    return keys.join(t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", "left")


@query("SELECT doc_id, label_n, CASE WHEN label_n > 1 THEN 'repeated' ELSE 'single' END AS kind FROM (SELECT doc_id, count(*) AS label_n FROM labels GROUP BY 1)")
def duplicate_groups(t, spark):
    """AGG-21: groups of equal keys."""
    g = t("labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("label_n"))
    return g.withColumn("kind", F.when(F.col("label_n") > 1, "repeated").otherwise("single"))


