"""Queries over two views of the embeddings: the halves of each vector.

Pair statistics take the cohort that their method names (a bounded number of rows in the source
too): the vectors of label 0 to 2; where no cohort is named, all vectors.  Neighbour statistics take all vectors.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import models, permutations, ranks, screen, vectors, views
from ..operators.permutations import STEPS
from .core import query, r

K = 5
ROUNDS = 5
#: Rounds of a null by permutation, and pairs drawn for the correlation of distances.
NULLS = 20
DRAWN = 4000
COHORT = "label < 3 AND vec_id % 3 = 0"

_D = "round(sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 9)"
_P = f"""c AS (SELECT vec_id, embedding[1:32] AS a, embedding[33:64] AS b FROM embeddings WHERE {COHORT}),
p AS (SELECT x.vec_id AS src, y.vec_id AS dst, {_D.format('x.a', 'y.a')} AS a, {_D.format('x.b', 'y.b')} AS b FROM c x JOIN c y ON x.vec_id < y.vec_id),
rk AS (SELECT src, dst, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb, a, b FROM p)"""
#: The same over all vectors.
_ALL = _P.replace(f" WHERE {COHORT}", "")
_NN = f"""e AS (SELECT vec_id, label, embedding[1:32] AS a, embedding[33:64] AS b FROM embeddings),
d AS (SELECT x.vec_id AS id, y.vec_id AS neighbor, {_D.format('x.a', 'y.a')} AS da, {_D.format('x.b', 'y.b')} AS db FROM e x JOIN e y ON x.vec_id <> y.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY da, neighbor) AS ka, row_number() OVER (PARTITION BY id ORDER BY db, neighbor) AS kb FROM d)"""

#: The same permutations in SQL: keys of the rounds, and where a round takes a place.
_JUDGED = "jd AS (SELECT observed, avg(v) AS null_mean, stddev_pop(v) AS null_sd, avg((v >= observed)::INT) AS p FROM v, (SELECT v AS observed FROM v WHERE round = 0) WHERE round > 0 GROUP BY 1)"


def dealing(nodes, rounds):
    return f"""nn AS (SELECT count(*)::BIGINT AS n FROM {nodes}), ks AS (SELECT round, list(k ORDER BY i) AS keys FROM (SELECT round, i, ('0x' || substr(md5('0/' || round || '/' || i), 1, 13))::BIGINT % n AS k FROM nn, (SELECT unnest(range({rounds + 1})) AS round), (SELECT unnest(range(1, {STEPS + 1})) AS i)) GROUP BY 1)"""


def dealt_sql(place):
    other = "((keys[i2] - p2 + n) % n)"
    return f"CASE WHEN ks.round = 0 THEN {place} ELSE list_reduce(list_prepend({place}, range(1, {STEPS + 1})), lambda p2, i2: CASE WHEN substr(md5('0/' || ks.round || '/' || i2 || '/' || greatest(p2, {other})), 1, 1) >= '8' THEN {other} ELSE p2 END) END"


def halves(t, cohort=True):
    e = t("embeddings").where(COHORT) if cohort else t("embeddings")
    return e.select("vec_id", "label", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))


def pairs(t):
    return views.pair_distances(halves(t), "vec_id", {"a": "a", "b": "b"})


def near(t, view, k=K):
    return vectors.knn(halves(t, False), k, vector=view)


@query(f"WITH {_P} SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM rk")
def pair_spearman(t, spark):
    """STA-04: rank correlation of two views over all pairs of a cohort."""
    return spark.createDataFrame([views.rank_correlation_of_pairs(halves(t), "vec_id", {"a": "a", "b": "b"})], "rho double, n long").select(r(F.col("rho")).alias("rho"), "n")


@query()
def sampled_pair_spearman(t, spark):
    """STA-04: the same over pairs sampled by hash from all vectors; no pair table is made."""
    e = halves(t, False)
    s = views.hashed_pairs(e, "vec_id", 20_000)
    j = s.join(e.select(F.col("vec_id").alias("src"), F.col("a").alias("a1"), F.col("b").alias("b1")), "src").join(e.select(F.col("vec_id").alias("dst"), F.col("a").alias("a2"), F.col("b").alias("b2")), "dst")
    p = j.select(F.round(arrays.euclid(F.col("a1"), F.col("a2")), 9).alias("a"), F.round(arrays.euclid(F.col("b1"), F.col("b2")), 9).alias("b"))
    return spark.createDataFrame([(views.rank_correlation(p, "a", "b"),)], "rho double")


@query(f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding[1:32] AS a, embedding[33:64] AS b FROM embeddings), {dealing("e", NULLS)},
dr AS (SELECT pair, ('0x' || substr(md5('0/i/' || pair), 1, 13))::BIGINT % n AS i, ('0x' || substr(md5('0/j/' || pair), 1, 13))::BIGINT % n AS j FROM nn, (SELECT unnest(range({DRAWN})) AS pair)),
pa AS (SELECT pair, {_D.format('x.a', 'y.a')} AS d FROM dr JOIN e x ON x.place = i JOIN e y ON y.place = j WHERE i <> j), ra AS (SELECT pair, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS ra FROM pa),
mv AS (SELECT ks.round, pair, {dealt_sql('i')} AS i, {dealt_sql('j')} AS j FROM dr, ks, nn WHERE i <> j),
pb AS (SELECT round, pair, {_D.format('x.b', 'y.b')} AS d FROM mv JOIN e x ON x.place = i JOIN e y ON y.place = j), rb AS (SELECT round, pair, rank() OVER (PARTITION BY round ORDER BY d) + (count(*) OVER (PARTITION BY round, d) - 1) / 2 AS rb FROM pb),
v AS (SELECT round, corr(ra, rb) AS v FROM ra JOIN rb USING (pair) GROUP BY 1), {_JUDGED}
SELECT round(observed, 6) AS rho, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round((observed - null_mean) / (null_sd + 1e-12), 4) AS z, round(p, 6) AS p FROM jd""")
def mantel(t, spark):
    """STA-05: rank correlation of two views' distances over pairs drawn from all vectors, against renamed rows."""
    out = permutations.judged(permutations.mantel_rounds(halves(t, False), "vec_id", "a", "b", DRAWN, NULLS), "rho")
    return out.select(r(F.col("observed")).alias("rho"), r(F.col("null_mean")).alias("null_mean"), r(F.col("null_sd")).alias("null_sd"), r(F.col("z"), 4).alias("z"), r(F.col("p")).alias("p"))


_DRAW = "(('0x' || substr(md5({0} || '/' || round), 1, 6))::BIGINT % 3)"


@query(f"""
WITH {_P}, w AS (SELECT round, ra, rb, {_DRAW.format('src')} * {_DRAW.format('dst')} AS w FROM rk, (SELECT unnest(range(1, {ROUNDS + 1})) AS round)),
s AS (SELECT round, sum(w) AS n, sum(w * ra) AS x, sum(w * rb) AS y, sum(w * ra * ra) AS xx, sum(w * rb * rb) AS yy, sum(w * ra * rb) AS xy FROM w GROUP BY 1)
SELECT round, round((xy / n - x / n * y / n) / sqrt((xx / n - (x / n) ** 2) * (yy / n - (y / n) ** 2)), 6) AS r FROM s""")
def node_bootstrap(t, spark):
    """STA-08: nodes drawn anew (0 to 2 times each, by hash), pairs weighted by both."""
    def draw(node, rnd):
        return int(hashlib.md5(f"{node}/{rnd}".encode()).hexdigest()[:6], 16) % 3

    def key_hash(node, rnd):
        return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", node.cast("string"), rnd.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(3))

    out = views.node_bootstrap_of_pairs(halves(t), "vec_id", {"a": "a", "b": "b"}, draw, key_hash, ROUNDS)
    return out.select(F.col("round").cast("long").alias("round"), r(F.col("r")).alias("r"))


@query(f"""
WITH {_NN}, g AS (SELECT count(*)::DOUBLE AS n FROM e), ia AS (SELECT neighbor, count(*) AS c FROM n WHERE ka <= {K} GROUP BY 1), ib AS (SELECT neighbor, count(*) AS c FROM n WHERE kb <= {K} GROUP BY 1),
o AS (SELECT count(*) FILTER (ka <= {K} AND kb <= {K}) AS hits FROM n), x AS (SELECT sum(ia.c * ib.c) AS cross_sum FROM ia JOIN ib USING (neighbor))
SELECT round(hits / (n * {K}), 9) AS overlap, round(cross_sum / ({K} * n * n), 9) AS null_mean, round(hits / (n * {K}) / (cross_sum / ({K} * n * n) + 1e-12), 4) AS enrichment FROM g, o, x""")
def overlap_null(t, spark):
    """STA-06: overlap of neighbours and its expectation by in-degrees."""
    a, b = near(t, "a").select("id", "neighbor"), near(t, "b").select("id", "neighbor")
    out = views.overlap_null(a, b, K, halves(t, False).count())
    return out.select(r(F.col("overlap"), 9).alias("overlap"), r(F.col("null_mean"), 9).alias("null_mean"), r(F.col("enrichment"), 4).alias("enrichment"))


_ROUNDS = f"""{_NN}, pl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM e), {dealing("e", NULLS)}, mv AS (SELECT ks.round, id, {dealt_sql("place")} AS place FROM pl, ks, nn),
v AS (SELECT mv.round, count(y.id) / (any_value(n) * {K}::DOUBLE) AS v FROM nn, mv JOIN pl ON pl.place = mv.place JOIN n x ON x.id = mv.id AND x.ka <= {K} LEFT JOIN n y ON y.id = pl.id AND y.neighbor = x.neighbor AND y.kb <= {K} GROUP BY 1)"""


def dealt_overlaps(t):
    # Written, or every use would search for the neighbours anew.
    a, b = (vectors.cut_lineage(near(t, view).select("id", "neighbor")) for view in "ab")
    return a, b, permutations.overlap_rounds(a, b, halves(t, False).select(F.col("vec_id").alias("id")), K, NULLS)


@query(f"WITH {_ROUNDS} SELECT round, round(v, 9) AS overlap FROM v WHERE round > 0")
def overlap_rounds(t, spark):
    """STA-06: overlaps under rows dealt anew, each row by itself."""
    return dealt_overlaps(t)[2].where("round > 0").select(F.col("round").cast("long").alias("round"), r(F.col("overlap"), 9).alias("overlap"))


@query(f"""
WITH {_ROUNDS}, ia AS (SELECT neighbor, count(*) AS c FROM n WHERE ka <= {K} GROUP BY 1), ib AS (SELECT neighbor, count(*) AS c FROM n WHERE kb <= {K} GROUP BY 1), {_JUDGED},
x AS (SELECT sum(ia.c * ib.c) / ({K} * any_value(n)::DOUBLE * any_value(n)) AS expected FROM nn, ia JOIN ib USING (neighbor))
SELECT round(observed, 9) AS overlap, round(expected, 9) AS null_mean, round(null_sd, 9) AS null_sd, round((observed - expected) / (null_sd + 1e-12), 4) AS z, round(p, 6) AS p FROM jd, x""")
def overlap_test(t, spark):
    """STA-06: overlap of neighbours against its expectation in closed form, in deviations of the rounds."""
    a, b, rounds = dealt_overlaps(t)
    mean = views.overlap_null(a, b, K, halves(t, False).count()).first()["null_mean"]
    out = permutations.judged(rounds, "overlap", mean=F.lit(mean))
    return out.select(r(F.col("observed"), 9).alias("overlap"), r(F.col("null_mean"), 9).alias("null_mean"), r(F.col("null_sd"), 9).alias("null_sd"), r(F.col("z"), 4).alias("z"), r(F.col("p")).alias("p"))


@query(f"""
WITH {_NN} SELECT round((SELECT avg((da = 0)::INT) FROM d), 9) AS zero_share, round(avg((lo = hi)::INT), 9) AS tie_share FROM (SELECT id, min(da) FILTER (ka = {K}) AS lo, min(da) FILTER (ka = {K + 1}) AS hi FROM n GROUP BY 1)""")
def degeneracy(t, spark):
    """GRF-13: share of zero distances and of ties at the k-th neighbour; both from neighbour lists, zero ones by a radius search."""
    e = halves(t, False)
    n = e.count()
    zero = vectors.within(e, 0.0, vector="a").count()
    k = near(t, "a", K + 1)
    ties = views.degeneracy(k, k.limit(0).select((F.col("distance")).alias("distance")), K, "distance").select("tie_share")
    return ties.select(F.lit(round(2 * zero / (n * (n - 1)), 9)).alias("zero_share"), r(F.col("tie_share"), 9).alias("tie_share"))


@query(f"""
WITH {_NN} SELECT id, round(1 - count(*) FILTER (ka <= {K} AND kb <= {K}) / {K}.0, 6) AS disagreement FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def neighbor_disagreement(t, spark):
    """GRF-15: the 50 rows whose neighbours differ most between the views."""
    out = views.disagreement(near(t, "a"), near(t, "b"), K)
    return ranks.top_k(out.select("id", r(F.col("disagreement")).alias("disagreement")), 50, F.desc("disagreement"), F.asc("id"))


@query(f"""
WITH {_NN} SELECT n.id, string_agg('L' || e.label, ' ' ORDER BY ka) AS names FROM n JOIN e ON e.vec_id = n.neighbor WHERE ka <= {K} AND n.id IN (1, 2, 3, 50) GROUP BY 1""")
def neighbor_examples(t, spark):
    """GRF-17: names of the neighbours of chosen rows."""
    labels = t("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("name"))
    return views.neighbor_examples(near(t, "a"), labels, [1, 2, 3, 50], K)


_RN = "(ra - min(ra) OVER ()) / greatest(max(ra) OVER () - min(ra) OVER (), 1e-15)"


@query(f"""
WITH {_ALL}, s AS (SELECT src, dst, {_RN} AS x, {_RN.replace('ra', 'rb')} AS y, a, b FROM rk) SELECT src, dst, round(x, 8) AS rank_a, round((x + y) / 2, 8) AS consensus, round(0.7 * a + 0.3 * b, 6) AS fused, round(a / sqrt(32), 6) AS by_width FROM s""")
def consensus_distance(t, spark):
    """DST-06, DST-07, DST-08: distances over the root of the width, weighted fusion, and the mean of rank-scaled distances, of all pairs."""
    out = views.consensus_of_pairs(halves(t, False), "vec_id", {"a": "a", "b": "b"})
    # The sum has ten digits, so it may end in just a half: rounded as the SQL does, on the double and not on its shortest decimal.
    x = 0.7 * F.col("a") + 0.3 * F.col("b")
    fused = F.when(x < 1e9, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(r(x))
    return out.select("src", "dst", r(F.col("rank_a"), 8).alias("rank_a"), r(F.col("consensus"), 8).alias("consensus"), fused.alias("fused"), r(F.col("a") / F.sqrt(F.lit(32.0))).alias("by_width"))


@query(f"""
WITH c AS (SELECT vec_id, embedding[1:16] AS a, embedding[17:32] AS b, embedding[33:64] AS d FROM embeddings),
p AS (SELECT {_D.format('x.a', 'y.a')} AS a, {_D.format('x.b', 'y.b')} AS b, {_D.format('x.d', 'y.d')} AS d FROM c x JOIN c y ON x.vec_id < y.vec_id),
rk AS (SELECT {", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS r{v}" for v in "abd")} FROM p),
k AS (SELECT 'a' AS view_a, 'b' AS view_b, corr(ra, rb) AS rho FROM rk UNION ALL SELECT 'a', 'd', corr(ra, rd) FROM rk UNION ALL SELECT 'b', 'd', corr(rb, rd) FROM rk)
SELECT view_a, view_b, round(rho, 6) AS rho, round(sqrt(greatest(2 * (1 - rho), 0)), 6) AS distance FROM k""")
def view_distances(t, spark):
    """DST-10: distance between views by the rank correlation of all pairs."""
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 16).alias("b"), F.slice("embedding", 33, 32).alias("d"))
    out = views.view_distances_of_pairs(e, "vec_id", {v: v for v in "abd"})
    return out.select("view_a", "view_b", r(F.col("rho")).alias("rho"), r(F.col("distance")).alias("distance"))


@query(f"""
WITH {_NN}, s AS (SELECT id, greatest(da, 1e-12) AS s FROM n WHERE ka = {K}), w AS (SELECT least(n.id, neighbor) AS src, greatest(n.id, neighbor) AS dst, exp(-da * da / (x.s * y.s)) AS w FROM n JOIN s x ON x.id = n.id JOIN s y ON y.id = neighbor WHERE ka <= {K})
SELECT src, dst, round(max(w), 6) AS w FROM w GROUP BY 1, 2""")
def max_affinity(t, spark):
    """GRF-04: affinity by both ends' scales, the larger of both directions."""
    return views.max_affinity(near(t, "a"), K).select("src", "dst", r(F.col("w")).alias("w"))


@query(f"""
WITH {_NN}, g AS (SELECT count(*)::DOUBLE AS n FROM e), o AS (SELECT id, neighbor, greatest(ka, kb) AS worst FROM n), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY worst, neighbor) AS k FROM o),
x AS (SELECT id, neighbor, worst / (n - 1) AS r, greatest(max(worst / (n - 1)) OVER (PARTITION BY id), 1 / (n - 1)) AS lim FROM t, g WHERE k <= {K})
SELECT least(id, neighbor) AS src, greatest(id, neighbor) AS dst, round(max(exp(-(r / lim) * (r / lim))), 6) AS w FROM x GROUP BY 1, 2""")
def strict_affinity(t, spark):
    """GRF-05, DST-09: affinity of rows that are near in both views, by the worse rank."""
    e = t("embeddings")
    return views.strict_affinity(vectors.worst_rank(e, 32, K), e.count()).select("src", "dst", r(F.col("w")).alias("w"))


@query("""
WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT label, arg_min(vec_id, (round(sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: (p[1]::DOUBLE - p[2]) ** 2))), 9), vec_id)) AS medoid FROM embeddings JOIN c USING (label) GROUP BY 1""")
def medoids(t, spark):
    """EMB-10: the member nearest to the centre of its group."""
    e = t("embeddings").select("vec_id", "label", "embedding")
    return views.medoids(e, "label", "vec_id", "embedding", screen.centroids(e, "label", "embedding").select("label", "centroid"))


@query("""
SELECT vec_id, round(embedding[1]::DOUBLE * CASE WHEN (SELECT corr(embedding[1]::DOUBLE, label::DOUBLE) FROM embeddings) < 0 THEN -1 ELSE 1 END, 6) AS x,
  round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE) ** 2))) / 0.5, 6) AS tension FROM embeddings""")
def oriented_tension(t, spark):
    """EMB-08, EMB-11: an axis turned to rise with a label; distance of a thing's places in two maps."""
    e = t("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), F.col("embedding")[0].cast("double").alias("x0"), F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    turned = views.oriented(e, "x0", "label", "x").select("vec_id", r(F.col("x")).alias("x"))
    pull = views.tension(e.select("vec_id", F.col("a").alias("v")), e.select("vec_id", F.col("b").alias("v")), "vec_id", "v", 0.5)
    return turned.join(pull, "vec_id").select("vec_id", "x", r(F.col("tension")).alias("tension"))


@query(f"""
WITH {_NN}, s AS (SELECT id, da AS s FROM n WHERE ka = {K}), u AS (SELECT DISTINCT least(id, neighbor) AS src, greatest(id, neighbor) AS dst, da FROM n WHERE ka <= {K}),
w AS (SELECT src, dst, exp(-da * da / (x.s * y.s + 1e-12)) AS w FROM u JOIN s x ON x.id = src JOIN s y ON y.id = dst), st AS (SELECT id, sum(w) AS s FROM (SELECT src AS id, w FROM w UNION ALL SELECT dst, w FROM w) GROUP BY 1)
SELECT src, dst, round(w / (SELECT avg(s) FROM st), 6) AS w FROM w""")
def unit_strength(t, spark):
    """GRF-08: a layer scaled to mean strength 1."""
    return models.unit_strength(vectors.affinity(near(t, "a"), K)).select("src", "dst", r(F.col("w")).alias("w"))


@query(f"""
WITH {_NN}, a AS (SELECT DISTINCT least(id, neighbor) AS src, greatest(id, neighbor) AS dst FROM n WHERE ka <= {K}), b AS (SELECT DISTINCT least(id, neighbor) AS src, greatest(id, neighbor) AS dst FROM n WHERE kb <= {K})
SELECT 'a' AS layer, 'a' AS other, count(*) AS n, count(*)::DOUBLE AS w FROM a UNION ALL SELECT 'b', 'b', count(*), count(*) FROM b UNION ALL SELECT 'a', 'b', count(*), round(0.3 * count(*), 6) FROM e""")
def supra_layers(t, spark):
    """GRF-09: layers joined by identity edges of a given strength."""
    layers = {v: near(t, v).select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), F.lit(1.0).alias("w")).distinct() for v in "ab"}
    return models.supra_edges(layers, 0.3).groupBy("layer", "other").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w")).alias("w"))


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS representative, count(*) OVER (PARTITION BY embedding) > 1 AS repeated FROM embeddings")
def zero_distance_groups(t, spark):
    """GRF-10: groups of rows at distance 0, each with its first row as representative."""
    e = t("embeddings").select("vec_id", "embedding")
    near = vectors.within(e, 0.0, forest=True)
    c = vectors.components(near, near.select(F.col("src").alias("id")).union(near.select("dst")).distinct()) if not near.isEmpty() else None
    if c is None:
        return e.select("vec_id", F.col("vec_id").alias("representative"), F.lit(False).alias("repeated"))
    return e.join(c.withColumnRenamed("id", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("representative"), F.col("component").isNotNull().alias("repeated"))


_COS = "list_dot_product(x.a, y.a) / (sqrt(list_dot_product(x.a, x.a)) * sqrt(list_dot_product(y.a, y.a)))"
_CD = f"c AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a FROM embeddings WHERE {COHORT})"


@query(f"""
WITH {_CD}, p AS (SELECT x.vec_id AS src, y.vec_id AS dst, {_COS} AS c, abs(x.a[1] - y.a[1]) AS d FROM c x JOIN c y ON x.vec_id < y.vec_id)
SELECT src, dst, round(1 - c, 8) AS cosine, round(sqrt(greatest(2 - 2 * c, 0)), 6) AS kernel, round(d, 8) AS first_axis FROM p""")
def kernel_distances(t, spark):
    """DST-02, DST-04, DST-05: one axis' difference, kernel and cosine distances over a cohort's pairs."""
    c = halves(t).select("vec_id", F.transform("a", lambda x: x.cast("double")).alias("a"))
    p = c.join(c.toDF("dst", "b"), F.col("vec_id") < F.col("dst"))
    a, b = F.col("a"), F.col("b")
    return p.select(F.col("vec_id").alias("src"), "dst", r(arrays.cosine_distance(a, b), 8).alias("cosine"), r(arrays.kernel_distance(a, b)).alias("kernel"), r(F.abs(a[0] - b[0]), 8).alias("first_axis"))


@query(f"""
WITH {_P}, u AS (SELECT src AS id, dst AS other, a FROM p UNION ALL SELECT dst, src, a FROM p) SELECT id, other, round(row_number() OVER (PARTITION BY id ORDER BY a, other) / ((SELECT count(*) FROM c) - 1), 9) AS rank FROM u""")
def row_rank_matrix(t, spark):
    """WIN-05: every row's ranks of the others in a cohort, scaled by their number."""
    out = views.row_ranks(pairs(t), halves(t).count(), "a")
    return out.select("id", "other", r(F.col("rank"), 9).alias("rank"))


@query(f"""
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {COHORT}), c AS (SELECT id, 1 + abs(e[1]) AS a, 1 + abs(e[2]) AS b, abs(e[3]) AS h, e[4] AS x, e[5] AS y FROM e),
j AS (SELECT l.id AS lower, u.id AS upper, greatest(abs(l.a / u.a - 1), abs(l.b / u.b - 1)) AS s, greatest(abs(l.a / u.b - 1), abs(l.b / u.a - 1)) AS t, l.h + u.h + 3.3 AS height, l.x AS lx, l.y AS ly, u.x AS ux, u.y AS uy FROM c l JOIN c u ON l.id < u.id)
SELECT lower, upper, t < s AS turned, round(least(s, t), 6) AS strain, round(height, 6) AS height, round(sqrt((lx - CASE WHEN t < s THEN -uy ELSE ux END) ** 2 + (ly - CASE WHEN t < s THEN ux ELSE uy END) ** 2 + 3.3 ** 2), 6) AS nearest FROM j WHERE least(s, t) <= 0.02""")
def bilayer_stacks(t, spark):
    """FEA-16: pairs of cells that fit within two percent, turned or not, and their stack."""
    e = t("embeddings").where(COHORT).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    c = e.select("id", (1 + F.abs(F.col("e")[0])).alias("a"), (1 + F.abs(F.col("e")[1])).alias("b"), F.abs(F.col("e")[2]).alias("h"), F.col("e")[3].alias("x"), F.col("e")[4].alias("y"))
    out = views.bilayers(c)
    return out.select("lower", "upper", "turned", *(r(F.col(k)).alias(k) for k in ("strain", "height", "nearest")))


@query("SELECT r_name, c_mktsegment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN (SELECT c_custkey, c_mktsegment AS m, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) ON m = c_mktsegment AND n_regionkey = r_regionkey GROUP BY 1, 2")
def complete_grid(t, spark):
    """JOIN-14, JOIN-01, JOIN-03: every combination of two short lists (regions, segments), with a count that may be 0."""
    c = t("customer").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("k"))
    grid = t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name").crossJoin(t("customer").select("c_mktsegment").distinct())
    return grid.join(c, ["n_regionkey", "c_mktsegment"], "left").select("r_name", "c_mktsegment", F.coalesce("k", F.lit(0)).alias("n"))
