"""Queries over vectors: distances, neighbours, graphs, references, embeddings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import landmarks, permutations, screen, silhouette, spectral, stats, vectors
from .core import query, r
from .views import _JUDGED, NULLS, dealing, dealt_sql

_PAIRS = f"pairs AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
_KNN = _PAIRS + ", knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM pairs) WHERE rank <= 10)"
K = 10


def knn(t):
    return vectors.knn(t("embeddings").select("vec_id", "embedding"), K)


@query(f"WITH {_KNN} SELECT id, neighbor, round(distance, 6) AS distance, rank FROM knn")
def knn_exact(t, spark):
    """DST-01, GRF-01: ten nearest others, ties by id, in blocks."""
    return knn(t).select("id", "neighbor", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT vec_id, round(list_min(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS low, round(list_max(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS high, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean,
  round(list_median(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS median, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""")
def array_stats(t, spark):
    """ARR-01, MTH-07, MTH-11, AGG-06 over a row's array."""
    v = F.col("embedding")
    s = arrays.sorted_stats(v)
    return t("embeddings").select("vec_id", r(s["low"]).alias("low"), r(s["high"]).alias("high"), r(s["mean"]).alias("mean"), r(arrays.median(v)).alias("median"), r(arrays.norm(v)).alias("norm"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l1_of_unit FROM embeddings")
def l2_normalize(t, spark):
    """SCL-07."""
    u = arrays.l2_normalize(F.col("embedding"))
    return t("embeddings").select("vec_id", r(arrays.total(F.transform(u, F.abs))).alias("l1_of_unit"))


@query("""
WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), z AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY 1),
d AS (SELECT vec_id, e.label AS own, z.label AS nearest, round(list_distance(embedding::DOUBLE[], m), 9) AS distance FROM embeddings e, z)
SELECT vec_id, nearest, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rn FROM d) WHERE rn = 1""")
def nearest_seed(t, spark):
    """JOIN-18: nearest reference (label centroid) of every vector."""
    e = t("embeddings")
    c = screen.centroids(e, "label", "embedding").withColumnRenamed("label", "ref")
    return screen.nearest_reference(e, c, "vec_id", "embedding", "ref", "centroid").select("vec_id", "nearest", r(F.col("distance")).alias("distance"))


@query("""
WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), z AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY 1),
d AS (SELECT vec_id, e.label AS own, z.label AS nearest, round(list_distance(embedding::DOUBLE[], m), 9) AS distance FROM embeddings e, z WHERE z.label <> e.label)
SELECT vec_id, nearest, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rn FROM d) WHERE rn = 1""")
def nearest_seed_excluding_group(t, spark):
    """JOIN-19: nearest reference that is not of the row's own group."""
    e = t("embeddings")
    c = screen.centroids(e, "label", "embedding").withColumn("ref", F.col("label")).withColumnRenamed("label", "ref_group")
    return screen.nearest_reference(e, c, "vec_id", "embedding", "ref", "centroid", exclude=("label", "ref_group")).select("vec_id", "nearest", r(F.col("distance")).alias("distance"))


def _halves(t):
    e = t("embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 32).alias("embedding")), e.select("vec_id", F.slice("embedding", 33, 32).alias("embedding"))


_HALF = "{n} AS (SELECT id, neighbor FROM (SELECT a.vec_id AS id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding[{lo}:{hi}]::DOUBLE[], b.embedding[{lo}:{hi}]::DOUBLE[]), 9), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rn <= 10)"


@query(f"WITH {_HALF.format(n='p', lo=1, hi=32)}, {_HALF.format(n='q', lo=33, hi=64)} SELECT i.vec_id AS id, round(coalesce(n, 0) / 10.0, 6) AS overlap FROM embeddings i LEFT JOIN (SELECT id, count(*) AS n FROM p JOIN q USING (id, neighbor) GROUP BY 1) ON id = vec_id")
def knn_overlap_views(t, spark):
    """GRF-11, GRF-12: neighbours shared by two views of the same cohort."""
    a, b = _halves(t)
    return vectors.knn_overlap(vectors.knn(a, K), vectors.knn(b, K), K).select("id", r(F.col("overlap")).alias("overlap"))


_AFF = _KNN + """, s AS (SELECT id, distance AS s FROM knn WHERE rank = 10), e AS (SELECT DISTINCT least(id, neighbor) AS src, greatest(id, neighbor) AS dst, distance FROM knn),
aff AS (SELECT src, dst, exp(-distance * distance / (x.s * y.s + 1e-12)) AS w FROM e JOIN s x ON x.id = src JOIN s y ON y.id = dst)"""


@query(f"WITH {_AFF} SELECT src, dst, round(w, 6) AS w FROM aff")
def affinity_edges(t, spark):
    """GRF-03: local-scale affinities, union of both directions."""
    return vectors.affinity(knn(t), K).select("src", "dst", r(F.col("w")).alias("w"))


@query(f"""WITH RECURSIVE {_AFF}, both_e AS (SELECT src AS a, dst AS b FROM aff UNION ALL SELECT dst, src FROM aff), deg AS (SELECT vec_id AS id, count(b) AS d FROM embeddings LEFT JOIN both_e ON a = vec_id GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN both_e e ON r.b = e.a), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1), size AS (SELECT c, count(*) AS n FROM comp GROUP BY 1)
SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM aff) AS edges, (SELECT count(*) FROM size) AS components, (SELECT round(max(n) / sum(n), 6) FROM size) AS giant_share, (SELECT count(*) FROM deg WHERE d = 0) AS isolated, (SELECT round(avg(d), 6) FROM deg) AS mean_degree""")
def graph_qa(t, spark):
    """GRF-06: size, components, giant share, isolated nodes and degrees."""
    edges = vectors.cut_lineage(vectors.affinity(knn(t), K).select("src", "dst"))
    nodes = t("embeddings").select(F.col("vec_id").alias("id"))
    both = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    deg = nodes.join(both, "id", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("d").isNull(), 1)).alias("isolated"), r(F.sum(F.coalesce("d", F.lit(0))) / F.count(F.lit(1))).alias("mean_degree"), (F.coalesce(F.sum("d"), F.lit(0)) / 2).cast("long").alias("edges"))
    size = vectors.components(edges, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("components"), r(F.max("n") / F.sum("n")).alias("giant_share"))
    return deg.crossJoin(size).select("nodes", "edges", "components", "giant_share", "isolated", "mean_degree")


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) <= 1.0),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS component FROM reach GROUP BY 1""")
def connected_components(t, spark):
    """GRF-07: components of the graph of near vectors."""
    near = vectors.within(t("embeddings").select("vec_id", "embedding"), 1.0, forest=True)
    return vectors.components(near, t("embeddings").select(F.col("vec_id").alias("id")))


@query(f"WITH {_AFF} SELECT round(sum(w * (x.label - y.label) ** 2) / sum(w), 6) AS smoothness FROM aff JOIN embeddings x ON x.vec_id = src JOIN embeddings y ON y.vec_id = dst")
def graph_smoothness(t, spark):
    """GRF-14: weighted squared label differences along edges."""
    y = t("embeddings").select("vec_id", F.col("label").cast("double").alias("y"))
    j = vectors.affinity(knn(t), K).join(y.toDF("src", "y1"), "src").join(y.toDF("dst", "y2"), "dst")
    d = F.col("y1") - F.col("y2")
    return j.agg(r(F.sum(F.col("w") * d * d) / F.sum("w")).alias("smoothness"))


@query(f"""
WITH {_AFF}, pl AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), {dealing("embeddings", NULLS)}, mv AS (SELECT ks.round, id, {dealt_sql("place")} AS place FROM pl, ks, nn),
y AS (SELECT mv.round, mv.id, pl.label AS y FROM mv JOIN pl ON pl.place = mv.place), v AS (SELECT a.round, sum(w * (a.y - b.y) ** 2) / sum(w) AS v FROM aff JOIN y a ON a.id = src JOIN y b ON b.id = dst AND b.round = a.round GROUP BY 1),
{_JUDGED.replace('>=', '<=')} SELECT round(observed, 6) AS smoothness, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round((observed - null_mean) / (null_sd + 1e-12), 4) AS z, round(p, 6) AS p FROM jd""")
def smoothness_null(t, spark):
    """GRF-14: smoothness of the labels against labels dealt anew to the nodes; p is the share of rounds that are as smooth."""
    y = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"))
    out = permutations.judged(permutations.smoothness_rounds(vectors.affinity(knn(t), K), y, NULLS), "smoothness", upper=False)
    return out.select(r(F.col("observed")).alias("smoothness"), r(F.col("null_mean")).alias("null_mean"), r(F.col("null_sd")).alias("null_sd"), r(F.col("z"), 4).alias("z"), r(F.col("p")).alias("p"))


@query(f"WITH {_KNN} SELECT e.label, round(avg((n.label = e.label)::INT), 6) AS same_label, round(avg((n.label = e.label)::INT) / any_value(b.share), 4) AS enrichment FROM knn JOIN embeddings e ON e.vec_id = id JOIN embeddings n ON n.vec_id = neighbor JOIN (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS share FROM embeddings GROUP BY 1) b ON b.label = e.label GROUP BY 1")
def neighbor_label_enrichment(t, spark):
    """GRF-16: share of neighbours with the own label, over the label's share."""
    lab = t("embeddings").select("vec_id", "label")
    n = lab.count()
    share = lab.groupBy("label").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("share"))
    j = knn(t).join(lab.toDF("id", "label"), "id").join(lab.toDF("neighbor", "other"), "neighbor")
    g = j.groupBy("label").agg(F.avg((F.col("label") == F.col("other")).cast("int")).alias("s"))
    return g.join(F.broadcast(share), "label").select("label", r(F.col("s")).alias("same_label"), F.round(F.col("s") / F.col("share"), 4).alias("enrichment"))


@query(f"WITH {_KNN} SELECT id, round(sum(n.label / (distance + 1e-9)) / sum(1 / (distance + 1e-9)), 4) AS prediction FROM knn JOIN embeddings n ON n.vec_id = neighbor GROUP BY 1")
def knn_regression(t, spark):
    """MOD-07: inverse-distance mean of the neighbours."""
    y = t("embeddings").select(F.col("vec_id").alias("neighbor"), F.col("label").cast("double").alias("y"))
    return screen.knn_regression(knn(t), y).select("id", F.round("prediction", 4).alias("prediction"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings), z AS (SELECT *, list_sum(p) AS s FROM h), c AS (SELECT i, avg(x) AS m FROM (SELECT unnest(list_transform(p, lambda x: x / s)) AS x, generate_subscripts(p, 1) AS i FROM z) GROUP BY 1), r AS (SELECT list(m ORDER BY i) AS q FROM c)
SELECT vec_id, round(sqrt(0.5 * list_sum(list_transform(list_zip(p, q), lambda w: (sqrt(w[1] / s) - sqrt(w[2])) ** 2))), 6) AS hellinger FROM z, r""")
def hellinger_to_mean(t, spark):
    """DST-03: distance of each row's distribution to the mean one."""
    h = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("h"))
    p = h.select("vec_id", F.lit(1).alias("g"), F.transform("h", lambda x: x / arrays.total(F.col("h"))).alias("p"))
    m = screen.centroids(p, "g", "p").select("centroid")
    return p.crossJoin(F.broadcast(m)).select("vec_id", r(arrays.hellinger(F.col("p"), F.col("centroid"))).alias("hellinger"))


@query(f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, round(list_distance(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 9) AS d1, round(list_distance(a.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[]), 9) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT id, neighbor, greatest(row_number() OVER (PARTITION BY id ORDER BY d1, neighbor), row_number() OVER (PARTITION BY id ORDER BY d2, neighbor)) AS worst FROM p)
SELECT id, neighbor, worst FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY worst, neighbor) AS rn FROM k) WHERE rn <= 5""")
def rank_and_distance(t, spark):
    """DST-09: the five others whose worse rank in two views is best."""
    return vectors.worst_rank(t("embeddings").select("vec_id", "embedding"), 32, 5)


@query()
def pca_variance(t, spark):
    """EMB-01: explained variance, from one d x d cross product."""
    values, _, effective = vectors.pca(t("embeddings"), "embedding")
    return spark.createDataFrame([(i, float(v / values.sum()), effective) for i, v in enumerate(values)], "component int, share double, effective_rank double")


def landmark_map(t, steps: int = 0):
    """All vectors with the landmarks that place them in the plane."""
    e = t("embeddings").select("vec_id", "embedding")
    return e, landmarks.lower_stress(e, "vec_id", "embedding", landmarks.classical(e, "vec_id", "embedding"), steps) if steps else landmarks.classical(e, "vec_id", "embedding")


def _xy(df, place: str = "place"):
    return [r(F.col(place)[i]).alias(f"{place}_{a}") for i, a in enumerate("xy")]


@query()
def mds_coords(t, spark):
    """EMB-04: every vector placed in the classical map of 64 landmarks."""
    e, marks = landmark_map(t)
    return landmarks.place(e, "vec_id", "embedding", marks).select(F.col("id").alias("vec_id"), r(F.col("place")[0]).alias("x"), r(F.col("place")[1]).alias("y"))


@query()
def stress_map(t, spark):
    """EMB-05, EMB-07: every vector's place of least stress against the landmarks, and its classical place turned onto it."""
    e, marks = landmark_map(t, 12)
    start = landmarks.place(e, "vec_id", "embedding", replace(marks, places=marks.places[:1]))
    both = landmarks.turned_onto(landmarks.place(e, "vec_id", "embedding", marks), start)
    return both.select(F.col("id").alias("vec_id"), *_xy(both), *_xy(both, "other"))


@query()
def map_preservation(t, spark):
    """EMB-12: rank correlation of distances to the landmarks with those in the map, and the share of ten nearest that the map keeps."""
    e, marks = landmark_map(t, 12)
    order = stats.spearman_panel(landmarks.landmark_pairs(e, "vec_id", "embedding", marks).select(F.lit("all").alias("g"), "d", "e"), ["d"], "e", ["g"])
    place = landmarks.place(e, "vec_id", "embedding", marks)
    kept = vectors.knn_overlap(knn(t), vectors.knn(place, K, "id", "place"), K).agg(F.avg("overlap").alias("kept"))
    return order.select("n", r(F.col("rho")).alias("spearman")).crossJoin(F.broadcast(kept)).select("n", "spearman", r(F.col("kept")).alias("neighbors_kept"))  # one row


@query()
def diffusion_coords(t, spark):
    """EMB-02, EMB-03: coordinates by the leading eigenvectors of the affinity graph of all vectors."""
    pairs = spectral.eigenpairs(vectors.affinity(knn(t), K), 3)
    c = spectral.diffusion_coordinates(pairs)
    return c.select(F.col("id").alias("vec_id"), *(r(F.col(n)).alias(n) for n in c.columns[1:]))


@query("""
WITH p AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) END) AS s, count(*) AS n FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, label, max(s / nullif(n - 1, 0)) FILTER (other = label) AS a, min(s / n) FILTER (other <> label) AS b FROM p GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m""")
def label_silhouette(t, spark):
    """EMB-09: how well each vector lies within its label."""
    s = silhouette.silhouettes(t("embeddings"), ["label"])
    return s.select(F.col("id").alias("vec_id"), F.col("cluster").alias("label"), r(F.col("silhouette")).alias("silhouette"))


@query()
def silhouette_scan(t, spark):
    """EMB-09, AGG-30: three to six clusters by the mean silhouette, numbered left to right, with sizes and medians."""
    rows, mean, best = silhouette.choose_clusters(t("embeddings").select("vec_id", "embedding", "label"), range(3, 7))
    x = r(F.median(F.col("embedding")[0].cast("double")))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), x.alias("median_x"), F.lit(best).alias("k"), F.lit(round(mean[best], 6)).alias("silhouette"))


@query()
def kmeans_profile(t, spark):
    """EMB-09, AGG-30: clusters with their sizes and leading label."""
    k = screen.kmeans_profile(t("embeddings").select("vec_id", "embedding", "label"), "embedding", 8)
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.mode("label").alias("label"), F.median("label").alias("median_label"))
