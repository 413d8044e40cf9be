"""Two views of the same things: pairs of distances, rank consensus, overlap nulls, graph variants (STA-04..08, GRF-04, 05, 13..17, DST-06..10).

Everything over pairs works on a pair table (src < dst, a, b) of a stated cohort; the size of the
cohort is the caller's and the pair table is spread over the cluster, never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from . import pair_ranks
from .ranks import average_rank, value_positions


def pair_distances(df: DataFrame, key: str, views: dict[str, str], digits: int = 9) -> DataFrame:
    """src < dst and the distance of each view for all pairs of a cohort (a theta join on the key, as stated)."""
    left = df.select(F.col(key).alias("src"), *(F.col(v).alias(f"_{n}") for n, v in views.items()))
    right = df.select(F.col(key).alias("dst"), *(F.col(v).alias(f"__{n}") for n, v in views.items()))
    return left.join(right, F.col("src") < F.col("dst")).select("src", "dst", *(F.round(arrays.euclid(F.col(f"_{n}"), F.col(f"__{n}")), digits).alias(n) for n in views))


def hashed_pairs(nodes: DataFrame, key: str, pairs: int, seed: int = 3) -> DataFrame:
    """A sample of ``pairs`` pairs of different nodes, each drawn by a hash of its number: no pair table is made (STA-04).

    Nodes are numbered in the order of their keys; pairs that draw one node twice are left out.
    """
    n = nodes.count()
    places = value_positions(nodes.select(key), key).select(F.col("value").alias(key), F.col("before").alias("place"))
    spark = nodes.sparkSession
    draw = spark.range(pairs).select("id", *(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).alias(c) for k, c in enumerate("ij"))).where("i <> j")
    a = places.select(F.col("place").alias("i"), F.col(key).alias("src"))
    b = places.select(F.col("place").alias("j"), F.col(key).alias("dst"))
    return draw.join(a, "i").join(b, "j").select("id", "src", "dst")


def rank_correlation(pairs: DataFrame, a: str, b: str) -> float:
    """Spearman of two columns of a pair table, ties averaged."""
    ranked = average_rank(average_rank(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry")).first()[0]


def node_bootstrap(pairs: DataFrame, key_hash, a: str, b: str, rounds: int = 20) -> DataFrame:
    """round, r: correlation of two views' ranks with whole nodes drawn anew, a pair counting as often as both its nodes (STA-08)."""
    ranked = average_rank(average_rank(pairs, a, "ra"), b, "rb")
    many = ranked.select("ra", "rb", "src", "dst", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    w = many.withColumn("w", key_hash(F.col("src"), F.col("round")) * key_hash(F.col("dst"), F.col("round"))).where("w > 0")
    x, y = F.col("ra"), F.col("rb")
    s = w.groupBy("round").agg(*(F.sum(F.col("w") * c).alias(n) for n, c in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    mx, my = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    return s.select("round", ((F.col("xy") / F.col("n") - mx * my) / F.sqrt((F.col("xx") / F.col("n") - mx * mx) * (F.col("yy") / F.col("n") - my * my))).alias("r"))


def node_bootstrap_of_pairs(df: DataFrame, key: str, views: dict[str, str], draw: Callable[[int, int], int], key_hash, rounds: int = 20) -> DataFrame:
    """``node_bootstrap`` of the two views over all pairs of a cohort, ranked by blocks; ``draw`` of (id, round) is ``key_hash`` in Python. Vectors with missing or odd values by the pair table."""
    if not pair_ranks.plain(df, views):
        return node_bootstrap(pair_distances(df, key, views), key_hash, *views, rounds)
    found = pair_ranks.weighted_correlations(pair_ranks.build(df, key, views), draw, rounds)
    return df.sparkSession.createDataFrame(found, "round int, r double")


def rank_correlation_of_pairs(df: DataFrame, key: str, views: dict[str, str]) -> tuple[float | None, int]:
    """``rank_correlation`` of the two views over all pairs of a cohort, ranked by blocks, and their number; vectors with missing or odd values by the pair table."""
    a, b = views
    if not pair_ranks.plain(df, views):
        pairs = pair_distances(df, key, views)
        return rank_correlation(pairs, a, b), pairs.count()
    p = pair_ranks.build(df, key, views)
    return pair_ranks.correlations(p)[a, b], p.n


def overlap_null(a: DataFrame, b: DataFrame, k: int, n: int) -> DataFrame:
    """overlap, null_mean, enrichment of two views' neighbours (id, neighbor), the null by in-degrees in closed form (STA-06).

    Under a random renaming of the second view's rows the expected overlap is the sum over
    neighbours of the product of both in-degrees, over k n^2.
    """
    both = a.join(b, ["id", "neighbor"]).agg(F.count(F.lit(1)).alias("hits"))
    da, db = (x.groupBy("neighbor").agg(F.count(F.lit(1)).alias(c)) for x, c in ((a, "da"), (b, "db")))
    null = da.join(db, "neighbor").agg(F.coalesce(F.sum(F.col("da").cast("double") * F.col("db")), F.lit(0.0)).alias("cross"))
    # One row each.
    j = both.crossJoin(null)
    overlap, mean = F.col("hits") / F.lit(float(n * k)), F.col("cross") / F.lit(float(k) * n * n)
    return j.select(overlap.alias("overlap"), mean.alias("null_mean"), (overlap / (mean + 1e-12)).alias("enrichment"))


def degeneracy(neighbors: DataFrame, pairs: DataFrame, k: int, distance: str) -> DataFrame:
    """zero_share of the pairs, tie_share of the rows whose k-th and next distances are equal (GRF-13)."""
    zero = pairs.agg(F.avg((F.col(distance) == 0).cast("double")).alias("zero_share"))
    at = neighbors.where(F.col("rank").isin(k, k + 1)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    return zero.crossJoin(at.agg(F.avg(((F.col("n") == 2) & (F.col("lo") == F.col("hi"))).cast("double")).alias("tie_share")))


def disagreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """id, disagreement: share of the k neighbours (by id) that the views do not have in common (GRF-15)."""
    both = a.join(b, ["id", "neighbor"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("id").distinct().join(both, "id", "left").select("id", (1 - F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("disagreement"))


def neighbor_examples(neighbors: DataFrame, labels: DataFrame, ids: Sequence[int], k: int) -> DataFrame:
    """id, names of its first k neighbours in order (GRF-17)."""
    j = neighbors.where(F.col("id").isin(*ids) & (F.col("rank") <= k)).join(labels.select(F.col("id").alias("neighbor"), "name"), "neighbor")
    return j.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), " ").alias("names"))


def rank_normalized(pairs: DataFrame, *views: str) -> DataFrame:
    """Distances of each view as average ranks scaled to 0..1, and their mean as the consensus (DST-08)."""
    out = pairs
    for v in views:
        out = average_rank(out, v, f"_{v}")
    ends = out.agg(*(f(f"_{v}").alias(f"{n}_{v}") for v in views for n, f in (("lo", F.min), ("hi", F.max))))
    # One row.
    out = out.crossJoin(F.broadcast(ends))
    scaled = [(F.col(f"_{v}") - F.col(f"lo_{v}")) / F.greatest(F.col(f"hi_{v}") - F.col(f"lo_{v}"), F.lit(1e-15)) for v in views]
    return out.select(*pairs.columns, *(c.alias(f"rank_{v}") for c, v in zip(scaled, views, strict=True)), (sum(scaled[1:], scaled[0]) / len(views)).alias("consensus"))


def view_distances(pairs: DataFrame, *views: str) -> DataFrame:
    """view_a, view_b, rho, distance sqrt(2 (1 - rho)) of every two views by the ranks of their pairs (DST-10): ranks once, one pass of sums."""
    ranked = pairs
    for v in views:
        ranked = average_rank(ranked, v, f"_{v}")
    two = [(a, b) for i, a in enumerate(views) for b in views[i + 1 :]]
    one = ranked.agg(*(F.corr(f"_{a}", f"_{b}").alias(f"{a}__{b}") for a, b in two))
    rows = F.array(*(F.struct(F.lit(a).alias("view_a"), F.lit(b).alias("view_b"), F.col(f"{a}__{b}").alias("rho")) for a, b in two))
    return one.select(F.explode(rows).alias("r")).select("r.view_a", "r.view_b", "r.rho", F.sqrt(F.greatest(2 * (1 - F.col("r.rho")), F.lit(0.0))).alias("distance"))


def consensus_of_pairs(df: DataFrame, key: str, views: dict[str, str]) -> DataFrame:
    """``rank_normalized`` of all pairs of a cohort, ranked by blocks; vectors with missing or odd values by the pair table."""
    if not pair_ranks.plain(df, views):
        return rank_normalized(pair_distances(df, key, views), *views)
    p = pair_ranks.build(df, key, views)
    scaled = []
    for v in views:
        lo, hi = p.ends.get(v, (0, 0))
        scaled.append((F.col(f"r_{v}") - F.lit(lo)) / F.lit(float(max(hi - lo, 1))))
    return pair_ranks.rows(p).select("src", "dst", *(F.col(f"d_{v}").alias(v) for v in views), *(c.alias(f"rank_{v}") for c, v in zip(scaled, views, strict=True)), (sum(scaled[1:], scaled[0]) / len(views)).alias("consensus"))


def view_distances_of_pairs(df: DataFrame, key: str, views: dict[str, str]) -> DataFrame:
    """``view_distances`` of all pairs of a cohort, ranked by blocks; vectors with missing or odd values by the pair table."""
    if not pair_ranks.plain(df, views):
        return view_distances(pair_distances(df, key, views), *views)
    rho = pair_ranks.correlations(pair_ranks.build(df, key, views))
    out = df.sparkSession.createDataFrame([(*k, x) for k, x in rho.items()], "view_a string, view_b string, rho double")
    return out.withColumn("distance", F.sqrt(F.greatest(2 * (1 - F.col("rho")), F.lit(0.0))))


def max_affinity(neighbors: DataFrame, k: int) -> DataFrame:
    """src < dst, w = exp(-(d / sqrt(s_src s_dst))^2), the larger of both directions (GRF-04); s is the distance to the k-th neighbour."""
    scale = neighbors.where(F.col("rank") == k).select("id", F.greatest("distance", F.lit(1e-12)).alias("s"))
    j = neighbors.where(F.col("rank") <= k).join(scale.select("id", F.col("s").alias("s1")), "id").join(scale.select(F.col("id").alias("neighbor"), F.col("s").alias("s2")), "neighbor")
    w = F.exp(-F.col("distance") * F.col("distance") / (F.col("s1") * F.col("s2")))
    return j.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def strict_affinity(worst: DataFrame, n: int) -> DataFrame:
    """src < dst, w = exp(-(rank / local threshold)^2) of best-of-worst ranks (id, neighbor, worst), the larger of both directions (GRF-05)."""
    r = worst.select("id", "neighbor", (F.col("worst") / F.lit(float(n - 1))).alias("r"))
    top = r.groupBy("id").agg(F.greatest(F.max("r"), F.lit(1.0 / (n - 1))).alias("t"))
    j = r.join(top, "id")
    u = F.col("r") / F.col("t")
    w = F.exp(-u * u)
    return j.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def medoids(df: DataFrame, group: str, key: str, vector: str, centers: DataFrame) -> DataFrame:
    """group, medoid: the member nearest to its group's centre, first by key (EMB-10). ``centers``: a row per group, broadcast by its size."""
    j = df.join(centers, group)
    return j.groupBy(group).agg(F.min(F.struct(F.round(arrays.euclid(F.col(vector), F.col("centroid")), 9).alias("d"), F.col(key).alias("medoid"))).alias("m")).select(group, F.col("m.medoid").alias("medoid"))


def oriented(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """``x`` with the sign that makes it rise with ``y`` (EMB-08)."""
    sign = df.agg(F.when(F.corr(x, y) < 0, -1.0).otherwise(1.0).alias("_sign"))
    return df.crossJoin(F.broadcast(sign)).withColumn(out, F.col(x) * F.col("_sign")).drop("_sign")


def tension(a: DataFrame, b: DataFrame, key: str, vector: str, scale: Column | float) -> DataFrame:
    """key, tension: distance of a thing's places in two maps over a typical distance (EMB-11)."""
    j = a.select(key, F.col(vector).alias("x")).join(b.select(key, F.col(vector).alias("y")), key)
    return j.select(key, (arrays.euclid(F.col("x"), F.col("y")) / (scale if isinstance(scale, Column) else F.lit(scale))).alias("tension"))


def row_ranks(pairs: DataFrame, n: int, distance: str) -> DataFrame:
    """id, other, rank: place of every other row by distance, ties by id, over n - 1 (WIN-05). ``pairs`` holds src < dst of a cohort."""
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other"), distance).union(pairs.select("dst", "src", distance))
    w = Window.partitionBy("id").orderBy(distance, "other")
    return both.select("id", "other", (F.row_number().over(w) / F.lit(float(n - 1))).alias("rank"))


def bilayers(cells: DataFrame, most_strain: float = 0.02, gap: float = 3.3) -> DataFrame:
    """lower, upper, turned, strain, height, nearest: cells (id, a, b, h, x, y) of a cohort stacked where they fit, as they are or turned by a quarter (FEA-16).

    The strain is the larger of both edges'; of two ways the smaller one is taken.  ``nearest`` is
    the distance of the cells' facing sites, ``gap`` the height between the layers.
    """
    low, up = (cells.select(*(F.col(c).alias(f"{p}{c}") for c in cells.columns)) for p in ("l_", "u_"))

    def strain(a: str, b: str) -> Column:
        return F.greatest(F.abs(F.col("l_a") / F.col(a) - 1), F.abs(F.col("l_b") / F.col(b) - 1))

    j = low.join(up, F.col("l_id") < F.col("u_id")).withColumn("_s", strain("u_a", "u_b")).withColumn("_t", strain("u_b", "u_a"))
    turned = F.col("_t") < F.col("_s")
    # A quarter turn takes (x, y) to (-y, x).
    dx = F.col("l_x") - F.when(turned, -F.col("u_y")).otherwise(F.col("u_x"))
    dy = F.col("l_y") - F.when(turned, F.col("u_x")).otherwise(F.col("u_y"))
    out = j.select(F.col("l_id").alias("lower"), F.col("u_id").alias("upper"), turned.alias("turned"), F.least("_s", "_t").alias("strain"), (F.col("l_h") + F.col("u_h") + gap).alias("height"), F.sqrt(dx * dx + dy * dy + gap * gap).alias("nearest"))
    return out.where(F.col("strain") <= most_strain)
