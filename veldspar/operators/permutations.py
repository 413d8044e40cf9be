"""Nulls by permutation without an order of all rows in one task (STA-05, STA-06, GRF-14).

A round's permutation is a keyed bijection of the places 0 .. n - 1 that each row works out by
itself: in each step a place p and its partner (key - p) mod n change places or not, as a hash of
the larger of both says.  Partners agree on the hash, so a step is its own inverse and the whole a
bijection for every n.  Nothing is sorted or windowed over a round; round 0 leaves all as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from .ranks import average_rank, grouped_average_rank, value_positions
from .vectors import cut_lineage

#: Steps of a permutation; a place stays out of all of them with a chance of 2^-STEPS.
STEPS = 24


def _number(*parts) -> Column:
    """A hash of some values, below 2^52."""
    text = F.concat_ws("/", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def deals(spark: SparkSession, rounds: int, n: int, seed: int = 0) -> DataFrame:
    """round (0 .. rounds) and the keys of its steps: a row per round, small enough to broadcast."""
    r = spark.range(rounds + 1).select(F.col("id").cast("int").alias("round"))
    return r.select("round", F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda i: F.pmod(_number(seed, F.col("round"), i), F.lit(max(n, 1)).cast("long"))).alias("keys"))


def dealt(place: Column, n: int, seed: int = 0) -> Column:
    """Where a round (columns ``round`` and ``keys`` of :func:`deals`) takes a place of 0 .. n - 1; null for null."""

    def step(p: Column, i: Column) -> Column:
        other = F.pmod(F.element_at("keys", i) - p, F.lit(n).cast("long"))
        text = F.concat_ws("/", F.lit(str(seed)), F.col("round").cast("string"), i.cast("string"), F.greatest(p, other).cast("string"))
        return F.when(F.substring(F.md5(text.cast("binary")), 1, 1) >= "8", other).otherwise(p)

    place = place.cast("long")
    return F.when((F.col("round") == 0) | place.isNull(), place).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), place, step))


def places(nodes: DataFrame, key: str) -> DataFrame:
    """key, place: distinct non-null keys numbered from 0 in their order."""
    return value_positions(nodes.select(key).distinct(), key).select(F.col("value").alias(key), F.col("before").alias("place"))


def _spread(nodes: DataFrame, place: str) -> DataFrame:
    """Rows dealt out by their place: the planner puts small rows into few partitions, but each stands for a row per round with its hashes."""
    # By a hash, as what lies by the place already would stay where it is.
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(place))


def judged(rounds: DataFrame, value: str, upper: bool = True, mean: Column | None = None) -> DataFrame:
    """observed, null_mean, null_sd, z, p of (round, value): round 0 against the others.

    p is the share of rounds that reach the observed value (from above, or from below); ``mean`` is
    a closed form that takes the place of the rounds' mean.  A row per round comes in.
    """
    seen = rounds.where("round = 0").select(F.col(value).alias("observed"))
    j = rounds.where("round > 0").crossJoin(F.broadcast(seen))  # one row
    reach = F.col(value) >= F.col("observed") if upper else F.col(value) <= F.col("observed")
    s = j.groupBy("observed").agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"), F.avg(reach.cast("double")).alias("p"))
    s = s.withColumn("null_mean", mean) if mean is not None else s
    return s.select("observed", "null_mean", "null_sd", ((F.col("observed") - F.col("null_mean")) / (F.col("null_sd") + 1e-12)).alias("z"), "p")


def overlap_rounds(a: DataFrame, b: DataFrame, nodes: DataFrame, k: int, rounds: int, seed: int = 0) -> DataFrame:
    """round, overlap: share of neighbours (id, neighbor) in common when row i of ``a`` meets the row of ``b`` that the round deals to it (STA-06).

    A row per node and round with its k neighbours is what is shuffled.  Nodes without a list in one
    of the views have nothing in common; without nodes there are no rounds.
    """
    at = cut_lineage(places(nodes, "id"))
    n = at.count()
    if not n:
        return nodes.sparkSession.createDataFrame([], "round int, overlap double")
    near = [x.join(at, "id").groupBy("place").agg(F.collect_set("neighbor").alias(c)) for x, c in ((a, "mine"), (b, "theirs"))]
    every = deals(nodes.sparkSession, rounds, n, seed)
    asked = _spread(near[0], "place").crossJoin(F.broadcast(every)).select("round", "mine", dealt(F.col("place"), n, seed).alias("place"))
    # An inner join would work out each place again to see that it is not null.
    met = asked.join(near[1], "place", "left")
    hits = met.groupBy("round").agg(F.sum(F.when(F.col("theirs").isNotNull(), F.size(F.array_intersect("mine", "theirs")))).alias("hits"))
    return every.select("round").join(hits, "round", "left").select("round", (F.coalesce("hits", F.lit(0)) / F.lit(float(n * k))).alias("overlap"))


def smoothness_rounds(edges: DataFrame, values: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """round, smoothness: sum w (y_i - y_j)^2 / sum w over edges (src, dst, w), the values (id, y) dealt anew to the nodes (GRF-14).

    A node carries its values of all rounds in one array.  Edges with an end that has no value, or a
    null or NaN one, do not count in that round; null where none counts.
    """
    spark = edges.sparkSession
    at = cut_lineage(places(values, "id"))
    n = at.count()
    if not n:
        return spark.createDataFrame([], "round int, smoothness double")
    given = values.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("y").cast("double").alias("y"))
    own = at.join(given, "id").select(F.col("place").alias("to"), F.nanvl("y", F.lit(None).cast("double")).alias("y"))
    asked = _spread(at, "place").crossJoin(F.broadcast(deals(spark, rounds, n, seed))).select("id", "round", dealt(F.col("place"), n, seed).alias("to"))
    # Every place has its row, so the outer join drops nothing; an inner one would work out each place again to see that it is not null.
    placed = asked.join(own, "to", "left")
    # As many entries as rounds; written, as both ends of an edge take it.
    ys = cut_lineage(placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "y"))), lambda s: s["y"]).alias("ys")))
    j = edges.select("src", "dst", F.col("w").cast("double").alias("w")).join(ys.toDF("src", "ys1"), "src").join(ys.toDF("dst", "ys2"), "dst")
    d = j.select("w", F.posexplode(F.zip_with("ys1", "ys2", lambda p, q: (p - q) * (p - q))).alias("round", "d")).where("d is not null")
    s = d.groupBy("round").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("smoothness"))
    return spark.range(rounds + 1).select(F.col("id").cast("int").alias("round")).join(s, "round", "left")


def drawn_pairs(spark: SparkSession, pairs: int, n: int, seed: int = 0) -> DataFrame:
    """pair, i, j: places of pairs drawn by hash; draws of one place twice are left out."""
    return spark.range(pairs).select(F.col("id").alias("pair"), *(F.pmod(_number(seed, c, F.col("id")), F.lit(max(n, 1)).cast("long")).alias(c) for c in "ij")).where("i <> j")


def mantel_rounds(df: DataFrame, key: str, a: str, b: str, pairs: int, rounds: int, seed: int = 0, digits: int = 9) -> DataFrame:
    """round, rho: rank correlation of the two views' distances over drawn pairs, the rows of ``b`` renamed in each round (STA-05).

    Rows with a null key or view are left out; of repeated keys one row is taken.  Vectors go to the
    pairs that ask for them, so work is pairs times rounds whatever the number of rows.
    """
    spark = df.sparkSession
    src = df.where(F.col(key).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("v"))
    at = places(src, key)
    n = at.count()
    v = cut_lineage(at.join(src, key).select("place", "v.a", "v.b"))
    draw = drawn_pairs(spark, pairs, n, seed)

    def ends(t: DataFrame, view: str) -> DataFrame:
        one, two = (v.select(F.col("place").alias(c), F.col(view).alias(f"_{c}")) for c in "ij")
        return t.join(one, "i").join(two, "j").withColumn("d", F.round(arrays.euclid(F.col("_i"), F.col("_j")), digits)).drop("_i", "_j", "i", "j")

    ra = average_rank(ends(draw, "a"), "d", "ra").select("pair", "ra")
    # Written, or the planner would work out each place again for every condition on it.
    many = cut_lineage(draw.crossJoin(F.broadcast(deals(spark, rounds, n, seed))).select("pair", "round", *(dealt(F.col(c), n, seed).alias(c) for c in "ij")))
    rb = grouped_average_rank(ends(many, "b"), ["round"], "d", "rb").select("pair", "round", "rb")
    return rb.join(ra, "pair").groupBy("round").agg(F.corr("ra", "rb").alias("rho"))
