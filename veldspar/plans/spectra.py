"""Queries over spectra and curves: triples of vector components, and users' event curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectra
from ..operators import ranks
from .core import query, r

#: Consecutive triples of a 64-component vector.
TRIPLES = 21

# SQL of the triples: vector, number of the triple, its values and the same in ascending order.
_T = f"t AS (SELECT vec_id, i, list_transform(embedding[3 * i + 1 : 3 * i + 3], lambda x: x::DOUBLE) AS v FROM embeddings, range({TRIPLES}) g(i)), s AS (SELECT *, list_sort(v) AS s, list_sort(list_transform(v, lambda x: abs(x))) AS a FROM t)"


def triples(t, size=False):
    """vec_id, i, v: each vector's consecutive triples, as a spectrum (of sizes, if asked for)."""
    v = F.transform(F.slice("embedding", F.col("i") * 3 + 1, 3), lambda x: (F.abs(x.cast("double")) if size else x.cast("double")))
    return t("embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(TRIPLES - 1))).alias("i")).select("vec_id", F.col("i").cast("long").alias("i"), v.alias("v"))


def rounded(features, *names):
    return [r(features[n]).alias(n) for n in names or features]


@query(f"""
WITH {_T} SELECT vec_id, i, round((a[1] + a[2] + a[3]) / 3, 6) AS mean, round(a[2], 6) AS median, round(CASE WHEN a[2] > 0 THEN sqrt(a[2] * a[3]) END, 6) AS dom_geo,
  round(CASE WHEN a[1] > 0 THEN pow(a[1] * a[2] * a[3], 1.0 / 3) END, 6) AS geo_all, round(CASE WHEN a[1] > 0 THEN log10(a[3] / a[1]) END, 6) AS a_total,
  round(CASE WHEN a[1] > 0 THEN log10(a[2] / a[1]) END, 6) AS d, round(CASE WHEN a[2] > 0 THEN log10(a[3] / a[2]) END, 6) AS a_dom FROM s""")
def conductivity_spectrum(t, spark):
    """FEA-03: geometry of sorted channels, all expressions."""
    return triples(t, True).select("vec_id", "i", *rounded(spectra.conductivity_spectrum(F.col("v"))))


@query(f"""
WITH {_T}, f AS (SELECT vec_id, i, CASE WHEN a[1] > 0 THEN log10(a[2] / a[1]) END AS d, CASE WHEN a[2] > 0 THEN log10(a[3] / a[2]) END AS m FROM s),
q AS (SELECT median(d) AS dm, median(m) AS mm FROM f)
SELECT CASE WHEN d IS NULL OR m IS NULL THEN 'C4' WHEN d > dm AND m <= mm THEN 'C1' WHEN d > dm THEN 'C2' WHEN m <= mm THEN 'C3' ELSE 'C4' END AS kind, count(*) AS n FROM f, q GROUP BY 1""")
def spectrum_classes(t, spark):
    """PRJ-09: classes by the exact medians of two features."""
    f = spectra.conductivity_spectrum(F.col("v"))
    rows = triples(t, True).select(f["d"].alias("d"), f["a_dom"].alias("a"))
    (d,), (a,) = ranks.exact_quantiles(rows, "d", [0.5]), ranks.exact_quantiles(rows, "a", [0.5])
    return rows.groupBy(spectra.spectrum_class(F.col("d"), F.col("a"), d, a).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_T}, m AS (SELECT *, (v[1] + v[2] + v[3]) / 3 AS mean FROM s), k AS (SELECT *, sqrt(((v[1] - mean) ** 2 + (v[2] - mean) ** 2 + (v[3] - mean) ** 2) / 3) AS std FROM m)
SELECT vec_id, i, round(mean, 6) AS s_mean, round(s[2], 6) AS s_median, round(std, 6) AS s_std, round(list_median([abs(s[1] - s[2]), 0.0, abs(s[3] - s[2])]), 6) AS s_mad,
  round(s[3] - s[1], 6) AS s_range, round((a[1] + a[2] + a[3]) / 3, 6) AS s_abs_mean, round(a[3], 6) AS s_abs_max, round(std / (abs(mean) + 1e-12), 4) AS s_relative_spread,
  round(len(list_filter(v, lambda x: x < 0)) / 3.0, 6) AS s_sign_fraction FROM k""")
def seebeck_spectrum(t, spark):
    """FEA-01, MTH-07: centre, spread and sign share of signed spectra."""
    f = spectra.seebeck_features(F.col("v"), -1)
    return triples(t).select("vec_id", "i", *rounded({k: c for k, c in f.items() if k != "s_relative_spread"}), r(f["s_relative_spread"], 4).alias("s_relative_spread"))


@query(f"""
WITH {_T} SELECT vec_id, i, round(CASE WHEN a[2] > 0 THEN log10(sqrt(a[2] * a[3]) + 1e-6) ELSE 0 END, 6) AS log_dom_geo, round(CASE WHEN a[1] > 1e-9 THEN log10(a[2] / a[1]) ELSE 6 END, 6) AS d,
  round(CASE WHEN a[2] > 1e-9 THEN log10(a[3] / a[2]) ELSE 6 END, 6) AS a_dom, round(CASE WHEN a[1] > 1e-9 THEN log10(a[3] / a[1]) ELSE 6 END, 6) AS a_total FROM s""")
def capped_spectrum(t, spark):
    """FEA-01, MTH-04: log ratios with their cap."""
    return triples(t, True).select("vec_id", "i", *rounded(spectra.capped_spectrum(F.col("v"))))


@query(f"""
WITH {_T}, f AS (SELECT *, (a[1] + a[2] + a[3]) / 3 AS mean FROM s), e AS (SELECT min(mean) FILTER (mean > 0) / 10 AS eps FROM f)
SELECT vec_id, i, round(mean, 6) AS mean, round(sqrt(((a[1] - mean) ** 2 + (a[2] - mean) ** 2 + (a[3] - mean) ** 2) / 3), 6) AS std, round(a[1], 6) AS low, round(a[3], 6) AS high,
  round(CASE WHEN a[1] > 1e-9 THEN log10(a[3] / a[1]) END, 6) AS anisotropy_log, round(log10(mean + eps), 6) AS log_mean FROM f, e""")
def invariant_spectrum(t, spark):
    """FEA-02: features that no order of the channels changes, logs offset by a tenth of the least positive mean."""
    rows = triples(t, True).select("vec_id", "i", *(c.alias(k) for k, c in spectra.invariant_features(F.col("v")).items()))
    # One row.
    eps = rows.agg((F.min(F.when(F.col("mean") > 0, F.col("mean"))) / 10).alias("eps"))
    names = ("mean", "std", "low", "high", "anisotropy_log")
    return rows.crossJoin(F.broadcast(eps)).select("vec_id", "i", *(r(F.col(n)).alias(n) for n in names), r(F.log10(F.col("mean") + F.col("eps"))).alias("log_mean"))


@query(f"""
WITH {_T} SELECT vec_id, i, round((a[1] + a[2] + a[3]) / 3, 6) AS mean, round(a[2], 6) AS median, round(a[1], 6) AS least, round(sqrt(a[1] * a[2]), 6) AS dom_geo, round(a[3] - a[1], 6) AS span,
  round(CASE WHEN a[1] > 0 THEN log10(a[3] / a[1]) END, 6) AS spectral_ratio FROM s""")
def mass_spectrum(t, spark):
    """FEA-04: spectrum of effective masses."""
    return triples(t, True).select("vec_id", "i", *rounded(spectra.mass_spectrum(F.col("v"))))


@query(f"""
WITH {_T}, p AS (SELECT vec_id, i, list_filter(a, lambda x: x > 0) AS p FROM s)
SELECT vec_id, i, round(CASE WHEN len(p) >= 2 THEN ln(1 + list_max(p) / list_min(p)) END, 6) AS ratio,
  round(CASE WHEN len(p) >= 2 THEN ln(1 + pow(exp(list_sum(list_transform(p, lambda x: ln(x))) / len(p)) / (len(p) / list_sum(list_transform(p, lambda x: 1 / x))), 1.5)) END, 6) AS complexity FROM p""")
def mass_shape(t, spark):
    """FEA-05, ARR-04: spread and complexity of the masses that are finite and not 0."""
    return triples(t).select("vec_id", "i", *rounded(spectra.mass_shape(F.col("v"))))


@query(f"""
WITH {_T}, p AS (SELECT x.vec_id, x.i, list_transform([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]], lambda o: (x.v[1] * y.v[o[1]] + x.v[2] * y.v[o[2]] + x.v[3] * y.v[o[3]]) / 3) AS m
  FROM t x JOIN t y ON x.vec_id = y.vec_id AND y.i = x.i + 1)
SELECT vec_id, i, round(list_min(m), 6) AS low, round(list_avg(m), 6) AS mean, round(list_max(m), 6) AS high FROM p""")
def pairing_orders(t, spark):
    """ARR-03: products of two spectra over every pairing of their channels."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    two = t("embeddings").select("vec_id", v.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(TRIPLES - 2))).alias("i"))
    both = spectra.paired_over_orders(F.slice("e", F.col("i") * 3 + 1, 3), F.slice("e", F.col("i") * 3 + 4, 3))
    return two.select("vec_id", F.col("i").cast("long").alias("i"), *rounded(both))


@query(f"""
WITH {_T}, c AS (SELECT *, len(list_filter(v, lambda x: x > 0)) AS up, len(list_filter(v, lambda x: x < 0)) AS down FROM s)
SELECT CASE WHEN up > down THEN 1 WHEN down > up THEN -1 ELSE 0 END AS majority, round(greatest(up, down) / 3, 6) AS share, sign((v[1] + v[2] + v[3]) / 3) = sign(s[2]) AS agree, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def sign_agreement(t, spark):
    """MTH-08: the sign of most channels, and whether mean and median share it."""
    f = spectra.sign_agreement(F.col("v"))
    return triples(t).groupBy(f["majority"].alias("majority"), r(f["share"]).alias("share"), f["agree"].alias("agree")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_T} SELECT vec_id, round(max(v[2] - v[1]) FILTER (i = 0), 6) AS gap_correction, round(max(CASE WHEN v[1] > 0 THEN log10(v[1]) END) FILTER (i = 1), 6) AS log_mass,
  round(max(CASE WHEN v[2] > 0 THEN log10(v[2]) END) FILTER (i = 1), 6) AS log_other_mass, round(max(CASE WHEN v[1] > 0 AND v[2] > 0 THEN log10(v[1]) - log10(v[2]) END) FILTER (i = 1), 6) AS log_mass_ratio,
  round(max(list_sum(list_transform(list_filter(v, lambda x: x > 0), lambda x: log10(x))) / len(list_filter(v, lambda x: x > 0))) FILTER (i = 2 AND len(list_filter(v, lambda x: x > 0)) > 0), 6) AS log_dielectric_geo,
  round(max(CASE WHEN len(list_filter(v, lambda x: x > 0)) >= 2 THEN log10(list_max(list_filter(v, lambda x: x > 0)) / list_min(list_filter(v, lambda x: x > 0))) END) FILTER (i = 2), 6) AS log_dielectric_anisotropy FROM s GROUP BY 1""")
def band_features(t, spark):
    """FEA-11: gap, masses and dielectric tensor of a record on log scales."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", e.alias("e")).select("vec_id", *rounded(spectra.band_features(F.col("e")[0], F.col("e")[1], F.col("e")[3], F.col("e")[4], F.slice("e", 7, 3))))


@query(f"""
WITH {_T} SELECT vec_id, i, round(abs(v[1]), 6) AS abs_seebeck, CASE WHEN sign(v[1]) = 1 THEN 1.0 ELSE 0.0 END AS sign_expected, round(CASE WHEN v[2] > 0 THEN log10(v[2]) END, 6) AS log_sigma,
  round(CASE WHEN v[3] > 0 THEN log10(v[3]) END, 6) AS log_kappa, round(CASE WHEN v[2] > 0 AND v[3] > 0 THEN log10(v[3]) - log10(v[2]) END, 6) AS log_kappa_over_sigma FROM s""")
def transport_fingerprint(t, spark):
    """FEA-12: thermopower and conductivities of a record on log scales."""
    v = F.col("v")
    return triples(t).select("vec_id", "i", *rounded(spectra.transport_fingerprint(v[0], v[1], v[2], 1)))


# A user's events of a type as a curve: hours of the day against the value.
_C = """c AS (SELECT user_id, event_type, hour(ts)::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND value BETWEEN 1 AND 400 AND hour(ts) BETWEEN 3 AND 21),
k AS (SELECT user_id, event_type, x, median(y) AS y FROM c GROUP BY 1, 2, 3)"""


def hourly(t):
    e = t("events").where("value is not null").groupBy("user_id", "event_type").agg(F.collect_list(F.struct(F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))).alias("p"))
    return e.select("user_id", "event_type", spectra.clean_curve(F.col("p.x"), F.col("p.y"), (3.0, 21.0), (1.0, 400.0)).alias("curve"))


@query(f"WITH {_C} SELECT user_id, event_type, count(*) AS knots, round(min(x), 6) AS x_low, round(max(x), 6) AS x_high, round(sum(y), 4) AS total FROM k GROUP BY 1, 2")
def curve_cleaning(t, spark):
    """ARR-08, ARR-09: points within ranges, medians where x repeats. A list per user and type: bounded by a user's events."""
    c = hourly(t).where(F.size("curve") > 0)
    return c.select("user_id", "event_type", F.size("curve").cast("long").alias("knots"), r(F.col("curve")[0]["x"]).alias("x_low"), r(F.element_at("curve", -1)["x"]).alias("x_high"), r(F.aggregate("curve", F.lit(0.0), lambda s, p: s + p["y"]), 4).alias("total"))


@query(f"""
WITH {_C}, g AS (SELECT user_id, event_type, arg_max(y, x) FILTER (x <= 12) AS yl, max(x) FILTER (x <= 12) AS xl, arg_min(y, x) FILTER (x >= 12) AS yh, min(x) FILTER (x >= 12) AS xh FROM k GROUP BY 1, 2)
SELECT user_id, event_type, round(CASE WHEN xl IS NULL THEN yh WHEN xh IS NULL OR xh = xl THEN yl ELSE yl + (yh - yl) * (12 - xl) / (xh - xl) END, 6) AS y_noon FROM g""")
def interpolate_clamped(t, spark):
    """MTH-13: linear interpolation with the end values beyond a curve's ends."""
    return hourly(t).where(F.size("curve") > 0).select("user_id", "event_type", r(spectra.interpolate_clamped(F.col("curve"), F.lit(12.0))).alias("y_noon"))


def _dotx(x: str, y: str, z: str) -> str:
    """SQL of x . (y x z)."""
    return f"({x}[1] * ({y}[2] * {z}[3] - {y}[3] * {z}[2]) + {x}[2] * ({y}[3] * {z}[1] - {y}[1] * {z}[3]) + {x}[3] * ({y}[1] * {z}[2] - {y}[2] * {z}[1]))"


@query(f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT vec_id, [1 + e[1], e[2], e[3]] AS a, [e[4], 1 + e[5], e[6]] AS b, [e[7], e[8], 1 + e[9]] AS c, e[10:12] AS s, [e[13] - floor(e[13]), e[14] - floor(e[14]), e[15] - floor(e[15])] AS h FROM e),
f AS (SELECT vec_id, {_dotx('s', 'b', 'c')} / {_dotx('a', 'b', 'c')} AS x, {_dotx('s', 'c', 'a')} / {_dotx('a', 'b', 'c')} AS y, {_dotx('s', 'a', 'b')} / {_dotx('a', 'b', 'c')} AS z, list_sort(h) AS h FROM c)
SELECT vec_id, round(x - floor(x), 6) AS x, round(y - floor(y), 6) AS y, round(z - floor(z), 6) AS z, round(greatest(h[2] - h[1], h[3] - h[2], h[1] + 1 - h[3]), 6) AS vacuum FROM f""")
def fractional_sites(t, spark):
    """MTH-12: fractional coordinates in a cell, and the vacuum between layers."""
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = [F.col("e")[k] for k in range(15)]
    lattice = [[1 + v[0], v[1], v[2]], [v[3], 1 + v[4], v[5]], [v[6], v[7], 1 + v[8]]]
    x, y, z = spectra.fractional(lattice, v[9:12])
    gap, _ = spectra.vacuum_gap(F.array(*(c - F.floor(c) for c in v[12:15])))
    return e.select("vec_id", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"), r(gap).alias("vacuum"))
