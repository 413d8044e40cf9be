"""Queries of compositions: formulas are made of each part's numbers, element properties come from the suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.cols import entropy
from ..operators import composition
from ..operators.composition import SYMBOLS, SYSTEMS, place
from .core import query, r

PROPS = ("z", "row", "group", "measure")

_SYMBOLS = "[" + ", ".join(f"'{s}'" for s in SYMBOLS) + "]"
_ROWS = "[" + ", ".join(str(place(z)[0]) for z in range(1, 119)) + "]"
_GROUPS = "[" + ", ".join(str(place(z)[1]) for z in range(1, 119)) + "]"
_COMP = f"""el AS (SELECT k AS z, ({_SYMBOLS})[k] AS symbol, ({_ROWS})[k] AS "row", ({_GROUPS})[k] AS "group", s_acctbal AS measure FROM range(1, 119) t(k) LEFT JOIN supplier ON s_suppkey = k),
raw AS (SELECT p_partkey, unnest([1 + p_partkey % 118, 1 + (p_size * 7) % 118, 1 + length(p_type) % 20]) AS z, unnest([1 + p_partkey % 4, 1 + p_size % 3, 1]) AS n FROM part),
comp AS (SELECT p_partkey, z, sum(n)::DOUBLE AS n, sum(n) / sum(sum(n)) OVER (PARTITION BY p_partkey) AS f FROM raw GROUP BY 1, 2)"""


def amounts(t):
    """p_partkey, formula, amounts of three elements a part's numbers pick."""
    table = F.array(*(F.lit(s) for s in SYMBOLS))

    def term(z, n):
        return F.concat(F.element_at(table, (z % 118 + 1).cast("int")), n.cast("string"))

    f = F.concat(term(F.col("p_partkey"), 1 + F.col("p_partkey") % 4), term(F.col("p_size") * 7, 1 + F.col("p_size") % 3), term(F.length("p_type") % 20, F.lit(1)))
    p = t("part").select("p_partkey", f.alias("formula"))
    return p.select("p_partkey", "formula", text.element_amounts(F.col("formula")).alias("amounts"))


def elements(t, spark):
    measure = t("supplier").select(F.col("s_suppkey").cast("int").alias("z"), F.col("s_acctbal").alias("measure"))
    return composition.element_table(spark).join(measure, "z", "left")


def _stats(weight: str) -> str:
    out = []
    for p in PROPS:
        w, x = f"sum({weight}) FILTER (e.\"{p}\" IS NOT NULL)", f'e."{p}"'
        mean = f"sum({weight} * {x}) / {w}"
        out.append(
            f"round(coalesce({mean}, 0), 5) AS {p}_mean, round(coalesce(sqrt(greatest(sum({weight} * {x} * {x}) / {w} - ({mean}) ** 2, 0)), 0), 3) AS {p}_std, coalesce(min({x}), 0)::DOUBLE AS {p}_min, "
            f"coalesce(max({x}), 0)::DOUBLE AS {p}_max, round(coalesce(max({x}) - min({x}), 0), 6) AS {p}_range, round(coalesce(sum({weight}) FILTER ({x} IS NULL), 0) / sum({weight}), 6) AS {p}_missing"
        )
    return ", ".join(out)


def rounded(df, key="p_partkey"):
    digits = {"mean": 5, "std": 3}
    return df.select(key, *(r(F.col(c), digits.get(c.rsplit("_", 1)[1], 6)).alias(c) for c in df.columns if c != key))


@query(f"WITH {_COMP} SELECT p_partkey, {_stats('c.f')} FROM comp c JOIN el e USING (z) GROUP BY 1")
def composition_stats(t, spark):
    """FEA-07: fraction-weighted statistics of element properties, missing ones told by their share."""
    return rounded(composition.property_stats(composition.atoms(amounts(t), "p_partkey", "amounts"), elements(t, spark), "p_partkey", PROPS))


@query(f"WITH {_COMP} SELECT p_partkey, {_stats('c.n')} FROM comp c JOIN el e USING (z) GROUP BY 1")
def atom_stats(t, spark):
    """FEA-06: the same over atoms, each counting once."""
    return rounded(composition.property_stats(composition.atoms(amounts(t), "p_partkey", "amounts"), elements(t, spark), "p_partkey", PROPS, "amount"))


@query(f"""
WITH {_COMP}, v AS (SELECT g.p_partkey, g.k, coalesce(c.f, 0) AS f FROM (SELECT p_partkey, k FROM part, range(1, 119) t(k)) g LEFT JOIN comp c ON c.p_partkey = g.p_partkey AND c.z = g.k)
SELECT p_partkey, count(*) AS width, round(sum(f), 9) AS total, round(sum(f * k), 6) AS moment, count(*) FILTER (f > 0) AS n_nonzero FROM v GROUP BY 1""")
def fraction_vectors(t, spark):
    """ARR-06, FEA-07: fractions over all 118 elements, told by width, sum, first moment and nonzero entries."""
    v = amounts(t).select("p_partkey", composition.fraction_vector(F.col("amounts")).alias("v"))
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("p_partkey", F.size("v").cast("long").alias("width"), r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), r(moment).alias("moment"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_nonzero"))


@query(f"""
WITH {_COMP}, m AS (SELECT p_partkey, count(*)::DOUBLE AS n_elements, -sum(f * ln(f)) AS entropy, max(f) AS largest, sum(f * c.z) AS mz, sum(f * c.z * c.z) AS mzz, sum(f * "group") AS mg, max("row") - min("row") AS rr FROM comp c JOIN el USING (z) GROUP BY 1)
SELECT p_partkey, n_elements, round(entropy, 6) AS entropy, round(largest, 6) AS largest, round(mz, 6) AS mean_z, round(sqrt(greatest(mzz - mz * mz, 0)), 3) AS std_z, round(ln(1 + mz), 6) AS log_mean_z, round(sqrt(greatest(mzz - mz * mz, 0)) / greatest(mz, 1e-12), 4) AS variation, round(mg, 6) AS mean_group, rr::DOUBLE AS row_range FROM m""")
def composition_scalars(t, spark):
    """FEA-08, MTH-09, MTH-10: scalars of a composition."""
    comp = composition.atoms(amounts(t), "p_partkey", "amounts")
    s = composition.property_stats(comp, composition.element_table(spark), "p_partkey", ("z", "row", "group"))
    j = composition.mixing_stats(comp, "p_partkey").join(s, "p_partkey")
    return j.select("p_partkey", "n_elements", r(F.col("entropy")).alias("entropy"), r(F.col("largest")).alias("largest"), r(F.col("z_mean")).alias("mean_z"), r(F.col("z_std"), 3).alias("std_z"), r(F.log1p("z_mean")).alias("log_mean_z"), r(F.col("z_std") / F.greatest(F.col("z_mean"), F.lit(1e-12)), 4).alias("variation"), r(F.col("group_mean")).alias("mean_group"), F.col("row_range"))


_SYSTEM = "CASE " + " ".join(f"WHEN n <= {last} THEN '{name}'" for name, last in SYSTEMS) + " ELSE 'unknown' END"


@query(f"""
WITH s AS (SELECT p_partkey, {_SYSTEM} AS system FROM (SELECT p_partkey, 1 + (p_partkey * 13) % 240 AS n FROM part))
SELECT p_partkey, system, {", ".join(f"(system = '{n}')::INT::DOUBLE AS crystal_{n}" for n, _ in SYSTEMS)} FROM s""")
def crystal_systems(t, spark):
    """FEA-10: crystal system of a space-group number, and its one-hot columns."""
    s = t("part").select("p_partkey", composition.crystal_system(1 + (F.col("p_partkey") * 13) % 240).alias("system"))
    return s.select("p_partkey", "system", *((F.col("system") == n).cast("double").alias(f"crystal_{n}") for n, _ in SYSTEMS))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT vec_id, e[1:3] AS a, e[4:6] AS b, e[7:9] AS c, [90 + 10 * e[10], 90 + 10 * e[11], 90 + 10 * e[12]] AS g FROM e),
x AS (SELECT *, [a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]] AS k, sqrt(list_dot_product(a, a)) AS la, sqrt(list_dot_product(b, b)) AS lb, sqrt(list_dot_product(c, c)) AS lc FROM c),
y AS (SELECT *, abs(list_dot_product(k, c)) AS v, sqrt(list_dot_product(k, k)) AS area FROM x)
SELECT vec_id, round(v / 4 * 1e6, 4) AS volume_per_atom, round(ln(greatest(la, lb, lc) / greatest(least(la, lb, lc), 1e-12)), 6) AS log_anisotropy, round((abs(g[1] - 90) + abs(g[2] - 90) + abs(g[3] - 90)) / 3 / 90, 6) AS angle_distortion,
  round(area * 1e6, 4) AS area, round(lc, 6) AS height, round(CASE WHEN area > 1e-12 THEN lc / sqrt(area) END, 5) AS aspect, round(CASE WHEN v > 1e-12 THEN log10(60 * 1.66054 / v) END, 6) AS log_density FROM y""")
def cell_geometry(t, spark):
    """FEA-09, MTH-11: geometry of a cell from its three vectors and angles."""
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    def v(k):
        return [F.col("e")[k + i] for i in range(3)]

    g = composition.cell_geometry(v(0), v(3), v(6), F.array(*(90 + 10 * F.col("e")[k] for k in (9, 10, 11))), F.lit(4.0), F.lit(60.0))
    return e.select("vec_id", r(g["volume_per_atom"] * 1e6, 4).alias("volume_per_atom"), r(g["log_anisotropy"]).alias("log_anisotropy"), r(g["angle_distortion"]).alias("angle_distortion"), r(g["area"] * 1e6, 4).alias("area"), r(g["height"]).alias("height"), r(g["aspect"], 5).alias("aspect"), r(F.log10(g["density"])).alias("log_density"))


@query(f"""
WITH {_COMP}, f AS (SELECT p_partkey, sum(n * c.z) / sum(n) AS z_mean, sum(n * "row") / sum(n) AS row_mean, max("group") - min("group") AS group_range, sum(n * measure) / sum(n) FILTER (measure IS NOT NULL) AS measure_mean, max(measure) AS measure_max, sum(n) AS nsites FROM comp c JOIN el e USING (z) GROUP BY 1)
SELECT p_partkey, array_to_string(list_transform([round(z_mean, 5), round(row_mean, 5), group_range, round(coalesce(measure_mean, 0), 5), coalesce(measure_max, 0), nsites, p_retailprice], lambda x: printf('%.5f', x::DOUBLE)), ' ') AS v
FROM f JOIN part USING (p_partkey)""")
def cheap_features(t, spark):
    """FEA-15: a vector of features that need no computed property, in a fixed order (as text)."""
    comp = composition.atoms(amounts(t), "p_partkey", "amounts")
    s = composition.property_stats(comp, elements(t, spark), "p_partkey", PROPS, "amount")
    n = comp.groupBy("p_partkey").agg(F.sum("amount").alias("nsites"))
    j = s.join(n, "p_partkey").join(t("part").select("p_partkey", "p_retailprice"), "p_partkey")
    parts = (r(F.col("z_mean"), 5), r(F.col("row_mean"), 5), F.col("group_range"), r(F.col("measure_mean"), 5), F.col("measure_max"), F.col("nsites"), F.col("p_retailprice"))
    return j.select("p_partkey", F.concat_ws(" ", *(F.format_string("%.5f", c.cast("double")) for c in parts)).alias("v"))


@query(f"""
WITH {_COMP} SELECT symbol, count(*) AS n_parts, round(avg(f), 6) AS mean_fraction FROM comp JOIN el USING (z) GROUP BY 1""")
def element_fractions(t, spark):
    """AGG-31, ARR-05: how often and how much of each element."""
    return composition.atoms(amounts(t), "p_partkey", "amounts").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_parts"), r(F.avg("fraction")).alias("mean_fraction"))


@query(f"""
WITH {_COMP}, whole AS (SELECT p_partkey, z, n, f, symbol FROM comp JOIN el USING (z)), g AS (SELECT p_partkey, list_reduce(list(n::BIGINT), lambda x, y: gcd(x, y)) AS g FROM whole GROUP BY 1)
SELECT p_partkey, string_agg(symbol, '-' ORDER BY symbol) AS system, string_agg(symbol || CASE WHEN n::BIGINT // g = 1 THEN '' ELSE (n::BIGINT // g)::VARCHAR END, '' ORDER BY symbol) AS reduced, round(abs(-sum(f * ln(f))), 6) AS entropy
FROM whole JOIN g USING (p_partkey) GROUP BY 1""")
def formula_features(t, spark):
    """STR-10..12, MTH-09, MAP-01: amounts, system, reduced key and entropy of the parts' formulas."""
    a = F.col("amounts")
    e = entropy(F.map_values(text.fractions(a)))
    return amounts(t).select("p_partkey", text.chemical_system(a).alias("system"), text.reduced_formula(a).alias("reduced"), F.abs(r(e)).alias("entropy"))
