"""Element tables and composition features (FEA-06..08, 10, 15, ARR-06, ARR-12, AGG-31)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import finite

# Symbols of the elements by atomic number, and the lengths of the periods.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
PERIODS = (2, 8, 8, 18, 18, 32, 32)

# The last space group of each crystal system.
SYSTEMS = (("triclinic", 2), ("monoclinic", 15), ("orthorhombic", 74), ("tetragonal", 142), ("trigonal", 167), ("hexagonal", 194), ("cubic", 230))


def place(z: int) -> tuple[int, int]:
    """Row and group of an element; the f block counts to group 3."""
    row, before = 0, 0
    while z > before + PERIODS[row]:
        before += PERIODS[row]
        row += 1
    at, length = z - before, PERIODS[row]
    # From the right end of the row the groups count down; what is wider than 18 is the f block.
    group = at if at <= 2 and not (row == 0 and at == 2) else max(3, 18 - (length - at))
    return row + 1, group


def element_table(spark: SparkSession) -> DataFrame:
    """symbol, z, row, group of the 118 elements; other properties are joined by the caller."""
    return spark.createDataFrame([(s, z, *place(z)) for z, s in enumerate(SYMBOLS, 1)], "symbol string, z int, row int, group int")


def atoms(df: DataFrame, key: str, amounts: str) -> DataFrame:
    """key, symbol, amount, fraction: a row per element of a map of amounts; empty and nonpositive ones are left out."""
    total = F.aggregate(F.map_values(amounts), F.lit(0.0), lambda s, x: s + x)
    e = df.withColumn("_total", total).where("_total > 0").select(key, "_total", F.explode(amounts).alias("symbol", "amount"))
    return e.where("amount > 0").select(key, "symbol", "amount", (F.col("amount") / F.col("_total")).alias("fraction"))


def property_stats(comp: DataFrame, elements: DataFrame, key: str, props: Sequence[str], weight: str = "fraction") -> DataFrame:
    """key and, by property, weighted mean and deviation, least, largest, range, and the weight of elements without it (FEA-06, FEA-07).

    The element table has 118 rows and is broadcast; sums are added up before the shuffle.  A
    property that no element of a row has gives 0 and a missing share of 1.
    """
    j = comp.join(F.broadcast(elements), "symbol", "left")
    aggs = [F.sum(weight).alias("_w")]
    for p in props:
        x = finite(F.col(p))
        w = F.when(x.isNotNull(), F.col(weight))
        aggs += [F.sum(w).alias(f"{p}_w"), F.sum(w * x).alias(f"{p}_x"), F.sum(w * x * x).alias(f"{p}_xx"), F.min(x).alias(f"{p}_low"), F.max(x).alias(f"{p}_high")]
    g = j.groupBy(key).agg(*aggs)
    out: list[Column] = [F.col(key)]
    for p in props:
        w, mean = F.col(f"{p}_w"), F.col(f"{p}_x") / F.col(f"{p}_w")
        stats = {"mean": mean, "std": F.sqrt(F.greatest(F.col(f"{p}_xx") / w - mean * mean, F.lit(0.0))), "min": F.col(f"{p}_low"), "max": F.col(f"{p}_high"), "range": F.col(f"{p}_high") - F.col(f"{p}_low")}
        out += [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{p}_{n}") for n, c in stats.items()]
        out.append(F.coalesce((F.col("_w") - F.coalesce(w, F.lit(0.0))) / F.col("_w"), F.lit(1.0)).alias(f"{p}_missing"))
    return g.select(*out)


def mixing_stats(comp: DataFrame, key: str) -> DataFrame:
    """key, n_elements, entropy, largest fraction."""
    f = F.col("fraction")
    return comp.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n_elements"), (-F.sum(f * F.ln(f))).alias("entropy"), F.max(f).alias("largest"))


def fraction_vector(amounts: Column, basis: Sequence[str] = SYMBOLS) -> Column:
    """Fractions over a fixed basis of elements, 0 where there is none (ARR-06)."""
    total = F.aggregate(F.map_values(amounts), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(*(F.lit(s) for s in basis)), lambda s: F.coalesce(F.try_element_at(amounts, s), F.lit(0.0)) / total)


def crystal_system(number: Column) -> Column:
    """Crystal system of a space-group number, ``unknown`` outside 1..230 (FEA-10)."""
    out = F.when(F.coalesce(number, F.lit(0)) < 1, "unknown")
    for name, last in SYSTEMS:
        out = out.when(number <= last, name)
    return out.otherwise("unknown")


def cell_geometry(a: Column, b: Column, c: Column, angles: Column, n_atoms: Column, mass: Column) -> dict[str, Column]:
    """Volume per atom, anisotropy, angle distortion, in-plane area, height and aspect, density of a cell of three vectors (FEA-09)."""
    def dot(x, y):
        return sum((x[i] * y[i] for i in range(1, 3)), x[0] * y[0])

    def cross(x, y):
        return [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]

    axb = cross(a, b)
    volume = F.abs(dot(axb, c))
    lengths = [F.sqrt(dot(v, v)) for v in (a, b, c)]
    area = F.sqrt(dot(axb, axb))
    return {
        "volume_per_atom": volume / n_atoms, "log_anisotropy": F.ln(F.greatest(*lengths) / F.greatest(F.least(*lengths), F.lit(1e-12))),
        "angle_distortion": F.aggregate(angles, F.lit(0.0), lambda s, x: s + F.abs(x - 90)) / F.size(angles) / 90,
        "area": area, "height": lengths[2], "aspect": F.when(area > 1e-12, lengths[2] / F.sqrt(area)), "density": F.when(volume > 1e-12, mass * 1.66054 / volume),
    }
