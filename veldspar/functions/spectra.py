"""Features of three-value spectra and curves (FEA-01..05, 11, 12, ARR-03, MTH-08, MTH-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays

#: Reported instead of a log ratio whose divisor vanishes, and the least divisor that does not.
CAP, LEAST = 6.0, 1e-9
#: The orders of three things.
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def _log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def _power(x: Column, e: float) -> Column:
    return F.when(x > 0, F.pow(x, F.lit(e)))


def _std(a: Column) -> Column:
    m = arrays.mean(a)
    return F.sqrt(arrays.mean(F.transform(a, lambda x: (x - m) * (x - m))))


def conductivity_spectrum(v: Column) -> dict[str, Column]:
    """Sorted channels s1 <= s2 <= s3 and their geometry; null where a logarithm has no positive argument (FEA-03)."""
    s = F.sort_array(v)
    s1, s2, s3 = (s[i] for i in range(3))
    return {
        "mean": arrays.mean(v), "median": s2,
        "dom_geo": F.when((s2 > 0) & (s3 > 0), F.sqrt(s2 * s3)), "geo_all": F.when(s1 > 0, _power(s1 * s2 * s3, 1 / 3)),
        "a_total": F.when(s1 > 0, _log10(s3 / s1)), "d": F.when(s1 > 0, _log10(s2 / s1)), "a_dom": F.when(s2 > 0, _log10(s3 / s2)),
    }


def spectrum_class(d: Column, a: Column, d_median: float, a_median: float) -> Column:
    """C1 one weak channel, C2 three apart, C3 nearly isotropic, C4 the rest and nulls (PRJ-09)."""
    high, split = d > d_median, a > a_median
    return F.when(d.isNull() | a.isNull(), "C4").when(high & ~split, "C1").when(high, "C2").when(~split, "C3").otherwise("C4")


def seebeck_features(v: Column, sign: int) -> dict[str, Column]:
    """Centre, spread and share of the expected sign (FEA-01)."""
    s = F.sort_array(v)
    mean, median = arrays.mean(v), s[1]
    return {
        "s_mean": mean, "s_median": median, "s_std": _std(v), "s_mad": arrays.mad(v), "s_range": s[2] - s[0],
        "s_abs_mean": arrays.mean(F.transform(v, F.abs)), "s_abs_max": F.array_max(F.transform(v, F.abs)),
        "s_relative_spread": _std(v) / (F.abs(mean) + 1e-12), "s_sign_fraction": F.size(F.filter(v, lambda x: x * sign > 0)) / F.lit(3.0),
    }


def capped_spectrum(v: Column) -> dict[str, Column]:
    """log of the dominant pair and log ratios of channels, the cap where the divisor vanishes (FEA-01)."""
    s = F.sort_array(v)
    s1, s2, s3 = (s[i] for i in range(3))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > LEAST, F.log10(a / b)).otherwise(F.lit(CAP))

    return {"log_dom_geo": F.when(s2 > 0, F.log10(F.sqrt(s2 * s3) + 1e-6)).otherwise(F.lit(0.0)), "d": ratio(s2, s1), "a_dom": ratio(s3, s2), "a_total": ratio(s3, s1)}


def invariant_features(v: Column) -> dict[str, Column]:
    """What no order of the channels changes; the anisotropy only of positive spectra (FEA-02)."""
    s = F.sort_array(v)
    return {"mean": arrays.mean(v), "std": _std(v), "low": s[0], "high": s[2], "anisotropy_log": F.when(s[0] > LEAST, F.log10(s[2] / s[0]))}


def mass_spectrum(v: Column) -> dict[str, Column]:
    """Effective-mass spectrum; the dominant pair is the lighter one (FEA-04)."""
    s = F.sort_array(v)
    return {"mean": arrays.mean(v), "median": s[1], "least": s[0], "dom_geo": F.when(s[0] * s[1] >= 0, F.sqrt(F.abs(s[0] * s[1]))), "span": s[2] - s[0], "spectral_ratio": F.when(s[0] > 0, F.log10(s[2] / s[0]))}


def mass_shape(v: Column) -> dict[str, Column]:
    """log1p of the spread and of (density-of-states over conductivity mass) ^ 1.5, of the finite nonzero sizes; null of fewer than two (FEA-05)."""
    a = F.filter(F.transform(arrays.finite_only(v), F.abs), lambda x: x > 0)
    n = F.size(a)
    dos = F.exp(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.ln(x)) / n)
    conductivity = n / F.aggregate(a, F.lit(0.0), lambda s, x: s + 1 / x)
    return {"ratio": F.when(n >= 2, F.log1p(F.array_max(a) / F.array_min(a))), "complexity": F.when(n >= 2, F.log1p(F.pow(dos / conductivity, F.lit(1.5))))}


def paired_over_orders(a: Column, b: Column) -> dict[str, Column]:
    """Least, mean and largest of the mean product of two spectra over all pairings of their channels (ARR-03)."""
    values = F.array(*(sum((a[i] * b[j] for i, j in enumerate(o)), F.lit(0.0)) / 3 for o in ORDERS))
    return {"low": F.array_min(values), "mean": arrays.mean(values), "high": F.array_max(values)}


def sign_agreement(v: Column) -> dict[str, Column]:
    """Sign of most values, its share, and whether mean and median agree on it (MTH-08)."""
    up, down, n = F.size(F.filter(v, lambda x: x > 0)), F.size(F.filter(v, lambda x: x < 0)), F.size(v)
    sign = F.when(up > down, 1).when(down > up, -1).otherwise(0)
    return {"majority": sign, "share": F.greatest(up, down) / n, "agree": F.signum(arrays.mean(v)) == F.signum(arrays.median(v))}


def band_features(gap: Column, gap_high: Column, mass: Column, other_mass: Column, eps: Column) -> dict[str, Column]:
    """Gap correction, masses and dielectric geometry on log scales; null from missing or nonpositive values (FEA-11)."""
    good = F.filter(arrays.finite_only(eps), lambda x: x > 0)
    geo = F.aggregate(good, F.lit(0.0), lambda s, x: s + F.log10(x)) / F.size(good)
    return {
        "gap_correction": gap_high - gap, "log_mass": _log10(mass), "log_other_mass": _log10(other_mass), "log_mass_ratio": _log10(mass) - _log10(other_mass),
        "log_dielectric_geo": F.when(F.size(good) > 0, geo), "log_dielectric_anisotropy": F.when(F.size(good) >= 2, F.log10(F.array_max(good) / F.array_min(good))),
    }


def transport_fingerprint(seebeck: Column, sigma: Column, kappa: Column, sign: int) -> dict[str, Column]:
    """Size and sign of the thermopower, logs of the conductivities and of their ratio (FEA-12)."""
    return {"abs_seebeck": F.abs(seebeck), "sign_expected": (F.signum(seebeck) == sign).cast("double"), "log_sigma": _log10(sigma), "log_kappa": _log10(kappa), "log_kappa_over_sigma": _log10(kappa) - _log10(sigma)}


def clean_curve(x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float]) -> Column:
    """array<struct<x, y>> by ascending x: points within both ranges, the median of y where x repeats; null if the lengths differ (ARR-08, ARR-09)."""
    points = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].between(*x_range) & p["y"].between(*y_range) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    knots = F.array_sort(F.array_distinct(F.transform(points, lambda p: p["x"])))
    merged = F.transform(knots, lambda k: F.struct(k.alias("x"), arrays.median(F.transform(F.filter(points, lambda p: p["x"] == k), lambda p: p["y"])).alias("y")))
    return F.when(F.size(x) == F.size(y), merged)


def interpolate_clamped(curve: Column, at: Column) -> Column:
    """Value at ``at`` of a curve by ascending x: linear between knots, the end values beyond them; null if it is empty (MTH-13)."""
    below, above = F.filter(curve, lambda p: p["x"] <= at), F.filter(curve, lambda p: p["x"] >= at)
    lo, hi = F.element_at(below, -1), above[0]
    inside = lo["y"] + (hi["y"] - lo["y"]) * F.coalesce(F.try_divide(at - lo["x"], hi["x"] - lo["x"]), F.lit(0.0))
    return F.when(F.size(curve) > 0, F.when(F.size(below) == 0, curve[0]["y"]).when(F.size(above) == 0, F.element_at(curve, -1)["y"]).otherwise(inside))


def fractional(lattice: list[list[Column]], site: list[Column]) -> list[Column]:
    """Coordinates of a site in the cell of three row vectors, each brought into [0, 1) (MTH-12)."""
    def cross(x, y):
        return [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]

    def dot(x, y):
        return x[0] * y[0] + x[1] * y[1] + x[2] * y[2]

    a, b, c = lattice
    volume = dot(a, cross(b, c))
    parts = (dot(site, cross(b, c)) / volume, dot(site, cross(c, a)) / volume, dot(site, cross(a, b)) / volume)
    return [x - F.floor(x) for x in parts]


def vacuum_gap(heights: Column) -> tuple[Column, Column]:
    """The widest empty stretch between fractional heights, around the cell, and the heights with it centred on the cell's edge (MTH-12)."""
    s = F.sort_array(heights)
    n = F.size(s)
    gaps = F.transform(s, lambda x, i: F.struct(F.round(F.when(i + 1 < n, F.get(s, i + 1)).otherwise(s[0] + 1) - x, 9).alias("gap"), (-i).alias("first"), x.alias("from_")))
    best = F.array_max(gaps)
    middle = best["from_"] + best["gap"] / 2
    return best["gap"], F.sort_array(F.transform(s, lambda x: (x - middle) - F.floor(x - middle)))
