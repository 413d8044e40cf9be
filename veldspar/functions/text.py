"""Text parsers (STR)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import median

NUMBER = r"\d+(?:\.\d+)?"
# Micrometres in a unit, and the range in which lengths count.
NANO, MICRO, MILLI = 1e-3, 1.0, 1e3
SHORTEST_UM, LONGEST_UM = 0.003, 500.0
#: What a unit's token begins with, and its size.
UNITS = (("n", NANO), ("mm", MILLI))
#: Tokens of a text with lengths: numbers, units, what joins two numbers of a range, and anything else.
LENGTH_TOKEN = rf"{NUMBER}|\*\s*10\^?\(?-6\)?\s*m|nanometers?|nm|micrometers?|microns?|[uµμ]m|mm|to|[-~]|\S"


def alnum_key(c: Column) -> Column:
    """Lower case, letters and digits only (STR-06)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def numbers(c: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    """All numbers within a range (STR-07)."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1), lambda x: x.cast("double"))
    return F.filter(found, lambda x: (x >= low) & (x <= high))


def numbers_median(c: Column, low: float, high: float) -> Column:
    return median(numbers(c, low, high))


def length_um(c: Column, comment: Column | None = None, low: float = SHORTEST_UM, high: float = LONGEST_UM) -> Column:
    """Median of the lengths in a text, in micrometres (STR-08).

    The text is read token by token.  The last two numbers wait for a unit, which turns them into one
    length: a single number as it is, two by their mean.  Words and marks between forget the numbers.
    Lengths beyond the limits do not count.  A comment that is not blank is read in place of the text.
    """
    told = c if comment is None else F.coalesce(F.when(F.length(F.trim(comment)) > 0, comment), c)
    tokens = F.regexp_extract_all(F.lower(told), F.lit(f"({LENGTH_TOKEN})"), 1)
    nothing = F.lit(None).cast("double")
    start = F.struct(F.array().cast("array<double>").alias("lengths"), nothing.alias("first"), nothing.alias("last"))

    def state(lengths: Column, first: Column, last: Column) -> Column:
        return F.struct(lengths.alias("lengths"), first.alias("first"), last.alias("last"))

    def step(s: Column, token: Column) -> Column:
        size = F.lit(MICRO)
        for begin, value in UNITS:
            size = F.when(token.startswith(begin), F.lit(value)).otherwise(size)
        one = (F.coalesce(s["first"], s["last"]) + s["last"]) / 2 * size
        done = F.when(s["last"].isNotNull(), F.concat(s["lengths"], F.array(one))).otherwise(s["lengths"])
        return (
            F.when(token.rlike(rf"^{NUMBER}$"), state(s["lengths"], s["last"], token.cast("double")))
            .when(token.rlike("^(to|[-~])$"), s)
            .when(token.rlike("m$|meters?$|microns?$") & (F.length(token) > 1), state(done, nothing, nothing))
            .otherwise(state(s["lengths"], nothing, nothing))
        )

    return median(F.filter(F.aggregate(tokens, start, step, lambda s: s["lengths"]), lambda x: x.between(low, high)))


def canonical(c: Column, synonyms: dict[str, str], nulls: tuple[str, ...] = ("-", "unknown")) -> Column:
    """Synonym of the normalised text, else the trimmed text; null marks become null (STR-09)."""
    key = F.lower(F.trim(c))
    table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)) if synonyms else None
    out = F.coalesce(table[key], F.trim(c)) if synonyms else F.trim(c)
    return F.when(~key.isin(*nulls), out)


def tag_values(c: Column, tag: str) -> Column:
    """Contents of every ``<tag>...</tag>``, quotes stripped (SRC-11)."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))


def element_amounts(formula: Column) -> Column:
    """map<element, amount> of a flat formula; null if it is not one (STR-10)."""
    ok = formula.rlike(r"^([A-Z][a-z]?(\d+(\.\d+)?)?)+$")
    parts = F.arrays_zip(F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?"), 1).alias("e"), F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?"), 2).alias("n"))
    one = F.transform(parts, lambda x: F.struct(x["e"].alias("e"), F.coalesce(F.nullif(x["n"], F.lit("")).cast("double"), F.lit(1.0)).alias("n")))
    names = F.array_sort(F.array_distinct(F.transform(one, lambda x: x["e"])))
    sums = F.transform(names, lambda e: F.aggregate(F.filter(one, lambda x: x["e"] == e), F.lit(0.0), lambda s, x: s + x["n"]))
    return F.when(ok, F.map_from_arrays(names, sums))


def fractions(amounts: Column) -> Column:
    """Amounts over their sum (MAP-01)."""
    n = F.aggregate(F.map_values(amounts), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(amounts, lambda _, v: v / n)


def chemical_system(amounts: Column) -> Column:
    """Sorted elements joined by ``-`` (STR-12)."""
    return F.array_join(F.array_sort(F.map_keys(amounts)), "-")


def reduced_formula(amounts: Column) -> Column:
    """Elements in order with amounts divided by their greatest common divisor; null unless whole (STR-11)."""
    values = F.map_values(amounts)
    whole = F.forall(values, lambda v: v == F.round(v))
    def gcd(a: Column, b: Column) -> Column:
        # Divisors of an atom count are small: the largest up to the smaller number that divides both.
        return F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.when(a > 0, a).otherwise(b), b)).cast("int")), lambda d: (b % d == 0) & (a % d == 0)))
    g = F.aggregate(values, F.lit(0), lambda s, v: gcd(s, v.cast("int")).cast("int"))
    def term(e: Column) -> Column:
        n = (amounts[e] / g).cast("int")
        return F.concat(e, F.when(n > 1, n.cast("string")).otherwise(F.lit("")))
    return F.when(whole, F.array_join(F.transform(F.array_sort(F.map_keys(amounts)), term), ""))


def subscript(c: Column) -> Column:
    """Digits as subscripts of a label (STR-14)."""
    return F.regexp_replace(c, r"(\d+)", r"\$_{$1}\$")


def counted_formula(species: Column) -> Column:
    """Formula of a list of atoms: names in order, with their counts above one (STR-13)."""
    names = F.array_sort(F.array_distinct(species))

    def term(e: Column) -> Column:
        n = F.size(F.filter(species, lambda x: x == e))
        return F.concat(e, F.when(n > 1, n.cast("string")).otherwise(F.lit("")))

    return F.array_join(F.transform(names, term), "")


def number_kind(c: Column) -> Column:
    """real, complex or none: what a text holds as a number (STR-15)."""
    number = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
    return F.when(F.trim(c).rlike(rf"^\(?({number})?[+-](\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ij]\)?$"), "complex").when(F.trim(c).rlike(rf"^{number}$"), "real").when(c.isNotNull(), "none")


def repr_key(*cs: Column) -> Column:
    """A text that tells apart what differs in value or in kind, for distinct counts over mixed or nested values (STR-16)."""
    return F.to_json(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(cs))))
