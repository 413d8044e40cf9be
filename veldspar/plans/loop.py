"""Queries of a search round over parts: seeds, substitutions, hypotheses, validation, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import loop, stats
from .core import query, r

#: Families of words that stand for elements; the second one overwrites what the first said of MEDIUM.
FAMILIES = (("STANDARD", "ECONOMY", "MEDIUM"), ("PROMO", "LARGE", "MEDIUM"), ("RING", "BOLT", "WIDGET", "GEAR"))
_TYPE = "p_type || ' ' || upper(p_name)"
_FAMILY = "(VALUES " + ", ".join(f"('{e}', {f!r})" for e, f in loop.family_of(FAMILIES).items()) + ") fam(e, f)"
_SUBST = f"""w AS (SELECT p_partkey, string_split({_TYPE}, ' ') AS s FROM part), x AS (SELECT p_partkey, s, unnest(range(len(s))) AS site FROM w), y AS (SELECT p_partkey, s, site, s[site + 1] AS old, unnest(f) AS new FROM x JOIN {_FAMILY} ON e = s[site + 1]),
sub AS (SELECT p_partkey, site, list_transform(s, lambda v, i: CASE WHEN i = site + 1 THEN new ELSE v END) AS s FROM y WHERE new <> old)"""


def kind():
    return F.concat_ws(" ", "p_type", F.upper("p_name"))


def species(t):
    return t("part").select("p_partkey", F.split(kind(), " ").alias("s"))


@query(f"WITH {_SUBST} SELECT p_partkey, site, array_to_string(s, ' ') AS species FROM sub")
def substitution_expansion(t, spark):
    """ARR-10: every list with one site replaced within its family."""
    return loop.substitutions(species(t), "p_partkey", "s", FAMILIES).select("p_partkey", "site", F.array_join("species", " ").alias("species"))


@query("""
WITH e AS (SELECT n_name AS e FROM nation), c AS (SELECT 1 AS k, e AS a, NULL AS b, NULL AS c FROM e UNION ALL SELECT 2, x.e, y.e, NULL FROM e x JOIN e y ON x.e < y.e UNION ALL SELECT 3, x.e, y.e, z.e FROM e x JOIN e y ON x.e < y.e JOIN e z ON y.e < z.e)
SELECT place, elements FROM (SELECT row_number() OVER (ORDER BY k, a, b, c) - 1 AS place, concat_ws(' ', a, b, c) AS elements FROM c) WHERE place < 1500""")
def capped_combinations(t, spark):
    """ARR-11: combinations of up to three of the nations (a table of fixed size), the first 1,500."""
    names = [x.n_name for x in t("nation").select("n_name").orderBy("n_name").collect()]
    return loop.combinations(spark, names, 3, 1500).select("place", F.array_join("elements", " ").alias("elements"))


_R = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
_LINE_RANKS = f"""k AS (SELECT {_R.format('l_quantity')} AS q, {_R.format('l_discount')} AS d, {_R.format('l_tax')} AS x, {_R.format('l_extendedprice')} AS y FROM lineitem)"""
RECORDS = (
    {"id": "H1", "variable": "l_quantity", "target": "price", "direction": 1},
    {"id": "H2", "variable": "l_discount", "target": "price", "direction": -1},
    {"id": "H3", "variable": "l_tax", "target": "price", "direction": 1},
    {"id": "H4", "variable": "l_weight", "target": "price", "direction": 1},
)
_HYPOTHESES = f"""{_LINE_RANKS}, e AS (SELECT 'l_quantity' AS variable, corr(q, y) AS rho FROM k UNION ALL SELECT 'l_discount', corr(d, y) FROM k UNION ALL SELECT 'l_tax', corr(x, y) FROM k),
h AS (SELECT id, v.variable, direction, rho AS evidence, coalesce(sign(rho) = direction, false) AS holds FROM (VALUES ('H1', 'l_quantity', 1), ('H2', 'l_discount', -1), ('H3', 'l_tax', 1), ('H4', 'l_weight', 1)) v(id, variable, direction) LEFT JOIN e ON e.variable = v.variable)"""


def panel(t):
    return stats.spearman_panel(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("target", F.lit("price"))


@query(f"WITH {_HYPOTHESES} SELECT id, variable, direction, round(evidence, 6) AS evidence, holds FROM h")
def hypothesis_records(t, spark):
    """LOP-03: stated mechanisms with their evidence from the correlation panel; what has none does not hold."""
    return loop.hypotheses(panel(t), RECORDS).select("id", "variable", "direction", r(F.col("evidence")).alias("evidence"), "holds")


@query(f"""
WITH {_HYPOTHESES}, l AS (SELECT 'l_quantity' AS a, 'l_discount' AS b, corr(q, d) AS rho FROM k UNION ALL SELECT 'l_quantity', 'l_tax', corr(q, x) FROM k), b AS (SELECT a, b, rho FROM l UNION ALL SELECT b, a, rho FROM l)
SELECT o.id, CASE WHEN abs(p.evidence) > abs(o.evidence) THEN 'high' ELSE 'medium' END AS severity, 'statistical' AS kind, b.b AS rival FROM h o JOIN b ON b.a = o.variable AND abs(b.rho) >= 0.0005 JOIN h p ON p.variable = b.b
UNION ALL SELECT id, 'high', 'methodology', NULL FROM h WHERE evidence IS NULL OR NOT holds""")
def confounding_issues(t, spark):
    """LOP-04: rival explanations of each mechanism, and mechanisms without evidence."""
    p = panel(t)
    l = stats.spearman_panel(t("lineitem"), ["l_discount", "l_tax"], "l_quantity").select(F.lit("l_quantity").alias("a"), F.col("feature").alias("b"), "rho")
    return loop.confounders(loop.hypotheses(p, RECORDS), l, 0.0005)


_SCORED = f"""{_SUBST}, seeds AS (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20),
c AS (SELECT array_to_string(s, ' ') AS formula, max(round(0.7 * p_retailprice / 1000 + 0.3 * length(array_to_string(s, ' ')) / 50, 6)) AS merit FROM sub JOIN seeds USING (p_partkey) GROUP BY 1),
new AS (SELECT * FROM c WHERE formula NOT IN (SELECT {_TYPE} FROM part WHERE p_size > 40)), top AS (SELECT * FROM new ORDER BY merit DESC, formula LIMIT 15)"""


def scored(t):
    """formula, merit of the 15 best new substitutions of the 20 dearest parts."""
    seeds = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice", F.split(kind(), " ").alias("s"))
    out = loop.substitutions(seeds, "p_partkey", "s", FAMILIES).join(seeds.select("p_partkey", "p_retailprice"), "p_partkey").withColumn("formula", F.array_join("species", " "))
    merit = F.round(0.7 * F.col("p_retailprice") / 1000 + 0.3 * F.length("formula") / 50, 6)
    best = out.groupBy("formula").agg(F.max(merit).alias("merit"))
    new = best.join(t("part").where("p_size > 40").select(kind().alias("formula")).distinct(), "formula", "left_anti")
    return new.orderBy(F.desc("merit"), "formula").limit(15)


@query(f"""
WITH {_SCORED} SELECT formula, merit, length(formula) AS n_chars, printf('submit %s --skill relax --host a', formula) AS first_step, 2 AS n_steps FROM top""")
def validated_candidates(t, spark):
    """LOP-05, LOP-06, STR-18: new candidates, their merit computed anew, and a plan line for each step."""
    c = scored(t)
    v = loop.validate(c, "formula", F.round(F.col("merit") + 0 * F.length("formula"), 6), 1e-9, [("relax", "a"), ("band", "b")])
    return v.where("agrees").select("formula", "merit", F.length("formula").cast("long").alias("n_chars"), F.col("plan")[0].alias("first_step"), F.size("plan").alias("n_steps"))


@query(f"""
WITH {_SCORED}, ledger AS (SELECT {_TYPE} AS formula, round(max(p_retailprice) / 1000, 6) AS merit, 0 AS round, false AS winner FROM part WHERE p_size > 40 GROUP BY 1), won AS (SELECT *, row_number() OVER (ORDER BY merit DESC, formula) <= 5 AS winner FROM top)
SELECT round, winner, count(*) AS n, round(max(merit), 6) AS best FROM (SELECT formula, merit, round, winner FROM ledger UNION ALL SELECT formula, merit, 1, winner FROM won) GROUP BY 1, 2""")
def ledger_round(t, spark):
    """LOP-07: the ledger after a round, its winners marked."""
    ledger = t("part").where("p_size > 40").groupBy(kind().alias("formula")).agg(r(F.max("p_retailprice") / 1000).alias("merit")).withColumn("round", F.lit(0)).withColumn("winner", F.lit(False))
    out = loop.update_ledger(ledger, scored(t), "formula", 5, 1)
    return out.groupBy("round", "winner").agg(F.count(F.lit(1)).alias("n"), r(F.max("merit")).alias("best"))
