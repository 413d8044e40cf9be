"""Rounds of a search: substitutions, combinations, hypotheses, confounders, validation, ledger (ARR-10, ARR-11, LOP-03..07)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def family_of(families: Sequence[Sequence[str]]) -> dict[str, list[str]]:
    """Family of each member; of several the last one counts."""
    out: dict[str, list[str]] = {}
    for f in families:
        for e in f:
            out[e] = sorted(set(f))
    return out


def substitutions(df: DataFrame, key: str, species: str, families: Sequence[Sequence[str]]) -> DataFrame:
    """key, site, species: every list with one site replaced by another member of its family (ARR-10). No join: the table of families is a literal."""
    table = family_of(families)
    lookup = F.create_map(*(x for e, f in table.items() for x in (F.lit(e), F.array(*(F.lit(y) for y in f)))))
    sites = df.select(key, F.col(species).alias("_s"), F.posexplode(species).alias("site", "_old")).withColumn("_new", F.explode(F.try_element_at(lookup, F.col("_old"))))
    return sites.where("_new <> _old").select(key, F.col("site").cast("long").alias("site"), F.transform("_s", lambda x, i: F.when(i == F.col("site"), F.col("_new")).otherwise(x)).alias("species"))


def combinations(spark: SparkSession, elements: Sequence[str], most: int, cap: int) -> DataFrame:
    """place, elements: combinations of 1 to ``most`` of a set in order, the first ``cap`` of them (ARR-11); the cap is the operator's own."""
    every = itertools.chain.from_iterable(itertools.combinations(elements, k) for k in range(1, most + 1))
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(itertools.islice(every, cap))], "place long, elements array<string>")


def hypotheses(panel: DataFrame, records: Sequence[dict]) -> DataFrame:
    """id, variable, target, direction, evidence, holds: stated mechanisms with the correlation that a panel (feature, target, rho, n) has for them (LOP-03).

    Evidence that the panel lacks is null, and does not hold.
    """
    spark = panel.sparkSession
    table = spark.createDataFrame([(x["id"], x["variable"], x["target"], x["direction"]) for x in records], "id string, variable string, target string, direction int")
    j = table.join(panel.select(F.col("feature").alias("variable"), "target", F.col("rho").alias("evidence")), ["variable", "target"], "left")
    return j.select("id", "variable", "target", "direction", "evidence", F.coalesce(F.signum("evidence") == F.col("direction"), F.lit(False)).alias("holds"))


def confounders(hypotheses: DataFrame, links: DataFrame, strong: float) -> DataFrame:
    """id, severity, kind, rival: issues of each hypothesis (LOP-04).

    A variable that goes with another one (links: a, b, rho) at least as strongly as ``strong`` has
    a rival explanation: high if the rival's own evidence is the stronger.  One without evidence
    needs an experiment.
    """
    both = links.select("a", "b", "rho").union(links.select(F.col("b"), F.col("a"), F.col("rho"))).where(F.abs("rho") >= strong)
    own = hypotheses.select("id", F.col("variable").alias("a"), "target", F.col("evidence").alias("e"))
    other = hypotheses.select(F.col("variable").alias("b"), "target", F.col("evidence").alias("o"))
    rival = own.join(both, "a").join(other, ["b", "target"]).select("id", F.when(F.abs("o") > F.abs("e"), "high").otherwise("medium").alias("severity"), F.lit("statistical").alias("kind"), F.col("b").alias("rival"))
    bare = hypotheses.where("evidence is null or not holds").select("id", F.lit("high").alias("severity"), F.lit("methodology").alias("kind"), F.lit(None).cast("string").alias("rival"))
    return rival.union(bare)


def validate(candidates: DataFrame, key: str, merit: Column, tolerance: float, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Candidates with their merit computed anew, whether it agrees with the stated one, and a plan line for each step (LOP-06)."""
    again = candidates.withColumn("validated", merit).withColumn("agrees", F.abs(F.col("validated") - F.col("merit")) <= tolerance)
    lines = F.array(*(F.format_string(f"submit %s --skill {skill} --host {host}", F.col(key).cast("string")) for skill, host in steps))
    return again.withColumn("plan", lines)


def update_ledger(ledger: DataFrame, validated: DataFrame, key: str, winners: int, round_no: int) -> DataFrame:
    """key, merit, round, winner: the ledger with a round's candidates added (LOP-07).

    A key the ledger knows keeps its row; the best of the round, first by key, are its winners and
    the next round's seeds.
    """
    fresh = validated.select(key, "merit").join(ledger.select(key), key, "left_anti")
    best = fresh.orderBy(F.desc("merit"), F.asc(key)).limit(winners).select(key, F.lit(True).alias("_won"))
    added = fresh.join(F.broadcast(best), key, "left").select(key, "merit", F.lit(round_no).alias("round"), F.coalesce("_won", F.lit(False)).alias("winner"))
    return ledger.select(key, "merit", "round", "winner").union(added)
