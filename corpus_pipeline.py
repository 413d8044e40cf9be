"""A corpus pipeline: language, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame that is written as Parquet and read again before the next one; all but the last return
the columns of ``documents``.  Null and empty texts go at the first stage (no language); of
repeated rows one stays, which the mixture may repeat; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import decontaminate, jaccard, langid, mixing, sharding
from veldspar.llm._store import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
N_SHARDS = 8
#: Share of a text from which its leading language is taken for the declared one.
SURE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, under the language that was inferred.

    Those without a letter go, and those that evenly drawn n-grams explain better than any mixture
    of the learned languages.  ``lang`` becomes the leading language where it has at least
    ``SURE`` of the text; elsewhere a declared one stays and a missing one is filled.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    own = F.col("language")
    kept = found.where((own["lang"] != "und") & (own["fit"] > -langid.BITS * math.log(2)))
    return kept.withColumn("lang", F.when(own["score"] >= SURE, own["lang"]).otherwise(F.coalesce("lang", own["lang"]))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row of the smallest id."""
    return jaccard.keep_first(docs).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; those that are mostly such passages go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.clean(docs.select(*COLUMNS), bench, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says; none of rate 0."""
    labels = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.resample(docs, labels).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every record."""
    return sharding.shard(docs.select("doc_id", "text"), N_SHARDS, map_path=sharding.map_folder(spark))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("mixture", mixture),
    ("shards", shards),
]

#: Not expressible: trained models, components and fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
