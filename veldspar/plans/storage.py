"""Queries that write a table by a sink and read it back by a scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.vectors import shared_folder
from ..sources import pages, tables
from .core import query, r


def fresh(spark, name):
    """A path in the session's shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/storage/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(t, spark):
    """SRC-02, SRC-03, SNK-01: CSV by a stated schema, pruned to the columns asked for."""
    path = fresh(spark, "csv")
    tables.write_csv(t("supplier"), path)
    return tables.scan_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT count(*) AS n, 3 AS n_broken FROM supplier")
def tolerant_csv(t, spark):
    """SRC-04: broken rows are kept apart, not fatal."""
    path = fresh(spark, "broken")
    s = t("supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")).alias("line"))
    s.union(spark.createDataFrame([("x,1.5",), ("3,abc",), ("only",)], "line string")).write.text(path)
    schema = "k long, v double"
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").csv(path)
    # Both columns are asked for: the parser does not look at those that no one reads.
    bad = F.col("_corrupt").isNotNull() | (F.col("k").isNull() & F.col("v").isNull())
    return rows.agg(F.count(F.when(~bad, F.col("k"))).alias("n"), F.count(F.when(bad, 1)).cast("int").alias("n_broken"))


@query("SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def parquet_round_trip(t, spark):
    """SRC-01, SNK-02: partitioned Parquet; the filter on the partition column reads one folder."""
    path = fresh(spark, "parquet")
    tables.write_parquet(t("lineitem").select("l_returnflag", "l_linenumber"), path, "l_returnflag")
    return tables.scan_parquet(spark, path, ["l_linenumber", "l_returnflag"]).where("l_returnflag = 'R'").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price FROM part")
def json_records(t, spark):
    """SRC-05, SNK-04: JSON records, NaN written as null."""
    path = fresh(spark, "json")
    tables.write_json_records(t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("price")), path)
    return tables.scan_json(spark, path, "p_partkey long, price double")


@query("SELECT r_name AS key, r_regionkey AS k FROM region")
def keyed_json(t, spark):
    """SRC-06: a document that maps keys to records."""
    path = fresh(spark, "keyed")
    # One document of as many records as there are regions.
    doc = t("region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct(F.col("r_regionkey").alias("k"))))).alias("m")).select(F.to_json("m"))
    doc.coalesce(1).write.text(path)
    return tables.scan_keyed_json(spark, path, "struct<k:int>").select("key", F.col("value.k").alias("k"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding) AS width FROM embeddings")
def array_round_trip(t, spark):
    """SRC-07, SNK-05: dense matrices as array columns."""
    path = fresh(spark, "arrays")
    tables.write_arrays(t("embeddings"), "vec_id", "embedding", path)
    back = tables.scan_arrays(spark, path, "vec_id", "embedding")
    return back.select("vec_id", r(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("embedding").cast("long").alias("width"))


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_keys, sum(c_custkey)::BIGINT AS keys, max(page) AS pages FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS page FROM customer)")
def paged_ingest(t, spark):
    """SRC-08: a paged service as a Spark source, read in ranges of pages until one is short (the service: pages of a table's file)."""
    files = t("customer").inputFiles()
    base = files[0] if len(files) == 1 else files[0].rsplit("/", 1)[0]
    got = pages.read_pages(spark, "veldspar.sources.pages:parquet_page", "c_custkey long, c_name string", base=base, page_size=100, pages_per_task=4, max_pages=1 << 30)
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("n_keys"), F.sum("c_custkey").alias("keys"), F.max("page").alias("pages"))


@query("SELECT count(*) AS n_rows, 0 AS null_ids, count(DISTINCT c_custkey) AS distinct_ids, count(*) - count(DISTINCT c_custkey) AS repeated, 1 AS built_once FROM customer")
def snapshot_audit(t, spark):
    """SRC-14, SRC-15: ids of a table that is built at the first call and read at the second."""
    path, built = fresh(spark, "cached"), []

    def build():
        built.append(1)
        return t("customer").select("c_custkey")

    tables.read_or_build(spark, path, build)
    again = tables.read_or_build(spark, path, build)
    return tables.id_audit(again, "c_custkey").select(F.col("rows").alias("n_rows"), F.col("null_ids").cast("int").alias("null_ids"), "distinct_ids", "repeated", F.lit(len(built)).alias("built_once"))


@query("SELECT 'n' AS name, count(*)::VARCHAR AS value FROM part UNION ALL SELECT 'empty', '0'")
def summaries(t, spark):
    """SNK-03, SNK-06, SNK-07: a summary document, a typed empty table, a report table."""
    path = fresh(spark, "empty")
    tables.write_typed_empty(spark, "id long, x double", path)
    empty = spark.read.parquet(path)
    assert empty.dtypes == [("id", "bigint"), ("x", "double")]
    n = t("part").count()
    assert tables.markdown_table(spark.createDataFrame([(n,)], "n long")).endswith(f"| {n} |") and f'"n": {n}' in tables.summary_json({"n": n})
    return spark.createDataFrame([("n", str(n)), ("empty", str(empty.count()))], "name string, value string")


@query("SELECT s_suppkey, 3 AS n_sites, 'Mo1Se2' AS formula, round(s_acctbal / 1e4, 6) AS height FROM supplier")
def structure_texts(t, spark):
    """SRC-12, SNK-10, MTH-14: structure files as texts, written and parsed row by row in Arrow batches."""
    s = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 1e4).alias("z"))
    return tables.structure_round_trip(s, "s_suppkey", "z").select("s_suppkey", "n_sites", "formula", r(F.col("height")).alias("height"))


@query("SELECT 'edges' AS part, count(*) AS n FROM (SELECT DISTINCT n_regionkey, n_nationkey FROM nation) UNION ALL SELECT 'nodes', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)")
def frozen_graph(t, spark):
    """SNK-11: edges, nodes and metadata of a graph."""
    path = fresh(spark, "graph")
    tables.freeze_graph(t("nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 1000).cast("long").alias("dst"), F.lit(1.0).alias("w")), path, name="nations", k=1)
    return spark.read.parquet(f"{path}/edges").agg(F.lit("edges").alias("part"), F.count(F.lit(1)).alias("n")).union(spark.read.parquet(f"{path}/nodes").agg(F.lit("nodes"), F.count(F.lit(1))))


@query("""
SELECT count(*) AS n, count(CASE WHEN x <> -99999 THEN x END) AS n_numbers, count(CASE WHEN lower(trim(s)) NOT IN ('na', 'n/a', 'nan', 'none', '') THEN s END) AS n_texts, count(*) FILTER (x = 0) AS n_zero
FROM (SELECT CASE p_size % 4 WHEN 0 THEN -99999.0 WHEN 1 THEN 0 ELSE p_retailprice END AS x, CASE p_size % 3 WHEN 0 THEN 'na' WHEN 1 THEN ' ' ELSE p_type END AS s FROM part)""")
def sentinel_codes(t, spark):
    """PRJ-12: codes for missing values in numbers and texts; a true 0 stays."""
    x = F.when(F.col("p_size") % 4 == 0, -99999.0).when(F.col("p_size") % 4 == 1, 0.0).otherwise(F.col("p_retailprice"))
    s = F.when(F.col("p_size") % 3 == 0, "na").when(F.col("p_size") % 3 == 1, " ").otherwise(F.col("p_type"))
    out = tables.null_sentinels(t("part").select(x.alias("x"), s.alias("s")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_numbers"), F.count("s").alias("n_texts"), F.count(F.when(F.col("x") == 0, 1)).alias("n_zero"))
