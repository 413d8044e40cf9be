"""Queries over texts and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .core import query, r


@query(r"""
WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE) AS v FROM documents), k AS (SELECT doc_id, list_filter(v, lambda x: x >= 20 AND x <= 100) AS v FROM n)
SELECT doc_id, round(list_median(v), 6) AS median_number, len(v) AS n_numbers FROM k""")
def text_numbers_median(t, spark):
    """STR-07: numbers of a text within a range, and their median."""
    v = text.numbers(F.coalesce("text", F.lit("")), 20, 100)
    return t("documents").select("doc_id", r(text.median(v)).alias("median_number"), F.size(v).cast("long").alias("n_numbers"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS n_links, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def tag_extract(t, spark):
    """SRC-11: contents of tags by expression."""
    links = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), 1)
    return t("pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.trim(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT (props->>'k')::BIGINT) AS k_distinct FROM events GROUP BY 1")
def json_props(t, spark):
    """SRC-05: a field of a JSON column, by schema."""
    k = F.from_json("props", "k long")["k"]
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.countDistinct(k).alias("k_distinct"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, split_part(p_type, ' ', 1) AS head, starts_with(p_brand, 'Brand#1') AS first_maker FROM part")
def text_keys(t, spark):
    """STR-01, 02, 04, 06: normalised keys, heads and prefixes."""
    return t("part").select("p_partkey", text.alnum_key(F.col("p_name")).alias("key"), F.split("p_type", " ")[0].alias("head"), F.startswith("p_brand", F.lit("Brand#1")).alias("first_maker"))


@query("""
SELECT p_partkey, p_brand, sha256(p_name) AS digest, md5(p_type) AS type_key FROM part""")
def text_digests(t, spark):
    """STR-17: hashes of texts."""
    return t("part").select("p_partkey", "p_brand", F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"), F.md5(F.col("p_type").cast("binary")).alias("type_key"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1, 2")
def corpus_profile(t, spark):
    """AGG-10, AGG-23 on texts."""
    return t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), r(F.avg("n_chars")).alias("mean_chars"))
