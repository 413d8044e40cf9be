"""Merkle manifest of a table: one root for a data set, proofs for its rows.

A row is a leaf: SHA-256 of its fields, each with its length.  Leaves ascend by id within their
group (a source); while several nodes remain, every ``fanout`` consecutive ones become their hash,
the last run as it is.  The groups' roots, in the order of the groups, are reduced likewise.

*Superblock reduction.*  The leaves of a group are numbered without one task per group: rows are
dealt by range of (group, id), counted by range, and numbered within ranges from the ranges' totals.
Numbers are then cut into buckets of ``fanout ** depth``; ``applyInPandas`` collapses ``depth``
levels of a bucket at once to one root, and the roots are the rows of the next round.  A bucket
holds at most ``fanout ** depth`` rows (729), so a group of any size makes no large group.  On the
way back each bucket's path to the root is put behind the lower paths of its rows: a proof is the
lower path in the bucket and the upper path of the bucket.

A path says level by level what stands left and right of the node, as ``left|right``, levels parted
by ``;``.  Folding a leaf along its path gives the root if neither was changed.

Defined results: null fields count as ``-``; a null group is a group of its own before all others;
rows of one id are ordered by their leaves, null ids first, repeated rows are leaves of their own; a
group of one row has its leaf for root; an empty table has no rows and no root; other columns are
never read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import discard, fresh_path, materialize, small_batches, trimmed

FANOUT, DEPTH = 3, 6
#: Rows of one range when rows are numbered.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def levels(nodes: list[str], fanout: int, depth: int, whole: bool) -> list[list[str]]:
    """The nodes level by level: ``depth`` levels up, or until one is left if they are all of their group."""
    out = [nodes]
    while len(out) <= depth and not (whole and len(out[-1]) == 1):
        at = out[-1]
        out.append([sha("".join(at[i : i + fanout])) for i in range(0, len(at), fanout)])
    return out


def paths(tree: list[list[str]], fanout: int) -> list[str]:
    """For each node of the lowest level its path to the top one."""
    up = [""] * len(tree[-1])
    for nodes in reversed(tree[:-1]):
        here = []
        for i in range(len(nodes)):
            lo = i - i % fanout
            step = "".join(nodes[lo:i]) + "|" + "".join(nodes[i + 1 : lo + fanout])
            above = up[i // fanout]
            here.append(f"{step};{above}" if above else step)
        up = here
    return up


def fold(node: str, path: str) -> str:
    """The root that a node and its path give."""
    for step in path.split(";") if path else ():
        left, right = step.split("|")
        node = sha(left + node + right)
    return node


def joined(lower: str, upper: str) -> str:
    return f"{lower};{upper}" if lower and upper else lower or upper


def siblings(path: str) -> str:
    """What a proof consists of: the other nodes of all runs on the path, one after another."""
    return path.replace("|", "").replace(";", "")


def numbered(df: DataFrame, group: str, order: Sequence[str], rows: int) -> DataFrame:
    """``df`` with ``index`` (from 0) of each row in its group and the group's ``total``.

    ``order`` must tell all rows of a group apart.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    spread = materialize(df.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = spread.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    # A group has no more rows here than there are ranges.
    own = Window.partitionBy(group)
    counts = counts.select("part", group, (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    counts = materialize(counts, "ranges")
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    return spread.withColumn("within", place).join(counts, ["part", group]).withColumn("index", F.col("before") + F.col("within")).drop("part", "before", "within")


_BUCKET = "g string, bucket long, total long, root string, nodes array<string>"
_PAYLOAD = ", ids array<long>, known array<boolean>, others array<string>"


def _collapse(fanout: int, depth: int, payload: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One row of a bucket: its nodes in order and the node they collapse to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        total = int(rows.total.iloc[0])
        nodes = rows.node.tolist()
        out = {"g": rows.g.iloc[0], "bucket": int(rows["index"].iloc[0]) // fanout**depth, "total": total, "root": levels(nodes, fanout, depth, total <= fanout**depth)[-1][0], "nodes": nodes}
        if payload:
            out |= {"ids": rows.id.tolist(), "known": rows.known.tolist(), "others": rows.other.tolist()}
        return pd.DataFrame([out])

    return run


def reduce(items: DataFrame, largest: int, fanout: int = FANOUT, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of buckets, a round each, from ``items`` (g, index, total, node and, of leaves, id, known, other); the last has one bucket a group."""
    block, out = fanout**depth, []
    while True:
        payload = not out and "id" in items.columns
        grouped = items.withColumn("bucket", F.floor(F.col("index") / block)).groupBy("g", "bucket")
        out.append(materialize(grouped.applyInPandas(_collapse(fanout, depth, payload), _BUCKET + _PAYLOAD * payload), "buckets"))
        if largest <= block:
            return out
        largest = -(-largest // block)
        # A bucket's number is its root's in the next round.
        items = out[-1].select("g", F.col("bucket").alias("index"), F.ceil(F.col("total") / block).alias("total"), F.col("root").alias("node"))


def _descend(fanout: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """g, index, path of each node of buckets that know their own path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lower = paths(levels(r["nodes"], fanout, depth, r["total"] <= fanout**depth), fanout)
                base = r["bucket"] * fanout**depth
                n = len(lower)
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * n, pa.string()), pa.array(range(base, base + n), pa.int64()), pa.array([joined(x, r["path"]) for x in lower], pa.string())], names=["g", "bucket", "path"])

    return run


def bucket_paths(rounds: list[DataFrame], top: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """g, bucket, path of the first round's buckets, from the paths of the groups' roots (``top``: g, path)."""
    known = top.select("g", F.lit(0).cast("long").alias("bucket"), "path")
    for t in reversed(rounds[1:]):
        known = t.select("g", "bucket", "total", "nodes").join(known, ["g", "bucket"]).mapInArrow(trimmed(_descend(fanout, depth)), "g string, bucket long, path string")
    return known


def _leaf_rows(fanout: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lower = paths(levels(r["nodes"], fanout, depth, r["total"] <= fanout**depth), fanout)
                whole = [joined(x, r["path"]) for x in lower]
                folded = [fold(other or node, p) for node, other, p in zip(r["nodes"], r["others"], whole, strict=True)]
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i if k else None for i, k in zip(r["ids"], r["known"], strict=True)], pa.int64()), pa.array(r["nodes"], pa.string()), pa.array([r["subroot"]] * n, pa.string()), pa.array([r["whole_root"]] * n, pa.string()),
                        pa.array([sha(siblings(p)) for p in whole], pa.string()), pa.array(folded, pa.string()), pa.array([f == r["whole_root"] for f in folded], pa.bool_()), pa.array(whole, pa.string()),
                    ],
                    names=names,
                )

    return run


def build(df: DataFrame, path: str, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, found: dict[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> None:
    """Write the manifest of ``df`` below ``path``: ``buckets`` (leaves and paths of the buckets) and ``groups`` (their roots and the whole root).

    ``found`` gives, for some fields, what is met when rows are looked up again (null: as recorded);
    :func:`check` folds what was met along the recorded path.
    """
    spark = df.sparkSession
    now = leaf([df[c] for c in fields])
    met = [(found or {}).get(c) for c in fields]
    changed = [F.coalesce(m, df[c].cast("string")) if m is not None else df[c] for c, m in zip(fields, met, strict=True)]
    any_met = F.lit(False)
    for m in met:
        if m is not None:
            any_met = any_met | m.isNotNull()
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), df[group_col].cast("string")), F.lit("-")).alias("g"), F.coalesce(df[id_col].cast("long"), F.lit(0)).alias("id"), df[id_col].isNotNull().alias("known"),
        now.alias("node"), F.when(any_met, leaf(changed)).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "leaves")
    size = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups")).first()
    rounds = reduce(numbered(rows, "g", ["known", "id", "node", "row"], size.all or 0).drop("row"), size.most or 0, fanout, depth)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("node"))
    tops = numbered(materialize(subroots, "subroots"), "g", ["of"], size.groups)
    above = reduce(tops.select("g", "index", "total", "node"), size.groups, fanout, depth)
    # The groups' own paths, found as those of buckets: a round below the lowest.
    whole_root = above[-1].select("root").first()
    start = above[-1].select("g", F.lit("").alias("path"))
    known = bucket_paths(above, start, fanout, depth)
    known = above[0].select("g", "bucket", "total", "nodes").join(known, ["g", "bucket"]).mapInArrow(trimmed(_descend(fanout, depth)), "g string, bucket long, path string")
    groups = tops.select("of", "index", F.col("node").alias("subroot")).join(known.select(F.col("bucket").alias("index"), "path"), "index")
    groups.select(F.col("of").alias("g"), "subroot", "path", F.lit(whole_root.root if whole_root else None).cast("string").alias("whole_root")).write.mode("overwrite").parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    upper = bucket_paths(rounds, groups.select("g", "path"), fanout, depth)
    placed = rounds[0].join(upper, ["g", "bucket"]).join(groups.drop("path"), "g")
    placed.write.mode("overwrite").parquet(f"{path}/buckets")
    discard(rows, *rounds, *above)


def check(spark: SparkSession, path: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path of every row of a written manifest."""
    small_batches(spark, 64)
    buckets = spark.read.parquet(f"{path}/buckets").select("nodes", "others", "ids", "known", "total", "path", "subroot", "whole_root")
    return buckets.mapInArrow(trimmed(_leaf_rows(fanout, depth)), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    path = fresh_path(spark, "manifest")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.translate(docs["text"], "\n", ""))
    build(docs, path, found={"text": F.when(tampered != docs["text"], tampered)})
    return check(spark, path).drop("path")


def _oracle(below: int = 12, above: int = 6) -> str:
    """SQL by levels, for groups of up to 3 ** below rows and up to 3 ** above groups."""

    def h(x: str) -> str:
        return f"sha256({x})"

    def f(c: str) -> str:
        return f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')"

    head = "||".join(f(c) for c in FIELDS[:-1])
    crc = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: ord(c)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"
    ctes = [
        f"e AS MATERIALIZED (SELECT doc_id, source, {head} AS head, text, CASE WHEN xor({crc}, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents)",
        f"b AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '-') AS g, {h('head || ' + f('text'))} AS node, {h('head || ' + f('other'))} AS met FROM e)",
        "d0 AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, node AS leaf, g, met, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM b)",
        "t0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d0)",
    ]

    def climb(t: str, d: str, keep: str, k: int) -> None:
        ctes.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN n = 1 THEN min(h) ELSE {h('string_agg(h, ' + chr(39) * 2 + ' ORDER BY i)')} END AS h, (n + 2) // 3 AS n FROM {t}{k} GROUP BY g, i // 3, n)")
        ctes.append(
            f"{d}{k + 1} AS MATERIALIZED (SELECT {keep}, d.g, d.i // 3 AS i, d.proof || coalesce(l, '') || coalesce(r, '') AS proof, CASE WHEN n = 1 THEN met ELSE {h('coalesce(l, ' + chr(39) * 2 + ') || met || coalesce(r, ' + chr(39) * 2 + ')')} END AS met FROM (SELECT d.*, any_value(t.n) AS n, "
            f"string_agg(h, '' ORDER BY t.i) FILTER (WHERE t.i < d.i AND t.n > 1) AS l, string_agg(h, '' ORDER BY t.i) FILTER (WHERE t.i > d.i AND t.n > 1) AS r FROM {d}{k} d JOIN {t}{k} t ON t.g = d.g AND t.i // 3 = d.i // 3 GROUP BY ALL) d)"
        )

    for k in range(below):
        climb("t", "d", "u, doc_id, leaf", k)
    ctes.append(f"s0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS own FROM t{below})")
    ctes.append(f"p0 AS MATERIALIZED (SELECT u, doc_id, leaf, s0.h AS subroot, '' AS g, s0.i AS i, proof, met FROM d{below} d JOIN s0 ON d.g = s0.own)")
    ctes.append("q0 AS MATERIALIZED (SELECT g, i, h, n FROM s0)")
    for k in range(above):
        climb("q", "p", "u, doc_id, leaf, subroot", k)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, {h('proof')} AS proof_sha256, met AS folded_root, met = h AS verified FROM p{above}, q{above}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES: dict[str, str] = {"op12_merkle_manifest": _oracle()}
