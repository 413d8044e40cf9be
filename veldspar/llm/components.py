"""Connected components of an edge table by rounds of random-mate contraction, all distributed.

Each round every node picks, of itself and its neighbours, the one that is first under a hash
of (node, round); edges are then redrawn between the picks and loops and repeats dropped.  A
constant share of the nodes goes in a round, so rounds grow with the logarithm of the input.
Picking is a grouped minimum (summed up before the shuffle, so a node with very many edges is
no hot spot); redrawing is two joins against one row per node.  Every round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges, as many as connect the same nodes."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while up.get(x, x) != top:
                up[x], x = top, up[x]
            return top

        a, b = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: longs a, b.  Returns node, root for every node of an edge (any fixed node as root)."""
    now = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        rank = F.xxhash64("v", F.lit(len(steps)))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        own = F.xxhash64("u", F.lit(len(steps)))
        pick = (
            both.groupBy("u")
            .agg(F.min(F.struct(rank.alias("r"), F.col("v").alias("v"))).alias("m"))
            .select(F.col("u").alias("node"), F.when(F.col("m.r") < own, F.col("m.v")).otherwise(F.col("u")).alias("root"))
        )
        pick = materialize(pick, "picks")
        steps.append(pick)
        pa_, pb_ = (pick.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        drawn = now.join(pa_, "a").join(pb_, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        after = materialize(drawn, "edges")
        discard(now)
        now = after
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = materialize(out, "components")
    discard(now, *steps)
    return found
