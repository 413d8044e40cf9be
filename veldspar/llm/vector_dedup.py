"""Embedding near-duplicates by product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is indexed.
A vector lies in the inverted list of its nearest centroid, as codes of its residual's subspaces
with the length of the rest (its quantisation error).  A partner in another list lies beyond the
bisecting plane of the two centroids, so only lists whose plane is within a partner's reach can
hold one; of two lists one is searched by the vectors of the other.  Distances come from per-query
tables of the codes (asymmetric); what could lie within the threshold, given the stored error, is
reranked by the exact cosine in double precision.  So nothing below the threshold is ever linked,
and nothing is missed, whatever the dimension.

Equal vectors are one node with a multiplicity.  Lists are dealt to blocks of bounded size, short
ones together and long ones split, and a query goes once to each block that holds lists it probes;
its queries are split as well, so a list with a third of all vectors is many tasks.  Each task
returns link counts and a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; a null id stands before all others; rows with
equal ids are separate vectors; an empty table gives an empty result; other columns (labels too)
are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, materialize, trimmed
from .components import connected_components

THRESHOLD = 0.95
#: Lists: about the root of the vectors, within these bounds; sample rows for each.
LEAST_LISTS, MOST_LISTS, SAMPLE_PER_LIST = 16, 2048, 64
#: Bytes of the sample that the driver fits on (at least 8 rows a list), and rows it compares at once.
FIT_BYTES, FIT_ROWS = 128 << 20, 4096
SUBSPACES, CODES = 8, 256
#: Added to the reach of partners, far above the rounding of distances.
SLACK = 1e-6
#: Bytes of the vectors of a block, on either side, and its rows at least and at most.
BLOCK_BYTES, LEAST_BLOCK, MOST_BLOCK = 8 << 20, 256, 16_384
#: Components gathered at once when pairs are verified, and bytes of copied vectors of a search task.
GATHERED, TASK_BYTES = 1 << 19, 32 << 20
NULL_ID = -(1 << 63)


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's steps from distinct random rows; an empty cluster keeps its place."""
    x = np.unique(x, axis=0)
    c = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.concatenate([nearest(x[lo : lo + FIT_ROWS], c)[0] for lo in range(0, len(x), FIT_ROWS)])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and all squared distances."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
    return np.argmin(d, axis=1), d


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids, and per subspace the codebook of residuals."""

    centroids: np.ndarray
    books: np.ndarray
    reach: float

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    @staticmethod
    def fit(x: np.ndarray, lists: int, threshold: float) -> Quantiser:
        dim = x.shape[1]
        width = -(-dim // SUBSPACES)
        c = kmeans(x, lists)
        rest = np.zeros((len(x), width * SUBSPACES))
        for lo in range(0, len(x), FIT_ROWS):
            part = x[lo : lo + FIT_ROWS]
            rest[lo : lo + FIT_ROWS, :dim] = part - c[nearest(part, c)[0]]
        books = []
        for m in range(SUBSPACES):
            book = kmeans(rest[:, m * width : (m + 1) * width], CODES, steps=8, seed=m)
            books.append(np.concatenate([book, np.repeat(book[:1], CODES - len(book), axis=0)]))
        return Quantiser(c, np.stack(books), float(np.sqrt(2 - 2 * threshold)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, quantisation error and probed lists (a mask) of unit vectors."""
        near, d = nearest(x, self.centroids)
        width = self.books.shape[2]
        rest = np.zeros((len(x), self.padded))
        rest[:, : x.shape[1]] = x - self.centroids[near]
        codes, error = np.empty((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
        for m in range(SUBSPACES):
            k, e = nearest(rest[:, m * width : (m + 1) * width], self.books[m])
            codes[:, m] = k
            error += np.maximum(e[np.arange(len(x)), k], 0)
        return near, codes, np.sqrt(error), self.probes(near, d)

    def probes(self, near: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The own list, and those this one searches whose bisecting plane is no farther than partners reach.

        Of two lists one searches the other, by the parity of their numbers, so each asks about half of them.
        """
        apart = np.sqrt(np.maximum(nearest(self.centroids, self.centroids)[1], 1e-12))[near]
        margin = (d - d[np.arange(len(d)), near][:, None]) / (2 * apart)
        own, other = near[:, None], np.arange(d.shape[1])[None, :]
        asks = np.where((own + other) % 2 == 0, own < other, own > other)
        return ((margin <= self.reach + SLACK) & asks) | (own == other)

    def approximate(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to coded vectors of list ``at``, by table lookup."""
        width = self.books.shape[2]
        rest = np.zeros((len(query), self.padded))
        rest[:, : query.shape[1]] = query - self.centroids[at]
        out = np.zeros((len(query), len(codes)), np.float32)
        for m in range(SUBSPACES):
            table = nearest(rest[:, m * width : (m + 1) * width], self.books[m])[1].astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, raw (the components as doubles; null if the vector can not link)."""
    for b in batches:
        raw = []
        for v in b.column(1):
            x = None if not v.is_valid else v.values
            if x is None or len(x) == 0 or x.null_count:
                raw.append(None)
                continue
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    # Scaled first: the squares of very large or small components would leave the doubles.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_CELL = "cell string, side int, node long, own long, weight long, raw binary, codes binary, error double, lists binary"


@dataclass(frozen=True)
class Blocks:
    """Where lists lie: first block and number of blocks of each, and into how many parts a block's queries are split."""

    of: dict[int, tuple[int, int]]
    parts: list[int]

    @staticmethod
    def deal(stored: dict[int, int], asked: dict[int, int], total: int, rows: int) -> Blocks:
        """Short lists share a block of ``rows``; a longer list has blocks of its own."""
        of, sums, room = {}, [], 0
        for c in sorted(stored):
            if stored[c] > rows:
                n = -(-stored[c] // rows)
                of[c] = (len(sums), n)
                sums += [asked[c]] * n
                room = 0
                continue
            if stored[c] > room:
                sums.append(0)
                room = rows
            of[c] = (len(sums) - 1, 1)
            sums[-1] += asked[c]
            room -= stored[c]
        return Blocks(of, [max(1, -(-min(x, total) // rows)) for x in sums])


def _cells(sent, blocks: Blocks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each node into its block, once for each part of the block's queries, and as a query into every block it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = sent.value
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            nodes, weights, raws = (b.column(k).to_pylist() for k in range(3))
            near, codes, error, mask = q.encode(_unit(raws))
            rows: list[tuple] = []
            for i, node in enumerate(nodes):
                own = int(near[i])
                first, n = blocks.of[own]
                mine = first + node % n
                rows += [(f"{mine}:{j}", 0, node, own, weights[i], raws[i], codes[i].tobytes(), float(error[i]), None) for j in range(blocks.parts[mine])]
                want: dict[int, list[int]] = {}
                for c in np.flatnonzero(mask[i]).tolist():
                    if c in blocks.of:
                        first, n = blocks.of[c]
                        for k in range(first, first + n):
                            want.setdefault(k, []).append(c)
                rows += [(f"{k}:{node % blocks.parts[k]}", 1, node, own, weights[i], raws[i], None, None, np.array(c, "<i4").tobytes()) for k, c in want.items()]
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")])

    return run


def _search(sent, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links of a cell's queries with its block: link counts by node, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        q: Quantiser = sent.value
        side = table["side"].to_numpy()
        base, query = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        credit: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        if base.num_rows and query.num_rows:
            xb, xq = _unit(base["raw"].to_pylist()), _unit(query["raw"].to_pylist())
            codes = np.frombuffer(b"".join(base["codes"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            limit = (q.reach + base["error"].to_numpy() + 1e-3) ** 2
            nb, nq, own, at_list = base["node"].to_numpy(), query["node"].to_numpy(), query["own"].to_numpy(), base["own"].to_numpy()
            wb, wq = base["weight"].to_numpy(), query["weight"].to_numpy()
            wanted = [np.frombuffer(x, "<i4") for x in query["lists"].to_pylist()]
            asks = np.concatenate(wanted)
            asker = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            def found(at: int, a: np.ndarray, b: np.ndarray) -> None:
                hit = (np.einsum("nd,nd->n", xq[a], xb[b]) >= threshold) & (nq[a] != nb[b])
                a, b = a[hit], b[hit]
                # Within a list both search; of two lists only one does, and counts for both.
                alone = own[a] != at
                for n, w in zip([*nq[a].tolist(), *nb[b[alone]].tolist()], [*wb[b].tolist(), *wq[a[alone]].tolist()], strict=True):
                    credit[n] = credit.get(n, 0) + w
                for x, y in zip(nq[a].tolist(), nb[b].tolist(), strict=True):
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        up[max(rx, ry)] = min(rx, ry)
                        edges.add((x, y))

            many = max(1, GATHERED // xb.shape[1])
            for at in np.unique(at_list).tolist():
                mine, those = np.flatnonzero(at_list == at), asker[asks == at]
                for lo in range(0, len(those), 256):
                    some = those[lo : lo + 256]
                    i, j = np.nonzero(q.approximate(xq[some], at, codes[mine]) <= limit[mine])
                    for s in range(0, len(i), many):
                        found(at, some[i[s : s + many]], mine[j[s : s + many]])
        n = len(credit)
        return pa.table({"a": pa.array([*credit, *(e[0] for e in edges)], pa.int64()), "b": pa.array([None] * n + [e[1] for e in edges], pa.int64()), "n": pa.array([*credit.values(), *[0] * len(edges)], pa.int64())})

    return run


def _nodes(vectors: DataFrame) -> DataFrame:
    """node, raw, least (id), weight of every distinct vector; ids of nodes are made once, by writing."""
    grouped = vectors.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def fit(nodes: DataFrame, dim_bytes: int, threshold: float) -> Quantiser:
    """Fit on a sample of at most SAMPLE_PER_LIST * MOST_LISTS distinct vectors and about FIT_BYTES (lowest hash first)."""
    mine = nodes.where(F.octet_length("raw") == dim_bytes)
    n = mine.count()
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, round(n**0.5))))
    rows = mine.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(min(lists * SAMPLE_PER_LIST, max(lists * 8, FIT_BYTES // dim_bytes))).toArrow()["raw"].to_pylist()
    return Quantiser.fit(_unit(rows), lists, threshold)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    src = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = materialize(src.mapInArrow(trimmed(_vectors), "vec_id long, raw binary"), "vectors")
    nodes = _nodes(vectors)
    links = None
    for (size,) in nodes.select(F.octet_length("raw")).distinct().collect():
        sent = spark.sparkContext.broadcast(fit(nodes, size, threshold))
        mine = nodes.where(F.octet_length("raw") == size).select("node", "weight", "raw")

        def place(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near, _, _, mask = sent.value.encode(_unit(b.column(2).to_pylist()))
                k = mask.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.bincount(near, minlength=k)), pa.array(mask.sum(0))], names=["list", "stored", "asked"])

        # A row per list: at most MOST_LISTS reach the driver.
        sized = mine.mapInArrow(trimmed(place), "list long, stored long, asked long").groupBy("list").agg(F.sum("stored").alias("stored"), F.sum("asked").alias("asked")).where("stored > 0").collect()
        total = sum(r.stored for r in sized)
        rows = max(LEAST_BLOCK, min(MOST_BLOCK, BLOCK_BYTES // size))
        blocks = Blocks.deal({r.list: r.stored for r in sized}, {r.list: r.asked for r in sized}, total, rows)
        # At most every vector as a query in every block, and every block once for each part of its queries.
        copies = total * len(blocks.parts) + rows * sum(blocks.parts)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-copies * size // TASK_BYTES))
        found = mine.mapInArrow(trimmed(_cells(sent, blocks)), _CELL).repartition(tasks, "cell").groupBy("cell").applyInArrow(_search(sent, threshold), "a long, b long, n long")
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, n long")
    links = materialize(links, "links")
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("node"), "n")
    roots = connected_components(links.where("b is not null").select("a", "b"))
    named = materialize(nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    discard(nodes, roots)
    # Written, so that the joins have two plain sides and can split a class, or a vector, of very many rows.
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    info = named.join(least, "root").select("raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    info = materialize(info, "info")
    discard(named, least, links)
    out = vectors.join(info, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))

    def real(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)

    return out.select(real("vec_id"), "n_links", real("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op4_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_product_quantisation": op4_product_quantisation}
ORACLES: dict[str, str] = {
    "op4_product_quantisation": """
WITH RECURSIVE ok AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN least ON least.a = e.vec_id"""
}
