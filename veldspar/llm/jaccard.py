"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles.  Two sets link when 100 * |A & B| >= t * |A | B|.
All shingles are ordered by (frequency level, hash); the level comes from a count-min sketch over
all documents, of fixed size, so it is the same everywhere and any error in it costs time, never
a link.  Two sets that link share at least ``l`` of their first ``n - ceil(t n / 100) + l``
shingles, for every ``l``.  Each document picks its own ``l``: the estimated cost of its
candidates (how many documents hold the ``l``-th most frequent shingle of the prefix, times the
verification) against the cost of the longer prefix.  A pair must share the smaller of its two
``l`` within the prefixes of that ``l``, and enough for what lies beyond them to reach the overlap.

Frequent shingles never make pairs through the counting path.  A document that cannot fill its
prefix without frequent shingles joins, per frequent shingle, blocks of documents; each pair of
blocks (of bounded size) is verified at once as a matrix product.

Verification compares the words of shingles, not their hashes.

Equal sets are one node throughout, whatever the number of their documents: only one document per
distinct set and task reaches a shuffle, and copies are never expanded.  A set is named by 64 bits
and checked by 64 more that come from hashes of their own: if two sets have one name, all names are
made anew with another salt.

Defined results: null, empty and blank texts have no shingles and link with nothing (not with one
another); texts of fewer than ``n`` words have one shingle, the whole sequence; a null id stands
before all others; rows repeated with their id get equal rows; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import discard, materialize, small_batches, trimmed
from ._text import LONG, LOWER, SPACED, VALUE, VALUE2, blocks, gram_hashes, mix, word_hashes, words
from .components import connected_components

SHINGLE, PERCENT = 5, 80
#: The sketch: rows, and counters in a row (fixed size; wider for larger corpora if wished).
SKETCH_ROWS, SKETCH_BITS = 2, 21
#: A shingle counts as frequent from so many documents more than the sketch's noise.
FREQUENT = 64
#: Most shared prefix shingles asked for.
MOST_MATCHES = 6
#: Documents of a block, and postings held before they are sent on.
BLOCK_DOCS, HELD = 512, 400_000
#: Bytes of texts whose words are compared at once.
VERIFIED = 1 << 21
#: Ids of documents to verify are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Shingles of all documents for each bucket of postings.
BUCKET_SHINGLES = 1 << 19
NULL_ID = -(1 << 63)


def _runs(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word of every shingle of texts of ``n`` words at least."""
    count = np.diff(bounds)
    own = np.maximum(count - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), own)
    return owner, np.arange(len(owner)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(own)[:-1]]), own)


def _shingles(body: np.ndarray, found: tuple[np.ndarray, ...], n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle of a block, repeated ones too; the same order whatever the family."""
    starts, ends, bounds = found
    wh = word_hashes(body, starts, ends, (VALUE, VALUE2)[family], LONG)
    owner, at = _runs(bounds, n)
    hashes = gram_hashes(wh, n, family)[at] if len(at) else np.empty(0, np.uint64)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        one = np.array([gram_hashes(wh[bounds[d] : bounds[d + 1]], int(count[d]), family)[0] for d in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, one])
    return owner, hashes


def _distinct(body: np.ndarray, offsets: np.ndarray, n: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    found = words(body, offsets, SPACED)
    owner, hashes = _shingles(body, found, n, 0)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[new]
    return hashes[new], np.searchsorted(owner, np.arange(len(offsets))), _shingles(body, found, n, 1)[1][order][new] if both else None


def shingle_sets(body: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending within a text; and offsets."""
    return _distinct(body, offsets, n, False)[:2]


def checked_sets(body: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with a second hash of each shingle, of other byte values and multipliers."""
    return _distinct(body, offsets, n, True)


def exact_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of each text as numbers: equal numbers stand for equal words, compared as bytes.

    Hashes only sort the shingles.  Of equal hashes the words are compared; if they ever differ, all
    shingles are numbered word by word.
    """
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    body = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    found = starts, ends, bounds = words(body, offsets, SPACED)
    owner, hashes = _shingles(body, found, n, 0)
    if not len(owner):
        return [np.empty(0, np.int64) for _ in texts]
    # The words one after another, numbered by their bytes.
    inside = np.zeros(len(body) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(body[np.cumsum(inside[:-1]) > 0]))])
    code = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.concatenate([_runs(bounds, n)[1], bounds[:-1][short]])
    length = np.concatenate([np.full(len(first) - len(short), n), count[short]])
    # The words of a shingle in a row; -1 beyond a short one.
    rows = np.stack([np.where(length > j, code[np.minimum(first + j, len(code) - 1)], -1) for j in range(n)])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(~same)])
    if (rows[:, order[1:]] != rows[:, order[:-1]]).any(axis=0)[same].any():
        number = rows[0]
        for more in rows[1:]:
            number = np.unique(number * (len(code) + 1) + more + 1, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((number, owner))
    owner, number = owner[order], number[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    owner, number = owner[new], number[new]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [number[a:e] for a, e in zip(at[:-1], at[1:], strict=True)]


def set_keys(hashes: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each set."""
    if not len(hashes):
        return np.zeros(len(at) - 1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D + 0x9E3779B97F4A7C15 * salt & (1 << 64) - 1)), dtype=np.uint64)])
    return mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64) * np.uint64(0x14057B7EF767814F))


def sketch_slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for row in range(SKETCH_ROWS):
        yield (hashes * np.uint64(0x9E3779B97F4A7C15 * (2 * row + 1) & ((1 << 64) - 1) | 1)) >> np.uint64(64 - SKETCH_BITS)


def _survey(salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, n, key, check of each document; last, the task's sketch over its distinct sets."""
    names, types = ["doc_id", "n", "key", "check", "sketch"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0)
            for lo, hi, body, offsets in blocks(b.column(1)):
                hashes, at, second = checked_sets(body, offsets)
                n, keys, check = np.diff(at), set_keys(hashes, at, salt), set_keys(second, at)
                new = np.array([k not in seen and not seen.add(k) for k in keys.tolist()])
                part = hashes[np.repeat(new, n)]
                for row, slots in enumerate(sketch_slots(part)):
                    total[row] += np.bincount(slots.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(keys.view(np.int64)), pa.array(check.view(np.int64)), pa.nulls(hi - lo, pa.binary())], names=names)
        if total.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=names)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
    for b in batches:
        for s in b.column(0).to_pylist():
            total += np.frombuffer(zstandard.decompress(s), np.uint32).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["sketch"])


def _merged_sketch(rows: DataFrame) -> np.ndarray:
    """Add the tasks' sketches up in ever fewer tasks; one of fixed size reaches the driver."""
    parts = 16
    while parts:
        rows = rows.repartition(parts).mapInArrow(_add_sketches, "sketch binary")
        parts //= 4
    got = rows.collect()
    return np.frombuffer(zstandard.decompress(got[0].sketch), np.uint32).reshape(SKETCH_ROWS, -1)


def frequency(sketch: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, float]:
    """Estimated documents of each shingle over the mean load of a counter, and the load's spread."""
    got = None
    for row, slots in zip(sketch, sketch_slots(hashes), strict=True):
        x = row[slots.astype(np.int64)]
        got = x if got is None else np.minimum(got, x)
    mean = float(sketch[0].mean(dtype=np.float64))
    return np.maximum(got.astype(np.float64) - mean, 0.0), float(np.sqrt(mean) + 1)


def choose_matches(freq: np.ndarray, n: int, base: int) -> int:
    """How many shared prefix shingles a document asks for, by estimated cost.

    freq: estimated other documents of its shingles, in prefix order.  With ``l`` matches the index
    reads the postings of base + l - 1 shingles, and no more documents can be candidates than hold
    the l-th most frequent one; each is verified at the price of reading ``n`` shingles.
    """
    best, cost = 1, np.inf
    for l in range(1, min(MOST_MATCHES, len(freq) - base + 1, n - base + 1) + 1):
        prefix = freq[: base + l - 1]
        candidates = np.partition(prefix, len(prefix) - l)[len(prefix) - l]
        now = prefix.sum() + len(prefix) + candidates * n
        if now < cost:
            best, cost = l, now
    return best


def prefixes(hashes: np.ndarray, at: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(set, shingle, layer, matches, frequent) of every prefix entry of a block of sets."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    freq, spread = frequency(sketch, hashes)
    unit = 3 * spread
    level = np.where(freq < unit, 0, 1 + np.floor(np.log2(np.maximum(freq, unit) / unit))).astype(np.int64)
    frequent = freq >= max(FREQUENT, 8 * spread)
    level = np.where(frequent, level + 32, level)
    order = np.argsort(owner * 128 + level, kind="stable")
    hashes, level, freq, frequent = hashes[order], level[order], freq[order], frequent[order]
    base = n - -(-percent * n // 100) + 1
    matches = np.ones(len(n), np.int64)
    peak = np.maximum.reduceat(level, at[:-1][n > 0]) if len(hashes) else np.empty(0)
    top = np.zeros(len(n), np.int64)
    top[n > 0] = peak
    for d in np.flatnonzero((n > 0) & (top > 0)).tolist():
        a, e = at[d], at[d + 1]
        # Where no shingle of the longest prefix stands out there is nothing to save.
        if level[min(e, a + base[d] + MOST_MATCHES - 1) - 1]:
            matches[d] = choose_matches(np.where(level[a:e] > 0, freq[a:e], 0.0), int(n[d]), int(base[d]))
    rank = np.arange(len(hashes)) - at[:-1][owner]
    length = base + matches - 1
    take = rank < length[owner]
    layer = np.maximum(1, rank - base[owner] + 2)
    return owner[take], hashes[take], layer[take], matches[owner[take]], frequent[take]


_POSTING = np.dtype([("token", "<u8"), ("key", "<u8"), ("n", "<u4"), ("layer", "u1"), ("matches", "u1")])


def _index(sent, buckets: int, salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = np.concatenate(held)
                held.clear()
                to = (rows["token"] >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order].astype(np.int64)
                edge = np.flatnonzero(np.diff(to, prepend=-1))
                ends = np.append(edge[1:], len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to[edge]), pa.array([rows[a:e].tobytes() for a, e in zip(edge, ends, strict=True)], pa.binary()), pa.nulls(len(edge), pa.int64()), pa.nulls(len(edge), pa.int64())], names=["bucket", "postings", "token", "key"])

        for b in batches:
            for _, _, body, offsets in blocks(b.column(0)):
                hashes, at = shingle_sets(body, offsets)
                keys, n = set_keys(hashes, at, salt), np.diff(at)
                new = np.array([k not in seen and not seen.add(k) for k in keys.tolist()]) & (n > 0)
                if not new.any():
                    continue
                hashes = hashes[np.repeat(new, n)]
                keys, n = keys[new], n[new]
                owner, token, layer, matches, frequent = prefixes(hashes, np.concatenate([[0], np.cumsum(n)]), sent.value)
                rows = np.empty(int((~frequent).sum()), _POSTING)
                cold = ~frequent
                rows["token"], rows["key"], rows["n"], rows["layer"], rows["matches"] = token[cold], keys[owner[cold]], n[owner[cold]], layer[cold], matches[cold]
                held.append(rows)
                if frequent.any():
                    hot = pa.array(token[frequent].view(np.int64)), pa.array(keys[owner[frequent]].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(hot[0]), pa.int64()), pa.nulls(len(hot[0]), pa.binary()), *hot], names=["bucket", "postings", "token", "key"])
                if sum(map(len, held)) > HELD:
                    yield from flush()
        yield from flush()

    return run


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("need", "<i8")])


def _pairs(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's postings, every pair of sets under one shingle whose sizes allow a link."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _POSTING) for x in table["postings"].to_pylist()])
        rows = rows[np.argsort(rows["token"], kind="stable")]
        token = rows["token"]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(rows), bool)
        keep[1:] |= same
        keep[:-1] |= same
        rows = rows[keep]
        found: list[np.ndarray] = []
        if len(rows):
            # A set indexed by several tasks has equal postings: keep one of each.
            rows = np.unique(rows)
            edge = np.append(np.flatnonzero(np.diff(rows["token"].view(np.int64), prepend=0)) if len(rows) > 1 else [0], len(rows))
            edge[0] = 0
            size = np.diff(edge)
            end = np.repeat(edge[1:], size)
            left = np.arange(len(rows))
            step = 1
            while True:
                right = left + step
                ok = right < end[left]
                left = left[ok]
                if not len(left):
                    break
                x, y = rows[left], rows[left + step]
                need = np.minimum(x["matches"], y["matches"])
                small, large = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
                good = (x["layer"] <= need) & (y["layer"] <= need) & (100 * small >= percent * large) & (x["key"] != y["key"])
                if good.any():
                    p = np.empty(int(good.sum()), _PAIR)
                    kx, ky = x["key"][good].view(np.int64), y["key"][good].view(np.int64)
                    # Beyond the prefixes no more than the longer rest can be shared; the whole overlap must be reached.
                    whole = -(-percent * (small[good] + large[good]) // (100 + percent))
                    rest = -(-percent * large[good] // 100) - need[good]
                    p["a"], p["b"], p["need"] = np.minimum(kx, ky), np.maximum(kx, ky), np.maximum(need[good], whole - rest)
                    found.append(p)
                step += 1
        pairs, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, _PAIR), np.empty(0, np.int64))
        return pa.table({"a": pa.array(pairs["a"]), "b": pa.array(pairs["b"]), "need": pa.array(pairs["need"]), "got": pa.array(count)})

    return run


def _block_pairs(hot: DataFrame) -> DataFrame:
    """token, key -> cell (a pair of blocks under one frequent shingle), key: each set in every cell of its block."""
    sized = hot.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_DOCS)).cast("int").alias("blocks"))
    placed = hot.join(sized, "token").withColumn("mine", F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "key").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by matrix products over their common elements."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    on = shared[column]
    owner, column = owner[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, e = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:e], column[a:e] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _sets_of(bodies: list[bytes]) -> list[np.ndarray]:
    texts = pa.array([zstandard.decompress(b).decode() for b in bodies], pa.large_string())
    out: list[np.ndarray] = []
    for _, _, body, offsets in blocks(texts):
        hashes, at = shingle_sets(body, offsets)
        out += [hashes[a:e] for a, e in zip(at[:-1], at[1:], strict=True)]
    return out


def verified(bodies: list[bytes], pairs: list[tuple[int, int]], percent: int) -> list[bool]:
    """Whether each pair of (compressed) texts links, by the words themselves; about ``VERIFIED`` bytes of texts are held at once."""
    out: list[bool] = []
    at = 0
    while at < len(pairs):
        place: dict[int, int] = {}
        texts: list[bytes] = []
        size, to = 0, at
        while to < len(pairs) and (to == at or size < VERIFIED):
            for k in pairs[to]:
                if k not in place:
                    place[k] = len(texts)
                    texts.append(zstandard.decompress(bodies[k]))
                    size += len(texts[-1])
            to += 1
        sets = exact_sets(texts)
        for x, y in ((sets[place[a]], sets[place[b]]) for a, b in pairs[at:to]):
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        at = to
    return out


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links as connect what is linked."""
    left, out = np.ones(len(link), bool), []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            x = queue.pop()
            more = np.flatnonzero(link[x] & left)
            left[more] = False
            out += [(x, int(y)) for y in more]
            queue += more.tolist()
    return out


def _verify_cell(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links within a cell, as few as connect what is linked; each is verified by its words."""

    def run(table: pa.Table) -> pa.Table:
        keys, bodies = table["key"].to_numpy(), table["body"].to_pylist()
        edges: list[tuple[int, int]] = []
        if len(keys) > 1:
            sets = _sets_of(bodies)
            size = np.array([len(s) for s in sets])
            both = overlaps(sets)
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            while True:
                edges = _forest(link)
                wrong = [e for e, ok in zip(edges, verified(bodies, edges, percent), strict=True) if not ok]
                if not wrong:
                    break
                for x, y in wrong:
                    link[x, y] = link[y, x] = False
        return pa.table({"a": pa.array([keys[x] for x, _ in edges], pa.int64()), "b": pa.array([keys[y] for _, y in edges], pa.int64())})

    return run


def _verify_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            n = b.num_rows
            hit = pa.array(verified(b.column(2).to_pylist() + b.column(3).to_pylist(), [(k, n + k) for k in range(n)], percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], names=["a", "b"])

    return run


def _bodies(src: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """key, body (compressed text) of each wanted set, from the one document that ``wanted`` (key, doc_id) names."""
    wanted = materialize(wanted, "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, body, offsets in blocks(b.column(1)):
                want = b.column(0).slice(lo, hi - lo).to_numpy()
                keys = set_keys(*shingle_sets(body, offsets), salt).view(np.int64)
                # An id may stand on several texts; only the set that was asked for counts.
                at = np.flatnonzero(keys == want)
                yield pa.RecordBatch.from_arrays([pa.array(want[at]), pa.array([zstandard.compress(body[offsets[i] : offsets[i + 1]].tobytes(), 3) for i in at], pa.binary())], names=["key", "body"])

    found = src.join(side, "doc_id").select("key", "text").mapInArrow(trimmed(run), "key long, body binary")
    return found


def _real(c: str) -> Column:
    return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)


def _classes(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> tuple[DataFrame, int]:
    """doc_id (NULL_ID for null), n, key, root (of the class), component_id of every row, and the salt of the keys."""
    docs, links, salt = jaccard_links(df, id_col, text_col, percent)
    roots = connected_components(links)
    named = materialize(docs.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("doc_id", "n", "key", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root")), "rooted")
    discard(roots)
    # Written, so that the join has two plain sides and can split a class of very many rows.
    least = materialize(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    joined = named.where("n > 0").join(least, "root").select("doc_id", "n", "key", "root", "component_id")
    return joined.union(named.where("n = 0").select("doc_id", "n", "key", "root", F.col("doc_id").alias("component_id"))), salt


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; the join itself is :func:`jaccard_links`."""
    return _classes(df, id_col, text_col, percent)[0].select(_real("doc_id"), F.col("n").alias("n_shingles"), _real("component_id"))


def _sources(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, key of every row; a, b of linked sets, enough to connect all that are linked; the salt of the keys)."""
    spark = df.sparkSession
    small_batches(spark)
    src = _sources(df, id_col, text_col)
    salt = 0
    while True:
        survey = materialize(src.mapInArrow(trimmed(_survey(salt)), "doc_id long, n long, key long, check long, sketch binary"), "survey")
        docs = survey.where("sketch is null").drop("sketch")
        clash = docs.groupBy("key").agg((F.min("check") != F.max("check")).alias("two"), F.sum("n").alias("n")).agg(F.coalesce(F.max("two"), F.lit(False)), F.sum("n")).first()
        if not clash[0]:
            break
        discard(survey)
        salt += 1
    docs = docs.drop("check")
    sent = spark.sparkContext.broadcast(_merged_sketch(survey.where("sketch is not null").select("sketch")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-(clash[1] or 0) // BUCKET_SHINGLES))
    tasks = max(parts, buckets // 8)
    index = materialize(src.select("text").mapInArrow(trimmed(_index(sent, buckets, salt)), "bucket long, postings binary, token long, key long"), "index")
    pairs = index.where("bucket is not null").select("bucket", "postings").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_pairs(percent), "a long, b long, need long, got long")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("got").alias("got")).where("got >= need").select("a", "b"), "pairs")
    cells = materialize(_block_pairs(index.where("token is not null").select("token", "key").distinct()), "cells")
    discard(index)
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).union(cells.select("key")).distinct()
    # One row a set before the join: the copies of a text are summed up where they are.
    one = docs.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    bodies = materialize(_bodies(src, one.join(wanted, "key", "left_semi"), salt).dropDuplicates(["key"]), "bodies")
    both = pairs.join(bodies.select(F.col("key").alias("a"), F.col("body").alias("left")), "a").join(bodies.select(F.col("key").alias("b"), F.col("body").alias("right")), "b")
    exact = both.select("a", "b", "left", "right").mapInArrow(trimmed(_verify_pairs(percent)), "a long, b long")
    dense = cells.join(bodies, "key").groupBy("cell").applyInArrow(_verify_cell(percent), "a long, b long")
    return docs, exact.union(dense), salt


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of linked rows: of the smallest id (null before all), and of its rows any one.

    All columns are kept; rows without words are linked with nothing and stay.  Ids that stand on one
    row decide by the id alone; rows of repeated ids are told apart by their sets.
    """
    classes, salt = _classes(df.select(id_col, text_col), id_col, text_col)
    classes = materialize(classes, "classes")
    first = materialize(classes.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("f.doc_id", "f.key"), "first")
    often = materialize(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | (F.col("doc_id") == NULL_ID)).select("doc_id"), "often")
    drop = materialize(classes.where("n > 0 and doc_id <> component_id").select("doc_id").distinct().join(often, "doc_id", "left_anti").select(F.col("doc_id").alias("_drop")), "drop")

    def small(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if t.count() <= BROADCAST_IDS else t

    # Rows of null ids are among those of repeated ids.
    alone = df.join(small(drop), df[id_col] == F.col("_drop"), "left_anti")
    if often.isEmpty():
        return alone
    many = small(often.withColumnRenamed("doc_id", "_many"))
    code = F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID))
    alone = alone.join(many, code == F.col("_many"), "left_anti")
    rows = df.join(many, code == F.col("_many"), "left_semi")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = [], []
            for _, _, body, offsets in blocks(b.column(at)):
                hashes, ends = shingle_sets(body, offsets)
                key.append(set_keys(hashes, ends, salt).view(np.int64))
                n.append(np.diff(ends))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(key) if key else [], pa.int64()), pa.array(np.concatenate(n) if n else [], pa.int64())], names=[*b.schema.names, "_key", "_n"])

    keyed = rows.mapInArrow(trimmed(run), T.StructType([*rows.schema.fields, T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType())]))
    chosen = keyed.where("_n > 0").join(small(first.select(F.col("doc_id").alias("_first"), F.col("key").alias("_set"))), (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col("_first")) & (F.col("_key") == F.col("_set")), "left_semi")
    return alone.union(chosen.dropDuplicates([id_col, "_key"]).select(*df.columns)).union(keyed.where("_n = 0").select(*df.columns))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_jaccard_join": op1_jaccard_join}
ORACLES: dict[str, str] = {}
