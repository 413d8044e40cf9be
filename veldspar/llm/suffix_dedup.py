"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if a ``SPAN``-byte string that covers it also starts in a text of a smaller id.

1.  Every ``SPAN``-byte window has a minimizer: the least hash of the ``GRAM``-byte strings in it.
    Equal windows have equal minimizers, so a minimizer is what deals windows to shards, and runs of
    windows with one minimizer travel as one string of at most ``2 * SPAN - GRAM`` bytes.  Only
    minimizers that stand in two different texts go on.
2.  A shard makes one suffix array of its distinct strings by induced sorting (their names sorted by
    prefix multiplication, as the strings are short), permuted common prefixes from it, and from
    these the groups of equal windows with the least id of each.
3.  The findings go back to the unit (a part of a task's input, of bounded size) that sent the
    string, where they are laid over its texts.

Texts that are equal as a whole (by SHA-256) are one text with its least id; their further copies
are removed whole without entering any of this.  A minimizer that very many texts share (a common
line) makes no hot shard: its windows are dealt one by one, by their own hash.  Buckets and shards
grow in number with the bytes of the table, so none grows in size.

Defined results: a null text is empty; texts shorter than ``SPAN`` bytes lose nothing; repeats
within one text stay; a null id stands before all others; rows with equal ids are not repeats of
one another, whether their texts are equal or not, and each loses what its own text shares with
smaller ids; a table without repeats loses nothing; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, materialize, small_batches, trimmed
from ._text import blocks, mix
from .suffix_array import permuted_common_prefixes, suffix_array

SPAN, GRAM = 50, 20
#: Texts from which a minimizer's windows are dealt one by one; and the most such minimizers (the most common ones).
COMMON, MOST_COMMON = 8192, 100_000
#: Postings and text bytes a task holds before it sends them on; text bytes of a bucket and of a step over texts.
HELD, UNIT_BYTES, BUCKET_BYTES, STEP_BYTES = 400_000, 12 << 20, 2 << 20, 1 << 17
NULL_ID = -(1 << 63)
EMPTY_SHA = hashlib.sha256(b"").digest()

_RANDOM = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(body: np.ndarray) -> np.ndarray:
    """A hash of every string of ``GRAM`` bytes."""
    h, width = _RANDOM[body], 1
    while 2 * width <= GRAM:
        h, width = h[:-width] * _STEP + h[width:], 2 * width
        h ^= h >> np.uint64(29)
    if width < GRAM:
        h = h[: width - GRAM] * _STEP + h[GRAM - width :]
    return mix(h)


def minimizers(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimizer: text, first and last window's start, minimizer."""
    none = np.empty(0, np.int64)
    n = len(body)
    if n < SPAN:
        return none, none, none, np.empty(0, np.uint64)
    m, width, w = _gram_hashes(body), 1, SPAN - GRAM + 1
    while 2 * width <= w:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    m = np.minimum(m[: len(m) - (w - width)], m[w - width :]) if width < w else m
    # A window must not leave its text.
    size = np.diff(offsets)
    count = np.maximum(size - SPAN + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    if not len(doc):
        return none, none, none, np.empty(0, np.uint64)
    at = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    m = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    # One gram can not serve more than w windows in a row; equal neighbours of another gram start a new run.
    edge = np.flatnonzero(new)
    stop = np.append(edge[1:], len(at))
    long = stop - edge > w
    if long.any():
        more = [np.arange(a, e, w) for a, e in zip(edge[long], stop[long], strict=True)]
        edge = np.sort(np.concatenate([edge[~long], *more]))
        stop = np.append(edge[1:], len(at))
    return doc[edge], at[edge], at[stop - 1], m[edge]


def text_keys(body: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The first 16 bytes of each text's SHA-256."""
    view = memoryview(np.ascontiguousarray(body))
    return [hashlib.sha256(view[a:e]).digest()[:16] for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


# A text is named by 16 bytes; a posting holds 8 of them, for these tell only whether a minimizer is of two texts.
_POST = np.dtype([("gram", "<u8"), ("key", "<u8"), ("texts", "<u4")])
_KNOWN = np.dtype([("key", "<u8"), ("gram", "<u8")])
_SURVEY = "bucket long, kind string, n long, key long, blob binary"
_SURVEY_NAMES = ["bucket", "kind", "n", "key", "blob"]
_SURVEY_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _sliced(rows: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(rows):
        return
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    edge = np.flatnonzero(np.diff(to, prepend=-1))
    for a, e in zip(edge, np.append(edge[1:], len(rows)), strict=True):
        yield int(to[a]), rows[a:e].tobytes()


def _edges(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _survey(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each distinct text's minimizers, by bucket.

    What a task sees of a minimizer in several texts is settled there: those texts' entries go
    straight on as known, and one posting (with their number) stands for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(gram):
                return
            order = np.lexsort((key, gram))
            gram, key = gram[order], key[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            gram, key = gram[new], key[new]
            first = _edges(gram)
            size = np.diff(first, append=len(gram))
            post = np.empty(len(first), _POST)
            post["gram"], post["key"], post["texts"] = gram[first], key[first], size
            out = [(b, "post", None, None, x) for b, x in _sliced(post, (post["gram"] >> np.uint64(40)).astype(np.int64) % buckets)]
            on = np.repeat(size > 1, size)
            known = np.empty(int(on.sum()), _KNOWN)
            known["key"], known["gram"] = key[on], gram[on]
            out += [(buckets + b, "known", None, b, x) for b, x in _sliced(known, (known["key"] % np.uint64(buckets)).astype(np.int64))]
            yield _rows(out, _SURVEY_NAMES, _SURVEY_TYPES)

        for b in batches:
            for _, _, body, offsets in blocks(b.column(0), STEP_BYTES):
                keys = text_keys(body, offsets)
                new = np.array([k not in seen and not seen.add(k) for k in keys])
                doc, _, _, gram = minimizers(body, offsets)
                on = new[doc]
                held.append((gram[on], np.frombuffer(b"".join(keys), "<u8")[::2][doc[on]]))
                if sum(len(g) for g, _ in held) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _settle(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's postings, the minimizers of two texts or more: known entries by text bucket, and common ones."""

    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() != "post":
            return table.select(_SURVEY_NAMES)
        rows = np.concatenate([np.frombuffer(x, _POST) for x in table["blob"].to_pylist()])
        gram, key, texts = (np.ascontiguousarray(rows[c]) for c in ("gram", "key", "texts"))
        order = np.argsort(gram, kind="stable")
        gram, key, texts = gram[order], key[order], texts[order].astype(np.int64)
        first = _edges(gram)
        size = np.diff(first, append=len(gram))
        # The same text may be sent by several tasks: one key throughout is no repeat.
        several = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | (np.maximum.reduceat(texts, first) > 1)
        on = np.repeat(several, size)
        k = np.empty(int(on.sum()), _KNOWN)
        k["key"], k["gram"] = key[on], gram[on]
        out = [(0, "known", None, b, x) for b, x in _sliced(k, (k["key"] % np.uint64(buckets)).astype(np.int64))]
        total = np.add.reduceat(texts, first)
        out += [(0, "common", int(n), int(g), None) for g, n in zip(gram[first][total > COMMON].view(np.int64), total[total > COMMON], strict=True)]
        return pa.Table.from_batches([_rows(out, _SURVEY_NAMES, _SURVEY_TYPES)])

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """The minimizers (sorted) of each text, by the 8 bytes its postings hold."""
    rows = np.concatenate([np.frombuffer(x, _KNOWN) for x in table["blob"].to_pylist()])
    key, gram = np.ascontiguousarray(rows["key"]), np.ascontiguousarray(rows["gram"])
    order = np.lexsort((gram, key))
    key, gram = key[order], gram[order]
    first = _edges(key)
    return pa.table({"short": pa.array([k.tobytes() for k in key[first]], pa.binary()), "grams": pa.array([gram[a:e].tobytes() for a, e in zip(first, np.append(first[1:], len(gram)), strict=True)], pa.binary())})


_STRING = np.dtype([("which", "<u4"), ("size", "u1"), ("many", "u1"), ("least", "<i8")])
_PLACE = np.dtype([("text", "<u4"), ("at", "<u4"), ("which", "<u4")])
_FOUND = np.dtype([("which", "<u4"), ("first", "u1"), ("stop", "u1"), ("least", "<i8")])
_TEXT = np.dtype([("doc", "<i8"), ("key", "V16")])


def _strings(buckets: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Units of texts: the texts and their places (text, start, string) and, by shard, their distinct strings."""
    names, types = ["unit", "part", "shard", "blob"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, amount = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part, amount
            if not held:
                return
            number: dict[bytes, int] = {}
            shard: list[int] = []
            which: list[int] = []
            texts = np.empty(len(held), _TEXT)
            texts["doc"] = [h[0] for h in held]
            texts["key"] = np.frombuffer(b"".join(h[1] for h in held), "V16")
            for _, _, _, strings, to in held:
                for s, b in zip(strings, to, strict=True):
                    k = number.setdefault(s, len(number))
                    if k == len(shard):
                        shard.append(b)
                    which.append(k)
            places = np.empty(len(which), _PLACE)
            places["text"] = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            places["at"], places["which"] = np.concatenate([h[2] for h in held]), which
            held.clear()
            doc = texts["doc"][places["text"]]
            order = np.lexsort((doc, places["which"]))
            sw, sd = places["which"][order], doc[order]
            first = _edges(sw)
            last = np.append(first[1:], len(sw)) - 1
            info = np.empty(len(number), _STRING)
            info["which"], info["least"], info["many"] = np.arange(len(number)), sd[first], sd[first] != sd[last]
            bodies = list(number)
            info["size"] = [len(s) for s in bodies]
            out = [(0, part, None, len(texts).to_bytes(4, "little") + zstandard.compress(texts.tobytes() + places.tobytes(), 1))]
            shards = np.array(shard)
            order = np.argsort(shards, kind="stable")
            edge = np.flatnonzero(np.diff(shards[order], prepend=-1))
            for a, e in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                mine = order[a:e]
                head = info[mine].tobytes()
                out.append((0, part, int(shards[mine[0]]), len(mine).to_bytes(4, "little") + zstandard.compress(head + b"".join(bodies[k] for k in mine.tolist()), 1)))
            part, amount = part + 1, 0
            yield _rows(out, names, types)

        for b in batches:
            ids, keys, grams = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            texts = pa.array([zstandard.decompress(x).decode() for x in b.column(3).to_pylist()], pa.large_string())
            for lo, _, body, offsets in blocks(texts, STEP_BYTES):
                doc, start, stop, gram = minimizers(body, offsets)
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                raw = body.tobytes()
                for d in range(len(offsets) - 1):
                    x = slice(bounds[d], bounds[d + 1])
                    known = np.frombuffer(grams[lo + d], "<u8")
                    g = gram[x]
                    on = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                    if not on.any():
                        continue
                    g, a, e = g[on], start[x][on], stop[x][on] + SPAN
                    to = (g >> np.uint64(20)).astype(np.int64) % buckets
                    wide = np.isin(g, common)
                    if wide.any():
                        runs = [np.arange(p, q - SPAN + 1) for p, q in zip(a[wide], e[wide], strict=True)]
                        single = np.concatenate(runs)
                        a, e = np.concatenate([a[~wide], single]), np.concatenate([e[~wide], single + SPAN])
                        own = [int.from_bytes(hashlib.blake2b(raw[p : p + SPAN], digest_size=6).digest(), "little") % buckets for p in single.tolist()]
                        to = np.concatenate([to[~wide], own])
                    strings = [raw[p:q] for p, q in zip(a.tolist(), e.tolist(), strict=True)]
                    held.append((ids[lo + d], keys[lo + d], a - offsets[d], strings, to.tolist()))
                    amount += 120 * len(a)
                if amount > UNIT_BYTES:
                    yield from flush()
        yield from flush()

    return run


def repeated_windows(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window's start, least id) of every window, over one suffix array of distinct strings."""
    size = np.array([len(s) for s in strings])
    body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    text = body.astype(np.int64) + 2
    text[ends] = 1
    text = np.append(text, 0)
    # Distinct strings of at most 2 * SPAN bytes: no common prefix is longer than two of them.
    sa = suffix_array(text, 258, short=True)
    common = permuted_common_prefixes(text, sa)
    owner = np.repeat(np.arange(len(strings)), size + 1)
    left = ends[owner] - np.arange(len(owner))
    sa = sa[1:]
    windows = left[sa] >= SPAN
    # A suffix too short for a window stands between no two equal windows.
    group = np.cumsum(common[sa] < SPAN)
    at, group = sa[windows], group[windows]
    first = _edges(group)
    best = np.minimum.reduceat(least[owner[at]], first) if len(first) else np.empty(0, np.int64)
    best = np.repeat(best, np.diff(first, append=len(at)))
    order = np.argsort(at)
    at, best = at[order], best[order]
    return owner[at], at - (ends - size)[owner[at]], best


def _shard(table: pa.Table) -> pa.Table:
    """Suffix arrays over a shard's distinct strings; findings for each unit that sent some."""
    number: dict[bytes, int] = {}
    sent: list[tuple] = []
    for unit, part, blob in zip(table["unit"].to_pylist(), table["part"].to_pylist(), table["blob"].to_pylist(), strict=True):
        n, x = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:])
        info = np.frombuffer(x, _STRING, n)
        ends = np.cumsum(info["size"], dtype=np.int64) + n * _STRING.itemsize
        names = [number.setdefault(x[e - s : e], len(number)) for s, e in zip(info["size"].tolist(), ends.tolist(), strict=True)]
        sent.append((unit, part, info, np.array(names)))
    strings = list(number)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    for _, _, info, names in sent:
        np.minimum.at(least, names, info["least"])
    owner, at, best = repeated_windows(strings, least)
    # Runs of windows with one least id.
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])
    edge = np.flatnonzero(new)
    owner, first, stop, best = owner[edge], at[edge], at[np.append(edge[1:], len(at)) - 1] + 1, best[edge]
    bounds = np.searchsorted(owner, np.arange(len(strings) + 1))
    rows = []
    for unit, part, info, names in sent:
        count = bounds[names + 1] - bounds[names]
        j = np.arange(count.sum()) + np.repeat(bounds[names] - (np.cumsum(count) - count), count)
        k = np.repeat(np.arange(len(names)), count)
        on = (best[j] < info["least"][k]) | (info["many"][k] > 0)
        found = np.empty(int(on.sum()), _FOUND)
        found["which"], found["first"], found["stop"], found["least"] = info["which"][k[on]], first[j[on]], stop[j[on]], best[j[on]]
        if len(found):
            rows.append((unit, part, zstandard.compress(found.tobytes(), 1)))
    return pa.Table.from_batches([_rows(rows, ["unit", "part", "blob"], [pa.int64(), pa.int64(), pa.binary()])])


def _lay(places: pa.Table, found: pa.Table) -> pa.Table:
    """doc_id, key and the removed byte spans (merged) of a unit's texts."""
    rows = []
    if places.num_rows and found.num_rows:
        blob = places["blob"][0].as_py()
        n, x = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:])
        texts, p = np.frombuffer(x, _TEXT, n), np.frombuffer(x, _PLACE, offset=n * _TEXT.itemsize)
        f = np.concatenate([np.frombuffer(zstandard.decompress(x), _FOUND) for x in found["blob"].to_pylist()])
        f = f[np.argsort(f["which"], kind="stable")]
        a, e = np.searchsorted(f["which"], p["which"], "left"), np.searchsorted(f["which"], p["which"], "right")
        j = np.arange((e - a).sum()) + np.repeat(a - (np.cumsum(e - a) - (e - a)), e - a)
        k = np.repeat(np.arange(len(p)), e - a)
        on = f["least"][j] < texts["doc"][p["text"][k]]
        j, k = j[on], k[on]
        text, lo, hi = p["text"][k].astype(np.int64), p["at"][k].astype(np.int64) + f["first"][j], p["at"][k].astype(np.int64) + f["stop"][j] - 1 + SPAN
        order = np.lexsort((lo, text))
        text, lo, hi = text[order], lo[order], hi[order]
        edge = _edges(text) if len(text) else []
        for x, y in zip(edge, np.append(edge[1:], len(text)) if len(text) else [], strict=True):
            top = np.maximum.accumulate(hi[x:y])
            cut = np.append(True, lo[x + 1 : y] > top[:-1])
            starts = lo[x:y][cut]
            stops = top[np.append(np.flatnonzero(cut)[1:], y - x) - 1]
            rows.append((int(texts["doc"][text[x]]), texts["key"][text[x]].tobytes(), np.stack([starts, stops], 1).astype("<i8").tobytes()))
    return pa.Table.from_batches([_rows(rows, ["doc_id", "key", "spans"], [pa.int64(), pa.binary(), pa.binary()])])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key and compressed body of texts; a row that a task meets again is sent once."""
    seen: set[tuple] = set()
    for b in batches:
        for lo, _, body, offsets in blocks(b.column(1)):
            view, ends, keys = memoryview(np.ascontiguousarray(body)), offsets.tolist(), text_keys(body, offsets)
            ids = b.column(0).slice(lo, len(keys)).to_pylist()
            on = [d for d, x in enumerate(zip(ids, keys, strict=True)) if x not in seen and not seen.add(x)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in on], pa.int64()), pa.array([keys[d] for d in on], pa.binary()), pa.array([zstandard.compress(view[ends[d] : ends[d + 1]], 1) for d in on], pa.binary())], names=["doc_id", "key", "packed"])


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _key(sha: Column) -> Column:
    return F.substring(sha, 1, 16)


def _sha(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, sha, first of every row; doc_id, key, spans of first texts that lose bytes).

    ``first`` tells whether a row's id is the least of its text; other rows are copies.  ``key`` is
    the beginning of ``sha``, ``parts`` holds pairs of little-endian longs: start and end of each
    removed run, ascending.
    """
    spark = df.sparkSession
    small_batches(spark)
    src = _named(df, id_col, text_col)
    named = materialize(src.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _sha().alias("sha")), "names")
    # Written first, so that the join below has two plain sides and can split a text of very many rows.
    least = materialize(named.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    rows = materialize(named.join(least, "sha", "left").select("doc_id", "n_bytes", "sha", (F.col("doc_id") == F.coalesce("least", "doc_id")).alias("first")), "rows")
    discard(named, least)
    size = rows.where("first").agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-size // BUCKET_BYTES))
    tasks = max(parts, buckets // 16)
    survey = src.select("text").mapInArrow(trimmed(_survey(buckets)), _SURVEY)
    survey = materialize(survey.repartition(tasks, "bucket", "kind").groupBy("bucket", "kind").applyInArrow(_settle(buckets), _SURVEY), "minimizers", "kind")
    top = survey.where("kind = 'common'").orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()["key"].to_numpy()
    common = np.sort(top.view(np.uint64)) if len(top) else np.empty(0, np.uint64)
    known = survey.where("kind = 'known'").select("key", "blob").groupBy("key").applyInArrow(_by_text, "short binary, grams binary")
    firsts = rows.where("first").select("doc_id", _key(F.col("sha")).alias("key")).distinct()
    wanted = firsts.withColumn("short", F.substring("key", 1, 8)).join(known, "short").select("doc_id", "key", "grams")
    packed = src.where(F.octet_length("text") >= SPAN).mapInArrow(trimmed(_squeeze), "doc_id long, key binary, packed binary")
    joined = packed.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "grams", "packed")
    units = joined.mapInArrow(trimmed(_strings(buckets, common)), "unit long, part long, shard long, blob binary").select(F.spark_partition_id().cast("long").alias("unit"), "part", "shard", "blob")
    units = materialize(units, "units")
    discard(survey)
    sent = units.where("shard is not null").repartition(tasks, "shard").groupBy("shard").applyInArrow(_shard, "unit long, part long, blob binary")
    places = units.where("shard is null").select(F.col("unit").alias("u"), F.col("part").alias("p"), "blob")
    spans = places.groupBy("u", "p").cogroup(sent.groupBy("unit", "part")).applyInArrow(_lay, "doc_id long, key binary, spans binary")
    spans = materialize(spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("parts")), "spans")
    discard(units)
    return rows, spans


def merge_spans(parts: list[bytes]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted((int(a), int(e)) for x in parts for a, e in np.frombuffer(x, "<i8").reshape(-1, 2)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _cut(with_kept: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, out = b.column(3).to_pylist(), []
            for lo, _, body, offsets in blocks(b.column(2)):
                raw = body.tobytes()
                for d in range(len(offsets) - 1):
                    a, n = int(offsets[d]), int(offsets[d + 1] - offsets[d])
                    runs, kept, at = merge_spans(parts[lo + d]), [], 0
                    for x, y in runs:
                        kept.append(raw[a + at : a + x])
                        at = y
                    rest = b"".join([*kept, raw[a + at : a + n]])
                    out.append((n - len(rest), len(runs), hashlib.sha256(rest).digest(), rest if with_kept else None))
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "key", "cut_bytes", "cut_spans", "cut_sha", "kept"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes; null: all of them) of every row."""
    rows, spans = repeated_spans(df, id_col, text_col)
    # Texts that lose bytes are fetched once more; all others are settled by the first pass.
    # A few bytes per such text: broadcast below the session's limit, else both sides are shuffled.
    src = _named(df, id_col, text_col).where(F.octet_length("text") >= SPAN).withColumn("key", _key(_sha()))
    cut = src.join(spans, ["doc_id", "key"]).select("doc_id", "key", "text", "parts")
    done = cut.mapInArrow(trimmed(_cut(with_kept)), "doc_id long, key binary, cut_bytes long, cut_spans long, cut_sha binary, kept binary").dropDuplicates(["doc_id", "key"])
    copy = ~F.col("first") & (F.col("n_bytes") >= SPAN)
    out = rows.withColumn("key", _key(F.col("sha"))).join(done, ["doc_id", "key"], "left").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(F.col("first"), F.coalesce("cut_bytes", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(F.col("first"), F.coalesce("cut_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(copy, F.lit(EMPTY_SHA)).when(F.col("first"), F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")))).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_kept else out.drop("kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
