"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over texts.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  A window is
``n`` consecutive words of a benchmark item; an item of fewer words (but not none) is one window.
Every window of every text is looked up by a 64-bit hash and each hit is then verified word for
word, so a hash collision can not remove anything.

Size of what is broadcast: flat arrays of about 40 bytes a window (hashes, places, words), never
more than ``max_windows`` windows.  Up to that bound they go out as one set and the texts are
scanned in one narrow pass.  A larger benchmark is dealt into as many sets as needed; each is
scanned by tasks of its own, which open that set alone, and the findings meet by the text's hash.

Defined results: a null or empty text has no words and is never contaminated; a null or empty
item has no windows; windows of an item without id hit words, but it is neither counted nor
listed; items of one id are one item; repeated rows each get their own result; empty tables give
empty results (or no hits); other columns are carried, and one named ``contamination`` is
replaced, as ``withColumn`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialize, small_batches, trimmed, without
from ._text import ALNUM, LOWER, blocks, gram_hashes, word_hashes, words

WINDOW = 10
#: Windows of one broadcast set; about 40 bytes each in the driver and in a worker.
MAX_WINDOWS = 2_000_000

_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
_SCAN = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", _SPANS)
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS_ARROW)])
_FOUND = "contamination"


@dataclass(frozen=True)
class WindowSet:
    """Words of benchmark items as bytes, and by window length: hashes (ascending), and each window's first word and item."""

    body: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: tuple[str | None, ...]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.body, self.starts, self.ends, *(y for w in self.windows.values() for y in w)))

    @staticmethod
    def make(parts: list[tuple[str | None, bytes, np.ndarray, np.ndarray]], n: int) -> WindowSet:
        """``parts``: item, lower-cased bytes, starts and ends of its words."""
        base = np.cumsum([0, *(len(p[1]) for p in parts)])
        first = np.cumsum([0, *(len(p[2]) for p in parts)])
        body = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        starts, ends = (np.concatenate([p[k] + at for p, at in zip(parts, base, strict=False)]) if parts else np.empty(0, np.int64) for k in (2, 3))
        hashes = word_hashes(body, starts, ends) if len(starts) else np.empty(0, np.uint64)
        names = tuple(dict.fromkeys(p[0] for p in parts))
        number = {name: k for k, name in enumerate(names)}
        found: dict[int, list[tuple]] = {}
        for (item, *_), lo, hi in zip(parts, first[:-1].tolist(), first[1:].tolist(), strict=True):
            m = min(n, hi - lo)
            if m:
                found.setdefault(m, []).append((gram_hashes(hashes[lo:hi], m), np.arange(lo, hi - m + 1, dtype=np.int32), np.full(hi - lo - m + 1, number[item], np.int32)))
        windows = {}
        for m, rows in found.items():
            h, word, item = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(h, kind="stable")
            windows[m] = (h[order], word[order], item[order])
        return WindowSet(body, starts.astype(np.int32), ends.astype(np.int32), names, windows)


def equal_words(x: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, y: tuple[np.ndarray, np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Is word ``i`` of ``x`` (bytes, starts, ends; lower-cased here) word ``j`` of ``y``?"""
    a, b = x[1][i], y[1][j].astype(np.int64)
    size = x[2][i] - a
    same = size == y[2][j] - b
    size = np.where(same, size, 0)
    owner = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    differ = LOWER[x[0][a[owner] + step]] != y[0][b[owner] + step]
    same[owner[differ]] = False
    return same


def scan_batch(texts: pa.Array, known: WindowSet) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text: words, words hit, items (sorted), and the hit byte spans (merged)."""
    for lo, hi, body, offsets in blocks(texts):
        starts, ends, bounds = words(body, offsets, ALNUM)
        hashes = word_hashes(body, starts, ends)
        step = np.zeros(len(starts) + 1, np.int64)
        met: list[np.ndarray] = []
        for n, (keys, word, item) in known.windows.items():
            grams = gram_hashes(hashes, n)
            if not len(grams):
                continue
            first = np.searchsorted(keys, grams)
            at = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == grams)
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[doc + 1]
            at, doc = at[inside], doc[inside]
            first, stop = first[at], np.searchsorted(keys, grams[at], "right")
            # Of every hit, all windows of its hash: a hash may stand for several items (or, by accident, windows).
            count = stop - first
            hit = np.repeat(np.arange(len(at)), count)
            entry = np.arange(len(hit)) + np.repeat(first - (np.cumsum(count) - count), count)
            same = np.ones(len(hit), bool)
            for j in range(n):
                left = np.flatnonzero(same)
                same[left] = equal_words((body, starts, ends), at[hit[left]] + j, (known.body, known.starts, known.ends), word[entry[left]] + j)
            hit, entry = hit[same], entry[same]
            met.append(np.unique(doc[hit] * len(known.items) + item[entry]))
            k = at[np.unique(hit)]
            np.add.at(step, k, 1)
            np.add.at(step, k + n, -1)
        items: dict[int, set[str]] = {}
        for x in np.unique(np.concatenate(met)).tolist() if met else []:
            d, i = divmod(x, len(known.items))
            if known.items[i] is not None:
                items.setdefault(d, set()).add(known.items[i])
        hit_words = np.cumsum(step)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit_words)])
        for d in range(hi - lo):
            a, b = bounds[d], bounds[d + 1]
            n_hit = int(total[b] - total[a])
            spans = spans_of(hit_words[a:b], starts[a:b] - offsets[d], ends[a:b] - offsets[d]) if n_hit else []
            yield int(b - a), n_hit, sorted(items.get(d, ())), spans


def spans_of(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Bytes from the first to the last word of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(starts[x]), int(ends[y - 1])) for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _struct(n_words: int, n_hit: int, items: list[str], spans: list[tuple[int, int]]) -> dict:
    return {"n_words": n_words, "n_hit": n_hit, "items": items, "spans": [{"start": a, "end": b} for a, b in spans]}


def window_sets(benchmark: DataFrame, id_col: str, text_col: str, n: int, max_windows: int) -> Iterator[WindowSet]:
    """The benchmark as sets within the bound; the driver holds one at a time, items come in partition by partition."""
    parts, count = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        for _, _, body, offsets in blocks(pa.array([r.t], pa.string())):
            starts, ends, _ = words(body, offsets, ALNUM)
            low = LOWER[body]
            # A long item goes in pieces that overlap by a window less one word.
            for lo in range(0, max(len(starts) - n + 1, min(len(starts), 1)), max_windows):
                a, e = starts[lo : lo + max_windows + n - 1], ends[lo : lo + max_windows + n - 1]
                if count and count + len(a) > max_windows:
                    yield WindowSet.make(parts, n)
                    parts, count = [], 0
                parts.append((r.i, low[a[0] : e[-1]].tobytes(), a - a[0], e - a[0]))
                count += len(a)
    if parts:
        yield WindowSet.make(parts, n)


def _scanner(text_col: str, sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            rows = [_struct(*x) for x in scan_batch(texts, sent.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SCAN_ARROW)], names=[*batch.schema.names, _FOUND])

    return run


def _merge(text_col: str) -> Callable:
    """The findings of several sets (a column of them, last) as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index(text_col)), []
            parts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi, body, offsets in blocks(texts):
                starts, ends, bounds = words(body, offsets, ALNUM)
                for d in range(hi - lo):
                    mine, own = parts[lo + d] or [], slice(bounds[d], bounds[d + 1])
                    first, last = starts[own] - offsets[d], ends[own] - offsets[d]
                    hit = np.zeros(len(first), bool)
                    for x in (x for p in mine for x in p["spans"]):
                        hit[np.searchsorted(first, x["start"]) : np.searchsorted(last, x["end"], "right")] = True
                    rows.append(_struct(len(hit), int(hit.sum()), sorted({i for p in mine for i in p["items"]}), spans_of(hit, first, last)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _SCAN_ARROW)], names=[*batch.schema.names[:-1], _FOUND])

    return run


_Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _plan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, n: int, max_windows: int) -> tuple[DataFrame, _Run]:
    """What to map over, and the function that gives its batches the column of findings."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = [spark.sparkContext.broadcast(s) for s in window_sets(benchmark, item_id, item_text, n, max_windows)]
    sent = sent or [spark.sparkContext.broadcast(WindowSet.make([], n))]
    if len(sent) == 1:
        return docs, _scanner(text_col, sent[0])
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    found = None
    for s in sent:
        one = texts.mapInArrow(trimmed(_scanner("text", s)), T.StructType([*texts.schema.fields, T.StructField(_FOUND, _SCAN)]))
        one = one.where(f"{_FOUND}.n_hit > 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("_sha"), F.col(_FOUND)).dropDuplicates(["_sha"])
        found = one if found is None else found.union(one)
    found = materialize(found.groupBy("_sha").agg(F.collect_list(_FOUND).alias("_parts")), "hits")
    joined = docs.withColumn("_sha", F.sha2(F.col(text_col).cast("binary"), 256)).join(found, "_sha", "left").select(*docs.columns, "_parts")
    return joined, _merge(text_col)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with a struct column ``contamination``: n_words, n_hit, items, spans (bytes).

    One set: one pass over the texts, no shuffle.  Several: a pass for each, whose findings are
    joined to the texts by their SHA-256 (a broadcast if few, by Spark's own measure).
    """
    docs = without(docs, _FOUND)
    src, run = _plan(docs, benchmark, text_col, item_id, item_text, n, max_windows)
    return src.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(_FOUND, _SCAN)]))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    c = F.col(_FOUND)
    return scanned.select(
        F.col(id_col), c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"), (c.n_hit > 0).alias("contaminated"),
    )


def _cut(batch: pa.RecordBatch, text_col: str, drop_share: float, length_col: str | None) -> pa.RecordBatch:
    """A scanned batch without its hit spans, its mostly hit texts and the column that told of them."""
    i = batch.schema.get_field_index(text_col)
    texts = batch.column(i).to_pylist()
    sizes = batch.column(batch.schema.get_field_index(length_col)).to_pylist() if length_col else []
    keep = []
    for d, c in enumerate(batch.column(batch.schema.get_field_index(_FOUND)).to_pylist()):
        keep.append(c["n_hit"] == 0 or c["n_hit"] < drop_share * c["n_words"])
        if c["spans"] and keep[-1]:
            text, at, kept = texts[d].encode(), 0, []
            for s in c["spans"]:
                kept.append(text[at : s["start"]])
                at = s["end"]
            texts[d] = b"\n".join([*kept, text[at:]]).decode()
            if length_col:
                sizes[d] = len(texts[d])
    new = {text_col: texts, length_col: sizes}
    fields = [f for f in batch.schema if f.name != _FOUND]
    columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in fields]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields]).filter(pa.array(keep, pa.bool_()))


def remove_spans(scanned: DataFrame, text_col: str = "text", drop_share: float = 0.5, length_col: str | None = None) -> DataFrame:
    """Cut the hit spans out of each text; drop texts of which at least ``drop_share`` of the words are hit.

    Clean texts come back byte for byte.  What is left on both sides of a cut is parted by a
    line break, so a cut joins no words.  ``length_col`` (characters) follows the texts that change.
    """
    fields = [f for f in scanned.schema.fields if f.name != _FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch, text_col, drop_share, length_col)

    return scanned.mapInArrow(run, T.StructType(fields))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_share: float = 0.5, length_col: str | None = None, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """:func:`scan` and :func:`remove_spans` in one pass of one worker."""
    docs = without(docs, _FOUND)
    src, run = _plan(docs, benchmark, text_col, "item_id", "text", n, max_windows)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield _cut(batch, text_col, drop_share, length_col)

    return src.mapInArrow(trimmed(both), docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return digest(scan(docs, bench))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_decontaminate": op7_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[k : k + least({WINDOW}, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, k FROM dw SEMI JOIN (SELECT DISTINCT n, g FROM bw) USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
              FROM (SELECT DISTINCT doc_id, item_id FROM dw JOIN bw USING (n, g)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
}
