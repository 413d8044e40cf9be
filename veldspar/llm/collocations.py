"""Phrase collocation mining: suffix automata per shard, counts reduced over all shards.

Texts are cut into pieces at punctuation and line ends, pieces into words; all is per language.  A
shard is a few megabytes of one language's words.  Its *generalised suffix automaton* of bounded
depth (all pieces in one automaton, no substring across pieces) has a state for each class of
substrings that end at the same places: its longest member, the length of its suffix link's longest
one, and the number of its end places.  Every substring of the shard up to the depth belongs to one
state, so the states enumerate the substrings with their counts, and one record says many of them.
States are found by sorting places by what ends there, in numpy, not letter by letter.

Counts are reduced over all shards in rounds of growing depth, each of which asks only for what can
still be frequent, as no phrase is more frequent than its parts: words, pairs of frequent words,
triples of frequent pairs, and then phrases of up to five words within runs of frequent triples.
After each of the first three a shard is told which of *its own* words, pairs and triples are
frequent everywhere: no set of phrases is broadcast or reaches the driver, at any size of the corpus.  What is pruned has less
than the asked number of occurrences, so all counts that are needed are exact.

A candidate is scored by its weakest cut.  It is dropped if a longer candidate that holds it occurs
as often: then one exists that is longer by one word, to the left (a suffix link between states of
equal counts) or to the right.

Defined results: null and empty texts have no words; a null language is ``und``; rows repeated with
their id count each; texts of any length are read whole; ties go by score, occurrences and phrase; an
empty table has no phrases; other columns are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import discard, materialize, small_batches, trimmed
from ._text import LOWER, blocks, mix, word_hashes, words

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of words of a shard, and of all languages that a task holds.
SHARD_BYTES, HELD_BYTES = 16 << 20, 24 << 20
#: Distinct words of shards, or places of pairs and triples, for each bucket in which they are summed up.
BUCKET_WORDS, BUCKET_PLACES = 1 << 18, 1 << 20
#: Groups in which the best of a language are found before they meet.
SALTS = 16

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def automaton(codes: np.ndarray, linked: np.ndarray, depth: int, least: int = 1) -> dict[str, np.ndarray]:
    """States of the generalised suffix automaton of bounded depth that hold a substring of ``least`` codes or more.

    ``linked[p]``: the code at p follows that at p - 1 in one piece.  A state is an end place
    ``at`` of its substrings, the ``longest`` and ``shortest`` length of them (the shortest is one
    more than the longest of the state its suffix link leads to) and ``count``, its end places.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = int(rank.max()) + 1 if n else 1
    here = np.arange(n)
    ranks, counts, firsts = [], [], []
    name = rank
    for d in range(1, depth + 1):
        if d > 1:
            # A substring of d codes is named by that of the d - 1 last codes and the code before them.
            here = np.flatnonzero(_ends(linked, d))
            name = ranks[-1][here] * width + rank[here - d + 1]
        _, first, inverse, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        full = np.full(n, -1, np.int64)
        full[here] = inverse.reshape(-1)
        ranks.append(full)
        counts.append(count)
        firsts.append(here[first])
    out: dict[str, list[np.ndarray]] = {"at": [], "longest": [], "shortest": [], "count": []}
    shortest: list[np.ndarray] = []
    for d in range(depth):
        at, count = firsts[d], counts[d]
        low = np.full(len(at), d + 1, np.int64)
        if d:
            suffix = ranks[d - 1][at]
            same = counts[d - 1][suffix] == count
            low[same] = shortest[d - 1][suffix[same]]
        shortest.append(low)
        ends = np.ones(len(at), bool)
        if d + 1 < depth:
            # One more code to the left at all end places: the longer substring is of the same state.
            longer = ranks[d + 1][at]
            ends[longer >= 0] = counts[d + 1][longer[longer >= 0]] != count[longer >= 0]
        keep = ends & (d + 1 >= least)
        for k, v in (("at", at[keep]), ("longest", np.full(int(keep.sum()), d + 1, np.int64)), ("shortest", np.maximum(low[keep], least)), ("count", count[keep])):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}


def _ends(linked: np.ndarray, d: int) -> np.ndarray:
    """Places at which a substring of ``d`` codes ends."""
    ok = np.zeros(len(linked), bool)
    if len(linked) >= d:
        ok[d - 1 :] = True
        for j in range(d - 1):
            ok[d - 1 :] &= linked[d - 1 - j : len(linked) - j]
    return ok


def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, their lowest bytes first, then the next ones: alike bytes stand together and shrink."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(b: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)


def _zip(a: np.ndarray) -> bytes:
    return zstandard.compress(_planes(a), 1)


def _unzip(b: bytes) -> np.ndarray:
    raw = zstandard.decompress(b)
    return _numbers(raw, len(raw) // 4).astype(np.int64)


def _column(body: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words laid one after another as a column."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


_SHARD = "shard long, lang string, n long, distinct long, codes binary, linked binary, words binary, lengths binary, counts binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the task's texts: their words, each distinct one once, numbered."""
    from pyspark import TaskContext

    held: dict[str, list[tuple[np.ndarray, ...]]] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        parts = held.pop(lang)
        size.pop(lang)
        coded = _column(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).dictionary_encode()
        codes, found = coded.indices.to_numpy(), coded.dictionary
        lengths = np.diff(np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8))
        text = b"".join(found.to_pylist())
        linked = np.packbits(np.concatenate([p[2] for p in parts]))
        row = {"shard": number, "lang": lang, "n": len(codes), "distinct": len(found), "codes": _zip(codes), "linked": linked.tobytes(), "words": zstandard.compress(text, 1), "lengths": _zip(lengths), "counts": _zip(np.bincount(codes, minlength=len(found)))}
        number += 1
        return pa.RecordBatch.from_pylist([row], pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in _SHARD.split(", ")]))

    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, hi, body, offsets in blocks(b.column(1)):
            body = LOWER[body]
            starts, ends, bounds = words(body, offsets, _WORD)
            if not len(starts):
                continue
            broken = np.concatenate([[0], np.cumsum(_BREAK[body])])
            linked = np.zeros(len(starts), bool)
            linked[1:] = broken[starts[1:]] == broken[ends[:-1]]
            linked[bounds[:-1][bounds[:-1] < len(starts)]] = False
            inside = np.zeros(len(body) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            solid = np.cumsum(inside[:-1]) > 0
            at = np.concatenate([[0], np.cumsum(solid)])
            flat, lengths = body[solid], ends - starts
            of = np.array(["und" if l is None else l for l in langs[lo:hi]], object)
            for lang in dict.fromkeys(of.tolist()):
                mine = np.repeat(of == lang, np.diff(bounds))
                # Runs of texts of this language.
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    p = flat[at[starts[a]] : at[ends[e - 1]]]
                    held.setdefault(lang, []).append((p, lengths[a:e].astype(np.uint32), linked[a:e]))
                    size[lang] = size.get(lang, 0) + len(p) + 5 * (e - a)
                if size.get(lang, 0) > SHARD_BYTES:
                    yield flush(lang)
            while sum(size.values()) > HELD_BYTES:
                yield flush(max(size, key=lambda l: size[l]))
    while held:
        yield flush(next(iter(held)))


_MESSAGE = "bucket long, shard long, lang string, n long, body binary"
_FOUND = "shard long, lang string, places binary, names binary, word string, key binary, f long"


def _spread(row: dict, bucket: np.ndarray, counts: np.ndarray, columns: list[np.ndarray], keys: Callable[[np.ndarray], bytes] | None = None) -> pa.RecordBatch:
    """A shard's words, pairs or triples, dealt over buckets: places (as steps), counts, and columns of numbers or the words themselves."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    parts = [order[a:e] for a, e in zip(edge, np.append(edge[1:], len(order)), strict=True)]
    bodies = [zstandard.compress(b"".join([_planes(np.diff(p, prepend=0)), _planes(counts[p]), *(_planes(c[p]) for c in columns), keys(p) if keys else b""]), 1) for p in parts]
    cols = [pa.array(bucket[order][edge], pa.int64()), pa.array([row["shard"]] * len(parts), pa.int64()), pa.array([row["lang"]] * len(parts), pa.string()), pa.array([len(p) for p in parts], pa.int64()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _MESSAGE.split(", ")])


def _received(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], bytes]:
    """Items of each message, and of all items the places, counts and columns; and what follows them."""
    n = table["n"].to_numpy()
    whole = [zstandard.decompress(x) for x in table["body"].to_pylist()]
    flat = [np.concatenate([_numbers(x, k, 4 * k * j) for x, k in zip(whole, n.tolist(), strict=True)]) for j in range(2 + columns)]
    ends = np.cumsum(flat[0], dtype=np.int64)
    at = np.cumsum(n) - n
    places = ends - np.repeat(ends[at] - flat[0][at], n)
    return n, places, flat[1].astype(np.int64), flat[2:], b"".join([x[4 * k * (2 + columns) :] for x, k in zip(whole, n.tolist(), strict=True)])


def _lang_salt(lang: str) -> np.uint64:
    h = 0xCBF29CE484222325
    for x in lang.encode():
        h = (h ^ x) * 0x100000001B3 & (1 << 64) - 1
    return np.uint64(h)


def _say_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                text, lengths = np.frombuffer(zstandard.decompress(row["words"]), np.uint8), _unzip(row["lengths"])
                ends = np.cumsum(lengths)
                bucket = (mix(word_hashes(text, ends - lengths, ends) ^ _lang_salt(row["lang"])) % np.uint64(buckets)).astype(np.int64)

                def keys(p: np.ndarray, text=text, starts=ends - lengths, lengths=lengths) -> bytes:
                    size = lengths[p]
                    return text[np.arange(size.sum()) + np.repeat(starts[p] - (np.cumsum(size) - size), size)].tobytes()

                yield _spread(row, bucket, _unzip(row["counts"]), [lengths], keys)

    return run


def _empty(n: int, *names: str) -> dict[str, pa.Array]:
    kinds = dict(c.split() for c in _FOUND.split(", "))
    return {k: pa.nulls(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kinds[k]]) for k in names}


def _answers(table: pa.Table, n: np.ndarray, places: np.ndarray, which: np.ndarray, frequent: np.ndarray, names: np.ndarray | None) -> dict[str, pa.Array]:
    """For each message that holds frequent items: their places in its shard, and the names they got."""
    on = frequent[which]
    owner = np.repeat(np.arange(len(n)), n)[on]
    places, which = places[on], which[on]
    edge = np.searchsorted(owner, np.arange(len(n) + 1))
    some = np.flatnonzero(np.diff(edge))
    pairs = list(zip(edge[some].tolist(), edge[some + 1].tolist(), strict=True))
    told = pa.nulls(len(some), pa.binary()) if names is None else pa.array([names[which[a:e]].astype("<u4").tobytes() for a, e in pairs], pa.binary())
    return {"shard": pa.array(table["shard"].to_numpy()[some], pa.int64()), "places": pa.array([places[a:e].astype("<i4").tobytes() for a, e in pairs], pa.binary()), "names": told}


def _found(answers: dict, rows: dict, n: int) -> pa.Table:
    m = len(answers["shard"])
    order = [c.split()[0] for c in _FOUND.split(", ")]
    top = answers | _empty(m, "lang", "word", "key", "f")
    low = rows | _empty(n, *(k for k in order if k not in rows))
    return pa.table({k: pa.chunked_array([top[k], low[k]]) for k in order})


def _sum_words(buckets: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Counts of a bucket's words over all shards; frequent ones get a number, of which the shards that hold them are told."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, places, counts, (lengths,), flat = _received(table, 1)
        coded = _column(np.frombuffer(flat, np.uint8), lengths).dictionary_encode()
        langs = table["lang"].combine_chunks().dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), n).astype(np.int64)
        pair, which = np.unique(coded.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + lang, return_inverse=True)
        which = which.reshape(-1)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, which, counts)
        frequent = total >= least
        some = np.flatnonzero(frequent)
        word = coded.dictionary.take(pa.array(pair[some] // len(langs.dictionary))).to_pylist()
        tongue = langs.dictionary.take(pa.array(pair[some] % len(langs.dictionary))).to_pylist()
        # By language and word, so that numbers do not hang on the order in which messages came.
        order = sorted(range(len(some)), key=lambda k: (tongue[k], word[k]))
        names = np.zeros(len(pair), np.int64)
        names[some[order]] = 1 + table["bucket"][0].as_py() + buckets * np.arange(len(some))
        if len(some) and names.max() >= 1 << 32:
            raise ValueError("more frequent words than numbers")
        keys = [int(x).to_bytes(4, "big") for x in names[some]]
        rows = {"lang": pa.array(tongue, pa.string()), "word": pa.array([w.decode() for w in word], pa.string()), "key": pa.array(keys, pa.binary()), "f": pa.array(total[some], pa.int64())}
        return _found(_answers(table, n, places, which, frequent, names), rows, len(some))

    return run


def _numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row of columns, rows ascending, and the number of every row's."""
    name = columns[0].astype(np.int64)
    for c in columns[1:]:
        _, first, which = np.unique(name << 32 | c.astype(np.int64), return_index=True, return_inverse=True)
        name = which.reshape(-1).astype(np.int64)
    return first, name


_STREAM = "shard long, lang string, n long, codes binary, linked binary, names binary"


def _stream(row: dict, codes: np.ndarray, ends: np.ndarray, depth: int) -> pa.RecordBatch:
    """A shard's words by their global numbers, where substrings of ``depth`` words end at ``ends``; the others are left out."""
    linked, near = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    for j in range(depth):
        near[ends - j] = True
        if j < depth - 1:
            linked[ends - j] = True
    names, local = np.unique(codes[near], return_inverse=True)
    out = {"shard": row["shard"], "lang": row["lang"], "n": len(local), "codes": _zip(local.reshape(-1)), "linked": np.packbits(linked[near]).tobytes(), "names": _zip(names)}
    return pa.RecordBatch.from_pylist([out], pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((k, pa.binary()) for k in ("codes", "linked", "names"))]))


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return _unzip(row["names"])[_unzip(row["codes"])] if row["n"] else np.empty(0, np.int64), np.unpackbits(np.frombuffer(row["linked"], np.uint8), count=row["n"]).astype(bool)


def _grams(codes: np.ndarray, linked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where substrings of ``depth`` words end, the first such place of each distinct one, and each place's number."""
    at = np.flatnonzero(_ends(linked, depth))
    first, which = _numbered([codes[at - j] for j in range(depth - 1, -1, -1)]) if len(at) else (at, at)
    return at, first, which


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of the places of pairs of frequent words."""
    for b in batches:
        for row in b.to_pylist():
            name = np.zeros(row["distinct"], np.int64)
            for a in row["answers"] or ():
                name[np.frombuffer(a["places"], "<i4")] = np.frombuffer(a["names"], "<u4")
            codes = name[_unzip(row["codes"])]
            linked = np.unpackbits(np.frombuffer(row["linked"], np.uint8), count=len(codes)).astype(bool)
            linked[1:] &= (codes[1:] > 0) & (codes[:-1] > 0)
            yield _stream(row, codes, np.flatnonzero(linked), 2)


def _kept(row: dict, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a stream, and where substrings end whose two parts of ``depth`` words are frequent."""
    codes, linked = _read(row)
    at, first, which = _grams(codes, linked, depth)
    frequent = np.zeros(len(first), bool)
    for a in row["answers"] or ():
        frequent[np.frombuffer(a["places"], "<i4")] = True
    here = np.zeros(len(codes), bool)
    here[at[frequent[which]]] = True
    here[1:] &= here[:-1].copy()
    here[:1] = False
    # Two that follow one another in one piece.
    return codes, np.flatnonzero(here & _ends(linked, depth + 1))


def _frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of the places of triples of two frequent pairs."""
    for b in batches:
        for row in b.to_pylist():
            codes, ends = _kept(row, 2)
            yield _stream(row, codes, ends, 3)


def _say_phrases(buckets: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, linked = _read(row)
                at, first, which = _grams(codes, linked, depth)
                if len(first):
                    columns = [codes[at[first] - j] for j in range(depth - 1, -1, -1)]
                    h = np.full(len(first), _lang_salt(row["lang"]), np.uint64)
                    for c in columns:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
                    yield _spread(row, (h % np.uint64(buckets)).astype(np.int64), np.bincount(which, minlength=len(first)), columns)

    return run


def _sum_phrases(least: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        n, places, counts, columns, _ = _received(table, depth)
        # Numbers of words are of one language each, so phrases are too.
        first, which = _numbered(columns)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, which, counts)
        frequent = total >= least
        some = np.flatnonzero(frequent)
        rows = np.repeat(np.arange(len(n)), n)
        keys = np.stack([c[first[some]] for c in columns], axis=1).astype(">u4")
        low = {"lang": table["lang"].combine_chunks().take(pa.array(rows[first[some]])), "key": pa.array([k.tobytes() for k in keys], pa.binary()), "f": pa.array(total[some], pa.int64())}
        return _found(_answers(table, n, places, which, frequent, None), low, len(some))

    return run


def _say_states(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, key (numbers of the words), shortest, n of the states of the automaton within runs of frequent triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, ends = _kept(row, 3)
                linked, near = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
                for j in range(4):
                    near[ends - j] = True
                    if j < 3:
                        linked[ends - j] = True
                codes, linked = codes[near], linked[near]
                s = automaton(codes, linked, longest, 4)
                big = codes.astype(">u4")
                for lo in range(0, len(s["at"]), 10_000):
                    part = {k: v[lo : lo + 10_000] for k, v in s.items()}
                    keys = [big[p - m + 1 : p + 1].tobytes() for p, m in zip(part["at"].tolist(), part["longest"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(part["shortest"], pa.int64()), pa.array(part["count"], pa.int64())], names=["lang", "key", "shortest", "n"])

    return run


def _told(shards: DataFrame, found: DataFrame) -> DataFrame:
    """Each shard with what it was answered."""
    answers = found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("places", "names")).alias("answers"))
    return shards.join(answers, "shard", "left")


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, key, m, f of all phrases of up to ``longest`` words with ``least`` occurrences or more; lang, key, word of the words; lang, n of all words)."""
    spark = df.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = materialize(df.select(df[lang_col].cast("string").alias("lang"), df[text_col].alias("text")).mapInArrow(trimmed(_shards), _SHARD), "shards")
    size = shards.agg(F.sum("distinct").alias("words"), F.sum("n").alias("n")).first()
    totals = materialize(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    tables: list[DataFrame] = []

    def summed(messages: DataFrame, reduce: Callable, label: str) -> DataFrame:
        tables.append(materialize(messages.repartition(parts, "bucket").groupBy("bucket").applyInArrow(reduce, _FOUND), label))
        return tables[-1]

    # Buckets grow in number with the corpus, not in size.
    buckets = max(2 * parts, -(-(size.words or 0) // BUCKET_WORDS))
    found = summed(shards.select("shard", "lang", "words", "lengths", "counts").mapInArrow(trimmed(_say_words(buckets)), _MESSAGE), _sum_words(buckets, least), "frequent-words")
    words_ = found.where("word is not null").select("lang", "key", "word", "f")
    short = words_.select("lang", "key", "f")
    buckets = max(2 * parts, -(-(size.n or 0) // BUCKET_PLACES))
    streams = _told(shards.select("shard", "lang", "distinct", "codes", "linked"), found).mapInArrow(trimmed(_frequent_words), _STREAM)
    before = shards
    for depth in (2, 3):
        streams = materialize(streams, f"streams-{depth}")
        discard(before)
        before = streams
        found = summed(streams.mapInArrow(trimmed(_say_phrases(buckets, depth)), _MESSAGE), _sum_phrases(least, depth), f"frequent-{depth}")
        short = short.union(found.where("key is not null").select("lang", "key", "f"))
        streams = _told(streams, found).mapInArrow(trimmed(_frequent_pairs if depth == 2 else _say_states(longest)), _STREAM if depth == 2 else "lang string, key binary, shortest long, n long")
    states = streams
    # A state's substrings are the ends of its longest one.
    each = states.withColumn("m", F.explode(F.sequence("shortest", (F.octet_length("key") / 4).cast("long"))))
    each = each.select("lang", F.expr("substring(key, octet_length(key) - 4 * cast(m AS int) + 1)").alias("key"), "n")
    phrases = each.groupBy("lang", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counts = materialize(short.union(phrases).withColumn("m", (F.octet_length("key") / 4).cast("int")).where(F.col("m") <= longest), "phrase-counts")
    words_ = materialize(words_.select("lang", "key", "word"), "phrase-words")
    discard(before, *tables)
    return counts, words_, totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, key, m, a, l, r, n, score of every candidate at its weakest cut."""
    cuts = counts.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "key", "m", F.col("f").alias("a"), "k", F.expr("substring(key, 1, 4 * k)").alias("left_key"), F.expr("substring(key, 4 * k + 1)").alias("right_key"))
    parts = counts.select("lang", "key", "f")
    cuts = cuts.join(parts.select("lang", F.col("key").alias("left_key"), F.col("f").alias("l")), ["lang", "left_key"])
    cuts = cuts.join(parts.select("lang", F.col("key").alias("right_key"), F.col("f").alias("r")), ["lang", "right_key"])
    # One row a language.
    cuts = cuts.join(totals, "lang")
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(1000 AS {wide}) * cast(a AS {wide}) * cast(n AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))")
    best = cuts.withColumn("score", score).groupBy("lang", "key", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "key", "m", "a", "cut.l", "cut.r", "n", "cut.score")


def unsubsumed(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate of equal count holds."""
    longer = candidates.where("m > 2").withColumn("part", F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 4)"), F.expr("substring(key, 5)"))))
    held = longer.groupBy("lang", F.col("part").alias("key")).agg(F.max("a").alias("held"))
    return candidates.join(held, ["lang", "key"], "left").where("held IS NULL OR held < a").drop("held")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, words_, totals = phrase_counts(df, text_col, lang_col, least, longest)
    left = materialize(unsubsumed(materialize(scored(counts, totals), "scored")), "collocations")
    each = left.select("lang", "key", F.posexplode(F.expr("transform(sequence(1, m), i -> substring(key, 4 * i - 3, 4))")).alias("i", "one"))
    named = each.join(words_.withColumnRenamed("key", "one"), ["lang", "one"]).groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = named.select("lang", "key", F.array_join(F.col("w.word"), " ").alias("phrase"))
    rows = left.join(named, ["lang", "key"])
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task orders all of one.
    some = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w)) AS n FROM listed GROUP BY lang
), grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p FROM listed, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m
), f AS MATERIALIZED (SELECT lang, p, len(p) AS m, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100
), cuts AS (SELECT lang, p, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1
), rated AS (
    SELECT c.lang, c.p, c.m, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), held AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, unnest([p[1:m - 1], p[2:]]) AS part, a FROM best WHERE m > 2) GROUP BY lang, part
), kept AS (SELECT b.*, array_to_string(p, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.part = b.p WHERE h.a IS NULL OR h.a < b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {"op13_collocations": _SQL}
