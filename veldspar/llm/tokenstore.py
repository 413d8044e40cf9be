"""Token ids in a content-addressed store.

Texts are encoded by a public tokenizer and a rolling hash over the ids cuts each document's
stream into chunks (content decides the cuts, so copies and shared passages cut alike).  A chunk
is named by the BLAKE2b digest of its ids; chunks that occur once stay in their document's pack,
chunks that occur more often are stored once in the shared-chunk table.  Each document has a
recipe (digests and lengths of its chunks) and the Merkle root of its digests; each pack has a
manifest row with the Merkle root of its documents.  Reading back puts the recipes together and
verifies every digest and root.

On disk (all below ``path``):

* ``encoded/``   removed when the store is complete;
* ``store/kind=doc``    pack, place, doc_id, n_tokens, before, root, digests, lengths, shared, body
* ``store/kind=chunk``  digest, body
* ``manifest``          pack, n_docs, n_tokens, root

Packs are ascending ranges of doc_id and ``place`` is the place within the pack, so pack and
place give the ascending order of the whole stream.  ``body`` is zstd over little-endian ids of
``width`` bytes.

Defined results: a null text is an empty one and has the end id alone; null ids come first;
records with equal ids keep their own entries (in the order of a hash of their texts); texts of a
million words are one record like others; an empty table makes an empty store; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._store import discard, fresh_path, materialize, small_batches, trimmed
from ._text import EXACT, blocks, word_hashes

END_ID = 2
#: Ids a chunk has on average beyond the least, at least and at most.
MASK_BITS, LEAST, MOST = 9, 128, 4096
WINDOW = 16
#: Text bytes of a pack; most ranges of ids that packs are; sampled rows for each to find them.
PACK_BYTES, MAX_PACKS, SAMPLE_PER_PACK = 16 << 20, 65_536, 40
#: Segments whose ids a worker remembers (about 40 bytes each), and text bytes it encodes in one step.
REMEMBERED, STEP_BYTES = 1_000_000, 1 << 19

# White space of one byte; and of more bytes, as lead bytes with the last byte's values.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WIDE = (((0xC2,), (0x85, 0xA0)), ((0xE1, 0x9A), (0x80,)), ((0xE2, 0x80), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), ((0xE2, 0x81), (0x9F,)), ((0xE3, 0x80), (0x80,)))
#: Class of each byte: 1 letter, 2 digit, 3 other printable ASCII but space, 0 all else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


def white_space(body: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _WHITE[body]
    for lead, last in _WIDE:
        at = np.flatnonzero(body[: len(body) - len(lead)] == lead[0])
        for k, x in enumerate(lead[1:], 1):
            at = at[body[at + k] == x]
        at = at[np.isin(body[at + len(lead)], last)]
        for k in range(len(lead) + 1):
            out[at + k] = True
    return out


def segments(body: np.ndarray, offsets: np.ndarray, whole: bool = False, solid: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where texts may be cut without a change of their ids: the starts of their segments.

    The split pattern of byte-level BPE begins a new piece at a space between two characters that
    are not white space, at a letter after a digit or a digit after a letter, and at a mark after
    a letter or digit; no token spans pieces.  ``solid`` strings (added tokens) are never cut.
    With ``whole`` each text is one segment.
    """
    n = len(body)
    cut = np.zeros(n + 1, bool)
    if n > 1 and not whole:
        white = white_space(body)
        kind = _CLASS[body]
        cut[1 : n - 1] = (body[1:-1] == 32) & ~white[:-2] & ~white[2:]
        ahead, here = kind[:-1], kind[1:]
        cut[1:n] |= (here != ahead) & (ahead > 0) & (ahead < 3) & (here > 0)
        # A space at either end of a text stands between no two characters of it.
        last = offsets[1:][np.diff(offsets) > 0] - 1
        cut[last[body[last] == 32]] = False
        text = body.tobytes() if solid else b""
        for token in solid:
            at = text.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = text.find(token, at + 1)
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """The library's ids of whole texts, with the ids of frequent segments remembered.

    A text is the concatenation of its segments (see :func:`segments`), and each needs to be
    encoded once.  Segments are known by a 64-bit hash, their length and their first bytes; a
    block in which two segments can not be told apart is encoded whole.  Remembered segments take
    flat arrays of bounded size; when these are full, those not met again since are forgotten.  A
    tokenizer of another form (normaliser, other pre-tokenizer, tokens that take white space) is
    given whole texts.
    """

    def __init__(self, text: str) -> None:
        self.tok = Tokenizer.from_str(text)
        form = json.loads(text)
        self.cuttable = byte_level(form)
        self.solid = tuple(t["content"].encode() for t in form.get("added_tokens") or [])
        vocab = self.tok.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.leads[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.width = 2 if len(self.leads) <= 1 << 16 else 4
        self._forget(np.zeros(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        """Keep the remembered segments at these rows only."""
        if len(keep):
            n = self.n[keep]
            at = np.cumsum(n) - n
            self.ids = self.ids[np.arange(n.sum()) + np.repeat(self.at[keep] - at, n)]
            order = np.empty(len(self.n), np.int64)
            order[keep] = np.arange(len(keep))
            on = self.met[self.row]
            self.hash, self.row, self.check, self.at, self.n = self.hash[on], order[self.row[on]].astype(np.int32), self.check[keep], at, n
        else:
            self.ids = np.empty(0, np.uint16 if self.width == 2 else np.uint32)
            self.hash, self.row = np.empty(0, np.uint64), np.empty(0, np.int32)
            self.check, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.met = np.zeros(len(self.n), bool)

    def _library(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new segments, each one's place and number; plain words go some dozens at a time as one text."""
        simple = [w[0] == " " and w[1:].isalnum() for w in new]
        plain, rest = ([k for k, x in enumerate(simple) if x == y] for y in (True, False))
        parts = [plain[lo : lo + 64] for lo in range(0, len(plain), 64)]
        at, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        flat, size = [], 0
        for part, e in zip(parts, self.tok.encode_batch_fast(["".join([new[k] for k in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.ids.dtype)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(part) and starts[0] == 0:
                at[part], n[part] = size + starts, np.diff(starts, append=len(ids))
                flat.append(ids)
                size += len(ids)
            else:
                rest += part
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            got = [e.ids for e in self.tok.encode_batch_fast([new[k] for k in some], add_special_tokens=False)]
            count = np.array([len(x) for x in got])
            at[some], n[some] = size + np.cumsum(count) - count, count
            flat.append(np.array([i for x in got for i in x], self.ids.dtype))
            size += int(count.sum())
        return np.concatenate(flat), at, n

    def batch(self, texts: pa.Array, end_id: int = END_ID) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of texts: the ids of all, each text's followed by ``end_id``; and the ends of the texts' ids."""
        for _, _, body, offsets in blocks(texts, STEP_BYTES):
            starts = segments(body, offsets, not self.cuttable, self.solid)
            of = np.searchsorted(starts, offsets)
            ends = np.append(starts[1:], len(body))
            name, check = segment_names(body, starts, ends)
            _, first, which = np.unique(name, return_index=True, return_inverse=True)
            if (check != check[first][which]).any():
                starts = segments(body, offsets, True)
                of = np.searchsorted(starts, offsets)
                ends = np.append(starts[1:], len(body))
                first = which = np.arange(len(starts))
                ids, at, n = self._library([body[a:e].tobytes().decode() for a, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            else:
                ids, at, n = self._ids(body, starts[first], ends[first], name[first], check[first])
            count = n[which]
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
            stop = np.cumsum(count)
            out = np.full(int(stop[-1] if len(stop) else 0) + len(offsets) - 1, end_id, np.uint32)
            j = np.arange(int(count.sum()))
            out[j + np.repeat(text, count)] = ids[j + np.repeat(at[which] - (stop - count), count)]
            yield out, np.concatenate([[0], stop])[of[1:]] + np.arange(1, len(offsets))

    def _ids(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct segments (ascending by name): an array of ids, and each one's place and number there."""
        if len(self.n) > REMEMBERED:
            keep = np.flatnonzero(self.met)
            self._forget(keep if len(keep) <= REMEMBERED // 2 else keep[:0])
        at, n = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
        place = np.minimum(np.searchsorted(self.hash, name), max(len(self.hash) - 1, 0))
        there = self.hash[place] == name if len(self.hash) else np.zeros(len(name), bool)
        known = there.copy()
        known[there] = self.check[self.row[place[there]]] == check[there]
        row = self.row[place[known]] if len(self.row) else place[known]
        at[known], n[known] = self.at[row], self.n[row]
        self.met[row] = True
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids, at, n
        raw_body = body.tobytes()
        got, where, count = self._library([raw_body[a:e].decode() for a, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        at[new], n[new] = len(self.ids) + where, count
        self.ids = np.concatenate([self.ids, got])
        # Of two segments of one hash the first stays remembered.
        add = new[~there[new]]
        where = np.searchsorted(self.hash, name[add])
        self.hash, self.row = np.insert(self.hash, where, name[add]), np.insert(self.row, where, np.arange(len(self.n), len(self.n) + len(add), dtype=np.int32))
        self.check, self.at, self.n = (np.concatenate([x, y[add]]) for x, y in ((self.check, check), (self.at, at), (self.n, n)))
        self.met = np.concatenate([self.met, np.zeros(len(add), bool)])
        return self.ids, at, n


def byte_level(form: dict) -> bool:
    """Does a tokenizer's file say byte-level BPE with the usual split pattern and nothing before it?"""
    pre = form.get("pre_tokenizer") or {}
    added = form.get("added_tokens") or []
    return (
        (form.get("model") or {}).get("type") == "BPE" and not form["model"].get("dropout") and not form.get("normalizer") and not form.get("post_processor")
        and not form.get("truncation") and not form.get("padding") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    )


def segment_names(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each segment, and a second value made of its first 8 bytes and its length."""
    size = ends - starts
    ahead = np.ndarray(len(body), "<u8", body.tobytes() + bytes(8), strides=(1,))[starts].astype(np.uint64)
    ahead &= np.uint64((1 << 64) - 1) >> (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    return word_hashes(body, starts, ends, EXACT), ahead * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)


_ROLL = np.random.Generator(np.random.PCG64(97)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """For streams that end at ``stops``: start of each, and the ends of its chunks, where a rolling hash of the last WINDOW ids says so.

    No chunk is shorter than WINDOW, so what stands before a stream has no part in its cuts.
    """
    h = _ROLL[ids & 0xFFFF] + ids.astype(np.uint64)
    for step in (1, 2, 4, 8):
        low = h.copy()
        h[step:] = low[step:] + low[:-step] * np.uint64(0x9E3779B97F4A7C15)
    marks = np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1
    of = np.searchsorted(marks, stops).tolist()
    marks = marks.tolist()
    at, lo = 0, 0
    for stop, hi in zip(stops.tolist(), of, strict=True):
        begin, out = at, []
        for m in [*marks[lo:hi], stop]:
            while m - at > MOST:
                at += MOST
                out.append(at)
            if m - at >= LEAST or m == stop and m > at:
                out.append(m)
                at = m
        yield begin, out
        at, lo = stop, hi


NULL_ID = -(1 << 63)


def digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary Merkle tree of the leaves (an odd one is carried up)."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _pack(ids: np.ndarray, width: int) -> bytes:
    return zstandard.compress(ids.astype(f"<u{width}").tobytes(), 3)


def _unpack(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(body), f"<u{width}").astype(np.uint32)


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """This worker's encoder for a tokenizer, kept for later tasks (one at a time)."""
    # Tasks fill all cores already; threads of the library would only add memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    name = hashlib.sha256(text.encode()).digest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(text)
    return _ENCODERS[name]


def pack_bounds(src: DataFrame, pack_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, tie) at which packs end: places in a bounded sample of all rows' order, taken by hash.

    ``tie`` spreads the rows of one id (or without any) over as many packs as they need.
    """
    size, n = src.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    packs = int(min(MAX_PACKS, max(1, -(-(size or 0) // pack_bytes))))
    share = min(1.0, packs * SAMPLE_PER_PACK / max(n, 1))
    if packs == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    some = src.select("doc_id", "tie").where(F.xxhash64("tie", F.lit(5)) <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).toArrow()
    doc, tie = (some[c].to_numpy() for c in ("doc_id", "tie"))
    order = np.lexsort((tie, doc))
    at = order[[len(order) * i // packs for i in range(1, packs)]] if len(order) >= packs else order
    return doc[at], tie[at]


def _pack_of(doc: np.ndarray, tie: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of bounds below each (doc, tie)."""
    n = len(bounds[0])
    # Bounds first where equal, so a row counts every bound at or below its own place.
    order = np.lexsort((np.repeat([0, 1], [n, len(doc)]), np.concatenate([bounds[1], tie]), np.concatenate([bounds[0], doc])))
    out = np.empty(n + len(doc), np.int32)
    out[order] = np.cumsum(order < n)
    return out[n:]


def encode(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """The written table pack, uid, doc_id, tie, n_tokens, digests, lengths, body (all ids), and the ids' width."""
    spark = df.sparkSession
    small_batches(spark)
    src = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    # By the text first, then by the row: rows of one id have an order of their own.
    src = src.select("doc_id", "text", F.expr("(xxhash64(text) & ~1048575L) | (xxhash64(uid) & 1048575L)").alias("tie"))
    bounds = pack_bounds(src, pack_bytes)
    sent = spark.sparkContext.broadcast((tokenizer_json, bounds))
    width = _encoder(tokenizer_json).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, bounds = sent.value
        enc = _encoder(text)
        zip_ids = zstandard.ZstdCompressor(1).compress
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("n_tokens", "digests", "lengths", "body")}
            for ids, stops in enc.batch(b.column(1), end_id):
                raw, small = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype(f"<u{width}").tobytes())
                for (start, ends), stop in zip(cuts(ids, stops), stops.tolist(), strict=True):
                    edges = [start, *ends]
                    rows["n_tokens"].append(stop - start)
                    rows["digests"].append(b"".join([hashlib.blake2b(raw[4 * a : 4 * e], digest_size=16).digest() for a, e in zip(edges[:-1], ends, strict=True)]))
                    rows["lengths"].append(np.diff(edges).astype("<u4").tobytes())
                    rows["body"].append(zip_ids(small[width * start : width * stop]))
            pack = _pack_of(b.column(0).to_numpy(), b.column(2).to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pack), b.column(0), b.column(2), pa.array(rows["n_tokens"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in ("digests", "lengths", "body"))],
                names=["pack", "doc_id", "tie", "n_tokens", "digests", "lengths", "body"],
            )

    out = src.mapInArrow(trimmed(run), "pack int, doc_id long, tie long, n_tokens long, digests binary, lengths binary, body binary")
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "encoded"), width


def _shared_refs(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pack, uid, which, owned of every chunk that occurs more than once (the owner is its first place); and the table of such chunks."""
    one = encoded.select("pack", "uid", "digests").withColumn("which", F.explode(F.sequence(F.lit(0), (F.octet_length("digests") / 16).cast("int") - 1)))
    one = one.select("pack", "uid", "which", F.expr("substring(digests, which * 16 + 1, 16)").alias("digest"))
    place = F.struct("pack", "uid", "which")
    # Written, so that the join has two plain sides and can split a chunk that very many documents hold.
    often = materialize(one.groupBy("digest").agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    return one.join(often, "digest").select(F.col("pack").alias("of_pack"), F.col("uid").alias("of_uid"), "which", (place == F.col("owner")).alias("owned")), often


_DOC = "kind string, pack int, place long, doc_id long, n_tokens long, before long, root binary, digests binary, lengths binary, shared binary, digest binary, body binary"


def _write_pack(width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        marks: dict[int, dict[int, bool]] = {}
        for uid, which, owned in zip(refs.of_uid, refs.which, refs.owned, strict=True):
            marks.setdefault(uid, {})[which] = owned
        docs = docs.sort_values(["doc_id", "tie", "digests", "uid"], kind="stable")
        rows, before = [], 0
        for place, d in enumerate(docs.itertuples(index=False)):
            mine = marks.get(d.uid, {})
            lengths = np.frombuffer(d.lengths, "<u4").astype(np.int64)
            shared = np.zeros(len(lengths), np.uint8)
            shared[list(mine)] = 1
            body = d.body
            if mine:
                ids = _unpack(d.body, width)
                ends = np.cumsum(lengths)
                for w, owned in mine.items():
                    if owned:
                        rows.append(("chunk", d.pack, None, None, None, None, None, None, None, None, d.digests[16 * w : 16 * w + 16], _pack(ids[ends[w] - lengths[w] : ends[w]], width)))
                body = _pack(ids[np.repeat(shared == 0, lengths)], width)
            leaves = [d.digests[i : i + 16] for i in range(0, len(d.digests), 16)]
            doc_id = None if d.doc_id == NULL_ID else int(d.doc_id)
            rows.append(("doc", d.pack, place, doc_id, d.n_tokens, before, merkle(leaves), d.digests, d.lengths, shared.tobytes(), None, body))
            before += d.n_tokens
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _DOC.split(", ")])
        return out.astype({"place": "Int64", "doc_id": "Int64", "n_tokens": "Int64", "before": "Int64"})

    return run


def build(df: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, pack_bytes: int = PACK_BYTES) -> int:
    """Encode ``df`` and write the store below ``path``; returns the ids' width."""
    encoded, width = encode(df, tokenizer_json, id_col, text_col, end_id, pack_bytes)
    refs, often = _shared_refs(encoded)
    packs = encoded.groupBy("pack").cogroup(refs.groupBy("of_pack")).applyInPandas(_write_pack(width), _DOC)
    packs.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/store")
    discard(encoded, often)

    def seal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return pd.DataFrame({"pack": rows.pack.iloc[:1], "n_docs": [len(rows)], "n_tokens": [int(rows.n_tokens.sum())], "root": [merkle(list(rows.root))]})

    docs = _documents(df.sparkSession, path).select("pack", "place", "n_tokens", "root")
    docs.groupBy("pack").applyInPandas(seal, "pack int, n_docs long, n_tokens long, root binary").write.mode("overwrite").parquet(f"{path}/manifest")
    return width


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DOC).parquet(f"{path}/store").where("kind = 'doc'")


def read(spark: SparkSession, path: str, width: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, put together and verified.

    Documents without shared chunks are read where they lie; only the others meet the shared
    chunks in a join.  A digest, length or root that does not hold raises.
    """
    docs = _documents(spark, path).select("pack", "place", "doc_id", "n_tokens", "before", "root", "digests", "lengths", "shared", "body")
    some = F.hex("shared").contains("01")
    refs = docs.where(some).select("pack", "place", F.explode(F.expr("filter(transform(sequence(0, octet_length(shared) - 1), i -> if(substring(shared, i + 1, 1) = X'01', struct(i as which, substring(digests, i * 16 + 1, 16) as digest), null)), x -> x is not null)")).alias("r"))
    chunks = spark.read.schema(_DOC).parquet(f"{path}/store").where("kind = 'chunk'").select("digest", F.col("body").alias("piece"))
    pieces = refs.select("pack", "place", "r.which", "r.digest").join(chunks, "digest").groupBy("pack", "place").agg(F.collect_list(F.struct("which", "piece")).alias("pieces"))
    whole = docs.where(~some).withColumn("pieces", F.lit(None).cast("array<struct<which:int,piece:binary>>"))
    rest = docs.where(some).join(pieces, ["pack", "place"], "left").select(*whole.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            crc, flat = [], []
            for d in b.to_pylist():
                lengths = np.frombuffer(d["lengths"], "<u4").astype(np.int64)
                shared = np.frombuffer(d["shared"], np.uint8)
                own, pieces, at, parts = _unpack(d["body"], width), {p["which"]: p["piece"] for p in d["pieces"] or []}, 0, []
                for k, n in enumerate(lengths.tolist()):
                    if shared[k]:
                        parts.append(_unpack(pieces[k], width))
                    else:
                        parts.append(own[at : at + n])
                        at += n
                leaves = [digest(p) for p in parts]
                if b"".join(leaves) != d["digests"] or merkle(leaves) != d["root"] or at != len(own):
                    raise ValueError(f"document {d['doc_id']} does not match its recipe")
                ids = np.concatenate(parts).astype("<u4")
                if len(ids) != d["n_tokens"]:
                    raise ValueError(f"document {d['doc_id']} has {len(ids)} ids for {d['n_tokens']}")
                crc.append(zlib.crc32(ids.tobytes()))
                if with_ids:
                    flat.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(crc, pa.int64()), *([pa.array(flat, pa.list_(pa.int64()))] if with_ids else [])], names=["pack", "place", "doc_id", "n_tokens", "before", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "pack int, place long, doc_id long, n_tokens long, before long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = whole.unionByName(rest).mapInArrow(trimmed(run), schema)
    # One row per pack (at most MAX_PACKS + 1): running totals of the packs.
    total, rows = 0, []
    for r in spark.read.parquet(f"{path}/manifest").orderBy("pack").select("pack", "n_tokens").collect():
        rows.append((r.pack, total))
        total += r.n_tokens
    starts = spark.createDataFrame(rows, "pack int, base long")
    return found.join(F.broadcast(starts), "pack").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokenizer_text(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "tokens")
    width = build(docs, tokenizer_text(), path)
    return read(spark, path, width)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_content_store": op2_content_store}
ORACLES: dict[str, str] = {}
