"""Vector bin packing of token ids into training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples), and loss-bearing tokens.
An example is the ids of its prompt (no loss), of its text and an end id (both bear loss, but for
the first id of an example, which nothing precedes).  It may be cut anywhere.

*Dot product.*  A task reads its examples in windows of a million ids or some thousand examples.  One sequence
is filled at a time: of the examples that fit into what is left of all three limits, the one goes in
whose demands, as shares of the limits and weighted by how scarce each is in the window, have
the largest dot product with the shares left.  When none fits whole, the one of the largest dot
product is cut so that it fills the sequence to its tightest limit; its rest stays in the window.
What a window leaves is carried into the next one.  A sequence that ends below the token limit
(the segments or the loss run out, or the task's examples do) ends at a power of two, where no
padding is needed: what lies beyond goes back into the window.

Every task packs what it reads, so nothing is shuffled, no key can be hot, and a lost task is done
anew from its own input.  Sequence numbers hold the task's in their upper bits.

Ids: a tokenizer whose pieces never hold white space is given each distinct part of a word once;
what is remembered is bounded.  Another form of tokenizer is given whole texts.

Defined results: null and empty texts have the end id only; null ids are kept; rows repeated with
their id are examples of their own, each with all its pieces; a text of any length is cut into as
many pieces as it needs; equal dot products go to the example that came first; an empty table has no
sequences; columns other than the named ones are never read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._store import materialize, small_batches, trimmed
from ._text import LOWER, SPACED, blocks, words

END_ID = 2
TOKENS, SEGMENTS, LOSS = 4096, 64, 4096
#: Ids and examples of a window.
WINDOW_IDS, WINDOW_EXAMPLES = 1 << 20, 4096
#: Parts of words remembered by a worker.
REMEMBERED = 300_000
STEP_BYTES = 1 << 20


# Ids


def by_words(form: dict) -> bool:
    """Does a tokenizer's file treat what stands between white space on its own?

    That holds for a BPE over the matches of a pattern without white space, after composing
    characters, lower-casing and making white space single; added tokens that hold no white space
    and take none up do not change it.
    """
    norm, pre, added = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}, form.get("added_tokens") or []
    steps = norm.get("normalizers", [norm] if norm else [])
    splits = pre.get("pretokenizers", [pre] if pre else [])

    def plain(step: dict) -> bool:
        return step["type"] in ("NFC", "Lowercase") or step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "

    first = splits[0] if splits else {}
    # Matches of the pattern are kept, all else (white space above all) goes.
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
    rest = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in splits[1:])
    return bool(
        (form.get("model") or {}).get("type") == "BPE" and not form["model"].get("dropout") and not form.get("post_processor") and not form.get("truncation") and not form.get("padding")
        and all(plain(s) for s in steps) and kept and rest and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
    )


#: Class of each byte: 1 letter, 2 digit, 3 other printable ASCII but space, 0 all else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


def segments(body: np.ndarray, offsets: np.ndarray, solid: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts that are encoded on their own, and the offsets of texts into them.

    Texts are cut at white space, around digits, and between ASCII letters and marks, as the pattern
    does; not behind an apostrophe, where a contraction may stand, and not within ``solid`` strings.
    """
    starts, ends, _ = words(body, offsets, SPACED)
    kind = _CLASS[body]
    cut = np.zeros(len(body) + 1, bool)
    if len(body) > 1:
        before, here = kind[:-1], kind[1:]
        cut[1:-1] = (before > 0) & (here > 0) & ((before != here) | (here == 2)) & ~((body[:-1] == 39) & (here == 1))
    text = body.tobytes() if solid else b""
    for token in solid:
        at = text.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False
            at = text.find(token, at + 1)
    cut[offsets] = False
    inner = np.flatnonzero(cut)
    # A cut ends one part and starts another.
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner])), np.searchsorted(np.sort(np.concatenate([starts, inner])), offsets)


class Encoder:
    """Ids of whole texts by the library, each distinct part of them encoded once while it is remembered."""

    def __init__(self, text: str) -> None:
        self.tok = Tokenizer.from_str(text)
        form = json.loads(text)
        self.cuttable = by_words(form)
        self.solid = tuple(t["content"].encode() for t in form.get("added_tokens") or [])
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        suffix = form["model"].get("end_of_word_suffix") if self.cuttable else None
        self.last = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        if suffix:
            self.last[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.n = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _library(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, in the order given, and their numbers."""
        ids: list[np.ndarray | None] = [None] * len(some)
        # Plain words go some dozens at a time: each ends with an id that ends a word.
        plain = [k for k, w in enumerate(some) if w.isalpha() and w.isascii()] if self.last.any() else []
        groups = [plain[lo : lo + 64] for lo in range(0, len(plain), 64)]
        for lo in range(0, len(groups), 64):
            part = groups[lo : lo + 64]
            for group, e in zip(part, self.tok.encode_batch_fast([b" ".join([some[k] for k in g]).decode() for g in part], add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.last[got]) + 1
                if len(stops) == len(group) and stops[-1] == len(got):
                    for k, x in zip(group, np.split(got, stops[:-1]), strict=True):
                        ids[k] = x
        rest = [k for k, x in enumerate(ids) if x is None]
        for lo in range(0, len(rest), 512):
            part = rest[lo : lo + 512]
            for k, e in zip(part, self.tok.encode_batch_fast([some[k].decode() for k in part], add_special_tokens=False), strict=True):
                ids[k] = np.array(e.ids, np.uint32)
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of texts: the ids of all, and the n + 1 offsets of the texts into them."""
        for _, _, body, offsets in blocks(texts, STEP_BYTES):
            if not self.cuttable:
                ids, n = self._library([body[a:e].tobytes() for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield ids, np.concatenate([[0], np.cumsum(n)])
                continue
            low, raw = LOWER[body], body.tobytes()
            # Lower-casing must not make an added token of what is none.
            if all(low.tobytes().count(t) == raw.count(t) for t in self.solid):
                body = low
            starts, ends, bounds = segments(body, offsets, self.solid)
            inside = np.zeros(len(body) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(body[np.cumsum(inside[:-1]) > 0]))])
            coded = column.dictionary_encode()
            found = coded.dictionary.to_pylist()
            if len(self.known) > REMEMBERED:
                self._forget()
            new = [w for w in found if w not in self.known]
            if new:
                ids, n = self._library(new)
                self.known.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
                self.at, self.n = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n]), np.concatenate([self.n, n])
                self.flat = np.concatenate([self.flat, ids])
            which = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))[coded.indices.to_numpy()]
            count = self.n[which]
            stop = np.concatenate([[0], np.cumsum(count)])
            yield self.flat[np.arange(stop[-1]) + np.repeat(self.at[which] - stop[:-1], count)], stop[bounds]
            if len(self.flat) > 8 * REMEMBERED:
                # Few but very long parts: whole texts without white space.
                self._forget()


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """This worker's encoder for a tokenizer."""
    # Tasks fill all cores already; threads of the library would only add memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    name = hashlib.sha256(text.encode()).digest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(text)
    return _ENCODERS[name]


# Packing


@dataclass
class Example:
    """What is still to be placed of an example: ids from ``at`` on, of which those from ``loss_from`` on bear loss."""

    doc_id: int | None
    ids: np.ndarray
    loss_from: int
    at: int = 0

    def loss(self, n: int) -> int:
        return max(0, self.at + n - max(self.at, self.loss_from))

    def most(self, tokens: int, loss: int) -> int:
        """How many ids fit into what is left."""
        free = max(0, self.loss_from - self.at)
        return min(tokens, len(self.ids) - self.at, free + loss)


@dataclass
class Piece:
    example: Example
    start: int
    length: int


class Packer:
    """Fills sequences one after another from a window of examples."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("every limit is at least 1")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.window: list[Example] = []
        self.ids = 0

    def add(self, e: Example) -> Iterator[list[Piece]]:
        self.window.append(e)
        self.ids += len(e.ids) - e.at
        if self.ids > WINDOW_IDS or len(self.window) > WINDOW_EXAMPLES:
            yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[list[Piece]]:
        """Sequences of the window's examples; but for the last time, a part of it stays for the next window."""
        keep_ids, keep_examples = (0, 0) if last else (WINDOW_IDS // 8, WINDOW_EXAMPLES // 8)
        pool = self.window
        left = np.array([len(e.ids) - e.at for e in pool], np.int64)
        lost = np.array([e.loss(len(e.ids) - e.at) for e in pool], np.int64)
        # How scarce each limit is: the window's demand of it by its size.
        demand = np.array([left.sum(), len(pool), lost.sum()]) / self.limits
        weight = demand / max(demand.sum(), 1e-300) / self.limits
        todo, waiting = int(left.sum()), len(pool)

        def take(k: int, n: int) -> Piece:
            nonlocal todo, waiting
            e = pool[k]
            p = Piece(e, e.at, n)
            e.at += n
            self._count(k, left, lost, pool)
            todo -= n
            waiting -= left[k] == 0
            return p

        def give_back(p: Piece, k: int, n: int) -> None:
            """The last ``n`` ids of a piece return to the window."""
            nonlocal todo, waiting
            waiting += left[k] == 0
            p.length -= n
            p.example.at -= n
            self._count(k, left, lost, pool)
            todo += n

        while todo and (todo > keep_ids or waiting > keep_examples):
            room = np.array([self.tokens, self.segments, self.loss], np.int64)
            placed: list[tuple[Piece, int]] = []
            while room[0] and room[1] and todo:
                a, b, c = (weight * room / self.limits).tolist()
                score = np.where(left > 0, a * left + b + c * lost, -1.0)
                fits = (left > 0) & (left <= room[0]) & (lost <= room[2])
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    n = int(left[k])
                else:
                    k = int(np.argmax(score))
                    n = pool[k].most(int(room[0]), int(room[2]))
                    if not n:
                        # No loss is left: only prompts can still go in.
                        free = np.where(left > lost, left - lost, 0) * np.array([e.at < e.loss_from for e in pool])
                        if not free.any():
                            break
                        k = int(np.argmax(free))
                        n = pool[k].most(int(room[0]), 0)
                if placed and placed[-1][1] == k:
                    # The same example goes on: no piece of its own.
                    placed[-1][0].length += take(k, n).length
                else:
                    placed.append((take(k, n), k))
                    room[1] -= 1
                room[0] -= n
                room[2] = self.loss - sum(max(0, p.start + p.length - max(p.start, p.example.loss_from)) for p, _ in placed)
            used = sum(p.length for p, _ in placed)
            if used < self.tokens:
                # To the power of two below: no padding.
                over = used - (1 << (used.bit_length() - 1))
                while over:
                    p, k = placed[-1]
                    n = min(over, p.length)
                    give_back(p, k, n)
                    over -= n
                    if not p.length:
                        placed.pop()
            yield [p for p, _ in placed]
        self.window = [e for e in pool if e.at < len(e.ids)]
        self.ids = todo

    @staticmethod
    def _count(k: int, left: np.ndarray, lost: np.ndarray, pool: list[Example]) -> None:
        e = pool[k]
        left[k] = len(e.ids) - e.at
        lost[k] = e.loss(int(left[k]))


_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64()), ("loss", pa.int64())])
_SEQUENCE = "sequence_id long, n_tokens long, n_loss long, ids binary, pieces array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long, loss: long>>"


def pack(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end_id: int = END_ID) -> tuple[DataFrame, int]:
    """The written table of sequences, and the bytes of an id in it.

    sequence_id, n_tokens, n_loss, ids (little-endian, without padding) and the pieces: doc_id,
    start and length in the example, offset in the sequence, ids of the whole example, and ids of
    the piece that bear loss.
    """
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(tokenizer_json)
    width = _encoder(tokenizer_json).width
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = _encoder(sent.value), Packer(tokens, segments, loss)
        number = TaskContext.get().partitionId() << 32

        def examples() -> Iterator[Example]:
            for b in batches:
                ids, row = b.column(0).to_pylist(), 0
                heads = enc.batch(b.column(2)) if prompt_col else None
                ahead: list[np.ndarray] = []
                for flat, at in enc.batch(b.column(1)):
                    for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        while heads is not None and len(ahead) <= row:
                            h, edge = next(heads)
                            ahead += [h[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                        head = ahead[row] if heads is not None else flat[:0]
                        whole = np.concatenate([head, flat[a:e], [end_id]]).astype(np.uint32)
                        yield Example(ids[row], whole, max(1, len(head)))
                        row += 1

        def batch(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            pieces, out, count, lost = [], [], [], []
            for s in sequences:
                at, rows = 0, []
                for p in s:
                    e = p.example
                    rows.append({"doc_id": e.doc_id, "start": p.start, "length": p.length, "offset": at, "doc_tokens": len(e.ids), "loss": max(0, p.start + p.length - max(p.start, e.loss_from))})
                    at += p.length
                pieces.append(rows)
                out.append(np.concatenate([p.example.ids[p.start : p.start + p.length] for p in s]).astype(f"<u{width}").tobytes())
                count.append(at)
                lost.append(sum(r["loss"] for r in rows))
            first, number = number, number + len(sequences)
            return pa.RecordBatch.from_arrays([pa.array(range(first, number), pa.int64()), pa.array(count, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.binary()), pa.array(pieces, pa.list_(_PIECE))], names=["sequence_id", "n_tokens", "n_loss", "ids", "pieces"])

        def sequences() -> Iterator[list[Piece]]:
            for e in examples():
                yield from packer.add(e)
            yield from packer.pack(True)

        held: list[list[Piece]] = []
        for s in sequences():
            held.append(s)
            if len(held) == 64:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.alias("prompt"))
    return materialize(src.mapInArrow(trimmed(run), _SEQUENCE), "sequences"), width


def pieces(sequences: DataFrame, width: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss of every piece, from the written ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")}
            for number, body, some in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.frombuffer(body, f"<u{width}").astype("<u4")
                if len(ids) != sum(p["length"] for p in some):
                    raise ValueError(f"sequence {number} does not hold its pieces")
                for p in some:
                    for k in ("doc_id", "start", "length", "doc_tokens", "offset", "loss"):
                        rows[k].append(p[k])
                    rows["ids_crc32"].append(zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]].tobytes()))
                    rows["sequence_id"].append(number)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows))

    small_batches(sequences.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"
    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(trimmed(run), schema)


def tokenizer_text(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces(*pack(docs, tokenizer_text()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_vector_packing": op11_vector_packing}
ORACLES: dict[str, str] = {}
