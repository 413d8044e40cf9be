"""Vectorised words and word n-grams over Arrow batches of UTF-8 text (numpy, no per-word Python).

A batch is cut into blocks of about ``BLOCK`` bytes; a block always holds whole texts, so one
very long text makes one larger block and nothing is ever cut.  Words are byte runs of a
256-entry class table; a word's hash is a difference of prefix sums of a random-table
polynomial modulo 2**64, mixed afterwards, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Lower-case A-Z, leave all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random value of each byte after lower-casing.
VALUE = _bytes_table(20240229)[LOWER]
#: Random value of each byte as it is.
EXACT = _bytes_table(20240301)
#: The same for a second, independent hash.
VALUE2 = _bytes_table(20240307)[LOWER]
#: Odd random multipliers of the positions in a run of words, one row for each family of hashes.
_PLACES = _bytes_table(20240311).reshape(2, 128)
#: Words beyond so many bytes can be made to collide in a polynomial modulo 2**64.
LONG = 64
#: Bytes of words split at white space: all but space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of alphanumeric words: digits, letters, and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, np.uint64(base & _MASK), dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes (murmur-style avalanche), in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column (null: empty) and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    body = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with whole texts of about ``limit`` bytes."""
    body, offsets = raw(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        lo, hi = offsets[at], offsets[to]
        yield at, to, body[lo:hi], offsets[at : to + 1] - lo
        at = to


def words(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of texts into the words."""
    n = len(body)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = kind[body]
    here = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = VALUE, long: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased (or by another table of byte values).

    Words of more than ``long`` bytes (few by their length) take a digest in place of the polynomial.
    """
    up, down = _power(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(value[body] * up[: len(body)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    for w in np.flatnonzero(ends - starts > long).tolist() if long else ():
        digest = hashlib.blake2b(digest_size=8)
        for lo in range(int(starts[w]), int(ends[w]), 1 << 16):
            digest.update(value[body[lo : min(lo + (1 << 16), int(ends[w]))]])
        out[w] = int.from_bytes(digest.digest(), "little")
    return out


def gram_hashes(wh: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (len(wh) - n + 1 of them), the order of the words counting."""
    if len(wh) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(wh) - n + 1, n, np.uint64)
    for j in range(n):
        # From the second lap of the table on, words are mixed once more, so that no two places are treated alike.
        word = wh[j : j + len(out)]
        out += (word if j < _PLACES.shape[1] else mix(word + np.uint64(j))) * _PLACES[family, j % _PLACES.shape[1]]
    return mix(out)
