"""Language identification as mixture inference over character n-grams.

Training counts hashed letter n-grams per language over labelled documents (about
``per_language`` of each language, lowest id hash first: a bound of the training only).  A text is
a mixture of languages: expectation-maximisation estimates its proportions from the n-gram
likelihoods, and the language set is chosen by penalised likelihood: of the nested sets of its
1, 2, ... leading languages, the one with the least ``-2 log L + |set| log n``.

Words count by letters alone; a text's n-grams are those of its whole length.  The EM of all
texts of a block runs at once on flat arrays, so the cost is linear in the distinct n-grams.

Defined results: a null text or one without a letter gives ``und`` with score 0 and no
proportions; ties between languages go to the first by name; repeated rows get equal results; a
training table without labelled text gives ``und`` everywhere; an empty table gives an empty
result; other columns are carried, and one named ``language`` is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import small_batches, trimmed, without
from ._text import mix, raw

BITS = 15
PER_LANGUAGE = 2000
EM_STEPS = 12
SMOOTH = 0.5
#: Bytes of one EM block.
BLOCK = 1 << 17

_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point: its lower-case form, 0 if it is no letter."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0x10000:] = [c if chr(c).isalpha() else 0 for c in range(0x10000, 0x110000)]
        _LETTER["low"] = table
    return _LETTER["low"]


def grams(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of whole texts: (first row, end row, row of each n-gram, hashed n-gram).

    N-grams are letter runs of 1 to 4 code points, a word's edge counting as one of them.
    """
    body, offsets = raw(texts)
    n, at = len(offsets) - 1, 0
    low = _letters()
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        part = body[offsets[at] : offsets[to]]
        # Code points of the block, and where each text begins among them (UTF-8 lead bytes).
        lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        starts = lead[offsets[at : to + 1] - offsets[at]]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        letters = low[points].astype(np.uint64)
        row = np.repeat(np.arange(to - at), np.diff(starts))
        # An edge (0) before each text keeps n-grams from crossing texts.
        wide = np.zeros(len(letters) + to - at, np.uint64)
        wide[np.arange(len(letters)) + row + 1] = letters
        owner = np.repeat(np.arange(to - at), np.diff(starts) + 1)
        rows, cols = [], []
        h = wide.copy()
        for g in range(1, 5):
            if g > 1:
                if len(wide) < g:
                    break
                h = h[:-1] * np.uint64(0x10001B3) + wide[g - 1 :]
            head, tail = wide[: len(h)], wide[g - 1 :]
            keep = (head != 0) if g == 1 else (head != 0) | (tail != 0)
            for j in range(1, g - 1):
                keep &= wide[j : j + len(h)] != 0
            keep &= owner[: len(h)] == owner[g - 1 :]
            rows.append(owner[: len(h)][keep])
            cols.append((mix(h[keep] + np.uint64(g << 40)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        yield at, to, np.concatenate(rows), np.concatenate(cols)
        at = to


def counted(rows: np.ndarray, cols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, n-gram) pairs in order, with their counts."""
    key, count = np.unique((rows << bits) | cols, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count.astype(np.float64)


@dataclass(frozen=True)
class LangModel:
    """Probability of each hashed n-gram under each language."""

    languages: tuple[str, ...]
    prob: np.ndarray
    bits: int

    def infer(self, texts: pa.Array, steps: int = EM_STEPS) -> Iterator[tuple[bool, np.ndarray, float]]:
        """For each text: has it letters, the proportions of the chosen set, mean log-likelihood per n-gram."""
        L = len(self.languages)
        for lo, hi, rows, cols in grams(texts, self.bits):
            n = hi - lo
            r, c, k = counted(rows, cols, self.bits)
            total = np.bincount(r, k, minlength=n)
            first = np.searchsorted(r, np.arange(n + 1))
            some = np.flatnonzero(np.diff(first) > 0)
            pi, ll = self._select(c, k, np.diff(first)[some], total[some], steps)
            out = iter(zip(pi, ll, strict=True))
            at = set(some.tolist())
            for d in range(n):
                yield (True, *next(out)) if d in at and L else (False, np.zeros(L), 0.0)

    def _select(self, c: np.ndarray, k: np.ndarray, length: np.ndarray, size: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and mean log-likelihood of texts; ``length`` entries of ``c`` and ``k`` belong to each."""
        L = self.prob.shape[1]
        if not L or not len(length):
            return np.zeros((len(length), L)), np.zeros(len(length))
        p = [np.ascontiguousarray(self.prob[:, l])[c] for l in range(L)]
        penalty = np.log(np.maximum(size, 2.0))
        pi, ll, gap = _em(p, k, length, size, np.ones((len(length), L)), steps)
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        single = np.stack([np.add.reduceat(k * np.log(x), at) for x in p], axis=1)
        best = np.argmax(single, axis=1)
        best_pi, best_ll = np.eye(L)[best], single[np.arange(len(best)), best]
        cost = -2 * best_ll + penalty
        # No set of two or more can reach more than ll + gap, so most texts of one language end here.
        rank = np.argsort(-pi, axis=1, kind="stable")
        for left in range(2, L + 1):
            live = np.flatnonzero(-2 * (ll + gap) + left * penalty < cost)
            if not len(live):
                break
            mask = np.zeros(len(length), bool)
            mask[live] = True
            keep = np.repeat(mask, length)
            allowed = np.zeros((len(live), L))
            np.put_along_axis(allowed, rank[live, :left], 1.0, axis=1)
            new_pi, new_ll, _ = _em([x[keep] for x in p], k[keep], length[live], size[live], allowed, steps)
            now = -2 * new_ll + left * penalty[live]
            up = now < cost[live]
            best_pi[live[up]], best_ll[live[up]], cost[live[up]] = new_pi[up], new_ll[up], now[up]
        return best_pi, best_ll / size


def _em(p: list[np.ndarray], k: np.ndarray, length: np.ndarray, size: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of all texts at once, their log-likelihoods, and how much more any proportions could reach.

    The last is the duality gap: the log-likelihood is concave in the proportions, so it can
    rise by no more than size * (largest mean likelihood ratio - 1).
    """
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    pi = allowed / allowed.sum(1, keepdims=True)
    for step in range(steps + 1):
        mixed = np.zeros(len(k))
        for l, x in enumerate(p):
            mixed += x * np.repeat(pi[:, l], length)
        q = k / mixed
        ratio = np.stack([np.add.reduceat(x * q, at) for x in p], axis=1) / size[:, None]
        if step < steps:
            pi = pi * ratio
    return pi, np.add.reduceat(k * np.log(mixed), at), size * (ratio.max(1) - 1)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, bits: int = BITS) -> LangModel:
    """Count n-grams of about ``per_language`` texts of each language (all, if it has fewer; lowest id hash first).

    Each task counts what it reads into one dense vector per language; those are added up by
    block of n-grams, so what reaches the driver is the model itself.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    # A share of the hash space that holds about ``per_language`` ids of each language.
    limits = {r.lang: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * per_language // r.n) for r in counts}
    languages = tuple(sorted(limits))
    if not languages:
        return LangModel((), np.zeros((1 << bits, 0)), bits)
    wanted = F.lit(False)
    for lang, top in limits.items():
        wanted = wanted | ((F.col(lang_col) == lang) & (F.xxhash64(id_col) <= F.lit(top)))
    sample = labelled.where(wanted).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << bits))
        for b in batches:
            lang = np.array([index[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for lo, _, rows, cols in grams(b.column(0), bits):
                total += np.bincount((lang[rows + lo] << bits) | cols, minlength=total.size).reshape(total.shape)
        for i in np.flatnonzero(total.any(1)):
            cols = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), i)), pa.array(cols), pa.array(total[i, cols])], names=["l", "g", "c"])

    counts = sample.mapInArrow(trimmed(count), "l long, g long, c double").groupBy("l", "g").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros((1 << bits, len(languages)))
    table[counts["g"].to_numpy(), counts["l"].to_numpy()] = counts["c"].to_numpy()
    prob = table + SMOOTH
    return LangModel(languages, prob / prob.sum(0), bits)


def identify(df: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``language``: struct(lang, score, languages, proportions, fit). No shuffle.

    ``score`` is the proportion of the leading language of the chosen set, ``fit`` the mean
    log-likelihood of an n-gram under the mixture.  The model (2 ** bits rows of a few floats)
    is broadcast once.
    """
    small_batches(df.sparkSession)
    df = without(df, "language")
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType().add("lang", "string").add("score", "double").add("languages", T.ArrayType(T.StringType())).add("proportions", T.ArrayType(T.DoubleType())).add("fit", "double")
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64())), ("fit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = []
            for known, pi, fit in m.infer(b.column(b.schema.get_field_index(text_col))):
                if not known:
                    rows.append({"lang": "und", "score": 0.0, "languages": [], "proportions": [], "fit": None})
                    continue
                on = [i for i in np.argsort(-pi, kind="stable") if pi[i] > 1e-6]
                rows.append({"lang": m.languages[on[0]], "score": float(min(1.0, pi[on[0]])), "languages": [m.languages[i] for i in on], "proportions": [float(pi[i]) for i in on], "fit": float(fit)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow)], names=[*b.schema.names, "language"])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField("language", kind)]))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 4, is 2 (a null id is trained on)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model).drop("text")
    lang = F.col("language")
    return out.select("doc_id", held_out().alias("held_out"), lang.lang.alias("lang_pred"), lang.score.alias("score"), lang.languages.alias("languages"), lang.proportions.alias("proportions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_mixture_langid": op5_mixture_langid}
ORACLES: dict[str, str] = {}
