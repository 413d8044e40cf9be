"""Soft-membership mixing: rates of documents whose expected domain totals match targets.

1.  A classifier trained on the labelled table (at most ``max_labelled`` rows, lowest hash first; a
    bound of the training only) gives every document its posterior over the domains.
2.  Nonnegative rates r are the nearest to the even rate (by tokens) whose expected tokens of every
    domain k, sum(r * tokens * p_k), meet its target.  They are max(0, even - p . m) for K
    multipliers m, so no state is kept; m is found by Newton steps on the dual, which is convex
    and piecewise quadratic.  A pass needs K + K * K + 1 sums from all documents (a global sum over
    the narrow posterior table) and nothing else.  It ends when the optimum is reached and raises
    if it is not.  A ridge on m, moved along until it has no effect, settles targets that no rates
    can meet: the least squares of the gaps, with a warning that names them.
3.  A rate becomes whole copies: its floor, and one more with the probability of the rest, by a
    hash of the id.

Defined results: a null or empty text has no tokens, the prior as posterior and the rate of that;
labels without a document, and documents labelled twice alike, do no harm (twice differently: both
rows train); without labels all posteriors are even; repeated rows get equal rates; an empty table
gives an empty result; other columns are carried, and one that has the name of an added one is
replaced, as ``withColumn`` does.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialize, small_batches, trimmed, without
from ._text import ALNUM, blocks, word_hashes, words

BITS = 16
MAX_LABELLED = 4000
#: Labelled documents that must hold a word for it to count.
LEAST_DOCS = 5
#: Passes after which the fit is given up with an error (about 15 are needed); weight of the ridge;
#: gap allowed to a domain, relative to its own target; and to the optimum, relative to all tokens.
MOST_PASSES, RIDGE, TOLERANCE, SOLVED = 200, 1e-6, 1e-4, 1e-8

# The domains of the labelled table, and the production shares of tokens.
DOMAINS = ("prime", "plain", "toxic")
SHARES = {"prime": 0.8, "plain": 0.19, "toxic": 0.01}
#: A domain of a smaller share may lose tokens to meet its target.
BIG_SHARE = 0.1


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "prime").when(quality == 0, "plain")


def word_features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks: first row, end row, word counts, and (row, feature) of distinct words."""
    for lo, hi, body, offsets in blocks(texts):
        starts, ends, bounds = words(body, offsets, ALNUM)
        feature = (word_hashes(body, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
        n = np.diff(bounds)
        key = np.unique((np.repeat(np.arange(hi - lo), n) << bits) | feature)
        yield lo, hi, n, key >> bits, key & ((1 << bits) - 1)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression on words, each weighted by its rarity; a row's weights have norm 1."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    rarity: np.ndarray

    def values(self, n: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        v = self.rarity[col]
        return v / np.sqrt(np.maximum(np.bincount(row, v * v, minlength=n), 1e-12))[row]

    def posteriors(self, n: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        value = self.values(n, row, col)
        z = [np.bincount(row, self.weights[col, k] * value, minlength=n) for k in range(len(self.domains))]
        return softmax(np.stack(z, axis=1) + self.bias)


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, bits: int = BITS, steps: int = 400, l2: float = 2e-5) -> DomainModel:
    """Softmax regression on the presence of hashed words. ``labels``: id, domain (null: unused)."""
    known = labels.where(F.col("domain").isin(*domains) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "domain").distinct()
    picked = known.orderBy(F.xxhash64("id"), "id", "domain").limit(max_labelled)
    # At most ``max_labelled`` ids and names: bounded, so broadcast.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").where("text is not null").select("domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, row, col in word_features(b.column(1), bits):
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([col[x:y].astype("<i4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["domain", "features"])

    got = sample.mapInArrow(run, "domain string, features binary").orderBy("domain", "features").toArrow()
    K = len(domains)
    weights, bias, rarity = np.zeros((1 << bits, K)), np.zeros(K), np.zeros(1 << bits)
    if not got.num_rows:
        return DomainModel(domains, weights, bias, rarity)
    y = np.array([domains.index(d) for d in got["domain"].to_pylist()])
    parts = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["features"].to_pylist()]
    row, col, n = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts), len(y)
    # Words of hardly any labelled document tell nothing.
    count = np.bincount(col, minlength=1 << bits)
    rarity = np.where(count >= LEAST_DOCS, np.log((n + 1) / np.maximum(count, 1)), 0.0)
    value = DomainModel(domains, weights, bias, rarity).values(n, row, col)
    on = value > 0
    row, col, value = row[on], col[on], value[on]
    hot = np.eye(K)[y]
    w0, b0, lipschitz = weights, bias, 1.0
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        wy, by = weights + m * (weights - w0), bias + m * (bias - b0)
        e = softmax(np.stack([np.bincount(row, wy[col, k] * value, minlength=n) for k in range(K)], axis=1) + by) - hot
        grad = np.stack([np.bincount(col, e[row, k] * value, minlength=1 << bits) for k in range(K)], axis=1) / n + l2 * wy
        w0, b0 = weights, bias
        weights, bias = wy - grad / lipschitz, by - e.mean(0) / lipschitz
    return DomainModel(domains, weights, bias, rarity)


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text, unless it is kept) with n_tokens and posterior (array by domain). No shuffle."""
    docs = without(docs, "n_tokens", "posterior")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    prior = np.exp(model.bias - model.bias.max())
    prior = (prior / prior.sum()).tolist()
    bits = (len(model.rarity) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo, hi, n, row, col in word_features(b.column(at), bits):
                p = sent.value.posteriors(hi - lo, row, col)
                p[n == 0] = prior
                columns = [c.slice(lo, hi - lo) for k, c in enumerate(b.columns) if keep_text or k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=[*(f.name for f in rest), "n_tokens", "posterior"])

    return docs.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))


def rate_column(pulls: np.ndarray, even: float, ridge: float) -> Column:
    """The rate of a row by the multipliers of the domains, given in units of 1 / ``ridge``."""
    p = F.col("posterior")
    pull = F.lit(0.0)
    for k, g in enumerate(pulls):
        pull = pull + p[k] * F.lit(float(g) / ridge)
    return F.greatest(F.lit(0.0), F.lit(float(even)) - pull)


def fit_rates(table: DataFrame, targets: np.ndarray, ridge: float = RIDGE, tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES) -> tuple[np.ndarray, float]:
    """The multipliers that name each row's rate (see :func:`rate_column`), and the even rate.

    Every pass sends K + K * K + 1 sums over the whole table to the driver and nothing else.
    """
    K = len(targets)
    n, p, r = F.col("n_tokens"), F.col("posterior"), F.col("rate")
    total = table.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return np.zeros(K), 1.0
    even = float(targets.sum() / total)
    weight = ridge * targets.sum()

    def look(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value without the ridge, the gaps and the curvature at ``m``."""
        on = F.when(r > 0, n).otherwise(0)
        sums = [F.sum(n * r * r), *(F.sum(n * p[k] * r) for k in range(K)), *(F.sum(on * p[i] * p[j]) for i in range(K) for j in range(K))]
        got = table.withColumn("rate", rate_column(m * ridge, even, ridge)).agg(*sums).first()
        return got[0] / 2 + m @ targets, np.array(got[1 : K + 1]) - targets, np.array(got[K + 1 :]).reshape(K, K)

    m = np.zeros(K)
    (value, gap, curve), passes = look(m), 1
    centre, least = m, np.inf
    while True:
        while (np.abs(down := gap - weight * (m - centre)) > SOLVED * targets.sum()).any():
            step, part = np.linalg.solve(curve + weight * np.eye(K), down), 1.0
            now = value + weight / 2 * ((m - centre) ** 2).sum()
            while True:
                if passes >= most_passes:
                    raise RuntimeError(f"the mixing rates did not converge in {passes} passes; targets of tokens {targets.tolist()}, gaps {gap.tolist()}")
                there, passes = m + part * step, passes + 1
                found = look(there)
                if found[0] + weight / 2 * ((there - centre) ** 2).sum() <= now - 1e-4 * part * (down @ step) + 1e-12 * abs(now):
                    break
                part /= 2
            m, (value, gap, curve) = there, found
        size = float(np.abs(gap).max())
        if (np.abs(gap) <= tolerance * targets).all():
            break
        if size > least / 2:
            warnings.warn(f"no rates found that meet the targets of tokens {targets.tolist()}; gaps of the nearest {gap.tolist()}", stacklevel=2)
            break
        centre, least = m, size
    return m * ridge, even


def default_targets(table: DataFrame, shares: dict[str, float], domains: tuple[str, ...]) -> np.ndarray:
    """Token targets in the given shares, large enough that no domain of a big share need lose tokens to meet them.

    Domains of a share below ``BIG_SHARE`` are those that a mixture holds down, so they may lose tokens.
    """
    n, p = F.col("n_tokens"), F.col("posterior")
    row = table.agg(*(F.sum(n * p[k]).alias(f"s{k}") for k in range(len(domains)))).first()
    have = np.array([row[f"s{k}"] or 0.0 for k in range(len(domains))])
    share = np.array([shares[d] for d in domains])
    big = share >= BIG_SHARE
    total = (have[big] / share[big]).max() if big.any() else have.sum()
    return total * share


def _rated(table: DataFrame, shares: dict[str, float] | None, domains: tuple[str, ...]) -> DataFrame:
    pulls, even = fit_rates(table, default_targets(table, shares or SHARES, domains))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 40)) / float(1 << 40)
    rated = table.withColumn("rate", F.round(rate_column(pulls, even, RIDGE), 9))
    return rated.withColumn("copies", (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies of every row."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, domains, id_col, text_col)
    table = materialize(posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model), "posteriors")
    return _rated(table, shares, domains)


def resample(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, text_col: str = "text", domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id``), each as often as its copies; none of rate 0.

    The posteriors are written beside the rows, so the fit reads two narrow columns of that table
    and nothing is joined or shuffled.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, domains, "doc_id", text_col)
    table = materialize(posteriors(docs, model, text_col, keep_text=True), "posteriors")
    rows = _rated(table, shares, domains).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*without(docs, "n_tokens", "posterior").columns)


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mix(docs, labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_soft_mixing": op6_soft_mixing}
ORACLES: dict[str, str] = {}
