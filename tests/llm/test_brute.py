"""Models and fits of the training-data operators against plain loops, and SQL where there is some."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("veldspar.llm.registry")
from veldspar.llm import langid, mixing, registry, url_filter  # noqa: E402
from veldspar.llm._text import ALNUM, word_hashes, words  # noqa: E402

MASK = (1 << 64) - 1


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 29
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 32


# Language


def brute_grams(text, bits):
    """Letter runs of 1 to 4 characters of lower-cased words, an edge (0) counting as a character."""
    points = [0] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text]
    out = Counter()
    for g in range(1, 5):
        for i in range(len(points) - g + 1):
            w = points[i : i + g]
            if any(x == 0 for x in w[1:-1]) or not (w[0] if g == 1 else w[0] or w[-1]):
                continue
            h = w[0]
            for x in w[1:]:
                h = (h * 0x10001B3 + x) & MASK
            out[mixed((h + (g << 40)) & MASK) & ((1 << bits) - 1)] += 1
    return out


def brute_em(counts, prob, allowed, steps):
    n = sum(counts.values())
    pi = [1 / len(allowed) if l in allowed else 0.0 for l in range(prob.shape[1])]
    for step in range(steps + 1):
        like = {g: sum(pi[l] * prob[g, l] for l in allowed) for g in counts}
        if step < steps:
            pi = [pi[l] * sum(k * prob[g, l] / like[g] for g, k in counts.items()) / n if l in allowed else 0.0 for l in range(prob.shape[1])]
    return pi, sum(k * math.log(like[g]) for g, k in counts.items())


def brute_language(counts, prob, steps):
    """Of the nested sets of the 1, 2, ... leading languages the one of least penalised likelihood; one language alone is the best single one."""
    L, n = prob.shape[1], sum(counts.values())
    full, _ = brute_em(counts, prob, range(L), steps)
    single = [sum(k * math.log(prob[g, l]) for g, k in counts.items()) for l in range(L)]
    best = single.index(max(single))
    out, cost = [float(l == best) for l in range(L)], -2 * single[best] + math.log(max(n, 2))
    rank = sorted(range(L), key=lambda l: (-full[l], l))
    for size in range(2, L + 1):
        pi, ll = brute_em(counts, prob, rank[:size], steps)
        now = -2 * ll + size * math.log(max(n, 2))
        if now < cost:
            out, cost = pi, now
    return out


def test_language_against_loops(spark):
    rng = random.Random(8)
    stems = {"aa": ["kata", "kolo", "taka"], "bb": ["wen", "wyn", "newy"], "cc": ["zuß", "ßuz", "Zuß"]}
    rows = [(i, " ".join(rng.choice(stems[l]) for _ in range(20)) + ".", l) for i, l in enumerate(list(stems) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df, bits=10)
    counts = {l: Counter() for l in stems}
    for _, t, l in rows:
        counts[l].update(brute_grams(t, 10))
    for k, l in enumerate(model.languages):
        want = np.array([counts[l][g] + langid.SMOOTH for g in range(1 << 10)])
        assert np.allclose(model.prob[:, k], want / want.sum())
    texts = [rows[0][1], rows[0][1] + rows[1][1], " ".join(rows[k][1] for k in range(3)), "kata 12 wen", "Zuß", "x" * 40, "", None, "..."]
    for t, (some, pi, _) in zip(texts, model.infer(pa.array(texts)), strict=True):
        got = brute_grams(t or "", 10)
        assert some == bool(got)
        if some:
            assert np.allclose(pi, brute_language(got, model.prob, langid.EM_STEPS), atol=1e-6), t


def test_language_ties_go_by_name(spark):
    """Two languages of one text: equal likelihoods, the first by name."""
    rows = [(1, "kata kolo", "bb"), (2, "kata kolo", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.train(df)).collect()
    assert {r.language.lang for r in out} == {"aa"}


# Mixture


def test_posteriors_against_loops(spark):
    rng = random.Random(4)
    stems = {"prime": ["good", "fine", "well"], "plain": ["one", "two", "day"], "toxic": ["bad", "foul", "vile"]}
    rows = [(i, " ".join(rng.choice(stems[d] + ["and", "the"]) for _ in range(15)), d) for i, d in enumerate(list(stems) * 10)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90, None), (91, "unseen words only"), (92, "good " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    model = mixing.train(docs, labels, bits=12)
    got = {r.doc_id: r for r in mixing.posteriors(docs, model).collect()}

    def feature(w):
        body = np.frombuffer(w.encode(), np.uint8)
        s, e, _ = words(body, np.array([0, len(body)]), ALNUM)
        return int(word_hashes(body, s, e)[0] >> np.uint64(52))

    held = Counter(f for _, t, _ in rows for f in {feature(w) for w in t.split()})
    for f in range(1 << 12):
        want = math.log((len(rows) + 1) / held[f]) if held[f] >= mixing.LEAST_DOCS else 0.0
        assert model.rarity[f] == pytest.approx(want)
    for i, t in [(i, t) for i, t, _ in rows] + [(90, None), (91, "unseen words only"), (92, "good")]:
        cols = sorted({feature(w) for w in (t or "").split()})
        norm = math.sqrt(sum(model.rarity[c] ** 2 for c in cols)) or 1.0
        z = [sum(model.weights[c, k] * model.rarity[c] / norm for c in cols) + model.bias[k] for k in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(got[i].posterior, [x / sum(e) for x in e], atol=1e-6), i
    assert got[92].n_tokens == 9000 and got[90].n_tokens == 0
    right = sum(mixing.DOMAINS[int(np.argmax(got[i].posterior))] == d for i, _, d in rows)
    assert right >= 0.9 * len(rows)


def test_rates_against_projections(spark):
    """The nearest rates that are not negative and meet the targets, by alternating projections (Dykstra)."""
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([2, 1, 0.3], 60), rng.integers(1, 200, 60).astype(float)
    targets = np.array([0.7, 0.28, 0.02]) * n.sum()
    table = spark.createDataFrame([(i, int(k), [float(v) for v in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    pulls, even = mixing.fit_rates(table, targets)
    got = np.array([x.rate for x in table.withColumn("rate", mixing.rate_column(pulls, even, mixing.RIDGE)).orderBy("doc_id").collect()])
    x, corr = np.full(60, even), np.zeros(60)
    A = (n[:, None] * p).T
    solve = np.linalg.inv((A / n) @ A.T)
    for _ in range(20000):
        y = x - ((A / n).T @ (solve @ (A @ x - targets)))
        x, corr = np.maximum(y + corr, 0), y + corr - np.maximum(y + corr, 0)
    assert np.abs(A @ got - targets).max() <= 1e-3 * targets.min() + 1e-6 * targets.sum()
    assert np.abs(got - x).max() < 5e-3 and (got == 0).any()


# URLs


def brute_url_features(host, path, bits):
    out = Counter()
    for s, salt in ((host, 7_000_003), (path, 11_000_027)):
        b = [1, *s.encode(), 1]
        for g in url_filter.GRAMS:
            for i in range(len(b) - g + 1):
                h = b[i] + salt
                for x in b[i + 1 : i + g]:
                    h = (h * 0x100000001B3 + x) & MASK
                out[mixed((h + g) & MASK) & ((1 << bits) - 1)] += 1
    n = sum(out.values())
    return {f: k / math.sqrt(max(n, 1)) for f, k in out.items()}


def test_url_model_against_newton(spark):
    bits, l2 = 9, 1e-2
    table = url_filter.labelled_urls(spark).where("crc32(url) % 40 = 0").toPandas()
    model = url_filter.train(spark.createDataFrame(table), bits=bits, l2=l2, steps=6000)
    parts = table.url.str.extract(r"://([^/?#]*)([^?#]*)")
    x = np.zeros((len(table), 1 << bits))
    for i, (h, q) in enumerate(zip(parts[0], parts[1], strict=True)):
        for f, v in brute_url_features(h, q, bits).items():
            x[i, f] += v
    y, n = table.label.to_numpy(float), len(table)
    full = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(full.shape[1])
    ridge = np.append(np.full(1 << bits, n * l2), 0)
    for _ in range(30):
        q = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full * (q * (1 - q))[:, None]).T @ full + np.diag(ridge + 1e-9), full.T @ (q - y) + ridge * w)
    want = 1 / (1 + np.exp(-full @ w))
    got = model.score(pa.array(parts[0]), pa.array(parts[1]))
    assert np.abs(got - want).max() < 0.01


# SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist()), key=repr) == sorted(map(tuple, want[columns].values.tolist()), key=repr)


def test_vector_blocks_cover_lists():
    """Every list has its blocks, short ones share, long ones are split; query parts follow what is asked."""
    from veldspar.llm.vector_dedup import Blocks

    stored = {0: 3, 1: 4, 2: 25, 4: 2, 7: 9, 9: 1}
    b = Blocks.deal(stored, {0: 30, 1: 1, 2: 12, 4: 0, 7: 5, 9: 50}, 44, 10)
    assert b.of == {0: (0, 1), 1: (0, 1), 2: (1, 3), 4: (4, 1), 7: (5, 1), 9: (5, 1)} and b.parts == [4, 2, 2, 2, 1, 5]
